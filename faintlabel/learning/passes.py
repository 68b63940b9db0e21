"""One pass over a table for many fits at once.

``sum_over_rows`` runs a numpy reducer on the Arrow batches of each partition and adds up the small arrays it returns.
A sweep hands all its open fits to the same pass: the table is read once per step, not once per fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faintlabel.session import ship_package

# Bytes of partial results the driver may receive in one pass, and bytes one task may hold as its partial.
DRIVER_BYTES = 64 << 20
TASK_BYTES = 32 << 20
# Numbers per working array inside a task.
BATCH_CELLS = 1_000_000


def _emit(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        cell = pa.array([total.astype("<f8").tobytes()], type=pa.binary())
        yield pa.RecordBatch.from_arrays([cell], names=["partial"])


_tasks: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def _task_count(df: DataFrame) -> int:
    """Number of partitions, looked up once per table since solvers pass over the same one again and again."""
    if df not in _tasks:
        _tasks[df] = df.rdd.getNumPartitions()
    return _tasks[df]


def _add_partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for cell in batch.column(0):
            part = np.frombuffer(cell.as_py(), dtype="<f8")
            total = part.copy() if total is None else total + part
    return _emit(total)


def sum_over_rows(
    df: DataFrame, reducer: Callable[[pa.RecordBatch], np.ndarray], length: int, cells_per_row: int = 1
) -> np.ndarray:
    """Sum of ``reducer(batch)`` (flat arrays of ``length`` doubles) over all batches of the table.

    ``cells_per_row`` is how many working numbers a row needs per array; large batches are cut to keep them bounded.

    Each task sends one array.  While all of them fit in ``DRIVER_BYTES`` they go straight to the driver (one job);
    beyond that, rounds of merge tasks add them up in groups of at most the driver's fan-in first.
    """
    if length * 8 > TASK_BYTES:
        raise ValueError(f"a partial result of {length * 8} bytes is over the task limit; split the fits")

    ship_package(df.sparkSession)
    step = max(64, BATCH_CELLS // max(1, cells_per_row))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = reducer(batch.slice(start, step))
                total = part if total is None else total + part
        return _emit(total)

    parts = df.mapInArrow(partials, "partial binary")
    fan_in = max(2, DRIVER_BYTES // (length * 8))
    tasks = _task_count(df)
    while tasks > fan_in:
        groups = max(1, -(-tasks // min(fan_in, 64)))
        parts = parts.repartition(groups).mapInArrow(_add_partials, "partial binary")
        tasks = groups
    total = np.zeros(length)
    for row in parts.collect():
        total += np.frombuffer(row["partial"], dtype="<f8")
    return total
