"""Rows with equal features, added up.

Tables of whole-number features repeat the same feature values many times.  A pass needs the margin and its functions once
per distinct feature row; how often it trains or tests a fit follows from counts per combination of label, fold and bag
values ("cells"), of which a sweep has few.  Counts are whole numbers, so nothing is lost; only the order of sums differs.

For many passes these rows are ``packed`` once more: rows of one combination of labels lie together, thousands to a row of the
table, so a pass moves a few arrays and not every row, and finds all rows of a block on the same side of every fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintlabel.learning.batches import DenseBlock, SparseBlock, feature_blocks, nullable
from faintlabel.operators.features import FeatureSet
from faintlabel.session import held, ship_package

CELL, COUNT = "_cells", "_counts"
SEGMENT, VALUES, ROW = "_segment", "_values", "_row"
BLOCK = f"{SEGMENT} int, {VALUES} binary, {ROW} binary, {CELL} binary, {COUNT} binary"
#: Feature rows of a task of a packed table, at most and (for small tables) at least.
MOST_ROWS, FEWEST_ROWS = 1_000_000, 2_000
#: Feature rows that cost as much time as a block does by itself.
BLOCK_COST = 1_000
#: Counts that a part holds at most.
PART_CELLS = 1_000_000
#: Combinations of label, fold and bag values up to which rows are added up; a task holds a count of each per row at hand.
MOST_CELLS = 4_096
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Cells:
    """The combinations that occur: a row of ``values`` each, NaN for NULL."""

    names: tuple[str, ...]
    values: np.ndarray
    wrong: frozenset[str] = frozenset()  # columns with values that are not numbers

    def __len__(self) -> int:
        return len(self.values)

    def columns(self) -> dict[str, np.ndarray]:
        return {c: self.values[:, j] for j, c in enumerate(self.names)}


@dataclass(frozen=True)
class Part:
    """Feature rows of a batch, and where they belong: ``columns`` hold a value per row, or per cell if there are ``counts``
    (rows x cells).  ``present`` are the numbers of these cells."""

    block: DenseBlock | SparseBlock
    columns: dict[str, np.ndarray]
    counts: np.ndarray | None = None
    present: np.ndarray | None = None

    def weights(self, mask: np.ndarray) -> np.ndarray:
        """rows x M: how many table rows of each feature row a mask (rows or cells x M) holds."""
        return mask.astype(float) if self.counts is None else self.counts @ mask.astype(float)

    def totals(self, masks: Sequence[np.ndarray]) -> np.ndarray:
        """masks x M: how many table rows each mask holds."""
        held = None if self.counts is None else np.ones(len(self.counts)) @ self.counts
        return np.stack([m.sum(0).astype(float) if held is None else held @ m.astype(float) for m in masks])

    def rows(self) -> np.ndarray:
        """Table rows of each feature row."""
        return np.ones(self.block.n) if self.counts is None else self.counts.sum(1)


def parts(batch: pa.RecordBatch, features: FeatureSet, names: Sequence[str], cells: Cells | None) -> Iterator[Part]:
    if cells is None:
        columns = {c: nullable(batch.column(c)) for c in names}
        for rows, block in feature_blocks(batch, features):
            yield Part(block, {c: v[rows] for c, v in columns.items()})
        return
    if VALUES in batch.schema.names:
        yield from _unpacked(batch, features.size, cells)
        return
    for _, block in feature_blocks(batch, features):  # wide features: one block
        lengths = batch.column(CELL).value_lengths().to_numpy(zero_copy_only=False)
        cell = batch.column(CELL).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = batch.column(COUNT).flatten().to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(block.n) * len(cells), lengths) + cell
        counts = np.bincount(place, weights=n, minlength=block.n * len(cells)).reshape(block.n, len(cells))
        yield Part(block, cells.columns(), counts, np.arange(len(cells)))


def repeats(df: DataFrame, features: FeatureSet) -> bool:
    """Whether equal feature rows are to be expected: named columns of whole numbers."""
    return features.is_wide and all(isinstance(df.schema[c].dataType, WHOLE) for c in features.columns)


def _key(names: Sequence[str]) -> Column:
    """One key, however many label columns."""
    return F.array(*[F.col(c).cast("double") for c in names]).alias("_key")


def _combinations(df: DataFrame, features: FeatureSet, names: Sequence[str]) -> list | None:
    """The combinations of ``names`` that occur, NULLs as they are; None where features are not whole numbers or the
    combinations too many."""
    if not names or not repeats(df, features):
        return None
    found = [r["_key"] for r in df.select(_key(names)).distinct().limit(MOST_CELLS + 1).collect()]
    return found if len(found) <= MOST_CELLS else None


def _cells(names: Sequence[str], found: list) -> Cells:
    values = np.array([[np.nan if v is None else float(v) for v in r] for r in found], dtype=float).reshape(len(found), len(names))
    wrong = frozenset(c for j, c in enumerate(names) if any(r[j] is not None and r[j] != r[j] for r in found))
    return Cells(tuple(names), values, wrong)


def _tally(df: DataFrame, features: FeatureSet, names: Sequence[str], found: list, segment: list[int]) -> DataFrame:
    """Features, segment, cell and count: the rows of each distinct feature row in each cell.

    Only the cell's number is shuffled, and map-side combine comes first, so a feature row or cell that fills a third of the
    table is one row a task.
    """
    keyed = [(i, segment[i], k) for i, k in enumerate(found)]
    keyed = F.broadcast(df.sparkSession.createDataFrame(keyed, f"_cell int, {SEGMENT} int, _key array<double>"))  # MOST_CELLS rows
    groups = [*features.columns, SEGMENT, "_cell"]
    return df.select(*features.columns, _key(names)).join(keyed, "_key").groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))


def _listed(entries: DataFrame, features: FeatureSet) -> DataFrame:
    """A row per distinct feature row with its cells and their counts."""
    listed = entries.groupBy(*features.columns).agg(F.collect_list(F.struct("_cell", "_n")).alias("_l"))
    return listed.select(*features.columns, F.col("_l._cell").alias(CELL), F.col("_l._n").alias(COUNT))


@contextmanager
def counted(df: DataFrame, features: FeatureSet, names: Sequence[str]) -> Iterator[tuple[DataFrame, Cells | None]]:
    """One row per distinct feature row with its cells and their counts, and the cells of the columns ``names``.

    Yields the table as it is, and no cells, where features are not whole numbers or the combinations too many.
    """
    names = list(names)
    found = _combinations(df, features, names)
    if found is None:
        yield df, None
        return
    listed = _listed(_tally(df, features, names, found, [0] * len(found)), features)
    with held(listed, "auto", "repeats") as rows:
        yield rows, _cells(names, found)


@contextmanager
def blocked(
    df: DataFrame, features: FeatureSet, names: Sequence[str], labels: Sequence[str]
) -> Iterator[tuple[DataFrame, Cells | None, DataFrame]]:
    """The table and cells of ``counted`` and its rows ``packed`` in blocks.  Only the blocks are written for many passes: the
    table is lazy.  The table as it is, and no cells, as there."""
    names = list(names)
    found = _combinations(df, features, names)
    if not found:
        yield df, None, df
        return
    cells = _cells(names, found)
    segment, cost = _segments(cells, labels)
    with held(_tally(df, features, names, found, segment), "auto", "cells", False) as entries, _laid(entries, features, cost) as blocks:
        yield _listed(entries, features), cells, blocks


def _bytes(a: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them, led by its name; doubles where some are missing."""
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        limit = np.iinfo(kind)
        if a.size and np.isnan(a).any():
            break
        if not a.size or (a.min() >= limit.min and a.max() <= limit.max):
            return kind.encode() + a.astype(kind).tobytes()
    return b"<f8" + a.astype("<f8").tobytes()


def _numbers(cell: pa.Scalar) -> np.ndarray:
    data = cell.as_py()
    return np.frombuffer(data, data[:3].decode(), offset=3)


def _block_rows(batch: pa.RecordBatch, features: FeatureSet) -> Iterator[tuple]:
    """A row per run of equal segments in a sorted batch; neighbours with equal features become one feature row."""
    segment, cell, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (SEGMENT, "_cell", "_n"))
    x = next(feature_blocks(batch, features))[1].x
    first = np.ones(len(segment), dtype=bool)
    first[1:] = (segment[1:] != segment[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1), len(segment)]
    for a, b in zip(cuts, cuts[1:]):
        own = first[a:b]
        row = None if own.all() else _bytes(np.cumsum(own) - 1)
        yield int(segment[a]), _bytes(x[a:b][own].ravel()), row, _bytes(cell[a:b]), _bytes(n[a:b])


def _unpacked(batch: pa.RecordBatch, size: int, cells: Cells) -> Iterator[Part]:
    for values, row, cell, n in zip(*(batch.column(c) for c in (VALUES, ROW, CELL, COUNT))):
        x = _numbers(values).astype(float).reshape(-1, size)
        cell, n = _numbers(cell), _numbers(n)
        row = _numbers(row).astype(np.int64) if row.is_valid else np.arange(len(x))
        there = np.bincount(cell, minlength=len(cells)) > 0
        present, place = np.flatnonzero(there), (np.cumsum(there) - 1)[cell]
        columns = {c: v[present] for c, v in cells.columns().items()}
        step = max(1, PART_CELLS // len(present))
        for a in range(0, len(x), step):
            some = slice(*np.searchsorted(row, (a, a + step)))
            rows = min(step, len(x) - a)
            counts = np.bincount((row[some] - a) * len(present) + place[some], weights=n[some], minlength=rows * len(present))
            yield Part(DenseBlock(x[a : a + rows]), columns, counts.reshape(rows, -1), present)


def _segments(cells: Cells, labels: Sequence[str]) -> tuple[list[int], list[int]]:
    """A number per cell, the same for those with equal ``labels``, and per number one more than the labels that are there."""
    known: dict[tuple, int] = {}
    values = np.column_stack([cells.columns()[c] for c in labels])
    segment = [known.setdefault(tuple("" if v != v else v for v in r), len(known)) for r in values.tolist()]
    return segment, [1 + sum(v != "" for v in r) for r in known]


def _shares(sizes: dict[int, int], cost: list[int], tasks: int) -> list[list[int]]:
    """For each segment the tasks that take equal shares of its rows, so that all tasks cost about the same."""
    most = max(1, sum(n * cost[s] for s, n in sizes.items()) // (2 * tasks))
    pieces = []
    for s, n in sizes.items():
        parts = min(tasks, -(-n * cost[s] // most))
        pieces += [((n / parts + BLOCK_COST) * cost[s], s)] * parts
    load = [(0.0, t) for t in range(tasks)]
    out: list[list[int]] = [[] for _ in cost]
    for price, s in sorted(pieces, reverse=True):
        spent, t = heappop(load)
        out[s].append(t)
        heappush(load, (spent + price, t))
    return [own or [0] for own in out]


@contextmanager
def packed(table: DataFrame, features: FeatureSet, cells: Cells | None, labels: Sequence[str]) -> Iterator[DataFrame]:
    """The rows of a ``counted`` table in blocks, those with equal ``labels`` together; the table itself without cells."""
    if cells is None or not len(cells):
        yield table
        return
    segment, cost = _segments(cells, labels)
    segments = F.broadcast(table.sparkSession.createDataFrame(list(enumerate(segment)), f"_cell int, {SEGMENT} int"))  # at most MOST_CELLS rows
    entries = (
        table.select(*features.columns, F.explode(F.arrays_zip(F.col(CELL).alias("_cell"), F.col(COUNT).alias("_n"))).alias("_e"))
        .select(*features.columns, "_e.*")
        .join(segments, "_cell")
    )
    with _laid(entries, features, cost) as blocks:
        yield blocks


@contextmanager
def _laid(entries: DataFrame, features: FeatureSet, cost: list[int]) -> Iterator[DataFrame]:
    """Entries (features, segment, cell, count) in blocks; ``cost`` is what a row of each segment costs."""
    spark = entries.sparkSession
    ship_package(spark)
    sizes = {r[SEGMENT]: r["count"] for r in entries.groupBy(SEGMENT).count().collect()}  # at most MOST_CELLS rows
    rows, cores = sum(sizes.values()), spark.sparkContext.defaultParallelism
    tasks = min(cores * -(-rows // (cores * MOST_ROWS)), -(-rows // FEWEST_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), *[pa.binary()] * 4)
        for batch in batches:
            if batch.num_rows:
                columns = zip(*_block_rows(batch, features))
                arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[SEGMENT, VALUES, ROW, CELL, COUNT])

    order = [SEGMENT, *features.columns]
    shares = _shares(sizes, cost, max(1, tasks))
    tasks_of = F.array(*[F.array(*[F.lit(t) for t in own]) for own in shares])
    own = F.get(tasks_of, F.col(SEGMENT))
    task = F.get(own, F.pmod(F.xxhash64(*features.columns), F.size(own)).cast("int"))
    laid = entries.repartitionById(max(1, tasks), task).sortWithinPartitions(*order)
    with held(laid.mapInArrow(pack, BLOCK), "auto", "blocks") as blocks:
        yield blocks
