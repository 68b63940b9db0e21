"""Arrow record batches as numeric blocks, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from faintlabel.operators.features import FeatureSet

DENSE_CELLS = 4_000_000


class DenseBlock:
    """n rows x D dense values."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n = x.shape[0]

    def take(self, rows: np.ndarray) -> DenseBlock:
        """The rows that a mask or their numbers name."""
        return DenseBlock(self.x[rows] if rows.dtype == bool else self.x.take(rows, axis=0))

    def slices(self, step: int) -> Iterator[tuple[int, DenseBlock]]:
        """(first row, rows) of at most ``step`` rows each."""
        for a in range(0, self.n, step):
            yield a, DenseBlock(self.x[a : a + step])

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Margins n x K for K weight rows."""
        return self.x @ w.T

    def pull(self, c: np.ndarray) -> np.ndarray:
        """K x D sums of rows weighted by the n x K coefficients."""
        return c.T @ self.x

    def weighted(self, n: np.ndarray) -> DenseBlock:
        """The rows times n coefficients."""
        return DenseBlock(self.x * n[:, None])

    def weighted_square(self, c: np.ndarray) -> np.ndarray:
        """D x D sum of the rows' outer products, weighted by n coefficients."""
        return self.x.T @ (self.x * c[:, None])


class SparseBlock:
    """n rows as stored entries; costs the number of entries, whatever D is."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, size: int):
        self.row, self.col, self.value, self.n, self.size = row, col, value, n, size

    def take(self, rows: np.ndarray) -> SparseBlock:
        chosen = np.arange(self.n)[rows]
        place = np.full(self.n, -1)
        place[chosen] = np.arange(len(chosen))
        kept = place[self.row] >= 0
        return SparseBlock(place[self.row[kept]], self.col[kept], self.value[kept], len(chosen), self.size)

    def slices(self, step: int) -> Iterator[tuple[int, SparseBlock]]:
        """All rows at once: a slice would cost a look at every entry."""
        yield 0, self

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.column_stack(
            [np.bincount(self.row, weights=self.value * wk[self.col], minlength=self.n) for wk in w]
        )

    def pull(self, c: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.bincount(self.col, weights=self.value * c[self.row, k], minlength=self.size) for k in range(c.shape[1])]
        )

    def weighted(self, n: np.ndarray) -> SparseBlock:
        return SparseBlock(self.row, self.col, self.value * n[self.row], self.n, self.size)

    def weighted_square(self, c: np.ndarray) -> np.ndarray:
        """From the pairs of each row's entries."""
        out = np.zeros(self.size * self.size)
        order = np.argsort(self.row, kind="stable")
        row, col, value = self.row[order], self.col[order], self.value[order]
        first, last = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
        for shift in range(int((last - first).max(initial=0))):
            at = np.flatnonzero(first + shift < last)
            other = first[at] + shift
            out += np.bincount(col[at] * self.size + col[other], weights=c[row[at]] * value[at] * value[other], minlength=self.size * self.size)
        return out.reshape(self.size, self.size)


def _floats(a: pa.Array) -> np.ndarray:
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def feature_blocks(batch: pa.RecordBatch, features: FeatureSet):
    """Yield (row slice, block) for the feature columns of a record batch."""
    if features.is_wide:
        x = np.column_stack([_floats(batch.column(c)) for c in features.columns])
        yield slice(0, batch.num_rows), DenseBlock(x)
        return
    column = batch.column(features.packed)
    if features.is_entries:
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        col = column.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
        value = _floats(batch.column(features.values).flatten())
        if col.size and not 0 <= col.min() <= col.max() < features.size:
            raise ValueError(f"indices must be from 0 to {features.size - 1}")
        row = np.repeat(np.arange(batch.num_rows), lengths)
        yield slice(0, batch.num_rows), SparseBlock(row, col, value, batch.num_rows, features.size)
        return
    if pa.types.is_struct(column.type):
        yield from _vector_blocks(column, features.size)
        return
    flat = _floats(column.flatten())
    if flat.size != batch.num_rows * features.size:
        raise ValueError(f"rows must have {features.size} features")
    yield slice(0, batch.num_rows), DenseBlock(flat.reshape(batch.num_rows, features.size))


def _vector_blocks(column: pa.StructArray, size: int):
    kind = column.field("type").to_numpy(zero_copy_only=False)
    values = column.field("values")
    lengths = np.diff(values.offsets.to_numpy())
    if kind.size and (kind == 1).all():
        yield slice(0, len(column)), DenseBlock(_floats(values.flatten()).reshape(-1, size))
        return
    flat = _floats(values.flatten())
    col = np.empty(flat.size, dtype=np.int64)
    ends = np.cumsum(lengths)
    for i, k in enumerate(kind):
        a, b = ends[i] - lengths[i], ends[i]
        col[a:b] = column.field("indices")[i].values.to_numpy() if k == 0 else np.arange(size)
    row = np.repeat(np.arange(len(column)), lengths)
    yield slice(0, len(column)), SparseBlock(row, col, flat, len(column), size)


def nullable(a: pa.Array) -> np.ndarray:
    """Doubles with NaN for NULL."""
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)
