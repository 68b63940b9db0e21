"""Pairwise contingency: how often two features show two given non-zero values in the same row, per class.

One pass over the rows counts all pairs of features.  Tasks multiply blocks of indicator columns where rows are full, and
list the pairs of a row's stored entries where they are sparse; both give the same cells.  Zero values are never counted:
their cells are the marginals minus the rest, so a joint entropy sum

    S_xz = A_x + A_z + e + f(N - N_x - N_z + M)     f(n) = n log2 n,  A_x = sum of f over the non-zero values of x

needs per pair only M, the rows where both are non-zero, and e, what the pair's own cells change; a pair that never
meets has neither.  From there on everything is as large as the number of features squared, not as the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlabel.functions.scalar import xlog2x
from faintlabel.learning.batches import SparseBlock, feature_blocks
from faintlabel.operators.features import ROW_MARK, FeatureSet
from faintlabel.session import settled, ship_package

#: Cells a task holds before it adds them up, and after that before it hands them on.
MOST_CELLS = 1_000_000
#: Columns of a block of indicators that is multiplied at a time.
BLOCK = 512
#: Rows fuller than this are multiplied, sparser ones listed.
FULL = 1 / 64
#: Pairs of entries listed at a time.
PAIRS_AT_A_TIME = 2_000_000


class _Cells:
    """Counts of (group, code, code, class) of one task; a code stands for a feature and one of its non-zero values."""

    def __init__(self, classes: int):
        self.classes = classes
        self.codes: dict[tuple[int, float], int] = {}
        self.groups: dict[object, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def code_of(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.array([self.codes.setdefault(k, len(self.codes)) for k in zip(feature.tolist(), value.tolist(), strict=True)], np.int64)

    def add(self, group: object, a: np.ndarray, b: np.ndarray, kind: np.ndarray, n: np.ndarray) -> None:
        g = self.groups.setdefault(group, len(self.groups))
        self.held.append((np.stack([np.full(len(a), g), a, b, kind]), n))
        self.size += len(a)
        if self.size > MOST_CELLS:
            self._add_up()

    def _add_up(self) -> None:
        where = np.concatenate([k for k, _ in self.held], axis=1)
        n = np.concatenate([n for _, n in self.held])
        order = np.lexsort(where[::-1])
        where, n = where[:, order], n[order]
        first = np.concatenate(([True], (where[:, 1:] != where[:, :-1]).any(axis=0)))
        self.held = [(where[:, first], np.add.reduceat(n, np.flatnonzero(first)))]
        self.size = int(first.sum())

    def take(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(group number, code, code, class, n), each cell once; the cells are gone then."""
        if self.held:
            self._add_up()
            where, n = self.held[0]
            yield (*where, n)
        self.held, self.size = [], 0


def _full_pairs(x: np.ndarray, kind: np.ndarray, classes: int, out: _Cells, group: object, left: np.ndarray | None, right: np.ndarray | None) -> None:
    """Cells of dense rows by products of indicator blocks."""
    feature, value = [], []
    for j in range(x.shape[1]):
        own = np.unique(x[:, j])
        own = own[own != 0]
        feature += [j] * len(own)
        value += own.tolist()
    feature, value = np.array(feature, np.int64), np.array(value, float)
    codes = out.code_of(feature, value)
    for a in range(0, len(codes), BLOCK):
        fa = feature[a : a + BLOCK]
        mine = (x[:, fa] == value[a : a + BLOCK]).astype(np.float32)
        for b in range(a, len(codes), BLOCK):
            fb = feature[b : b + BLOCK]
            wanted = (fa[:, None] < fb[None, :]) | ((fa[:, None] == fb[None, :]) & (value[a : a + BLOCK][:, None] == value[b : b + BLOCK][None, :]))
            if left is not None:
                across = (left[fa][:, None] & right[fb][None, :]) | (right[fa][:, None] & left[fb][None, :])
                wanted &= across | (fa[:, None] == fb[None, :])
            theirs = mine if a == b else (x[:, fb] == value[b : b + BLOCK]).astype(np.float32)
            for k in range(classes):
                rows = kind == k
                met = np.rint(mine[rows].T @ theirs[rows]).astype(np.int64)
                i, j = np.nonzero((met > 0) & wanted)
                out.add(group, codes[a + i], codes[b + j], np.full(len(i), k), met[i, j])


def _listed_pairs(block: SparseBlock, kind: np.ndarray, classes: int, out: _Cells, group: object, left: np.ndarray | None, right: np.ndarray | None) -> None:
    """Cells of sparse rows by listing the pairs of each row's entries."""
    there = (block.value != 0) & (kind[block.row] >= 0)
    if left is not None:
        there &= left[block.col] | right[block.col]
    row, col, value = block.row[there], block.col[there], block.value[there]
    order = np.lexsort((col, row))
    row, col, value = row[order], col[order], value[order]
    if not len(row):
        return
    both = np.stack([col.astype(float), value])
    seen, inverse = np.unique(both, axis=1, return_inverse=True)
    codes = out.code_of(seen[0].astype(np.int64), seen[1])[inverse.ravel()]
    ends = np.searchsorted(row, row, "right")
    counts = ends - np.arange(len(row))
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), PAIRS_AT_A_TIME)) + at)
        own = counts[at:stop]
        first = np.repeat(np.arange(at, stop), own)
        second = first + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        if left is not None:
            ca, cb = col[first], col[second]
            wanted = (left[ca] & right[cb]) | (right[ca] & left[cb]) | (first == second)
            first, second = first[wanted], second[wanted]
        out.add(group, codes[first], codes[second], kind[row[first]], np.ones(len(first), np.int64))
        at = stop


def pair_cells(
    df: DataFrame, features: FeatureSet, labels: list[float], label: str = "label", group: str | None = None,
    left: Sequence[int] | None = None, right: Sequence[int] | None = None,
) -> DataFrame:
    """(group, a, u, b, v, n0, n1, ...): rows per class in which feature a is u and feature b is v, both not zero, a <= b.

    A feature with itself gives its marginals, and ``ROW_MARK`` with itself the rows.  With ``left`` and ``right`` only
    pairs of a feature of the one with a feature of the other are counted.  Rows of other classes and of a null label
    do not take part.  One scan.
    """
    ship_package(df.sparkSession)
    keys = [group] if group else []
    size, classes = features.size, len(labels)
    if left is not None and features.is_wide:  # the scan reads the asked columns alone
        asked = sorted({*left, *right})
        features, numbers = FeatureSet.wide([features.columns[i] for i in asked]), np.array([*asked, ROW_MARK])
        left, right = [asked.index(i) for i in left], [asked.index(i) for i in right]
        size = features.size
    else:
        numbers = None
    known = np.array(sorted(labels), float)
    place = np.array([labels.index(y) for y in known.tolist()])

    def sides() -> tuple[np.ndarray | None, np.ndarray | None]:
        if left is None:
            return None, None
        masks = np.zeros((2, size), bool)
        masks[0, list(left)] = True
        masks[1, list(right)] = True
        return masks[0], masks[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Cells(classes)
        one, other = sides()
        mark = out.code_of(np.array([ROW_MARK]), np.array([1.0]))
        for batch in batches:
            y = batch.column(label).cast(pa.float64()).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, np.nan_to_num(y, nan=np.inf)), classes - 1)
            kind = np.where(known[at] == y, place[at], -1)
            names = np.array(batch.column(group).to_pylist(), object) if group else np.full(batch.num_rows, None, object)
            for rows, block in feature_blocks(batch, features):
                for g in set(names[rows].tolist()):
                    mine = np.where(names[rows] == g, kind[rows], -1) if group else kind[rows]
                    n = np.bincount(mine[mine >= 0], minlength=classes)
                    out.add(g, np.repeat(mark, classes), np.repeat(mark, classes), np.arange(classes), n)
                    if isinstance(block, SparseBlock) and block.value.size < FULL * block.n * size:
                        _listed_pairs(block, mine, classes, out, g, one, other)
                    else:
                        _multiplied(block, mine, classes, out, g, one, other)
                if out.size > MOST_CELLS // 2:
                    yield from told(out)
        yield from told(out)

    def told(out: _Cells) -> Iterator[pa.RecordBatch]:
        features_of = np.array([f for f, _ in out.codes], np.int32)
        values_of = np.array([v for _, v in out.codes], float)
        if numbers is not None:
            features_of = numbers[features_of].astype(np.int32)  # the mark, -1, is the last
        groups = list(out.groups)
        for g, a, b, kind, n in out.take():
            some = n > 0
            g, a, b, kind, n = g[some], a[some], b[some], kind[some], n[some]
            own = [pa.array([groups[i] for i in g.tolist()], key_type)] if group else []
            columns = [*own, *(pa.array(c) for c in (features_of[a], values_of[a], features_of[b], values_of[b], kind.astype(np.int32), n))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "a", "u", "b", "v", "kind", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(df.schema[group].dataType) if group else None
    schema = "a int, u double, b int, v double, kind int, n long"
    if group:
        schema = f"`{group}` {df.schema[group].dataType.simpleString()}, {schema}"
    own = list(dict.fromkeys([*keys, label, *features.inputs]))
    cells = df.select(*own).mapInArrow(run, schema)
    return cells.groupBy(*keys, "a", "u", "b", "v").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)])


def _multiplied(block, kind: np.ndarray, classes: int, out: _Cells, group: object, left, right) -> None:
    """Dense rows as they are, fuller sparse rows laid out, without the columns that nobody asks for."""
    rows = kind >= 0
    if isinstance(block, SparseBlock):
        x = np.zeros((block.n, block.size))
        x[block.row, block.col] = block.value
    else:
        x = block.x
    x = x[rows]
    if left is not None:
        asked = left | right
        x = np.where(asked, x, 0.0)
    _full_pairs(x, kind[rows], classes, out, group, left, right)


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def pair_sums(cells: DataFrame, marginals: DataFrame, classes: int, group: str | None = None) -> DataFrame:
    """(group, a, b, e, ey, m0, m1, ...) per pair that meets: what its cells change in S_xz and S_xzy, and the rows per class
    in which both are non-zero."""
    keys = [group] if group else []
    ns = [f"n{k}" for k in range(classes)]
    n = [F.col(c) for c in ns]
    zero = [F.lit(0).cast("long").alias(f"m{k}") for k in range(classes)]
    met = cells.where(F.col("a") < F.col("b"))
    own = met.select(*keys, "a", "b", xlog2x(_total(n)).alias("e"), _total([xlog2x(c) for c in n]).alias("ey"), *[c.alias(f"m{k}") for k, c in enumerate(n)])

    def side(x: str, value: str, other: str) -> DataFrame:
        return met.select(*keys, F.col(x).alias("f"), F.col(value).alias("w"), F.col(other).alias("o"), *ns)

    rest = side("a", "u", "b").unionAll(side("b", "v", "a")).groupBy(*keys, "f", "w", "o").agg(*[F.sum(c).alias(c) for c in ns])
    whole = marginals.select(*keys, F.col("a").alias("f"), F.col("u").alias("w"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(ns)])
    t = [F.col(f"t{k}") for k in range(classes)]
    left = [x - y for x, y in zip(t, n, strict=True)]
    changed = rest.join(whole, [*keys, "f", "w"]).select(
        *keys, F.least("f", "o").alias("a"), F.greatest("f", "o").alias("b"),
        (xlog2x(_total(left)) - xlog2x(_total(t))).alias("e"),
        (_total([xlog2x(c) for c in left]) - _total([xlog2x(c) for c in t])).alias("ey"), *zero,
    )
    return own.unionAll(changed).groupBy(*keys, "a", "b").agg(F.sum("e").alias("e"), F.sum("ey").alias("ey"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(classes)])


def _f(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n * np.log2(np.maximum(n, 1)), 0.0)


@dataclass
class Marginals:
    """Per feature: entropy sums over its non-zero values and rows per class where it is not zero; rows per class."""

    a: np.ndarray
    ay: np.ndarray
    there: np.ndarray  # D x classes
    rows: np.ndarray  # classes

    @staticmethod
    def of(size: int, classes: int) -> Marginals:
        return Marginals(np.zeros(size), np.zeros(size), np.zeros((size, classes), np.int64), np.zeros(classes, np.int64))

    def add(self, row, classes: int) -> None:
        n = np.array([row[f"n{k}"] for k in range(classes)], np.int64)
        if row["a"] == ROW_MARK:
            self.rows += n
        else:
            self.a[row["a"]] += _f(n.sum())
            self.ay[row["a"]] += _f(n).sum()
            self.there[row["a"]] += n

    @property
    def n(self) -> int:
        return int(self.rows.sum())

    def sums(self) -> tuple[np.ndarray, np.ndarray, float]:
        """S_x, S_xy and S_y."""
        zero = self.rows - self.there
        return self.a + _f(zero.sum(1)), self.ay + _f(zero).sum(1), float(_f(self.rows).sum())

    def relevance(self) -> np.ndarray:
        s_x, s_xy, s_y = self.sums()
        return np.maximum(math.log2(self.n) + (s_xy - s_x - s_y) / self.n, 0.0)

    def redundancy(self, x: np.ndarray, z: np.ndarray, e: np.ndarray, ey: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """I(X;Z) and I(X;Z|Y) of pairs; ``met``: pairs x classes, and 0 where a pair never meets."""
        zero = self.rows - self.there[x] - self.there[z] + met
        s_xz = self.a[x] + self.a[z] + e + _f(zero.sum(-1))
        s_xzy = self.ay[x] + self.ay[z] + ey + _f(zero).sum(-1)
        s_x, s_xy, s_y = self.sums()
        mi = math.log2(self.n) + (s_xz - s_x[x] - s_x[z]) / self.n
        cmi = (s_xzy - s_xy[x] - s_xy[z] + s_y) / self.n
        return np.maximum(mi, 0.0), np.maximum(cmi, 0.0)


def marginals_of(cells: DataFrame, size: int, classes: int, group: str | None = None) -> dict[object, Marginals]:
    """Per group, on the driver: groups x features x values numbers."""
    out: dict[object, Marginals] = {}
    for r in cells.where(F.col("a") == F.col("b")).collect():
        out.setdefault(r[group] if group else None, Marginals.of(size, classes)).add(r, classes)
    return {g: m for g, m in out.items() if m.n}


class PairTable:
    """Redundancies of all pairs of features, per group, from one pass over the rows."""

    def __init__(self, df: DataFrame, features: FeatureSet, labels: list[float], label: str = "label", group: str | None = None):
        size, classes = features.size, len(labels)
        cells = settled(pair_cells(df, features, labels, label, group))
        self.marginals = marginals_of(cells, size, classes, group)
        sums = pair_sums(cells, cells.where((F.col("a") == F.col("b")) & (F.col("a") != ROW_MARK)), classes, group)
        self.mi = {g: np.zeros((size, size)) for g in self.marginals}
        self.cmi = {g: np.zeros((size, size)) for g in self.marginals}
        found = sums.toPandas()
        for g, m in self.marginals.items():
            part = found[found[group] == g] if group else found
            e, ey, met = np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size, classes), np.int64)
            a, b = part["a"].to_numpy(), part["b"].to_numpy()
            for x, y in ((a, b), (b, a)):
                e[x, y], ey[x, y] = part["e"], part["ey"]
                met[x, y] = part[[f"m{k}" for k in range(classes)]].to_numpy()
            own = np.arange(size)
            e[own, own], ey[own, own], met[own, own] = -m.a, -m.ay, m.there
            x, z = np.indices((size, size))
            self.mi[g], self.cmi[g] = m.redundancy(x, z, e, ey, met)
