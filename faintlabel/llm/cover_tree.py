"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are dealt into blocks by their nearest of a few pivots.  Queries of a group and data of a block are indexed
together in a task: a cover tree each, whose node pairs are visited best first and left out where the largest inner
product that the covering radii allow is under the worst k-th score of the query node.  Before that, whole pairs of
query group and block are left out by the same bound on the pivots' radii.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlabel.llm.common import slices, stored
from faintlabel.session import ship_package

PIVOTS = 64
BLOCK_ROWS = 2_048
GROUP_QUERIES = 4_096
LEAF = 64
#: Bounds are computed in floating point; they are raised by this share.
SLACK = 1e-9


@dataclass
class Node:
    """Rows ``members`` within ``radius`` of ``centre``; no children: a leaf."""

    members: np.ndarray
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node]


def build(points: np.ndarray, members: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree: a node's children have centres of the node that lie over half its radius apart, its own centre first,
    and cover their rows within that half.  Rows whose cover would hold a few of them only share leaves of the node."""
    members = np.arange(len(points)) if members is None else members
    centre = int(members[0]) if centre is None else centre
    away = np.linalg.norm(points[members] - points[centre], axis=1)
    radius = float(away.max(initial=0.0))
    node = Node(members, points[centre], radius, float(np.linalg.norm(points[centre])), [])
    if len(members) <= LEAF or radius == 0:
        return node
    rest, at, few = members, centre, []
    near = away <= radius / 2
    while True:
        taken = rest[near]
        if len(taken) < LEAF // 4:
            few.append(taken)
        else:
            node.children.append(build(points, taken, at))
        rest = rest[~near]
        if not len(rest):
            break
        at = int(rest[0])
        near = np.linalg.norm(points[rest] - points[at], axis=1) <= radius / 2
    loose = np.concatenate(few) if few else np.zeros(0, np.int64)
    for i in range(0, len(loose), LEAF):
        part = loose[i : i + LEAF]
        far = float(np.linalg.norm(points[part] - node.centre, axis=1).max())
        node.children.append(Node(part, node.centre, far, node.norm, []))
    return node


class Search:
    """Both trees, and the best k of every query so far."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, least: np.ndarray):
        self.queries, self.query_ids, self.data, self.data_ids, self.k = queries, query_ids, data, data_ids, k
        self.kth = least.copy()
        self.best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        wide = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
        self.exact = wide < 2**52
        if not self.exact:
            self.whole_queries, self.whole_data = queries.astype(np.int64), data.astype(np.int64)

    def run(self) -> None:
        if len(self.queries) and len(self.data):
            self._visit(build(self.queries), build(self.data))

    @staticmethod
    def _bound(q: Node, r: Node) -> float:
        return (float(q.centre @ r.centre) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius) * 1.0

    def _visit(self, q: Node, r: Node) -> None:
        stack = [(self._bound(q, r), q, r)]
        while stack:
            bound, q, r = stack.pop()
            if bound + SLACK * abs(bound) + SLACK * (q.norm + q.radius) * (r.norm + r.radius) < self.kth[q.members].min():
                continue
            if not q.children and not r.children:
                self._meet(q.members, r.members)
            elif q.children and (not r.children or q.radius > r.radius):
                stack += sorted(((self._bound(c, r), c, r) for c in q.children), key=lambda x: x[0])
            else:
                stack += sorted(((self._bound(q, c), q, c) for c in r.children), key=lambda x: x[0])

    def _meet(self, q: np.ndarray, r: np.ndarray) -> None:
        if self.exact:
            scores = self.queries[q] @ self.data[r].T
        else:
            scores = (self.whole_queries[q] @ self.whole_data[r].T).astype(np.float64)
        scores = np.where(self.query_ids[q][:, None] == self.data_ids[r][None, :], -np.inf, scores)
        for i in np.flatnonzero((scores >= self.kth[q][:, None]).any(1)):
            own = int(q[i])
            chosen = np.flatnonzero((scores[i] >= self.kth[own]) & (scores[i] > -np.inf))
            if self.exact:
                found = [(-int(s), int(d)) for s, d in zip(scores[i][chosen], self.data_ids[r[chosen]], strict=True)]
            else:
                found = [(-int(s), int(d)) for s, d in zip(self.whole_data[r[chosen]] @ self.whole_queries[own], self.data_ids[r[chosen]], strict=True)]
            self.best[own] = sorted(self.best[own] + found)[: self.k]
            if len(self.best[own]) == self.k:
                self.kth[own] = max(self.kth[own], float(-self.best[own][-1][0]))


def whole_vectors(table: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """id and v = floor(factor * x) of each component; rows whose id or vector is null, or with a null or non-finite component, are left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), scaled.alias("v"))


def _with_pivots(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim, pivot (place among those of the dimension), its distance and the norm; v becomes bytes."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows = [np.array(v, np.int64) for v in batch.column("v").to_pylist()]
            pivot, away, norm = [], [], []
            for v in rows:
                centres = pivots.get(len(v), np.zeros((1, len(v))))
                far = np.linalg.norm(centres - v, axis=1)
                pivot.append(int(far.argmin()))
                away.append(float(far.min()))
                norm.append(float(np.linalg.norm(v)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([v.tobytes() for v in rows], pa.binary()), pa.array([len(v) for v in rows], pa.int32()), pa.array(pivot, pa.int32()), pa.array(away, pa.float64()), pa.array(norm, pa.float64())],
                names=["id", "v", "dim", "pivot", "away", "norm"],
            )

    return vectors.mapInArrow(run, "id long, v binary, dim int, pivot int, away double, norm double")


def _dealt(points: DataFrame, size: int, name: str) -> DataFrame:
    """Adds a group of about ``size`` rows: neighbouring pivots share one, a pivot with more rows has several."""
    counts = stored(points.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n")), "counts")  # at most PIVOTS rows a dimension
    before = Window.partitionBy("dim").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    first = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size)
    parts = counts.select("dim", "pivot", first.cast("int").alias("_first"), F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("int").alias("_parts"))
    return points.join(parts, ["dim", "pivot"]).withColumn(name, F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_first", "_parts")


def _searched(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score: each query's best k in each block that its group is paired with."""

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        q = np.frombuffer(b"".join(left.column("v").to_pylist()), np.int64).reshape(-1, dim).astype(float)
        r = np.frombuffer(b"".join(right.column("v").to_pylist()), np.int64).reshape(-1, dim).astype(float)
        ids, data_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = Search(q, ids, r, data_ids, k, left.column("least").to_numpy())
        found.run()
        rows = [(int(i), d, -s) for i, best in zip(ids, found.best, strict=True) for s, d in best]
        return pa.table({n: pa.array([x[j] for x in rows], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    left = queries.join(pairs, ["dim", "group"]).select("dim", "group", "block", "id", "v", "least")
    right = data.join(pairs, ["dim", "block"]).select("dim", "group", "block", "id", "v")
    both = left.groupBy("dim", "group", "block").cogroup(right.groupBy("dim", "group", "block"))
    return both.applyInArrow(search, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, factor: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the queries, the rows for which ``is_query`` (on ``id``) holds: the k largest inner products of each query with all rows but its own.

    Components are floor(factor * x).  Ties go to the smaller id; fewer than k others give fewer rows; rows with a null
    id, or a vector that is null, empty or holds null or non-finite components take no part; vectors meet those of their
    own length; rows that repeat an id with the same vector count once; an empty table gives an empty result.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, key, vector, factor).distinct()
    sample = vectors.orderBy(F.xxhash64("id")).limit(PIVOTS).collect()
    pivots = {d: np.array([r["v"] for r in sample if len(r["v"]) == d], float) for d in {len(r["v"]) for r in sample}}
    points = stored(_with_pivots(vectors, pivots), "points")
    data = stored(_dealt(points, BLOCK_ROWS, "block"), "data")
    asked = stored(_dealt(points.where(is_query), GROUP_QUERIES, "group"), "asked")

    blocks = data.groupBy("dim", "block", "pivot").agg(F.max("away").alias("_r"), F.max("norm").alias("_n"))
    groups = asked.groupBy("dim", "group", "pivot").agg(F.max("away").alias("_q"))
    # a row for each group and block of the same pivot
    own = stored(groups.join(blocks, ["dim", "pivot"]).select("dim", "group", "block").distinct(), "own")
    none = F.lit(float("-inf"))
    first = stored(_best(_searched(asked.withColumn("least", none), data, own, k), k), "first")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("_kth"))
    bounded = stored(asked.join(kth, "id", "left").withColumn("least", F.coalesce("_kth", none)).drop("_kth"), "bounded")

    dots = [(d, i, j, float(p[i] @ p[j]), float(np.linalg.norm(p[i])), float(np.linalg.norm(p[j]))) for d, p in pivots.items() for i in range(len(p)) for j in range(len(p))]
    centre = F.broadcast(spark.createDataFrame(dots, "dim int, _a int, _b int, _dot double, _na double, _nb double"))  # PIVOTS squared rows
    worst = bounded.groupBy("dim", "group", "pivot").agg(F.max("away").alias("_q"), F.min("least").alias("_worst"))
    # the stated queries against all rows, in blocks: a row for each query group's pivot and each block's pivot
    met = worst.withColumnRenamed("pivot", "_a").join(blocks.withColumnRenamed("pivot", "_b"), "dim").join(centre, ["dim", "_a", "_b"], "left")
    top = F.col("_dot") + F.col("_q") * F.col("_nb") + F.col("_r") * F.col("_na") + F.col("_q") * F.col("_r")
    pairs = met.where(F.col("_dot").isNull() | (top + F.abs(top) * SLACK + 1 >= F.col("_worst"))).select("dim", "group", "block").distinct()
    pairs = stored(pairs.join(own, ["dim", "group", "block"], "left_anti"), "pairs")
    more = _searched(bounded, data, pairs, k)
    return _best(first.select("query_id", "vec_id", "score").unionAll(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
