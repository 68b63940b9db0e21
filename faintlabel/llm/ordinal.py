"""Quality by ordinal cumulative-link regression on hashed text.

P(grade > k) = logistic(x.w - threshold_k), with one weight vector for all grades and ordered thresholds.  x marks which
hashed features a text has: its words, their shapes and prefixes, prefixes of two words or more, and how often words
repeat at once.  A feature takes part if a likelihood-ratio test on the labelled rows says that it tells grades apart; the
limit, twice the logarithm of how many features are tested, lets about one of them pass by chance.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlabel.llm.common import forget, remembered, slices, stored, text_of, with_keys, with_text
from faintlabel.session import ship_package

#: Hash places; wide, so that a rare word seldom falls on a telling one.
PLACES = 1 << 22
#: Bytes of words and features that a worker remembers, and what an entry takes besides its letters and places.
MEMORY = 80 << 20
ENTRY = 180
#: Lengths of the word prefixes that are features.
PREFIXES = (4, 5, 6, 7)
#: A feature of fewer labelled rows takes no part.
LEAST_ROWS = 5
_SHAPES = (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0")
_LOWER, _TITLE = re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+")
_PREFIX, _WORD = crc32(b"p "), crc32(b"w ")
_EDGES = re.compile(r"^\W+|\W+$")


def _place(feature: str) -> int:
    return crc32(feature.encode()) % PLACES


@lru_cache(maxsize=10_000)
def _shape_place(shape: str) -> int:
    return _place("s " + shape)


def _again(place: int) -> int:
    """Place of the feature that two different words or more have the prefix of ``place``."""
    return (place * 40_503 + 1) % PLACES


class _Words(dict):
    """Places of a word's features, as 32-bit numbers in bytes: how many are of itself and its shape, those, and then
    those of its prefixes.  With ``used``, flags of all places, only features that a model uses; empty where there are
    none.  Starts anew when ``MEMORY`` bytes are held."""

    def __init__(self, used: np.ndarray | None = None):
        super().__init__()
        self.used = None if used is None else used.tobytes()
        self.size = 0

    def __missing__(self, word: str) -> bytes:
        lower = word.lower() if word.isalpha() else _EDGES.sub("", word).lower()
        if _LOWER.fullmatch(word):
            shape = "a"
        elif _TITLE.fullmatch(word):
            shape = "Aa"
        else:
            shape = word
            for pattern, sign in _SHAPES:
                shape = pattern.sub(sign, shape)
        own = [crc32(lower.encode(), _WORD) % PLACES, _shape_place(shape)]
        starts = []
        if len(lower) > PREFIXES[0]:
            done, at = _PREFIX, 0
            for n in PREFIXES:  # each sum goes on from the one of the prefix before
                if len(lower) <= n:
                    break
                done, at = crc32(lower[at:n].encode(), done), n
                starts.append(done % PLACES)
        used = self.used
        if used is not None:
            own = [p for p in own if used[p]]
            starts = [p for p in starts if used[p] or used[(p * 40_503 + 1) % PLACES]]
        found = array("i", [len(own), *own, *starts]).tobytes() if own or starts else b""
        if len(word) <= 64:
            self.size += ENTRY + len(word) + len(found)
            if self.size > MEMORY:
                self.clear()
                self.size = 0
            self[word] = found
        return found


def words_of(model: OrdinalModel) -> _Words:
    """The words that this worker remembers for the model."""

    def make() -> _Words:
        used = np.zeros(PLACES, np.uint8)
        used[model.places] = 1
        return _Words(used)

    return remembered(("ordinal", crc32(model.places.tobytes())), make)


def features_of(text: str, words: _Words | None = None) -> np.ndarray:
    """Sorted places of the features that a whole text has; an empty text has one that says so."""
    split = text.split()
    if not split:
        return np.array([_place("empty")])
    words = remembered("ordinal", _Words) if words is None else words
    distinct = set(split)
    found: set[int] = set()
    starts: set[int] = set()
    for packed in filter(None, map(words.__getitem__, distinct)):
        n_own, *places = array("i", packed)
        found.update(places[:n_own])
        for place in places[n_own:]:
            if place in starts:
                found.add(_again(place))
            else:
                starts.add(place)
    found |= starts
    again = sum(map(eq, split, split[1:])) / len(split)
    found.add(_place(f"adjacent {int(again * 20)}"))
    if len(split) >= 20:
        found.add(_place(f"distinct {int(10 * len(distinct) / (20**0.15 * len(split) ** 0.85))}"))
    return np.array(sorted(found))


@dataclass(frozen=True)
class OrdinalModel:
    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int, rounds: int = 300, l2: float = 5e-4, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by Adam over all rows.
    Thresholds are a first one and positive steps, so they stay ordered."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    places, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, m, steps = len(rows), len(places), levels - 1
    share = np.array([(np.sum(grades <= k) + 0.5) / (n + 1) for k in range(steps)])
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(m), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1 if n else 1):
        w, theta = x[:m], np.cumsum(np.concatenate([[x[m]], np.exp(x[m + 1 :])]))
        score = np.bincount(row, w[column], n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -500, 500)))
        tail = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        slope = tail * (1 - tail)
        at = np.arange(n)
        p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-12)
        down = (slope[at, grades] - slope[at, grades + 1]) / p
        g_theta = np.array([np.sum(np.where(grades == k, slope[:, k + 1] / p, 0)) - np.sum(np.where(grades == k + 1, slope[:, k + 1] / p, 0)) for k in range(steps)]) / n
        g = np.concatenate([-np.bincount(column, down[row], m) / n + l2 * w, [-g_theta.sum()], -np.array([g_theta[k:].sum() * np.exp(x[m + k]) for k in range(1, steps)])])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        x = x - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return OrdinalModel(places, x[:m], np.cumsum(np.concatenate([[x[m]], np.exp(x[m + 1 :])])))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and grade of the labelled documents: 0 poor, 1 sound but toxic, 2 sound.  Rows with a null label are left out."""
    told = labels.select(F.col("doc_id").alias("_doc"), "quality", "toxic").where("quality is not null and toxic is not null")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return docs.select("doc_id", "text").join(told, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", grade.alias("grade"))


def ratio(seen: list[Column], total: list[int]) -> Column:
    """The largest likelihood ratio of a feature between a grade and all grades above it, from the rows with the feature per grade."""

    def h(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    def tested(a: Column, b: Column, all_a: int, all_b: int) -> Column:
        whole_a, whole_b = F.lit(all_a), F.lit(all_b)
        parts = h(a) + h(b) + h(whole_a - a) + h(whole_b - b) + h(whole_a + whole_b)
        return 2 * (parts - h(a + b) - h(whole_a + whole_b - a - b) - h(whole_a) - h(whole_b))

    found = [tested(seen[k], sum(seen[k + 2 :], seen[k + 1]), total[k], sum(total[k + 1 :])) for k in range(len(seen) - 1)]
    return F.greatest(*found) if len(found) > 1 else found[0]


def telling(marked: DataFrame, levels: int) -> np.ndarray:
    """Places of the features that tell grades apart; tasks count theirs in one array each, sums are added up by place."""
    total = {r["grade"]: r["n"] for r in marked.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per grade
    names = [f"n{k}" for k in range(levels)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((levels, PLACES), np.int32)
        for batch in batches:
            for grade, marks in zip(batch.column("grade").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                seen[grade, np.frombuffer(marks, "<i4")] += 1
        at = np.flatnonzero(seen.any(0))
        for some in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(n[some].astype(np.int64)) for n in seen)], names=["place", *names])

    parts = marked.select("grade", "marks").mapInArrow(count, "place long, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("place").agg(*[F.sum(n).alias(n) for n in names])
    enough = sum((F.col(n) for n in names[1:]), F.col(names[0])) >= LEAST_ROWS
    tested = stored(sums.where(enough).select("place", ratio([F.col(n) for n in names], [total.get(k, 0) for k in range(levels)]).alias("ratio")), "tested")
    chosen = tested.where(F.col("ratio") >= 2 * log(max(tested.count(), 2)))
    found = np.array(sorted(r["place"] for r in chosen.select("place").collect()), np.int64)  # features of the bounded sample
    forget(tested)
    return found


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, levels: int = 3) -> OrdinalModel:
    """Fits on a sample, by a hash of doc_id, of about ``max_rows`` labelled documents; one task fits it, on the features
    that ``telling`` has chosen."""
    ship_package(docs.sparkSession)
    there = labels.count()
    share = min(1.0, max_rows / max(there, 1))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = graded(docs, picked)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [features_of(t).astype("<i4").tobytes() for t in text_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(marks, pa.binary())], names=["grade", "marks"])

    marked = stored(rows.mapInArrow(features, "grade int, marks binary"), "marked")
    chosen = telling(marked, levels)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.intersect1d(np.frombuffer(m, "<i4"), chosen, assume_unique=True).astype("<i4").tobytes() for m in batch.column("marks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(marks, pa.binary())], names=["grade", "marks"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((m, g) for b in batches for m, g in zip(b.column("marks").to_pylist(), b.column("grade").to_pylist(), strict=True))
        model = fit_ordinal([np.frombuffer(m, "<i4").astype(np.int64) for m, _ in got], np.array([g for _, g in got], np.int64), levels)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((model.places, "<i8"), (model.weights, "<f8"), (model.thresholds, "<f8"))], names=["p", "w", "t"])

    found = marked.mapInArrow(only, "grade int, marks binary").repartition(1).mapInArrow(fit, "p binary, w binary, t binary").first()
    forget(marked)
    if found is None:
        return fit_ordinal([], np.zeros(0, np.int64), levels)
    return OrdinalModel(np.frombuffer(found["p"], "<i8"), np.frombuffer(found["w"], "<f8"), np.frombuffer(found["t"], "<f8"))


def score(docs: DataFrame, model: OrdinalModel, keys: list[str], least: float = 0.5, text: str = "text") -> DataFrame:
    """``keys``, expected_grade, tail (P(highest grade)) and kept (tail of ``least`` or more) for every row.

    Null texts are scored as empty ones; repeated rows are scored each; without any labelled row every document has the
    same score.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample
    given, place = with_text(docs, keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        dense = np.zeros(PLACES, np.float32)
        dense[own.places] = own.weights
        words = words_of(own)
        for batch in slices(batches):
            tails = own.tails(np.array([float(dense[features_of(t, words)].sum()) for t in text_of(batch, place)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=[*keys, "expected_grade", "tail"])

    return given.mapInArrow(run, with_keys(given, keys, "expected_grade double, tail double")).withColumn("kept", F.col("tail") >= least)
