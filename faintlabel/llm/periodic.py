"""Runs of repeated word sequences within a text, by maximal pairs from an LCP-interval tree.

A run of period q is a maximal pair: the text from its start and the text from q words later agree for length - q words,
the words before differ and so do the words after.  The tree's intervals are gone through from the deepest up.  Each
keeps its positions in order and knows each position's left-word class; where two intervals of common prefix l join,
neighbouring positions of different classes at a distance that l allows are maximal pairs, and as such whole runs: nothing
is extended.  The smaller list goes into the larger.  Only neighbours count: were there an occurrence between the two
positions of a run, its period would not be the smallest.

Words whose prefix of the least common length occurs once in a text cannot be in such a pair; the suffixes of the others,
parted by walls, are sorted by doubling for many texts at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlabel.llm.common import slices, with_keys
from faintlabel.session import ship_package

#: Bytes of text whose suffixes are sorted together; one longer text is taken alone.
BYTES_AT_A_TIME = 1 << 21
#: One odd multiplier per place of a prefix.
PLACES = np.random.default_rng(13).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Run = tuple[int, int, int]


def shortest_overlap(least: int, exponent: int) -> int:
    """The fewest words that the two places of a run have in common: its length less its period."""
    return max(1, min(max(least, exponent * q) - q for q in range(1, least + 2)))


def _prefixes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words from each place on; equal prefixes have equal hashes."""
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out += words[j : len(words) - size + 1 + j] * PLACES[j % 64]
        out ^= out >> np.uint64(29)
    return out


def repeated_places(words: np.ndarray, text_of: np.ndarray, size: int) -> np.ndarray:
    """Places whose prefix of ``size`` words may occur again in the same text (all that do, and rarely another)."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    marks = _prefixes(words.astype(np.uint64), size) + text_of[: len(words) - size + 1].astype(np.uint64) * PLACES[63]
    inside = np.flatnonzero(text_of[: len(words) - size + 1] == text_of[size - 1 :])
    order = np.argsort(marks[inside], kind="stable")
    in_order = marks[inside][order]
    same = in_order[1:] == in_order[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.sort(inside[order[twice]])


def suffix_order(words: np.ndarray, text_of: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their suffixes, and how many words each has in common with the next (0 for the last)."""
    starts = np.flatnonzero(np.concatenate(([True], np.diff(places) > 1)))
    counts = np.diff(np.concatenate((starts, [len(places)])))
    # stretches of neighbouring places with the words of the last one's prefix, each followed by a wall of its own
    spans = counts + size
    ends = np.cumsum(spans)
    source = np.arange(ends[-1]) - np.repeat(ends - spans, spans) + np.repeat(places[starts], spans)
    wall = ends - 1
    source[wall] = 0
    symbols = text_of[source].astype(np.int64) * (int(words.max()) + 1) + words[source]
    symbols[wall] = np.iinfo(np.int64).max - np.arange(len(wall))
    levels = []
    n = len(symbols)
    ranks = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        levels.append(ranks.astype(np.int32))
        if int(ranks.max()) == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[:-step] = ranks[step:] + 1  # behind a wall; never looked at
        ranks = np.unique(ranks * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    own = np.ones(n, bool)
    tails = (wall[:, None] - np.arange(size)).ravel()
    own[tails] = False
    there = np.flatnonzero(own)
    there = there[np.argsort(ranks[there])]
    a, b = there[:-1], there[1:]
    shared = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        known = levels[level]
        x, y = a + shared, b + shared
        shared += np.where(known[x] == known[y], 1 << level, 0)
    return source[there], np.concatenate((shared, [0]))


def _joined(larger: list[int], smaller: list[int], shared: int, words: list[int], first: set[int], least: int, exponent: int, found: dict[tuple[int, int], int]) -> list[int]:
    """Both lists of positions in one; what neighbours of different left-word classes they bring together goes to ``found``."""
    if len(larger) < len(smaller):
        larger, smaller = smaller, larger
    reach, closest = shared // (exponent - 1), least - shared
    for x in smaller:
        k = bisect_left(larger, x)
        for other in larger[max(0, k - 1) : k + 1]:
            distance = abs(other - x)
            if closest <= distance <= reach:
                start, again = (x, other) if x < other else (other, x)
                if start in first or words[start - 1] != words[again - 1]:
                    span = (start, again + shared)
                    # lists are joined two by two, so a neighbour may be a multiple of the period away
                    found[span] = min(distance, found.get(span, distance))
    if larger[-1] < smaller[0]:
        larger += smaller
    elif len(smaller) == 1:
        larger.insert(bisect_left(larger, smaller[0]), smaller[0])
    else:
        larger += smaller
        larger.sort()
    return larger


def runs_of(texts: list[list[bytes]], least: int, exponent: int) -> list[list[Run]]:
    """(start, length, period) of each text's runs by start, then period: ``least`` words and ``exponent`` periods or more."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat = [numbers[w] for t in texts for w in t]
    out: list[list[Run]] = [[] for _ in texts]
    if not flat:
        return out
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    words, text_of = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), sizes)
    size = shortest_overlap(least, exponent)
    places = repeated_places(words, text_of, size)
    if not len(places):
        return out
    order, shared = suffix_order(words, text_of, places, size)
    first = set(begins.tolist())
    found: dict[tuple[int, int], int] = {}
    lists: list[list[int]] = []
    links: list[int] = []
    for place, link in zip(order.tolist(), shared.tolist(), strict=True):
        own = [place]
        while links and links[-1] >= link:
            own = _joined(lists.pop(), own, links.pop(), flat, first, least, exponent, found)
        if link >= size:
            lists.append(own)
            links.append(link)
    for (start, end), period in found.items():
        text = int(np.searchsorted(begins, start, "right")) - 1
        out[text].append((start - int(begins[text]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by single spaces, without those that a run repeats after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BYTES_AT_A_TIME:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def find_runs(docs: DataFrame, keys: list[str], least: int = 6, exponent: int = 4) -> DataFrame:
    """``keys``, n_words, runs (array of start, length, period; words from 0, by start, then period) and collapsed (the text
    with each run cut to its first period) of every row's whole text.

    Words are parted by the six ASCII blanks.  Null and empty texts have no words and an empty collapsed text; repeated
    rows are told each, texts of any length are taken whole, and columns besides keys and text are not read.
    """
    if least < 1 or exponent < 2:
        raise ValueError("a run repeats its period once at least")
    ship_package(docs.sparkSession)
    schema = with_keys(docs, keys, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            for a, b in _portions(texts):
                words = [t.encode().split() for t in texts[a:b]]
                runs = runs_of(words, least, exponent)
                short = [collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
                told = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.array([len(w) for w in words], pa.int64()), pa.array(told, kind), pa.array(short, pa.string())],
                    names=[*keys, "n_words", "runs", "collapsed"],
                )

    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(run, schema)
