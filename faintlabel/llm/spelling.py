"""Spelling variants of a corpus vocabulary by reduced-alphabet generation.

Letters are hashed to a few symbols, which makes a word's full one-edit neighbourhood small enough to write down: some
17 keys a letter instead of over 120.  Two words one edit apart have reduced words that are equal or one edit apart, so
joining the neighbourhoods with the reduced vocabulary finds every pair; the candidates are then verified on the words
themselves.

Counting: tasks add up the words of their texts in a bounded dictionary before anything is shuffled, so a word that fills
a third of the corpus is one row a task.  From there on there is one row per word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlabel.llm.common import slices, stored
from faintlabel.session import ship_package

#: Words after A-Z were lower-cased.
WORD = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task adds up before it hands them on.
MOST_HELD = 200_000
SYMBOLS = 8
#: Letters by falling frequency, dealt to the symbols to and fro, so that no symbol takes much more than its share.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
BASE = 0x9E3779B97F4A7C15
#: Neighbourhood keys made at a time.
KEYS_AT_A_TIME = 1 << 20


def lowered(text: str) -> str:
    """The text with A-Z alone in lower case."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def word_counts(docs: DataFrame, least_letters: int = 6, alter: Callable[[Counter, object], None] | None = None) -> DataFrame:
    """word and n of all words of ``docs`` (doc_id, text) with ``least_letters`` code points or more.

    ``alter(counts, doc_id)`` may change a text's words before they are counted.  Null and empty texts have no words.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = Counter(WORD.findall(lowered(text or "")))
                if alter is not None:
                    alter(found, doc_id)
                for word, n in found.items():
                    held[word] += n
            if len(held) > MOST_HELD:
                yield from told(held)
                held.clear()
        yield from told(held)

    def told(held: Counter) -> Iterator[pa.RecordBatch]:
        long = [w for w in held if len(w) >= least_letters]
        for at in range(0, len(long), 8192):
            part = long[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbol_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint64) % np.uint64(SYMBOLS)
    for i, letter in enumerate(BY_FREQUENCY):
        turn, place = divmod(i, SYMBOLS)
        table[ord(letter)] = SYMBOLS - 1 - place if turn % 2 else place
    return table + np.uint64(1)


def reduced(words: list[str], table: np.ndarray) -> np.ndarray:
    """Symbols, from 1, of words of one length: a row per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return table[codes].reshape(len(words), -1)


def keys_of(symbols: np.ndarray, edits: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its keys) of reduced words of one length: polynomial hashes of the words themselves, or with ``edits`` the
    distinct ones of their full one-edit neighbourhoods, themselves included."""
    length = symbols.shape[1]
    power = np.ones(length + 1, np.uint64)
    power[1:] = BASE
    power = np.multiply.accumulate(power)
    back = np.uint64(pow(BASE, -1, 1 << 64))
    letters = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    step = max(1, KEYS_AT_A_TIME // ((2 * SYMBOLS + 1) * (length + 1)))
    for at in range(0, len(symbols), step):
        part = symbols[at : at + step]
        n = len(part)
        before = np.zeros((n, length + 1), np.uint64)
        np.cumsum(part * power[:-1], axis=1, out=before[:, 1:])
        whole = before[:, -1:]
        if not edits:
            yield from ((at + i, whole[i]) for i in range(n))
            continue
        replaced = whole[:, :, None] + (letters - part[:, :, None]) * power[:-1, None]
        dropped = before[:, :-1] + (whole - before[:, 1:]) * back
        grown = (before + (whole - before) * np.uint64(BASE))[:, :, None] + letters * power[:, None]
        every = np.concatenate([replaced.reshape(n, -1), dropped, grown.reshape(n, -1)], axis=1)
        every.sort(axis=1)
        first = np.ones(every.shape, bool)
        first[:, 1:] = every[:, 1:] != every[:, :-1]
        yield from ((at + i, every[i][first[i]]) for i in range(n))


def reduced_keys(words: DataFrame, edits: bool) -> DataFrame:
    """key, id and size (code points) of words (word, id): one row per word, or with ``edits`` one per key of its neighbourhood."""
    ship_package(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _symbol_table()
        for batch in slices(batches, 4096):
            texts, ids = batch.column("word").to_pylist(), batch.column("id").to_pylist()
            lengths: dict[int, list[int]] = {}
            for i, word in enumerate(texts):
                lengths.setdefault(len(word), []).append(i)
            for length, rows in lengths.items():
                held: list[np.ndarray] = []
                owners: list[int] = []
                for i, keys in keys_of(reduced([texts[r] for r in rows], table), edits):
                    held.append(keys)
                    owners.append(ids[rows[i]])
                    if len(held) * len(keys) > KEYS_AT_A_TIME // 4:
                        yield told(held, owners, length)
                        held, owners = [], []
                if held:
                    yield told(held, owners, length)

    def told(held: list[np.ndarray], owners: list[int], length: int) -> pa.RecordBatch:
        keys = np.concatenate(held).view(np.int64)
        own = np.repeat(np.array(owners, np.int64), [len(k) for k in held])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), pa.array(np.full(len(keys), length, np.int32))], names=["key", "id", "size"])

    return words.select("word", "id").mapInArrow(run, "key long, id long, size int")


def near_words(words: DataFrame) -> DataFrame:
    """word, near and near_n: for each word of ``words`` (word, n; a word once) all words that differ from it by exactly one
    inserted, deleted or replaced code point."""
    own = stored(words.select("word", "n", F.xxhash64("word").alias("id")), "words")
    hood = reduced_keys(own, True)
    there = reduced_keys(own, False).select("key", F.col("id").alias("near_id"), F.col("size").alias("near_size"))
    # a word's keys are distinct, so each pair of words meets once
    pairs = hood.join(there, "key").where((F.col("id") != F.col("near_id")) & (F.abs(F.col("size") - F.col("near_size")) <= 1)).select("id", "near_id")
    left = own.select("id", "word")
    right = own.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.join(left, "id").join(right, "near_id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of words (word, n; a word once).

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times the
    word's own, else null; root: where the forms lead, the word itself without one.  An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms of less than twice the count could lead round in circles")
    words = stored(words, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b"))
    fits = -F.col("_b.m") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("_b.near")).alias("form"),
        F.when(fits, -F.col("_b.m")).alias("form_n"),
    )
    told = stored(told, "forms")
    span = told.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()  # one row
    # each step multiplies n by ratio at least, which bounds the steps; every round doubles how far a word has gone
    steps = 0 if span["least"] is None else int(math.log(span["most"] / max(1, span["least"]), ratio) + 1e-9)
    gone = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        gone = stored(gone, "roots")
        further = gone.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        gone = gone.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return told.join(gone, "word", "left").withColumn("root", F.coalesce("root", "word"))


def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5, alter: Callable[[Counter, object], None] | None = None) -> DataFrame:
    """word and n of the words of all whole texts that occur ``least_count`` times or more."""
    return word_counts(docs, least_letters, alter).where(F.col("n") >= least_count)
