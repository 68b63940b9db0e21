"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, posteriors decide.

A text's signals are counted in one pass.  Rules turn signals into votes (1 good, -1 bad, 0 abstain); the EM runs on the
counts of vote patterns, of which there are at most 3 to the number of rules however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlabel.llm.common import slices, stored, text_of, with_keys, with_text
from faintlabel.session import ship_package

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: One odd multiplier per place in a window.
PLACES = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Distinct words grow with a power of the words; in 20 words all may differ, which the scale makes 1 of.
VOCABULARY_POWER = 0.85
VOCABULARY_SCALE = 20**0.15

SIGNALS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_adjacent n_upper n_letters n_bangs n_tail_symbols n_ends"
).split()


def signals_of(text: str) -> tuple[int, ...]:
    """The counts named in SIGNALS, of one whole text; words end at the six ASCII blanks only."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n)
    repeat = 0
    if n > WINDOW:
        marks = np.zeros(n - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            marks += ids[j : n - WINDOW + 1 + j] * PLACES[j]
        _, inverse, counts = np.unique(marks, return_inverse=True, return_counts=True)
        if len(counts) < len(marks):
            starts = np.flatnonzero(counts[inverse] > 1)
            cover = np.bincount(starts, minlength=n + 1) - np.bincount(starts + WINDOW, minlength=n + 1)
            repeat = int((np.cumsum(cover) > 0).sum())
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    letters = np.frombuffer(raw, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    lower = int(((letters >= 97) & (letters <= 122)).sum())
    return (
        n,
        len(text) - sum(text.count(c) for c in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        len(numbers),
        int((ids[1:] == ids[:-1]).sum()),
        upper,
        upper + lower,
        text.count("!"),
        sum(w[-1] in b"#*$%&|<>" for w in words),
        sum(w[-1] in b".!?" for w in words),
    )


def signals(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the signals of every document's whole text (null: no words); ``text`` may be a field of a key."""
    ship_package(docs.sparkSession)
    given, place = with_text(docs, keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [signals_of(t) for t in text_of(batch, place)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(SIGNALS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *columns], names=[*keys, *SIGNALS])

    return given.mapInArrow(run, with_keys(given, keys, ", ".join(f"{s} long" for s in SIGNALS)))


def share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Bad above ``bad``, good below ``good``, silent between and where too little text is there to tell."""

    name: str
    value: Column
    good: float
    bad: float
    enough: Column | None = None

    def vote(self) -> Column:
        told = F.when(self.value > self.bad, F.lit(-1)).when(self.value < self.good, F.lit(1)).otherwise(F.lit(0))
        return told if self.enough is None else F.when(self.enough, told).otherwise(F.lit(0))


def rules() -> list[Rule]:
    """The rules in use; each junk kind they look for is seen by two of them at least."""
    some = F.col("n_words") >= 20
    return [
        Rule("symbols", share("n_symbols"), 0.02, 0.1, some),
        Rule("symbol_words", share("n_tail_symbols"), 0.02, 0.1, some),
        Rule("capitals", share("n_upper", "n_letters"), 0.2, 0.5, F.col("n_letters") >= 40),
        Rule("exclamations", share("n_bangs"), 0.05, 0.2, some),
        Rule("adjacent", share("n_adjacent"), 0.04, 0.1, some),
        Rule("windows", share("n_repeat_words"), 0.1, 0.3, some),
        Rule("lines", share("n_dup_lines", "n_lines"), 0.34, 0.5, F.col("n_lines") >= 4),
        Rule("vocabulary", F.lit(1) - F.col("n_distinct") / F.pow(F.greatest(F.col("n_words"), F.lit(1)), VOCABULARY_POWER) / VOCABULARY_SCALE, 0.5, 0.85, some),
        Rule("word_length", share("word_chars"), 8.0, 14.0, some),
    ]


@dataclass(frozen=True)
class LabelModel:
    """What EM has found: the share of good documents and, per rule, how it votes on good and on bad ones."""

    good_share: float
    good_votes_bad: np.ndarray
    bad_votes_bad: np.ndarray
    rounds: int

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes; a silent rule says nothing."""
        said_bad, said_good = votes < 0, votes > 0
        log_good = np.log(self.good_share) + said_bad @ np.log(self.good_votes_bad) + said_good @ np.log1p(-self.good_votes_bad)
        log_bad = np.log1p(-self.good_share) + said_bad @ np.log(self.bad_votes_bad) + said_good @ np.log1p(-self.bad_votes_bad)
        return 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, prior_share: float = 0.9, prior_weight: float = 0.01) -> LabelModel:
    """EM over vote patterns.  Starts from 'bad if any rule says bad'.  The prior's weight is a share of the rows, so that
    the model behaves alike at every size: a rule rarely calls a good document bad, and sees about a third of the bad ones."""
    total = max(1.0, float(counts.sum()))
    weight = prior_weight * total
    said_bad, said_good = (votes < 0).astype(float), (votes > 0).astype(float)
    good = np.where(said_bad.any(1), 0.02, 0.98) if len(votes) else np.zeros(0)
    model, step = None, 0
    for step in range(1, rounds + 1):
        g, b = good * counts, (1 - good) * counts
        share_good = (g.sum() + weight * prior_share) / (total + weight)
        good_bad = (g @ said_bad + weight * 0.01) / (g @ (said_bad + said_good) + weight)
        bad_bad = (b @ said_bad + weight * 0.35) / (b @ (said_bad + said_good) + weight)
        model = LabelModel(float(np.clip(share_good, 1e-6, 1 - 1e-6)), np.clip(good_bad, 1e-6, 1 - 1e-6), np.clip(bad_bad, 1e-6, 1 - 1e-6), step)
        after = model.posterior(votes)
        moved = np.abs(after - good).max(initial=0.0)
        good = after
        if moved < 1e-6:
            break
    return model


def judge(docs: DataFrame, keys: list[str], threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``keys``, signals, ``base_failed``, ``posterior`` (of good quality) and ``kept`` of every document.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows.  kept: not base_failed and a
    posterior of ``threshold`` or more.  Null and empty texts have no words and fail the base; repeated rows are judged
    each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    used = rules()
    votes = F.concat_ws(",", *[r.vote().cast("string") for r in used])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    told = stored(signals(docs, keys, text).withColumn("base_failed", base).withColumn("_votes", votes), "signals")
    patterns = told.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    grid = np.array([[int(x) for x in r["_votes"].split(",")] for r in patterns], float).reshape(-1, len(used))
    model = fit_votes(grid, np.array([r["n"] for r in patterns], float))
    rows = [(r["_votes"], float(p)) for r, p in zip(patterns, model.posterior(grid), strict=True)]
    posterior = F.broadcast(spark.createDataFrame(rows, "_votes string, posterior double"))
    return told.join(posterior, "_votes").drop("_votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
