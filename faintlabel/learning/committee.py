"""Committees of binary linear models (Naive Bayes, SVM, logistic): vote, expert sum, and evaluation in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlabel.learning.batches import feature_blocks, nullable
from faintlabel.learning.models import BLOCK_BYTES, LinearModel, committee_columns, expert_prediction, stack, vote_prediction
from faintlabel.learning.passes import BATCH_CELLS, TASK_BYTES, sum_over_rows
from faintlabel.learning.repeats import Cells, parts
from faintlabel.operators.features import FeatureSet
from faintlabel.operators.metrics import areas_hard, auprc_of_counts, hard_counts


class Committee:
    """Models that predict together.  Members trained on their own feature subset have weight 0 elsewhere."""

    def __init__(self, models: Sequence[LinearModel]):
        self.models = tuple(models)
        self.weights, self.intercepts = stack(models)

    def __len__(self) -> int:
        return len(self.weights)

    def score(self, df: DataFrame, features: FeatureSet) -> DataFrame:
        """Rows with ``votes``, ``n_members``, ``certainty``, ``vote`` and ``expert``."""
        scored = committee_columns(df, features, self.weights, self.intercepts)
        return scored.withColumns({"vote": vote_prediction(), "expert": expert_prediction()})

    def voted_auprc(self, df: DataFrame, features: FeatureSet, **options) -> DataFrame:
        return areas_hard(self.score(df, features), prediction="vote", **options)

    def expert_auprc(self, df: DataFrame, features: FeatureSet, debug_path: str | None = None, **options) -> DataFrame:
        """Area of the expert prediction.  With one member, ``debug_path`` also stores its two prediction lists."""
        scored = self.score(df, features)
        if debug_path is not None and len(self) == 1:
            scored.select("expert", "label").write.mode("overwrite").csv(f"{debug_path}/expert")
            scored.select("vote", "label").write.mode("overwrite").csv(f"{debug_path}/member")
        return areas_hard(scored, prediction="expert", **options)

    def average_auprc(self, df: DataFrame, features: FeatureSet, curve_start: str = "spark") -> DataFrame:
        """Mean over the members of each member's own area; all members are counted in one pass."""
        scorers = [Scorer(str(i), m) for i, m in enumerate(self.models)]
        c = hard_counts(prediction_counts(df, features, scorers), ["name"], weight="n")
        area = auprc_of_counts(F.col("tp"), F.col("n_pred"), F.col("pos"), F.col("n"), curve_start)
        return c.agg(F.avg(area).alias("average_auprc"))

    def areas(self, df: DataFrame, features: FeatureSet, curve_start: str = "spark") -> DataFrame:
        """(rule, auprc, auroc) of the vote and of the expert sum, counted in one pass."""
        counts = committee_counts(df, features, [CommitteeTest("all", self.models)])
        return areas_hard(counts.withColumnRenamed("n", "w"), ["rule"], curve_start, weight="w")


@dataclass(frozen=True)
class Scorer:
    """A model and the rows it is tested on: all, or one fold.  ``label`` may name a variant column (NULL = not in)."""

    name: str
    model: LinearModel
    label: str = "label"
    fold_col: str | None = None
    fold: int | None = None
    cut: float = 0.0  # margin above which a row is positive


# Cells of the count table: predicted 0/1, observed 0/1/other, truth 0/1/-1/missing.
LABEL_CELLS, TRUTH_CELLS = 3, 4
CELLS = 2 * LABEL_CELLS * TRUTH_CELLS


def prediction_counts(
    df: DataFrame, features: FeatureSet, scorers: Sequence[Scorer], truth: str | None = None, cells: Cells | None = None
) -> DataFrame:
    """(name, prediction, label, real_label, n): what every model predicts on its test rows, counted in one pass.

    All hard-label metrics follow from these few rows.  With ``cells`` over a table of ``counted`` rows.
    """
    names = sorted({c for s in scorers for c in (s.label, s.fold_col) if c} | ({truth} if truth else set()))
    rows = df if cells is not None else df.select(*dict.fromkeys([*names, *features.inputs]))
    step = max(1, TASK_BYTES // (8 * max(CELLS, features.size)))
    out = []
    for at in range(0, len(scorers), step):
        part = list(scorers[at : at + step])
        w, b = stack([s.model for s in part])
        cut = np.array([s.cut for s in part])

        def reducer(batch: pa.RecordBatch, part=part, w=w, b=b, cut=cut) -> np.ndarray:
            acc = np.zeros((len(part), CELLS))
            for rows in parts(batch, features, names, cells):
                local = rows.columns
                if rows.counts is None:
                    above = rows.block.dot(w) + b > cut
                else:
                    every, positive = rows.counts.sum(0), np.zeros((rows.counts.shape[1], len(part)))
                    for first, some in rows.block.slices(max(1, BATCH_CELLS // len(part))):
                        positive += rows.counts[first : first + some.n].T @ (some.dot(w) + b > cut)
                n = rows.block.n if rows.counts is None else len(every)
                t = local[truth] if truth else np.full(n, np.nan)
                real = np.where(t == 0, 0, np.where(t == 1, 1, np.where(np.isnan(t), 3, 2)))
                for k, s in enumerate(part):
                    y = local[s.label]
                    inside = ~np.isnan(y)
                    if s.fold_col is not None and s.fold is not None:
                        inside &= local[s.fold_col] == s.fold
                    cell = np.where(y == 0, 0, np.where(y == 1, 1, 2)) * TRUTH_CELLS + real
                    if rows.counts is None:
                        cell = cell + above[:, k] * (LABEL_CELLS * TRUTH_CELLS)
                        acc[k] += np.bincount(cell[inside], minlength=CELLS)
                        continue
                    cell, yes = cell[inside], positive[inside, k]
                    no = every[inside] - yes
                    acc[k] += np.bincount(np.concatenate([cell, cell + LABEL_CELLS * TRUTH_CELLS]), weights=np.concatenate([no, yes]), minlength=CELLS)
            return acc.ravel()

        total = sum_over_rows(rows, reducer, len(part) * CELLS, max(len(part), len(cells or ()))).reshape(len(part), CELLS)
        for s, row in zip(part, total):
            out += _cell_rows(s.name, row)
    return df.sparkSession.createDataFrame(
        out, "name string, prediction double, label double, real_label double, n bigint"
    )


def _cell_rows(name: str, row: np.ndarray) -> list[tuple]:
    labels, truths = (0.0, 1.0, -1.0), (0.0, 1.0, -1.0, None)
    rows = []
    for i, n in enumerate(row):
        if n:
            p, rest = divmod(i, LABEL_CELLS * TRUTH_CELLS)
            y, t = divmod(rest, TRUTH_CELLS)
            rows.append((name, float(p), labels[y], truths[t], int(n)))
    return rows


@dataclass(frozen=True)
class CommitteeTest:
    """A committee and the rows it is tested on.

    With ``prefixes`` its first 1, 5, ... members are tested as committees of their own: every member is scored once, and
    the votes of all of them are read off the running sums.
    """

    name: str
    models: tuple[LinearModel, ...]
    fold_col: str | None = None
    fold: int | None = None
    prefixes: tuple[int, ...] = ()

    def __post_init__(self):
        if any(not 0 < p <= len(self.models) for p in self.prefixes):
            raise ValueError(f"prefixes must be from 1 to {len(self.models)}, got {self.prefixes}")

    @property
    def sizes(self) -> tuple[int, ...]:
        return self.prefixes or (len(self.models),)


def committee_counts(df: DataFrame, features: FeatureSet, tests: Sequence[CommitteeTest]) -> DataFrame:
    """(name, members, rule, prediction, label, n) for the vote and the expert rule of many committees.

    Committees are tested together while their weights fit in one broadcast block; a committee larger than a block is
    scored block after block instead.  A member's margins are taken on the rows of its own test alone.
    """
    out: list[tuple] = []
    block: list[CommitteeTest] = []
    size = 0
    for t in tests:
        need = len(t.models) * (features.size + 1) * 8
        if need > BLOCK_BYTES:
            for members in t.sizes:
                out += _large_committee_rows(df, features, t, members)
            continue
        if block and size + need > BLOCK_BYTES:
            out += _count_block(df, features, block)
            block, size = [], 0
        block.append(t)
        size += need
    if block:
        out += _count_block(df, features, block)
    schema = "name string, members int, rule string, prediction double, label double, n bigint"
    return df.sparkSession.createDataFrame(out, schema)


def _large_committee_rows(df: DataFrame, features: FeatureSet, test: CommitteeTest, members: int) -> list[tuple]:
    rows = df if test.fold_col is None else df.filter(F.col(test.fold_col) == test.fold)
    scored = Committee(test.models[:members]).score(rows, features)
    label = F.when(F.col("label") > 0.5, 1.0).otherwise(0.0).alias("y")
    cells = scored.groupBy("vote", "expert", label).agg(F.count("*").alias("n")).collect()  # at most 8 rows
    return [(test.name, members, rule, r[rule], r["y"], r["n"]) for r in cells for rule in ("vote", "expert")]


def _count_block(df: DataFrame, features: FeatureSet, tests: list[CommitteeTest]) -> list[tuple]:
    names = sorted({"label"} | {t.fold_col for t in tests if t.fold_col})
    rows = df.select(*dict.fromkeys([*names, *features.inputs]))
    w, b = stack([m for t in tests for m in t.models])
    ends = np.cumsum([len(t.models) for t in tests])
    starts = ends - [len(t.models) for t in tests]
    where = [(t.fold_col, t.fold) for t in tests]
    sizes = [np.array(t.sizes) for t in tests]
    cells = np.concatenate(([0], np.cumsum([len(s) for s in sizes])))
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    def reducer(batch: pa.RecordBatch) -> np.ndarray:
        weights, bias = shared.value
        columns = {c: nullable(batch.column(c)) for c in names}
        acc = np.zeros((cells[-1], 8))
        for sl, block in feature_blocks(batch, features):
            local = {c: v[sl] for c, v in columns.items()}
            y = (local["label"] > 0.5).astype(int)
            of: dict[tuple, tuple] = {}
            for k, (fold_col, fold) in enumerate(where):
                if where[k] not in of:
                    inside = np.ones(block.n, dtype=bool) if fold_col is None else local[fold_col] == fold
                    of[where[k]] = (block if inside.all() else block.take(inside)), y[inside]
                part, seen = of[where[k]]
                if not part.n:
                    continue
                m = part.dot(weights[starts[k] : ends[k]]) + bias[starts[k] : ends[k]]
                e = np.exp(-np.abs(m))
                members = sizes[k] - 1
                votes = np.cumsum(m > 0, axis=1)[:, members]
                sure = np.cumsum(np.where(m >= 0, 1 / (1 + e), e / (1 + e)), axis=1)[:, members]
                vote = (votes * 2 > sizes[k]).astype(int)
                expert = 1 - (sizes[k] - sure > sure).astype(int)
                for p in range(len(members)):
                    acc[cells[k] + p, :4] += np.bincount(vote[:, p] * 2 + seen, minlength=4)
                    acc[cells[k] + p, 4:] += np.bincount(expert[:, p] * 2 + seen, minlength=4)
        return acc.ravel()

    widest = max(len(t.models) for t in tests)
    total = sum_over_rows(rows, reducer, int(cells[-1]) * 8, widest).reshape(-1, 2, 2, 2)
    return [
        (t.name, int(members), rule, float(p), float(y), int(total[cells[k] + i, r, p, y]))
        for k, t in enumerate(tests)
        for i, members in enumerate(t.sizes)
        for r, rule in enumerate(("vote", "expert"))
        for p in (0, 1)
        for y in (0, 1)
    ]
