"""Linear models: scoring expressions, storage, and scoring of many models in one projection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.functions.scalar import sigmoid, weighted_sum
from faintlabel.learning.batches import feature_blocks
from faintlabel.operators.features import FeatureSet
from faintlabel.session import ship_package

# Above this many multiply-adds one generated method gets too large for the JIT compiler; Arrow batches take over.
CODEGEN_TERMS = 128
# A broadcast block of model weights; larger committees are scored block after block.
BLOCK_BYTES = 64 << 20


@dataclass(frozen=True)
class LinearModel:
    """Weights of a binary (or, for scoring only, multinomial) logistic model.

    A row is positive if its score is strictly above ``threshold``; without a threshold the score itself is returned.
    """

    weights: tuple[float, ...]
    intercept: float = 0.0
    num_features: int = 0
    num_classes: int = 2
    threshold: float | None = 0.5

    def __post_init__(self):
        if self.num_features == 0:
            object.__setattr__(self, "num_features", len(self.weights))
        d, k, size = self.num_features, self.num_classes, len(self.weights)
        if k == 2 and size != d:
            raise ValueError(f"{size} weights for {d} features")
        if k > 2 and size not in ((k - 1) * d, (k - 1) * (d + 1)):
            raise ValueError(f"{size} weights do not fit {k} classes and {d} features")
        if k < 2:
            raise ValueError("need at least two classes")

    def shape_report(self, df: DataFrame, column: str) -> DataFrame:
        """(problem, size, n): rows whose array of features fits the model or does not, by the size they have (-1: none)."""
        size = F.when(F.col(column).isNull(), -1).otherwise(F.size(F.col(column)))
        problem = F.when(size < 0, "no features").when(size != self.num_features, "wrong size").otherwise("fits")
        return df.groupBy(problem.alias("problem"), size.alias("size")).agg(F.count("*").alias("n"))

    def with_threshold(self, threshold: float) -> LinearModel:
        return replace(self, threshold=threshold)

    def without_threshold(self) -> LinearModel:
        return replace(self, threshold=None)

    @property
    def class_matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """(k-1) x D weights and the bias per class."""
        k, d = self.num_classes, self.num_features
        w = np.asarray(self.weights, dtype=float).reshape(k - 1, -1)
        if k == 2:
            return w, np.array([self.intercept])
        return (w[:, :d], w[:, d]) if w.shape[1] == d + 1 else (w, np.zeros(k - 1))

    def margins(self, df: DataFrame, features: FeatureSet) -> list[Column]:
        w, b = self.class_matrix
        if features.size != self.num_features:
            raise ValueError(f"model has {self.num_features} features, rows have {features.size}")
        return margin_columns(df, features, w, b)

    def score(self, df: DataFrame, features: FeatureSet) -> Column:
        """Probability of class 1."""
        if self.num_classes != 2:
            raise ValueError("scores are defined for two classes")
        return sigmoid(self.margins(df, features)[0])

    def predict(self, df: DataFrame, features: FeatureSet) -> Column:
        """Predicted class, or the score if there is no threshold.  Ties of a multinomial model go to the lower class."""
        if self.num_classes == 2:
            s = self.score(df, features)
            return s if self.threshold is None else F.when(s > self.threshold, 1.0).otherwise(0.0)
        margins = [F.lit(0.0), *self.margins(df, features)]
        return (F.array_position(F.array(*margins), F.greatest(*margins)) - 1).cast("double")

    def row(self) -> tuple:
        return (list(self.weights), self.intercept, self.num_features, self.num_classes, self.threshold)


MODEL_SCHEMA = "weights array<double>, intercept double, num_features int, num_classes int, threshold double"


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    spark.createDataFrame([model.row()], MODEL_SCHEMA).coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    r = spark.read.schema(MODEL_SCHEMA).parquet(path).first()
    return LinearModel(tuple(r["weights"]), r["intercept"], r["num_features"], r["num_classes"], r["threshold"])


def margin_columns(df: DataFrame, features: FeatureSet, w: np.ndarray, b: np.ndarray) -> list[Column]:
    """Margin expressions of a few models: flat sums if they stay small, else array folds."""
    if features.is_wide and w.size <= CODEGEN_TERMS:
        return [weighted_sum(features.scalars(df), row, bias) for row, bias in zip(w, b)]
    stored = features.stored(df)
    if stored is not None:
        return [
            F.aggregate(stored, F.lit(float(bias)), _add_entry(F.lit([float(v) for v in row]))) for row, bias in zip(w, b)
        ]
    x = features.array(df)
    return [
        F.aggregate(
            F.zip_with(x, F.lit([float(v) for v in row]), lambda a, c: a * c), F.lit(float(bias)), lambda s, v: s + v
        )
        for row, bias in zip(w, b)
    ]


def _add_entry(weights: Column):
    """Running margin plus one stored entry of a sparse row."""
    return lambda total, e: total + e["value"] * F.element_at(weights, e["feature"] + 1)


def committee_columns(df: DataFrame, features: FeatureSet, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """Add ``votes`` (members with a positive margin), ``n_members`` and ``certainty`` (sum of sigmoid margins).

    Rows are never paired with models: all members are evaluated on the row where it is.  Sums over members add up,
    so a committee larger than one broadcast block is scored block after block in the same stage.
    """
    if len(w) == 0:
        raise ValueError("a committee needs at least one member")
    if features.is_wide and w.size <= CODEGEN_TERMS:
        m = margin_columns(df, features, w, b)
        votes = sum((F.when(x > 0, 1).otherwise(0) for x in m[1:]), F.when(m[0] > 0, 1).otherwise(0))
        certainty = sum((sigmoid(x) for x in m[1:]), sigmoid(m[0]))
        return df.withColumns(
            {"votes": votes.cast("bigint"), "n_members": F.lit(len(w)).cast("bigint"), "certainty": certainty}
        )
    out = df.withColumns({"votes": F.lit(0).cast("bigint"), "certainty": F.lit(0.0)})
    for start, stop in member_blocks(len(w), features.size):
        out = _add_block(out, features, w[start:stop], b[start:stop])
    return out.withColumn("n_members", F.lit(len(w)).cast("bigint"))


def member_blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of members whose weights fit in one broadcast."""
    step = max(1, BLOCK_BYTES // (8 * (size + 1)))
    for start in range(0, n, step):
        yield start, min(n, start + step)


def _add_block(df: DataFrame, features: FeatureSet, w: np.ndarray, b: np.ndarray) -> DataFrame:
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            votes = np.zeros(batch.num_rows, dtype=np.int64)
            sure = np.zeros(batch.num_rows)
            for rows, block in feature_blocks(batch, features):
                m = block.dot(weights) + bias
                e = np.exp(-np.abs(m))
                votes[rows] = (m > 0).sum(1)
                sure[rows] = np.where(m >= 0, 1 / (1 + e), e / (1 + e)).sum(1)
            old_votes = batch.column("votes").to_numpy() + votes
            old_sure = batch.column("certainty").to_numpy() + sure
            columns = [batch.column(c) for c in batch.schema.names]
            names = batch.schema.names
            columns[names.index("votes")] = pa.array(old_votes)
            columns[names.index("certainty")] = pa.array(old_sure)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(score, df.schema)


def vote_prediction() -> Column:
    """Majority of the members; a tie goes to class 0."""
    return F.when(F.col("votes") * 2 > F.col("n_members"), 1.0).otherwise(0.0)


def expert_prediction() -> Column:
    """Class with the larger summed posterior; a tie goes to class 1."""
    return F.when(F.col("n_members") - F.col("certainty") > F.col("certainty"), 0.0).otherwise(1.0)


def margin_cut(threshold: float = 0.5) -> float:
    """Margin at which the logistic score equals the threshold."""
    return math.log(threshold) - math.log1p(-threshold)


def stack(models: Sequence[LinearModel]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of binary models as arrays."""
    if any(m.num_classes != 2 for m in models):
        raise ValueError("only binary models form a committee")
    return np.array([m.weights for m in models]), np.array([m.intercept for m in models])
