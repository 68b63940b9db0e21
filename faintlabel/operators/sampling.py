"""Sampling, splits, folds, label noise and one-shot families, all by hashed row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.functions.hashing import hash32, hash_unit, key_digest


def hash_sample(df: DataFrame, fraction: float, seed: int, key: str = "id") -> DataFrame:
    """Bernoulli sample: keep a row if the hash of its key falls under ``fraction``."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must be in [0, 1], got {fraction}")
    return df.filter(hash_unit(F.col(key), seed) < fraction)


def split_index(weights: Sequence[float], seed: int, key: str = "id") -> Column:
    """Index of the split a row falls in; weights are normalised to sum 1."""
    total = float(sum(weights))
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("split weights must be non-negative and not all zero")
    u = hash_unit(F.col(key), seed)
    out, upper = F.lit(len(weights) - 1), 1.0
    for i in range(len(weights) - 2, -1, -1):
        upper = sum(weights[: i + 1]) / total
        out = F.when(u < upper, i).otherwise(out)
    return out


def hash_split(df: DataFrame, weights: Sequence[float], seed: int, key: str = "id") -> DataFrame:
    """Weighted split as a column ``split``: no shuffle, no second scan; filter on it to get a part."""
    return df.withColumn("split", split_index(weights, seed, key))


def kfold_assign(df: DataFrame, k: int, seed: int, key: str = "id", col: str = "fold") -> DataFrame:
    """Fold number 0..k-1.  Fold f is tested on ``fold = f`` and trained on ``fold <> f``."""
    if k < 2:
        raise ValueError(f"need at least two folds, got {k}")
    return df.withColumn(col, (hash32(F.col(key), seed) % k).cast("int"))


def noise_shares(n_pos: int, n_unl: int, noise: float, labeled_share: float) -> tuple[float, float]:
    """Shares of the positives that stay labeled and that are hidden among the unlabeled rows.

    Hiding h = noise * n_unl / (1 - noise) positives makes them the share ``noise`` of all label-0 rows.
    """
    if not 0.0 <= noise < 1.0 or not 0.0 <= labeled_share <= 1.0:
        raise ValueError("noise must be in [0, 1) and labeled_share in [0, 1]")
    if n_pos == 0:
        raise ValueError("no positive rows to hide")
    hidden = noise * n_unl / (1.0 - noise) / n_pos
    if labeled_share + hidden > 1.0 + 1e-12:
        room = (1.0 - labeled_share) * n_pos
        raise ValueError(
            f"noise level {noise} needs {hidden:.4f} of the positives but only {1 - labeled_share:.4f} are free; "
            f"the largest possible level is {room / (room + n_unl):.6f}"
        )
    return labeled_share, hidden


def positive_counts(df: DataFrame) -> tuple[int, int]:
    """Number of label-1 and label-0 rows, in one job."""
    row = df.agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("u")
    ).first()
    return int(row["p"]), int(row["u"])


def noise_role(
    noise: float, labeled_share: float, counts: tuple[int, int], seed: int, key: str = "id", unit: Column | None = None
) -> Column:
    """Training label after noise injection: 1 labeled, 0 unlabeled (true or hidden), NULL for dropped positives.

    ``unit`` is a column with ``hash_unit`` of key and seed, for many roles of the same rows.
    """
    labeled, hidden = noise_shares(*counts, noise, labeled_share)
    u = hash_unit(F.col(key), seed) if unit is None else unit
    return F.when(F.col("label") == 0, 0.0).when(
        F.col("label") == 1, F.when(u < labeled, 1.0).when(u < labeled + hidden, 0.0)
    )


def inject_noise(
    df: DataFrame, noise: float, labeled_share: float = 0.5, seed: int = 11, key: str = "id"
) -> DataFrame:
    """Hide part of the positives among the unlabeled rows and drop the positives that are left over.

    One narrow projection after a two-number count; hidden rows carry ``real_label`` 1.
    """
    role = noise_role(noise, labeled_share, positive_counts(df), seed, key)
    return (
        df.withColumn("_role", role)
        .filter(F.col("_role").isNotNull())
        .withColumn("real_label", F.when((F.col("label") == 1) & (F.col("_role") == 0), 1.0))
        .withColumn("label", F.col("_role"))
        .drop("_role")
    )


def undersample(df: DataFrame, seed: int = 11, key: str = "id", fold_col: str | None = None) -> DataFrame:
    """Keep all positives and about as many negatives.

    With ``fold_col`` the rate is taken per training fold and the result has one ``train_fold`` copy per fold.
    """
    if fold_col is None:
        p, u = positive_counts(df)
        rate = min(1.0, p / u) if u else 1.0
        return df.filter((F.col("label") == 1) | (hash_unit(F.col(key), seed) < rate))
    counts = {
        r["fold"]: (r["p"], r["u"])
        for r in df.groupBy(F.col(fold_col).alias("fold"))
        .agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("u"))
        .collect()  # one row per fold
    }
    p_all = sum(p for p, _ in counts.values())
    u_all = sum(u for _, u in counts.values())
    keep = []
    for f in sorted(counts):
        p, u = p_all - counts[f][0], u_all - counts[f][1]
        rate = min(1.0, p / u) if u else 1.0
        sampled = (F.col("label") == 1) | (hash_unit(F.col(key), seed) < rate)
        keep.append(F.when((F.col(fold_col) != f) & sampled, F.lit(f)))
    return df.withColumn("train_fold", F.explode(F.array_compact(F.array(*keep))))


def family_one_shot(
    positives: DataFrame,
    benign: DataFrame,
    split_seed: int = 7,
    benign_fraction: float = 0.01,
    benign_seed: int = 11,
    key: str = "id",
) -> DataFrame:
    """One labeled positive per family.

    A random half of the positive rows is the test set.  In the other half the first row of each family (in hash
    order) stays labeled, the rest is hidden among the unlabeled rows together with a small benign sample.  Column
    ``role`` is ``test``, ``labeled``, ``hidden`` or ``benign``; the supervised training set leaves ``hidden`` out.

    The first row per family is a ``min`` with map-side combine, joined back on the unique row key, so a family
    that holds a third of all rows never meets in one task.
    """
    half = positives.withColumn("_split", split_index([0.5, 0.5], split_seed, key))
    pick = F.struct(key_digest(F.col(key), split_seed).alias("h"), F.col(key).alias("k"))
    first = (
        half.filter(F.col("_split") == 0)
        .groupBy("family")
        .agg(F.min(pick).alias("m"))
        .select(F.col("m.k").alias(key), F.lit(True).alias("_first"))
    )
    role = (
        F.when(F.col("_split") == 1, "test").when(F.col("_first"), "labeled").otherwise("hidden")
    )
    pos = half.join(first, key, "left").withColumn("role", role).drop("_split", "_first")
    pos = pos.withColumn("label", F.when(F.col("role") == "hidden", 0.0).otherwise(1.0)).withColumn(
        "real_label", F.when(F.col("role") == "hidden", 1.0)
    )
    neg = (
        hash_sample(benign, benign_fraction, benign_seed, key)
        .withColumn("role", F.lit("benign"))
        .withColumn("label", F.lit(0.0))
        .withColumn("real_label", F.lit(None).cast("double"))
    )
    return pos.unionByName(neg, allowMissingColumns=True)


def random_features(spark: SparkSession, n_features: int, k: int, seed: int) -> DataFrame:
    """k of n feature indices in a seeded random order (``rank`` from 1)."""
    return random_subset(spark.range(n_features).select(F.col("id").cast("int").alias("feature")), k, seed)


def random_subset(features: DataFrame, k: int, seed: int) -> DataFrame:
    """k random features of a (distinct) ``feature`` column; top-k, so no task sees more than k rows per partition."""
    ordered = F.struct(key_digest(F.col("feature"), seed).alias("h"), F.col("feature").alias("f"))
    top = features.select("feature").distinct().orderBy(ordered).limit(k)
    return top.agg(F.sort_array(F.collect_list(ordered)).alias("s")).select(
        F.posexplode(F.transform("s", lambda x: x["f"])).alias("rank", "feature")
    ).withColumn("rank", F.col("rank") + 1)
