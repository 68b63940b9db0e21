"""Evaluation of predictions against labels, per any grouping.

All functions take pairs (``prediction``, ``label``), optionally pre-counted in a weight column, and group by ``keys``.
Hard 0/1 predictions need one aggregate and no sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlabel.functions.scalar import divide
from faintlabel.session import settled


def hard_counts(
    pairs: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction", label: str = "label",
    weight: str | None = None,
) -> DataFrame:
    """tp, fp (label exactly 0), n_pred (predicted positive), pos (label > 0.5) and n per group."""
    w = F.lit(1) if weight is None else F.col(weight)
    p, y = F.col(prediction), F.col(label)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, w).otherwise(0)), F.lit(0)).cast("bigint")

    return pairs.groupBy(*keys).agg(
        total((p == 1) & (y == 1)).alias("tp"),
        total((p == 1) & (y == 0)).alias("fp"),
        total(p > 0.5).alias("n_pred"),
        total(y > 0.5).alias("pos"),
        total(F.lit(True)).alias("n"),
    )


def metrics_basic(pairs: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    """``tp_rate_all`` divides by all rows (recall only on sets of positives) and feeds ``f1_ref``; ``recall``, ``f1``
    are the textbook forms.  Undefined ratios are NaN."""
    c = hard_counts(pairs, keys, **columns)
    tp, fp, pos, n = (F.col(x) for x in ("tp", "fp", "pos", "n"))
    return c.select(
        *keys,
        "n",
        divide(tp, n).alias("tp_rate_all"),
        divide(tp, pos).alias("recall"),
        divide(tp, tp + fp).alias("precision"),
    ).select(
        "*",
        harmonic(F.col("precision"), F.col("tp_rate_all")).alias("f1_ref"),
        harmonic(F.col("precision"), F.col("recall")).alias("f1"),
    )


def harmonic(a: Column, b: Column) -> Column:
    return divide(2 * a * b, a + b)


def auprc_of_counts(tp: Column, n_pred: Column, pos: Column, n: Column, curve_start: str = "spark") -> Column:
    """Area under the two-threshold PR curve.  ``legacy`` starts the curve at precision 1, ``spark`` at the first one."""
    base = pos / F.greatest(n, F.lit(1))
    r = F.when(pos > 0, tp / F.greatest(pos, F.lit(1))).otherwise(0.0)
    p = F.when(n_pred > 0, tp / F.greatest(n_pred, F.lit(1))).otherwise(base)
    if curve_start == "spark":
        some = r * p + (1 - r) * (p + base) / 2
        return F.when(n_pred > 0, some).otherwise(base)
    if curve_start == "legacy":
        some = r * (1 + p) / 2 + (1 - r) * (p + base) / 2
        return F.when(n_pred > 0, some).otherwise((1 + base) / 2)
    raise ValueError(f"curve_start must be spark or legacy, got {curve_start}")


def auroc_of_counts(tp: Column, n_pred: Column, pos: Column, n: Column) -> Column:
    neg = n - pos
    tpr = tp / F.greatest(pos, F.lit(1))
    fpr = (n_pred - tp) / F.greatest(neg, F.lit(1))
    return F.when(pos == 0, 0.0).when(neg == 0, 1.0).otherwise((1 + tpr - fpr) / 2)


def areas_hard(pairs: DataFrame, keys: Sequence[str] = (), curve_start: str = "spark", **columns) -> DataFrame:
    """``auprc`` and ``auroc`` of hard predictions."""
    c = hard_counts(pairs, keys, **columns)
    args = [F.col(x) for x in ("tp", "n_pred", "pos", "n")]
    return c.select(
        *keys, auprc_of_counts(*args, curve_start=curve_start).alias("auprc"), auroc_of_counts(*args).alias("auroc")
    )


def confusion_matrix(pairs: DataFrame, k: int) -> DataFrame:
    """All k x k cells (actual, predicted, n), zeros included: k*k conditional counts in one aggregate."""
    cells = [(i, j) for i in range(k) for j in range(k)]
    counts = pairs.agg(
        *[F.count(F.when((F.col("label") == i) & (F.col("prediction") == j), 1)).alias(f"c{i}_{j}") for i, j in cells]
    )
    rows = F.array(
        *[F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(f"c{i}_{j}").alias("n")) for i, j in cells]
    )
    return counts.select(F.explode(rows).alias("c")).select("c.*")


def positive_rate(pairs: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Share of rows predicted 1: the detection rate on a set that is all positive."""
    w = F.lit(1) if weight is None else F.col(weight)
    return pairs.groupBy(*keys).agg(
        divide(F.sum(F.when(F.col("prediction") == 1, w).otherwise(0)), F.sum(w)).alias("rate")
    )


def mean_over_folds(results: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """True mean of a metric over its folds."""
    return results.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n_folds"))


POINTS_PER_RANGE = 500_000
MAX_RANGES = 10_000


def score_curve(
    scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", num_bins: int = 0,
    ranges: int | None = None,
) -> DataFrame:
    """One row per distinct score from high to low with cumulative counts ``tp`` and ``fp`` and the class sizes.

    Rows first collapse per score, so a score shared by a third of the table is one row.  The running sums then work
    in ``ranges`` score ranges (one per POINTS_PER_RANGE distinct scores by default) cut at approximate quantiles,
    shifted by the totals of the ranges above; the quantiles only balance the work and do not touch the result.
    """
    keys = list(keys)
    s = scored.select(*keys, F.col(score).cast("double").alias("score"), (F.col(label) > 0.5).alias("_pos"))
    points = settled(
        s.groupBy(*keys, "score").agg(
            F.count(F.when(F.col("_pos"), 1)).alias("_p"), F.count(F.when(~F.col("_pos"), 1)).alias("_n")
        )
    )
    if ranges is None:
        ranges = min(MAX_RANGES, 1 + points.count() // POINTS_PER_RANGE)
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = points.select(F.percentile_approx("score", shares, 10 * MAX_RANGES).alias("q")).first()["q"] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    ranged = (
        Bucketizer(splits=splits, inputCol="score", outputCol="_range").transform(points)
        if len(splits) > 2
        else points.withColumn("_range", F.lit(0.0))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_range").agg(
        F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn"), F.count("*").alias("_rc")
    )  # at most ``ranges`` rows per group
    totals = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(o) for c, o in (("_rp", "_op"), ("_rn", "_on"), ("_rc", "_oc"))],
        F.sum("_rp").over(whole).alias("pos"),
        F.sum("_rn").over(whole).alias("neg"),
        F.sum("_rc").over(whole).alias("_points"),
    )
    curve = ranged.withColumns(
        {"_ip": F.sum("_p").over(inside), "_in": F.sum("_n").over(inside), "_ic": F.count("*").over(inside)}
    ).join(totals, [*keys, "_range"])
    curve = curve.select(
        *keys,
        "score",
        (F.col("_op") + F.col("_ip")).alias("tp"),
        (F.col("_on") + F.col("_in")).alias("fp"),
        F.col("_p").alias("own_pos"),
        F.col("_n").alias("own_neg"),
        (F.col("_oc") + F.col("_ic")).alias("point"),
        F.col("_points").alias("points"),
        "pos",
        "neg",
    )
    return curve if num_bins <= 0 else _merge_points(curve, keys, num_bins)


def _merge_points(curve: DataFrame, keys: list[str], num_bins: int) -> DataFrame:
    """Merge runs of ``points // num_bins`` neighbouring points; fewer than two per bin leaves the curve alone."""
    run = F.greatest(F.floor(F.col("points") / num_bins), F.lit(1))
    return (
        curve.withColumn("_bin", F.floor((F.col("point") - 1) / run))
        .groupBy(*keys, "_bin")
        .agg(
            F.min("score").alias("score"), F.max("tp").alias("tp"), F.max("fp").alias("fp"),
            F.sum("own_pos").alias("own_pos"), F.sum("own_neg").alias("own_neg"), F.max("point").alias("point"),
            F.first("points").alias("points"), F.first("pos").alias("pos"), F.first("neg").alias("neg"),
        )
        .drop("_bin")
    )


#: Cells of a score sketch.
SCORE_CELLS = 1 << 14


def score_sketch(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(keys, cell, pos, neg): rows per class in fixed cells of the score; scores outside of low..high are in the end cells.

    Tasks count their own rows, and sketches of parts add up by ``merged_sketch`` to that of the whole, so thousands of
    models and folds need one pass and no sort of their scores.
    """
    width = (high - low) / SCORE_CELLS
    cell = F.least(F.greatest(F.floor((F.col(score) - low) / width), F.lit(0)), F.lit(SCORE_CELLS - 1)).cast("int")
    return scored.groupBy(*keys, cell.alias("cell")).agg(
        F.count(F.when(F.col(label) > 0.5, 1)).alias("pos"), F.count(F.when(~(F.col(label) > 0.5), 1)).alias("neg")
    )


def merged_sketch(one: DataFrame, other: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return one.unionByName(other).groupBy(*keys, "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def binned_curve(sketch: DataFrame, keys: Sequence[str] = (), num_bins: int = 100, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(keys, bin, threshold, tp, fp, pos, neg, recall, precision): bins of near equal counts from high to low scores.

    A cell belongs to the bin in which its first row falls when all rows are numbered by falling score: the exact rule
    of merging neighbouring cells.  ``threshold`` is the bin's lowest score.
    """
    whole = Window.partitionBy(*keys)  # a model's cells, at most SCORE_CELLS of them
    upto = whole.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.col("pos") + F.col("neg")
    cells = sketch.select(
        *keys, "cell", F.sum("pos").over(upto).alias("_tp"), F.sum("neg").over(upto).alias("_fp"), n.alias("_n"),
        F.sum("pos").over(whole).alias("_pos"), F.sum("neg").over(whole).alias("_neg"),
    )
    before = F.col("_tp") + F.col("_fp") - F.col("_n")
    cells = cells.withColumn("bin", F.expr(f"(_tp + _fp - _n) * {int(num_bins)} div (_pos + _neg)") if num_bins > 0 else before)
    bins = cells.groupBy(*keys, "bin").agg(
        F.min("cell").alias("_c"), F.max("_tp").alias("tp"), F.max("_fp").alias("fp"), F.max("_pos").alias("pos"), F.max("_neg").alias("neg")
    )
    return bins.select(
        *keys, "bin", (F.col("_c") * ((high - low) / SCORE_CELLS) + low).alias("threshold"), "tp", "fp", "pos", "neg",
        divide(F.col("tp"), F.col("pos")).alias("recall"), divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def binned_areas(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auprc): trapezoids over the bins of ``binned_curve``, from the first bin's precision."""
    order = Window.partitionBy(*keys).orderBy("bin")
    r0, p0 = F.coalesce(F.lag("recall").over(order), F.lit(0.0)), F.coalesce(F.lag("precision").over(order), F.col("precision"))
    part = (F.col("recall") - r0) * (F.col("precision") + p0) / 2
    return curve.withColumn("_a", part).groupBy(*keys).agg(F.sum("_a").alias("auprc"))


def pr_curve(scored: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """(threshold, recall, precision) points."""
    c = score_curve(scored, keys, **options)
    return c.select(
        *keys,
        F.col("score").alias("threshold"),
        divide(F.col("tp"), F.col("pos")).alias("recall"),
        divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def areas_scored(scored: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """``auprc`` (curve from the first precision), ``auprc_legacy`` (from precision 1) and ``auroc`` of scores.

    Each point knows its predecessor (cumulative minus own counts), so the trapezoids add up in any order.
    """
    c = score_curve(scored, keys, **options)
    tp, fp, pos, neg = (F.col(x) for x in ("tp", "fp", "pos", "neg"))
    tp0, fp0 = tp - F.col("own_pos"), fp - F.col("own_neg")
    p = tp / (tp + fp)
    gain = (tp - tp0) / F.greatest(pos, F.lit(1))

    def under_pr(start: Column) -> Column:
        before = F.when(tp0 + fp0 > 0, tp0 / F.greatest(tp0 + fp0, F.lit(1))).otherwise(start)
        return F.sum(gain * (p + before) / 2)

    roc = (fp - fp0) / F.greatest(neg, F.lit(1)) * (tp + tp0) / 2 / F.greatest(pos, F.lit(1))
    return c.groupBy(*keys).agg(
        under_pr(p).alias("auprc"),
        under_pr(F.lit(1.0)).alias("auprc_legacy"),
        F.when(F.first("neg") == 0, 1.0).otherwise(F.sum(roc)).alias("auroc"),
    )
