from __future__ import annotations

import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from faintlabel.operators import metrics as M

PAIRS = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 2 + [(0.0, 1.0)] + [(0.0, 0.0)] * 4


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "prediction double, label double").cache()


def test_hard_areas(pairs):
    a = M.areas_hard(pairs).first()
    assert a["auprc"] == pytest.approx(0.575)
    assert a["auroc"] == pytest.approx(0.7083333, abs=1e-7)
    assert M.areas_hard(pairs, curve_start="legacy").first()["auprc"] == pytest.approx(0.725)


def test_hard_areas_agree_with_the_evaluator(pairs):
    e = BinaryClassificationEvaluator(rawPredictionCol="prediction", metricName="areaUnderPR")
    assert M.areas_hard(pairs).first()["auprc"] == pytest.approx(e.evaluate(pairs))


@pytest.mark.parametrize("value,start,want", [(0.0, "spark", 0.4), (0.0, "legacy", 0.7), (1.0, "spark", 0.4), (1.0, "legacy", 0.7)])
def test_constant_predictions(pairs, value, start, want):
    flat = pairs.withColumn("prediction", F.lit(value))
    assert M.areas_hard(flat, curve_start=start).first()["auprc"] == pytest.approx(want)


def test_weighted_counts_equal_rows(pairs):
    counted = pairs.groupBy("prediction", "label").agg(F.count("*").alias("w"))
    assert M.metrics_basic(counted, weight="w").first() == M.metrics_basic(pairs).first()


def test_basic(pairs):
    r = M.metrics_basic(pairs).first()
    assert (r["tp_rate_all"], r["recall"], r["precision"]) == pytest.approx((0.3, 0.75, 0.6))
    assert r["f1_ref"] == pytest.approx(0.4)


def test_undefined_precision_is_nan(pairs):
    r = M.metrics_basic(pairs.withColumn("prediction", F.lit(0.0))).first()
    assert math.isnan(r["precision"]) and math.isnan(r["f1_ref"])


def test_confusion_matrix_has_all_cells(pairs):
    got = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(pairs, 3).collect()}
    assert len(got) == 9 and got[1, 1] == 3 and got[0, 1] == 2 and got[2, 2] == 0


@pytest.fixture(scope="module")
def scored(spark):
    """5,000 rows in two groups; a third of all rows share one score."""
    u = (F.hash("id") % 1000 / 1000.0)
    return spark.range(5000).select(
        (F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.abs(u)).alias("score"),
        F.when(F.col("id") % 7 < 2 + 3 * F.abs(u), 1.0).otherwise(0.0).alias("label"),
    ).cache()


def test_score_areas_agree_with_the_evaluator(scored):
    got = {r["g"]: r for r in M.areas_scored(scored, ["g"]).collect()}
    for g in (0, 1):
        part = scored.filter(F.col("g") == g)
        for metric, column in (("areaUnderPR", "auprc"), ("areaUnderROC", "auroc")):
            e = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=metric, numBins=0)
            assert got[g][column] == pytest.approx(e.evaluate(part), abs=1e-12)


def test_curve_does_not_depend_on_the_ranges(scored):
    one = M.score_curve(scored, ranges=1)
    many = M.score_curve(scored, ranges=33)
    assert one.exceptAll(many).count() == 0
    assert one.count() == scored.select("score").distinct().count()


def test_merged_points_end_at_the_totals(scored):
    c = M.score_curve(scored, num_bins=50)
    last = c.orderBy(F.desc("point")).first()
    assert c.count() <= 60 and last["tp"] == last["pos"] and last["fp"] == last["neg"]
    assert M.areas_scored(scored, num_bins=50).first()["auprc"] == pytest.approx(M.areas_scored(scored).first()["auprc"], abs=0.02)


def test_score_sketch_merges_and_bins(spark):
    import random

    draw = random.Random(9)
    rows = []
    for i in range(6000):
        model, y = i % 3, float(draw.random() < 0.3)
        rows.append((model, min(1.0, max(0.0, draw.gauss(0.35 + 0.2 * y, 0.15))), y))
    scored = spark.createDataFrame(rows, "model int, score double, label double")
    one, other = scored.filter("score < 0.4"), scored.filter("score >= 0.4")
    whole = M.score_sketch(scored, ["model"])
    merged = M.merged_sketch(M.score_sketch(one, ["model"]), M.score_sketch(other, ["model"]), ["model"])
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0
    curve = M.binned_curve(whole, ["model"], 100)
    sizes = [r["count"] for r in curve.groupBy("model").count().collect()]
    assert len(sizes) == 3 and all(90 <= n <= 100 for n in sizes)
    exact = {r["model"]: r["auprc"] for r in M.areas_scored(scored, ["model"]).collect()}
    for r in M.binned_areas(curve, ["model"]).collect():
        assert r["auprc"] == pytest.approx(exact[r["model"]], abs=0.01)
    last = curve.filter("recall = 1").groupBy("model").agg(F.max("tp").alias("tp"), F.first("pos").alias("pos")).collect()
    assert len(last) == 3 and all(r["tp"] == r["pos"] for r in last)
    ends = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (-5.0, 0.0), (7.0, 1.0)], "score double, label double")
    assert {(r["cell"], r["pos"], r["neg"]) for r in M.score_sketch(ends).collect()} == {(M.SCORE_CELLS - 1, 2, 1), (0, 0, 1)}
    assert M.binned_curve(M.score_sketch(ends.limit(0))).count() == 0
