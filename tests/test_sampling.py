from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faintlabel.operators import bags as B
from faintlabel.operators import labeling as L
from faintlabel.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    """1,000 rows, 100 of them positive; one family holds a third of the positives."""
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0).alias("label"),
        F.when(F.col("id") % 30 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 7).cast("string"))).alias("family"),
    )
    return df.cache()


def test_folds_partition_the_rows(rows):
    folds = S.kfold_assign(rows, 4, 11)
    assert folds.count() == 1000
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1, 2, 3}
    again = S.kfold_assign(rows.repartition(7), 4, 11)
    assert folds.exceptAll(again).count() == 0


def test_noise_keeps_unlabeled_rows_and_hides_the_right_share(rows):
    out = S.inject_noise(rows, 0.03, 0.5)
    assert out.filter("label = 0 AND real_label IS NULL").count() == 900
    hidden = out.filter("real_label = 1").count()
    assert abs(hidden - 0.03 * 900 / 0.97) < 15
    assert out.filter("label = 1 AND real_label IS NOT NULL").count() == 0
    none = S.inject_noise(rows, 0.0, 0.5)
    assert none.filter("real_label = 1").count() == 0


def test_noise_level_out_of_reach_names_the_limit(rows):
    with pytest.raises(ValueError, match="largest possible level is 0.052632"):
        S.inject_noise(rows, 0.2, 0.5)


def test_every_bag_holds_all_minority_rows(rows):
    bags = B.balanced_bags(rows, 7)
    per_bag = bags.groupBy("bag_id").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("p"), F.count(F.when(F.col("label") == 0, 1)).alias("u")
    ).collect()
    assert len(per_bag) == 9
    assert all(r["p"] == 100 and r["u"] == 100 for r in per_bag)
    assert bags.filter("label = 0").groupBy("id").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("buckets", [2, 16, 64])
def test_bags_do_not_depend_on_the_ranges(rows, buckets):
    one = B.assign_bags(rows, 7, n_buckets=1)
    many = B.assign_bags(rows.repartition(5), 7, n_buckets=buckets)
    assert one.n_bags == many.n_bags
    assert one.rows.exceptAll(many.rows).count() == 0


def test_short_last_bag(spark):
    df = spark.range(25).select("id", F.when(F.col("id") < 10, 1.0).otherwise(0.0).alias("label"))
    sizes = B.balanced_bags(df, 1).filter("label = 0").groupBy("bag_id").count().orderBy("bag_id").collect()
    assert [r["count"] for r in sizes] == [10, 5]


def test_no_minority_is_an_error(spark):
    with pytest.raises(ValueError, match="minority"):
        B.assign_bags(spark.range(5).withColumn("label", F.lit(0.0)), 1)


def test_bag_shares(spark):
    for share, n in ((1.0, 9), (0.75, 6), (0.5, 4), (0.25, 2), (0.05, 0)):
        assert B.kept_bags(spark, 9, share, 3).count() == n


def test_one_labeled_row_per_family(rows):
    out = S.family_one_shot(rows.filter("label = 1"), rows.filter("label = 0"), benign_fraction=0.1)
    labeled = out.filter("role = 'labeled'").groupBy("family").count().collect()
    assert labeled and all(r["count"] == 1 for r in labeled)
    trained = out.filter("role IN ('labeled', 'hidden')")
    assert trained.select("family").distinct().count() == len(labeled)
    assert out.filter("role IN ('labeled', 'hidden', 'test')").count() == 100
    assert out.filter("role = 'hidden' AND (label <> 0 OR real_label <> 1)").count() == 0


def test_undersample_balances(rows):
    out = S.undersample(rows)
    assert out.filter("label = 1").count() == 100
    assert abs(out.filter("label = 0").count() - 100) < 35


def test_split_weights_are_normalised(rows):
    a = S.hash_split(rows, [2, 1], 5)
    b = S.hash_split(rows, [0.5, 0.25], 5)
    assert a.exceptAll(b).count() == 0
    assert abs(a.filter("split = 0").count() - 667) < 60


def test_threshold_overlap_goes_to_malware(spark):
    df = spark.createDataFrame([(1, -1), (2, 0), (3, 5), (4, 6), (5, 12)], "id int, scannersCount int")
    got = {r["id"]: r["label"] for r in L.label_by_threshold(df, 6, 5).collect()}
    assert got == {2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_any_positive_and_effective_label(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 0.0, 1.0), (3, 0.0, None), (4, 0.0, 0.0)], "id int, label double, real_label double")
    assert {r["id"] for r in df.filter(L.any_positive(df)).collect()} == {1, 2}
    assert [r["y"] for r in df.select(L.effective_label(df).alias("y"), "id").orderBy("id").collect()] == [1.0, 1.0, 0.0, 0.0]
