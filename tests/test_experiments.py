"""Sweeps on the smallest tables: shapes, settings, and agreement with hand-made runs."""

from __future__ import annotations

from inspect import signature

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from faintlabel.learning.bayes import fit_nb
from faintlabel.operators import labeling as L
from faintlabel.operators import metrics as M
from faintlabel.plans import committees as C
from faintlabel.plans import experiments as X
from faintlabel.plans.oracle import ORACLE
from faintlabel.plans.queries import QUERIES
from faintlabel.sources import tables as T

SMALL = "/root/testdata/sf0.001"
FS = T.appsec_features()


@pytest.fixture(scope="module")
def labeled(spark):
    return L.label_2016(T.appsec(spark, SMALL)).select("id", "label", *T.APPSEC_FEATURES).cache()


def test_noise_sweep_covers_every_fit(labeled):
    sweep = X.noise_sweep(labeled, FS, (0.0, 0.02), k=3, max_iter=3, reg_param=0.001)
    rows = sweep.results.collect()
    assert len(rows) == 2 * 3 * 4
    assert {r["model"] for r in rows} == {"naive_bayes", "logistic", "svm", "label_regularized"}
    means = sweep.summary().collect()
    assert len(means) == 8 and all(r["n_folds"] == 3 for r in means)


def test_naive_bayes_of_a_sweep_equals_a_direct_run(labeled):
    from faintlabel.operators.sampling import kfold_assign

    case = X.Case("all", "label", "label", (0, 1, 2), {}, ("naive_bayes",))
    got = X.run_cases(kfold_assign(labeled, 3, 11), FS, [case], "x", ["label_auprc"]).results.collect()
    rows = kfold_assign(labeled, 3, 11)
    for r in got:
        m = fit_nb(rows.filter(F.col("fold") != r["fold"]), FS)
        test = rows.filter(F.col("fold") == r["fold"])
        pairs = test.withColumn("prediction", F.when(m.margins(test, FS)[0] > 0, 1.0).otherwise(0.0))
        assert r["value"] == pytest.approx(M.areas_hard(pairs).first()["auprc"])


def test_highconf_uses_the_count_of_the_first_fold(spark):
    df = L.label_highconf_rest(T.appsec(spark, SMALL)).select("id", "label", "real_label", *T.APPSEC_FEATURES)
    sweep = X.highconf_sweep(df, FS, lambda_us=(1,), max_iter=2, reg_param=0.001)
    strengths = {r["params"]["lambda_u"] for r in sweep.results.collect()}
    assert len(strengths) == 2 and max(float(s) for s in strengths) > 100


def test_family_sweep_trains_on_two_sets(spark):
    df = L.label_2016(T.appsec(spark, SMALL)).select("id", "family", "label", *T.APPSEC_FEATURES)
    sweep = X.family_sweep(
        df.filter("label = 1"), df.filter("label = 0"), FS, (0.1,), benign_fraction=0.3, max_iter=3, reg_param=0.001
    )
    got = {(r["params"]["training"], r["model"]) for r in sweep.results.collect()}
    assert got == {("supervised", "naive_bayes"), ("supervised", "logistic"), ("supervised", "svm"), ("semi", "label_regularized")}


def test_temporal_rate_and_stored_predictions(spark, labeled):
    from faintlabel.session import new_folder
    from faintlabel.sources.results import read_predictions

    later = L.temporal_holdout(T.appsec(spark, SMALL))
    folder = new_folder(spark, "predictions")
    sweep = X.unlabeled_sweep(labeled, FS, later, (0.001,), k=2, max_iter=2, reg_param=0.001, prediction_dir=folder)
    rates = [r["value"] for r in sweep.results.filter("metric = 'temporal_rate'").collect()]
    assert len(rates) == 8 and all(0 <= v <= 1 for v in rates)
    assert read_predictions(spark, f"{folder}/temporal_0.001.csv").count() == later.count()


def test_bag_dropping_reports_every_share(spark):
    df = T.bits(spark, SMALL).withColumn("label", F.when(F.col("group") == 3, 1.0).otherwise(0.0)).select("id", "label", "features")
    out = C.bag_dropping(df, T.vector_features(), k=5, folds=2, shares=(1.0, 0.5)).collect()
    assert {r["params"]["share"] for r in out} == {"1.0", "0.5"}
    assert {r["metric"] for r in out} == {"auprc", "auroc", "expert_auprc"}
    assert {r["fold"] for r in out} == {0, 1}


def asked_for(monkeypatch) -> list[dict]:
    """What the committee queries ask for, filled while they run."""
    asked, run, shape = [], C.rank_committee, signature(C.rank_committee)

    def spied(*args, **options):
        given = shape.bind(*args, **options)
        given.apply_defaults()
        asked.append(given.arguments)
        return run(*args, **options)

    monkeypatch.setattr(C, "rank_committee", spied)
    return asked


def test_bag_dropping_query_takes_all_shares_and_features(spark, monkeypatch):
    asked = asked_for(monkeypatch)
    out = QUERIES["x_bag_dropping"](spark, SMALL).collect()
    assert {r["share"] for r in out} == {str(s) for s in C.BAG_SHARES} and len(C.BAG_SHARES) == 5
    assert [a["k"] >= T.VECTOR_SIZE for a in asked] == [True]


def test_rank_committee_query_takes_all_steps_and_features(spark, monkeypatch):
    asked = asked_for(monkeypatch)
    out = QUERIES["x_rank_committee"](spark, SMALL).collect()
    assert {r["features"] for r in out} == {"merged", "base", "random"}
    assert [(a["k"] >= T.VECTOR_SIZE, a["svm_iterations"]) for a in asked] == [(True, 100)]


def test_fits_of_a_sweep_tell_how_they_ended(labeled):
    sweep = X.lambda_sweep(labeled, FS, lambda_us=(1,), reg_params=(0.01, 0.5), p_tilde=0.05, k=2, max_iter=3)
    told = {r["metric"]: r["n"] for r in sweep.results.groupBy("metric").agg(F.count("*").alias("n")).collect()}
    fits = len(sweep.fitted)
    assert told["evaluations"] == told["converged"] == fits
    kept = sweep.results.filter("metric = 'evaluations' and model = 'label_regularized'").collect()
    assert sorted(r["value"] for r in kept) == sorted(float(f.evaluations) for f in sweep.fitted if f.fit.kind == "pu")
    assert {r["value"] for r in sweep.results.filter("metric = 'converged' and model = 'label_regularized'").collect()} == {0.0}


def test_contract():
    assert entry_module.queries().keys() == {**QUERIES, **entry_module.CORPUS}.keys()
    assert entry_module.oracle_sql().keys() == {**ORACLE, **entry_module.CORPUS_ORACLE}.keys()
    assert len(QUERIES) >= 85


SOLVER_QUERIES = sorted(set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", ["lrlr_fit", "baseline_lr", "x_android", "x_changed_train"])
def test_solver_queries_give_rows(spark, name):
    assert name in SOLVER_QUERIES
    assert QUERIES[name](spark, SMALL).count() > 0


def test_noise_sweep_reads_its_rows_once(spark, labeled):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    read = labeled.mapInArrow(passed, labeled.schema)
    X.noise_sweep(read, FS, (0.0, 0.02), k=3, max_iter=1, reg_param=0.001, svm_iterations=1)
    assert seen.value == labeled.count()
