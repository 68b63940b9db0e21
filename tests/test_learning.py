from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from faintlabel.functions.scalar import sigmoid
from faintlabel.learning import models as MO
from faintlabel.learning import fits, passes, repeats, training
from faintlabel.learning.bayes import bag_models, bag_sums, cell_sums, fit_nb, label_sums, nb_params
from faintlabel.learning.batches import DenseBlock
from faintlabel.learning.committee import Committee, Scorer, prediction_counts
from faintlabel.learning.fits import DIVERGENCES, Fit, batch_sums, divergence, loss_and_gradient, true_kl
from faintlabel.learning.models import LinearModel, committee_columns, load_model, save_model
from faintlabel.learning.repeats import counted, packed
from faintlabel.learning.training import (
    catalyst_sums, arrow_sums, evaluate, fit_label_regularized, fit_label_regularized_sgd, fit_many, fit_minibatch, fit_newton,
    inverse_std, loss_history, pass_sums,
)
from faintlabel.operators import bags as B
from faintlabel.operators.features import FeatureSet
from faintlabel.operators.sampling import kfold_assign
from faintlabel.session import new_folder
from faintlabel.sources import tables as T

D = 10
WIDE = T.appsec_features()
W = np.array([math.sin(j + 1) / 10 for j in range(D)])


@pytest.fixture(scope="module")
def rows(spark):
    from faintlabel.operators.labeling import label_2016

    df = label_2016(T.appsec(spark, "/root/testdata/sf0.001")).select("id", "label", *T.APPSEC_FEATURES)
    return kfold_assign(df, 3, 11).repartition(4).cache()


@pytest.fixture(scope="module")
def matrix(rows):
    data = rows.orderBy("id").collect()
    x = np.array([[float(r[c]) for c in T.APPSEC_FEATURES] for r in data])
    return x, np.array([r["label"] for r in data]), np.array([r["fold"] for r in data])


@pytest.fixture(scope="module")
def vector_rows(rows):
    v = VectorAssembler(inputCols=T.APPSEC_FEATURES, outputCol="features").transform(rows)
    return v.select("id", "label", "fold", "features").cache()


FITS = [
    Fit("pu", "pu", p_tilde=0.05),
    Fit("lr", "logistic", fold_col="fold", left_out=1),
    Fit("svm", "hinge", reg_param=0.01, scale=False),
]


def test_catalyst_and_arrow_sums_agree(rows):
    w = np.stack([W, W * 2, -W])
    np.testing.assert_allclose(catalyst_sums(rows, WIDE, FITS, w), arrow_sums(rows, WIDE, FITS, w), rtol=1e-9, atol=1e-9)


def test_vector_rows_give_the_same_sums(rows, vector_rows):
    w = np.stack([W, W * 2, -W])
    packed = FeatureSet.in_column("features", D)
    np.testing.assert_allclose(arrow_sums(vector_rows, packed, FITS, w), arrow_sums(rows, WIDE, FITS, w), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(inverse_std(vector_rows, packed, FITS), inverse_std(rows, WIDE, FITS), rtol=1e-9)


def test_std_matches_numpy(rows, matrix):
    x, _, fold = matrix
    inv = inverse_std(rows, WIDE, FITS)
    np.testing.assert_allclose(inv[0], 1 / x.std(0, ddof=1), rtol=1e-9)
    np.testing.assert_allclose(inv[1], 1 / x[fold != 1].std(0, ddof=1), rtol=1e-9)
    np.testing.assert_allclose(inv[2], np.ones(D))


def test_constant_feature_gets_weight_zero(rows):
    df = rows.withColumn("f3", F.lit(7))
    done = fit_label_regularized(df, WIDE, 0.05, 1.0, reg_param=0.01, max_iter=3)
    assert done.model.weights[3] == 0.0


@pytest.mark.parametrize("name", sorted(DIVERGENCES))
def test_gradient_matches_finite_differences(rows, name):
    fit = Fit("pu", "pu", p_tilde=0.05, lambda_u=2.0, reg_param=0.001, divergence=name)
    inv = inverse_std(rows, WIDE, [fit])[0]

    def value(w):
        return loss_and_gradient(fit, evaluate(rows, WIDE, fit, w, inv), w)

    _, grad = value(W)
    for j in (0, 4, 9):
        e = np.zeros(D)
        e[j] = 1e-5
        assert (value(W + e)[0] - value(W - e)[0]) / 2e-5 == pytest.approx(grad[j], abs=1e-8)


def test_divergence_values():
    assert divergence("kl", 0.2, 0.0)[0] == pytest.approx(-math.log(0.8))
    assert true_kl(0.05, 0.05) == pytest.approx(0.0, abs=1e-12)
    assert divergence("bhattacharyya", 0.3, 0.3) == pytest.approx((0.0, 0.0), abs=1e-12)
    assert math.isfinite(divergence("kl", 0.0, 0.1)[0])


def test_fit_reaches_a_stationary_point(rows):
    done = fit_label_regularized(rows, WIDE, 0.05, 1.0, reg_param=0.001, tol=1e-9)
    inv = inverse_std(rows, WIDE, [done.fit])[0]
    w = np.array(done.model.weights) / inv
    _, grad = loss_and_gradient(done.fit, evaluate(rows, WIDE, done.fit, w, inv), w)
    assert np.linalg.norm(grad) < 1e-3
    assert all(b <= a + 1e-12 for a, b in zip(done.losses, done.losses[1:]))
    assert loss_history(rows, done).count() == len(done.losses)


def test_fits_together_equal_fits_alone(rows):
    fits = [Fit(f"f{i}", "pu", fold_col="fold", left_out=i, p_tilde=0.02, reg_param=0.001) for i in range(2)]
    together = fit_many(rows, WIDE, fits, max_iter=8)
    for f, t in zip(fits, together):
        alone = fit_many(rows, WIDE, [f], max_iter=8)[0]
        np.testing.assert_allclose(t.model.weights, alone.model.weights, rtol=1e-6)
        filtered = fit_many(rows.filter(F.col("fold") != f.left_out), WIDE, [Fit("x", "pu", p_tilde=0.02, reg_param=0.001)], max_iter=8)[0]
        np.testing.assert_allclose(t.model.weights, filtered.model.weights, rtol=1e-6)


@pytest.mark.parametrize("hold", ["memory", "table", "none"])
def test_holding_does_not_change_the_fit(rows, hold):
    got = fit_label_regularized(rows, WIDE, 0.05, 1.0, reg_param=0.001, max_iter=4, hold=hold)
    want = fit_label_regularized(rows, WIDE, 0.05, 1.0, reg_param=0.001, max_iter=4)
    np.testing.assert_allclose(got.model.weights, want.model.weights, rtol=1e-8)


def test_merge_rounds_give_the_same_sums(rows, monkeypatch):
    want = arrow_sums(rows, WIDE, FITS[:1], W[None, :])
    monkeypatch.setattr(passes, "DRIVER_BYTES", 1)
    np.testing.assert_allclose(arrow_sums(rows.repartition(9), WIDE, FITS[:1], W[None, :]), want, rtol=1e-9)
    monkeypatch.setattr(training, "TASK_BYTES", 8 * (5 + 2 * D))
    two = training.pass_sums(rows, WIDE, FITS[:1] * 2, np.stack([W, W]))
    np.testing.assert_allclose(two, np.concatenate([want, want]), rtol=1e-9)


def test_svm_matches_the_library_schedule(spark, rows):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.regression import LabeledPoint

    points = rows.select("label", *T.APPSEC_FEATURES).rdd.map(lambda r: LabeledPoint(r[0], [float(v) for v in r[1:]]))
    want = SVMWithSGD.train(points, iterations=30)
    got = fit_many(rows, WIDE, [Fit("svm", "hinge", reg_param=0.01, scale=False)], max_iter=30)[0]
    np.testing.assert_allclose(got.model.weights, want.weights.toArray(), rtol=1e-8)


def test_logistic_matches_the_library_optimum(rows, vector_rows):
    want = LogisticRegression(regParam=0.0, fitIntercept=False, standardization=True, tol=1e-10, maxIter=200).fit(vector_rows)
    got = fit_many(rows, WIDE, [Fit("lr", "logistic")], tol=1e-10)[0]
    np.testing.assert_allclose(got.model.weights, want.coefficients.toArray(), rtol=2e-2, atol=2e-3)


def test_bad_labels_and_missing_unlabeled_rows(rows):
    with pytest.raises(ValueError, match="other than 0 and 1"):
        fit_label_regularized(rows.withColumn("label", F.lit(2.0)), WIDE, 0.1, 1.0)
    with pytest.raises(ValueError, match="no unlabeled rows"):
        fit_label_regularized(rows.withColumn("label", F.lit(1.0)), WIDE, 0.1, 1.0)
    with pytest.raises(ValueError):
        Fit(kind="tree")
    with pytest.raises(ValueError, match="corrections"):
        fit_label_regularized(rows, WIDE, 0.1, 1.0, corrections=0)


def test_sgd_lowers_the_loss_and_samples_positives(rows):
    full = fit_label_regularized_sgd(rows, WIDE, 0.05, 1.0, iterations=10, step=0.5)
    assert full.losses[-1] < full.losses[0]
    sampled = fit_label_regularized_sgd(rows, WIDE, 0.05, 1.0, iterations=3, batch_fraction=0.5)
    assert len(sampled.losses) == 3
    with pytest.raises(ValueError, match="tol"):
        fit_label_regularized_sgd(rows, WIDE, 0.05, 1.0, tol=2.0)


def test_feature_mask_equals_a_narrow_fit(rows):
    narrow = fit_many(rows, FeatureSet.wide(["f1", "f4"]), [Fit("n", "hinge", reg_param=0.01, scale=False)], max_iter=6)[0]
    masked = fit_many(rows, WIDE, [Fit("m", "hinge", reg_param=0.01, scale=False, only=(1, 4))], max_iter=6)[0]
    assert [masked.model.weights[i] for i in (1, 4)] == pytest.approx(list(narrow.model.weights))
    assert sum(abs(w) for i, w in enumerate(masked.model.weights) if i not in (1, 4)) == 0


# ---- scoring ------------------------------------------------------------------------------------------------------


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "f0 double")
    m = LinearModel((1.0,))
    fs = FeatureSet.wide(["f0"])
    assert [r[0] for r in df.select(m.predict(df, fs)).collect()] == [0.0, 1.0, 0.0]
    raw = [r[0] for r in df.select(m.without_threshold().predict(df, fs)).collect()]
    assert raw[0] == 0.5
    assert [r[0] for r in df.select(m.with_threshold(0.2).predict(df, fs)).collect()] == [1.0, 1.0, 1.0]


def test_model_shapes():
    with pytest.raises(ValueError):
        LinearModel((1.0, 2.0), 0.0, 3)
    with pytest.raises(ValueError):
        LinearModel((1.0,) * 5, 0.0, 2, 3)
    LinearModel((1.0,) * 6, 0.0, 2, 3)


def test_multinomial_ties_go_down(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "f0 double")
    m = LinearModel((1.0, 1.0), 0.0, 1, 3)
    assert [r[0] for r in df.select(m.predict(df, FeatureSet.wide(["f0"]))).collect()] == [1.0, 0.0, 0.0]


def test_sigmoid_does_not_overflow(spark):
    df = spark.createDataFrame([(800.0,), (-800.0,)], "m double")
    assert [r[0] for r in df.select(sigmoid(F.col("m"))).collect()] == [1.0, 0.0]


def test_model_round_trip(spark):
    path = new_folder(spark, "model")
    m = LinearModel((0.1, -2.0), 0.5).without_threshold()
    save_model(spark, m, path)
    assert load_model(spark, path) == m


def test_committee_paths_agree(rows, vector_rows, monkeypatch):
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(7, D)) / 10, rng.normal(size=7) / 10
    small = committee_columns(rows, WIDE, w, b).select("id", "votes", F.round("certainty", 9).alias("c"), "n_members")
    monkeypatch.setattr(MO, "CODEGEN_TERMS", 0)
    monkeypatch.setattr(MO, "BLOCK_BYTES", 8 * (D + 1) * 3)
    blocks = committee_columns(rows, WIDE, w, b).select("id", "votes", F.round("certainty", 9).alias("c"), "n_members")
    assert small.exceptAll(blocks).count() == 0
    packed = committee_columns(vector_rows, FeatureSet.in_column("features", D), w, b)
    assert small.exceptAll(packed.select("id", "votes", F.round("certainty", 9).alias("c"), "n_members")).count() == 0


def test_vote_and_expert_ties(spark):
    df = spark.createDataFrame([(1.0,)], "f0 double")
    fs = FeatureSet.wide(["f0"])
    r = Committee([LinearModel((2.0,)), LinearModel((-2.0,))]).score(df, fs).first()
    assert (r["votes"], r["vote"]) == (1, 0.0)
    r = Committee([LinearModel((0.0,)), LinearModel((0.0,))]).score(df, fs).first()
    assert (r["votes"], r["vote"], r["expert"]) == (0, 0.0, 1.0)


def test_prediction_counts(rows, matrix):
    x, y, fold = matrix
    m = LinearModel(tuple(W), -1.0)
    got = prediction_counts(rows, WIDE, [Scorer("a", m), Scorer("b", m, fold_col="fold", fold=2)])
    pred = (x @ W - 1.0 > 0).astype(float)
    for name, keep in (("a", fold >= 0), ("b", fold == 2)):
        for p in (0.0, 1.0):
            for t in (0.0, 1.0):
                n = sum(r["n"] for r in got.filter(f"name = '{name}' AND prediction = {p} AND label = {t}").collect())
                assert n == int(((pred == p) & (y == t) & keep).sum())


def test_large_committees_are_counted_in_blocks(rows, monkeypatch):
    from faintlabel.learning import committee as CM

    models = tuple(LinearModel(tuple(W * (i - 3)), 0.1 * i) for i in range(7))
    tests = [CM.CommitteeTest("a", models), CM.CommitteeTest("b", models[:3], "fold", 1), CM.CommitteeTest("c", models[2:4])]
    want = CM.committee_counts(rows, WIDE, tests).filter("n > 0").drop("members")
    monkeypatch.setattr(CM, "BLOCK_BYTES", 8 * (D + 1) * 4)
    monkeypatch.setattr(MO, "BLOCK_BYTES", 8 * (D + 1) * 4)
    got = CM.committee_counts(rows, WIDE, tests).groupBy("name", "rule", "prediction", "label").agg(F.sum("n").alias("n"))
    assert got.filter("n > 0").exceptAll(want).count() == 0


def test_prefixes_equal_separate_committees(rows, monkeypatch):
    from faintlabel.learning import committee as CM

    models = tuple(LinearModel(tuple(W * (i - 3)), 0.1 * i) for i in range(7))
    at_once = [CM.CommitteeTest("a", models, "fold", 1, (1, 3, 7)), CM.CommitteeTest("b", models[1:], None, None, (2,))]
    apart = [CM.CommitteeTest("a", models[:n], "fold", 1) for n in (1, 3, 7)] + [CM.CommitteeTest("b", models[1:3])]
    want = CM.committee_counts(rows, WIDE, apart).filter("n > 0")
    for most in (CM.BLOCK_BYTES, 8 * (D + 1) * 4):
        monkeypatch.setattr(CM, "BLOCK_BYTES", most)
        got = CM.committee_counts(rows, WIDE, at_once).groupBy("name", "members", "rule", "prediction", "label").agg(F.sum("n").alias("n")).filter("n > 0")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    with pytest.raises(ValueError, match="prefixes"):
        CM.CommitteeTest("c", models, prefixes=(8,))


def test_members_are_scored_on_their_own_fold(rows, monkeypatch):
    from faintlabel.learning import batches as BA
    from faintlabel.learning import committee as CM

    seen = []
    monkeypatch.setattr(CM, "sum_over_rows", lambda df, reducer, length, cells: sum(reducer(b) for b in df.toArrow().to_batches()))
    dot = BA.DenseBlock.dot
    monkeypatch.setattr(BA.DenseBlock, "dot", lambda self, w: seen.append(self.n * len(w)) or dot(self, w))
    models = tuple(LinearModel(tuple(W * (i - 3)), 0.1 * i) for i in range(4))
    CM.committee_counts(rows, WIDE, [CM.CommitteeTest(str(f), models, "fold", f, (1, 2, 4)) for f in range(3)])
    assert sum(seen) == 4 * rows.count()


def test_fits_tell_why_they_ended(rows):
    done = fit_label_regularized(rows, WIDE, 0.05, 1.0, reg_param=0.01)
    assert done.converged and done.reason in ("gain", "gradient")
    short = fit_label_regularized(rows, WIDE, 0.05, 1.0, reg_param=0.01, max_iter=2)
    assert not short.converged and short.reason == "iterations"
    few = fit_label_regularized(rows, WIDE, 0.05, 1.0, reg_param=0.01, max_evals=3, tol=0.0)
    assert not few.converged and few.reason == "evaluations"
    svm = fit_many(rows, WIDE, [Fit("svm", "hinge", reg_param=0.01, scale=False)], max_iter=3)[0]
    assert not svm.converged and svm.reason == "iterations"


def newton_fits(reg):
    return [
        Fit("all", "logistic", reg_param=reg), Fit("raw", "logistic", reg_param=reg, scale=False), Fit("fold", "logistic", fold_col="fold", left_out=1, reg_param=reg),
        Fit("some", "logistic", reg_param=reg, only=(0, 2, 5)),
    ]


def test_newton_finds_the_engines_optimum(rows, vector_rows):
    from pyspark.ml.classification import LogisticRegression

    found = {f.fit.name: f for f in fit_newton(rows, WIDE, newton_fits(0.01))}
    for name, data, scaled in (("all", vector_rows, True), ("raw", vector_rows, False), ("fold", vector_rows.filter("fold <> 1"), True)):
        engine = LogisticRegression(regParam=0.01, fitIntercept=False, standardization=scaled, tol=1e-14, maxIter=500).fit(data)
        assert found[name].converged
        # the engine's own steps end some 1e-7 before the optimum; the next test looks at the gradient
        assert np.array(found[name].model.weights) == pytest.approx(engine.coefficients.toArray(), abs=1e-6)
    assert {j for j, w in enumerate(found["some"].model.weights) if w} <= {0, 2, 5}


def test_newton_gradient_vanishes_and_steps_are_few(rows, matrix):
    x, y, fold = matrix
    std = x.std(axis=0, ddof=1)
    for f in fit_newton(rows, WIDE, newton_fits(0.01)):
        keep = fold != 1 if f.fit.name == "fold" else np.ones(len(y), bool)
        scale = np.ones(D) if f.fit.name == "raw" else x[keep].std(axis=0, ddof=1)
        w = np.array(f.model.weights) * scale
        z = x[keep] / scale
        grad = z.T @ (1 / (1 + np.exp(-z @ w)) - y[keep]) / keep.sum() + 0.01 * w
        inside = [0, 2, 5] if f.fit.name == "some" else range(D)
        assert np.abs(grad[list(inside)]).max() < 1e-9
        assert f.evaluations <= 15
    assert std.min() > 0


def test_newton_on_separable_rows_stops(spark):
    rows = spark.createDataFrame([(i, float(i >= 10), float(i) - 9.5, 0.0) for i in range(20)], "id long, label double, a double, b double")
    free, held_back = fit_newton(rows, FeatureSet.wide(["a", "b"]), [Fit("free", "logistic"), Fit("ridge", "logistic", reg_param=0.1)], max_iter=12)
    assert held_back.converged and held_back.model.weights[0] > 0 and held_back.model.weights[1] == 0.0
    assert np.isfinite(free.model.weights).all() and free.losses == sorted(free.losses, reverse=True)


def test_minibatches_read_their_buckets(rows):
    from faintlabel.learning import buckets

    table = buckets.Bucketed.write(rows.select("id", "label", *WIDE.columns), "id", 20, seed=5)
    n = rows.count()
    with table:
        parts = [table.sample(step, 0.25, 42) for step in range(1, 9)]
        shares = [p.count() / n for p in parts]
        assert 0.15 < sum(shares) / len(shares) < 0.35
        assert len({tuple(sorted(table.drawn(step, 0.25, 42))) for step in range(1, 9)}) > 4
        plan = parts[0]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket", "_bucket")  # folders left out, not rows filtered
        read = {r[0] for r in parts[0].select(F.input_file_name()).distinct().collect()}
        assert len(read) == len(table.drawn(1, 0.25, 42)) < 12
        assert table.rows.count() == n


def test_minibatch_fit_follows_plain_steps(rows, matrix):
    from faintlabel.learning import buckets

    fit = fit_minibatch(rows, WIDE, 0.05, 1.0, reg_param=0.01, step=0.5, iterations=6, batch_fraction=0.3, n_buckets=16, tol=0.0)
    data = rows.select("id", "label", *WIDE.columns).toPandas()
    x, y = data[list(WIDE.columns)].to_numpy(float), data["label"].to_numpy()
    of = buckets.bucket_numbers(data["id"].tolist(), 16, 42)
    std = x.std(axis=0, ddof=1)
    z, w, read = x / std, np.zeros(D), 0
    for i in range(1, 7):
        drawn = set(buckets.drawn_buckets(i, 0.3, 42, 16))
        inside = np.array([b in drawn for b in of])
        read += inside.sum()
        pos, unl = inside & (y == 1), inside & (y == 0)
        if not pos.any() or not unl.any():
            continue
        s = 1 / (1 + np.exp(-z @ w))
        p = s[unl].mean()
        slope = (1 - 0.05) / (1 - p) - 0.05 / p
        push = slope * (s[unl] * (1 - s[unl])) @ z[unl] / unl.sum()
        w = w - 0.5 / np.sqrt(i) * ((s[pos] - 1) @ z[pos] / pos.sum() + 0.01 * w + push)
    assert np.array(fit.model.weights) == pytest.approx(w / std, abs=1e-9)
    assert fit.rows_read == read < 0.6 * 6 * len(y)


def test_empty_batches_leave_the_weights_alone(rows):
    done = fit_minibatch(rows, WIDE, 0.05, 1.0, iterations=4, batch_fraction=0.0, n_buckets=8)
    assert set(done.model.weights) == {0.0} and done.rows_read == 0 and done.losses == []


def test_entries_equal_wide_columns(rows):
    """Fits, Naive Bayes, scores, moments and the dense form from index and value arrays."""
    from faintlabel.operators import features as FE

    kept = F.filter(F.transform(WIDE.array(rows), lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: e["v"] != 0)
    sparse = rows.select("id", "label", "fold", kept.alias("_e")).select("id", "label", "fold", F.col("_e.i").alias("at"), F.col("_e.v").alias("there")).cache()
    fs = FeatureSet.entries("at", "there", D)
    a, b = ({r["label"]: list(r["sums"]) for r in label_sums(df, f, []).collect()} for df, f in ((rows, WIDE), (sparse, fs)))
    assert a == b
    m = LinearModel(tuple(W), -0.2).without_threshold()
    x = rows.select("id", F.round(m.predict(rows, WIDE), 9).alias("s"), WIDE.at(rows, 4).alias("x"), WIDE.array(rows).alias("d"))
    y = sparse.select("id", F.round(m.predict(sparse, fs), 9).alias("s"), fs.at(sparse, 4).alias("x"), fs.array(sparse).alias("d"))
    assert x.exceptAll(y).count() == 0
    s, t = ({r["feature"]: r["std"] for r in FE.feature_std(df, f).collect()} for df, f in ((rows, WIDE), (sparse, fs)))
    assert s == pytest.approx(t)
    p, q = (fit_label_regularized(df, f, 0.05, 1.0, reg_param=0.001, max_iter=4).model.weights for df, f in ((rows, WIDE), (sparse, fs)))
    assert p == pytest.approx(q, abs=1e-8)
    bad = FeatureSet.entries("at", "there", 3)
    with pytest.raises(Exception, match="indices must be"):
        fit_label_regularized(sparse, bad, 0.05, 1.0, max_iter=1)


def test_sparse_vectors_equal_wide_columns(rows, vector_rows):
    """Scores, lookups, moments and masks go through the stored entries of sparse rows."""
    from faintlabel.operators import features as FE

    packed = FeatureSet.in_column("features", D)
    kinds = {type(r["features"]).__name__ for r in vector_rows.select("features").collect()}
    assert kinds == {"SparseVector", "DenseVector"}
    m = LinearModel(tuple(W), -0.2).without_threshold()
    a = rows.select("id", F.round(m.predict(rows, WIDE), 9).alias("s"), WIDE.at(rows, 4).alias("x"))
    b = vector_rows.select("id", F.round(m.predict(vector_rows, packed), 9).alias("s"), packed.at(vector_rows, 4).alias("x"))
    assert a.exceptAll(b).count() == 0
    x = {r["feature"]: (r["mean"], r["std"]) for r in FE.feature_std(rows, WIDE).collect()}
    y = {r["feature"]: (r["mean"], r["std"]) for r in FE.feature_std(vector_rows, packed).collect()}
    assert all(x[j] == pytest.approx(y[j]) for j in range(D))
    masked = FE.subset(vector_rows, [4, 1], sparse=True, size=D)
    sums = {r["label"]: list(r["sums"]) for r in label_sums(masked, packed, []).collect()}
    full = {r["label"]: list(r["sums"]) for r in label_sums(rows, WIDE, []).collect()}
    for y0, s in sums.items():
        assert s == [v if j in (1, 4) else 0.0 for j, v in enumerate(full[y0])]


# ---- Naive Bayes --------------------------------------------------------------------------------------------------


def test_nb_matches_the_library(rows, vector_rows):
    want = NaiveBayes(smoothing=1.0).fit(vector_rows)
    got = {r["label"]: r for r in nb_params(rows, WIDE).collect()}
    for y in (0, 1):
        assert got[float(y)]["log_prior"] == pytest.approx(want.pi[y])
        np.testing.assert_allclose(got[float(y)]["log_theta"], want.theta.toArray()[y], rtol=1e-12)
    m = fit_nb(rows, WIDE)
    mine = rows.select("id", F.when(m.margins(rows, WIDE)[0] > 0, 1.0).otherwise(0.0).alias("prediction"))
    assert mine.exceptAll(want.transform(vector_rows).select("id", "prediction")).count() == 0


def test_nb_packed_equals_wide(rows, vector_rows):
    packed = FeatureSet.in_column("features", D)
    a = {r["label"]: (r["n"], list(r["sums"])) for r in label_sums(rows, WIDE, []).collect()}
    b = {r["label"]: (r["n"], list(r["sums"])) for r in label_sums(vector_rows, packed, []).collect()}
    assert a == b


def test_nb_rejects_negative_features(rows):
    with pytest.raises(Exception, match="features >= 0"):
        fit_nb(rows.withColumn("f2", F.lit(-1)), WIDE)


def test_bag_models_equal_models_of_the_written_bags(rows):
    bagging = B.assign_bags(rows, 7)
    shared = bag_models(bag_sums(bagging, WIDE), D)
    written = B.share_over_bags(bagging.rows, bagging)
    for b in range(bagging.n_bags):
        np.testing.assert_allclose(shared[b].weights, fit_nb(written.filter(F.col("bag_id") == b), WIDE).weights, rtol=1e-12)


def repeated_rows(spark):
    rows = [
        (i, i % 3, (i // 3) % 2, None if i % 7 == 0 else float(i % 5 == 0), i % 4, None if i % 2 else float(i % 3), float(i % 2))
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "id long, a int, b int, label double, fold int, bag double, truth double")


def test_equal_rows_are_added_up(spark, monkeypatch):
    df = repeated_rows(spark)
    fs = FeatureSet.wide(["a", "b"])
    fits = [
        Fit(f"{kind}{left}{bag}", kind, fold_col="fold", left_out=left, bag_col=bag, bag=1 if bag else None, p_tilde=0.1, reg_param=0.01)
        for kind in ("pu", "logistic", "hinge") for left in (None, 2) for bag in (None, "bag")
    ]
    w = np.random.default_rng(0).normal(size=(len(fits), 2))
    scorers = [Scorer(str(i), LinearModel((1.0, -1.5), 0.2 - i), "label", "fold" if i else None, i) for i in range(3)]
    with counted(df, fs, ["bag", "fold", "label", "truth"]) as (table, cells):
        assert table.count() == 6 and sum(sum(r["_counts"]) for r in table.collect()) == 600
        assert np.allclose(pass_sums(table, fs, fits, w, cells=cells), pass_sums(df, fs, fits, w), rtol=1e-12, atol=1e-12)
        assert np.allclose(inverse_std(table, fs, fits, cells), inverse_std(df, fs, fits), rtol=1e-12)
        got = prediction_counts(table, fs, scorers, "truth", cells)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, prediction_counts(df, fs, scorers, "truth").collect()))
    with counted(df.withColumn("a", F.col("a") + 0.5), fs, ["label"]) as (table, cells):
        assert cells is None and table.count() == 600

    seen = []
    sums = training.arrow_sums
    monkeypatch.setattr(training, "arrow_sums", lambda rows, *rest: seen.append(rows.count()) or sums(rows, *rest))
    fit_many(df, fs, fits[:2], max_iter=3)
    fit_label_regularized_sgd(df, fs, 0.1, 1.0, iterations=3)
    assert set(seen) == {6}  # a pass reads each distinct feature row once


def test_counted_rows_travel_in_blocks(spark, monkeypatch):
    df = repeated_rows(spark).withColumn("a", F.col("a").cast("long") * 3_000_000_000 - 5)
    fs = FeatureSet.wide(["a", "b"])
    fits = [
        Fit(f"{label}{kind}{left}{bag}", kind, label, "fold", left, "bag" if bag else None, bag, p_tilde=0.1)
        for label in ("label", "truth") for kind in ("pu", "logistic", "hinge") for left in (None, 2) for bag in (None, 1)
    ]
    w = np.random.default_rng(1).normal(size=(len(fits), 2)) * [1e-9, 1]
    scorers = [Scorer(str(i), LinearModel((1e-10, -1.5), 0.2 - i), "label", "fold" if i else None, i) for i in range(3)]
    names = ["bag", "fold", "label", "truth"]
    with counted(df, fs, names) as (table, cells), packed(table, fs, cells, ["label", "truth"]) as blocks:
        got = blocks.collect()
        assert len(got) == 6 and len({r["_segment"] for r in got}) == 6  # a row per combination of the labels, not per feature row
        plain = pass_sums(df, fs, fits, w)
        np.testing.assert_allclose(pass_sums(table, fs, fits, w, cells=cells, blocks=blocks), plain, rtol=1e-12, atol=1e-9)
        np.testing.assert_allclose(inverse_std(blocks, fs, fits, cells), inverse_std(df, fs, fits), rtol=1e-12)
        want = prediction_counts(df, fs, scorers, "truth").collect()
        assert Counter(map(tuple, prediction_counts(blocks, fs, scorers, "truth", cells).collect())) == Counter(map(tuple, want))
        whole = blocks.toArrow().to_batches()
        monkeypatch.setattr(repeats, "PART_CELLS", 20)  # several parts of a block
        assert sum(p.rows().sum() for batch in whole for p in repeats.parts(batch, fs, names, cells)) == 600
        assert max(p.counts.size for batch in whole for p in repeats.parts(batch, fs, names, cells)) <= 20

    seen = []
    plain_sums = training.sum_over_rows
    monkeypatch.setattr(training, "sum_over_rows", lambda rows, *rest: seen.append(rows.columns) or plain_sums(rows, *rest))
    fit_many(df, fs, fits[:2], max_iter=2)
    fit_label_regularized_sgd(df, fs, 0.1, 1.0, iterations=2)
    assert all("_values" in columns for columns in seen)  # every pass reads blocks


def test_small_segments_are_shared_among_tasks(spark):
    fs = FeatureSet.wide(["a", "b"])
    i = F.col("id")
    many = F.when(i < 20_000, 0).otherwise(1 + i % 40).cast("double")  # a large segment and 40 small ones
    df = spark.range(24_000).select((i % 997).cast("int").alias("a"), (i % 61).cast("int").alias("b"), many.alias("label"))
    with repeats.blocked(df, fs, ["label"], ["label"]) as (_, cells, blocks):
        assert len(cells) == 41
        n = [r["count"] for r in blocks.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(n) == 8 and max(n) <= 12
        sums = {r["label"]: (r["n"], list(r["sums"])) for r in cell_sums(blocks, fs, cells)}
    assert sums == {r["label"]: (r["n"], list(r["sums"])) for r in label_sums(df, fs, []).collect()}


def test_losses_by_products_of_factors():
    rng = np.random.default_rng(5)
    n = np.sort(rng.choice([1.0, 2.0, 7.0], 3_000))
    u = rng.normal(size=(3_000, 4)) * [0.001, 1, 30, 400]
    total, slope = fits._terms("logistic", False, u, n)
    np.testing.assert_allclose(total, n @ np.logaddexp(0, u), rtol=1e-12)
    np.testing.assert_allclose(slope, 0.5 + 0.5 * np.tanh(u / 2), atol=1e-15)


def test_cells_tell_bad_labels(spark):
    fs = FeatureSet.wide(["a"])
    for bad in (2.0, float("nan")):
        df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, bad), (4, None)], "a int, label double")
        with pytest.raises(ValueError, match="1 rows of label have a label other"):
            fit_many(df, fs, [Fit("x", "logistic")])
    with pytest.raises(ValueError, match="no unlabeled rows"):
        fit_many(spark.createDataFrame([(1, 1.0), (2, None)], "a int, label double"), fs, [Fit()])


def test_a_pass_of_svm_fits_leaves_counted_rows_as_they_are(monkeypatch):
    fs = FeatureSet.wide(["a", "b"])
    cells = repeats.Cells(("fold", "label"), np.array([[f, y] for f in (0.0, 1.0) for y in (0.0, 1.0)]))
    rng = np.random.default_rng(3)
    x, cell, n = rng.integers(0, 9, (200, 2)), rng.integers(0, 4, 200), rng.choice([1, 2, 70_000], 200)
    order = np.lexsort((x[:, 1], x[:, 0]))
    columns = {"_segment": np.zeros(200, int), "_cell": cell[order], "_n": n[order], "a": x[order, 0], "b": x[order, 1]}
    made = zip(*repeats._block_rows(pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()}), fs))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    blocks = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(made, kinds)], names=["_segment", "_values", "_row", "_cells", "_counts"])
    svms = [Fit(str(f), "hinge", fold_col="fold", left_out=f) for f in (0, 1)]
    w = np.array([[0.2, -0.1], [-0.3, 0.15]])

    def plain(i: int) -> np.ndarray:
        told = {"fold": cells.values[cell[i], 0], "label": cells.values[cell[i], 1], "a": x[i, 0], "b": x[i, 1]}
        return batch_sums(pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in told.items()}), fs, svms, w)

    want = sum(n[i] * plain(i) for i in range(200))
    weighted = []
    monkeypatch.setattr(DenseBlock, "weighted", lambda self, n: weighted.append(len(n)) or DenseBlock(self.x * n[:, None]))
    np.testing.assert_allclose(batch_sums(blocks, fs, svms, w, cells), want, rtol=1e-9)
    assert not weighted
