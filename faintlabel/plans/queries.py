"""The catalogue: every operator as a query over the given tables.

Each query reads whole tables and returns scalar columns.  ``oracle.py`` holds the SQL counterparts under the same names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.functions.scalar import rounded, sigmoid, weighted_sum
from faintlabel.learning import ranking as R
from faintlabel.learning.bayes import bag_models, bag_sums, fit_nb, nb_params
from faintlabel.learning.committee import Committee
from faintlabel.learning.fits import Fit, loss_and_gradient
from faintlabel.learning.models import LinearModel, load_model, save_model
from faintlabel.learning.solvers import pu_step
from faintlabel.learning.training import evaluate, fit_label_regularized, fit_label_regularized_sgd, fit_many, fit_minibatch, fit_newton, inverse_std, label_check
from faintlabel.operators import bags as B
from faintlabel.operators import features as FE
from faintlabel.operators import labeling as L
from faintlabel.operators import metrics as M
from faintlabel.operators import sampling as S
from faintlabel.plans import committees as C
from faintlabel.plans import experiments as X
from faintlabel.session import held, new_folder, settled
from faintlabel.sources import arff, libsvm, results
from faintlabel.sources import tables as T

FEATURES = T.APPSEC_FEATURES
BINARY = [0.0, 1.0]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def dbl(name: str):
    return rounded(F.col(name)).alias(name)


def _labeled(spark, d) -> DataFrame:
    return L.label_2016(T.appsec(spark, d)).select("id", "label", *FEATURES)


def _bit_classes(spark, d) -> DataFrame:
    """Sign bits with class 3 as the minority."""
    return T.bits(spark, d).withColumn("label", F.when(F.col("group") == 3, 1.0).otherwise(0.0)).select("id", "label", "features")


def given_weights(size: int = 10) -> list[float]:
    """Weights by formula, so that no solver is involved."""
    return [math.sin(j + 1) / 10 for j in range(size)]


# ---- sources and sinks --------------------------------------------------------------------------------------------


@query
def scan_appsec(spark, d):
    return T.appsec(spark, d)


@query
def arff_sparse(spark, d):
    """Sign bits written as sparse text (attribute 0 is the class) and read back."""
    path = new_folder(spark, "sparse-arff")
    arff.write_sparse(T.bits(spark, d), path, T.vector_features())
    rows, names = arff.read_sparse(spark, path)
    fs = arff.sparse_features(names)
    totals = FE.nonzero_long(rows, fs, ["label"], mark_rows=True).groupBy("label", "feature").agg(F.sum("value").alias("total"))
    sizes = totals.filter(F.col("feature") == FE.ROW_MARK).select("label", F.col("total").cast("bigint").alias("n"))
    every = sizes.withColumn("feature", F.explode(F.sequence(F.lit(1), F.lit(fs.size - 1))))
    return every.join(totals, ["label", "feature"], "left").select("label", big("feature"), "n", F.coalesce("total", F.lit(0.0)).alias("total"))


@query
def arff_dense(spark, d):
    """``class,f0..f9`` written with all classes; one class must be gone after reading."""
    path = new_folder(spark, "dense-arff")
    arff.write_dense(T.appsec(spark, d), path, ["class", "id", *FEATURES], ["class", "id", *FEATURES])
    rows, names = arff.read_dense(spark, path)
    fs = FE.FeatureSet.in_column("features", len(names) - 1)
    x = fs.array(rows)
    return rows.select(x[0].cast("bigint").alias("id"), "label", *[x[i + 1].cast("int").alias(c) for i, c in enumerate(FEATURES)])


@query
def genome_scan(spark, d):
    """``family-id,f0..f9`` rows."""
    path = new_folder(spark, "families")
    rows = L.label_2016(T.appsec(spark, d)).filter("label = 1")
    rows = rows.withColumn("member", F.concat_ws("-", "family", F.col("id").cast("string")))
    arff.write_dense(rows, path, ["member", *FEATURES], ["member", *FEATURES])
    read = arff.read_families(spark, path)
    x = FE.FeatureSet.in_column("features", len(FEATURES)).array(read)
    return read.select("family", "member", "label", *[x[i].cast("int").alias(c) for i, c in enumerate(FEATURES)])


@query
def libsvm_roundtrip(spark, d):
    """Train and test text of three and of five folds with the row key as feature 0, then read back."""
    base = new_folder(spark, "folds")
    rows = _labeled(spark, d)
    for k in (3, 5):
        rows = S.kfold_assign(rows, k, 11, col=f"fold{k}")
    libsvm.write_folds(rows, T.appsec_features(), base, {3: "fold3", 5: "fold5"}, "id")
    read = libsvm.read_parts(spark, base)
    x = FE.FeatureSet.entries("indices", "values", len(FEATURES) + 1).array(read)
    laid = read.select("part", "label", x.alias("x"))
    return laid.select("part", F.col("x")[0].cast("bigint").alias("id"), "label", *[F.col("x")[i + 1].cast("int").alias(c) for i, c in enumerate(FEATURES)])


@query
def save_predictions(spark, d):
    """Prediction rows at given weights, written twice: the second write must leave the first alone."""
    df = _labeled(spark, d)
    model = LinearModel(tuple(given_weights()))
    pairs = df.select(model.predict(df, T.appsec_features()).alias("prediction"), "label")
    path = new_folder(spark, "predictions")
    results.save_predictions(pairs, path)
    results.save_predictions(pairs.limit(1), path)
    return results.read_predictions(spark, path).groupBy("prediction", "label").agg(F.count("*").alias("n"))


@query
def model_roundtrip(spark, d):
    """A model whose weights are the feature means, stored and loaded."""
    means = FE.feature_std(_labeled(spark, d), T.appsec_features()).orderBy("feature").collect()
    path = new_folder(spark, "model")
    save_model(spark, LinearModel(tuple(r["mean"] for r in means), 0.25), path)
    m = load_model(spark, path)
    rows = [(i, float(w), m.intercept, m.num_features, m.num_classes, m.threshold) for i, w in enumerate(m.weights)]
    out = spark.createDataFrame(rows, "feature bigint, weight double, intercept double, num_features bigint, num_classes bigint, threshold double")
    return out.withColumn("weight", rounded(F.col("weight")))


@query
def experiment_results(spark, d):
    """Result rows of one run written twice and of another once, read back."""
    counts = L.class_counts(_labeled(spark, d)).filter("source = 'label'")
    rows = counts.select(
        F.lit("run").alias("run_id"), F.lit("counts").alias("experiment"),
        F.create_map(F.lit("label"), F.col("value").cast("int").cast("string")).alias("params"), F.lit(0).alias("fold"),
        F.lit("none").alias("model"), F.lit("rows").alias("metric"), F.col("n").cast("double").alias("value"),
    )
    path = new_folder(spark, "results")
    for run, fold in (("run", 0), ("run", 0), ("again", 1)):
        results.append_results(rows.withColumns({"run_id": F.lit(run), "fold": F.lit(fold)}), path)
    return results.read_results(spark, path).select(
        "run_id", "experiment", F.col("params")["label"].alias("label"), big("fold"), "model", "metric", "value"
    )


# ---- labels and filters -------------------------------------------------------------------------------------------


@query
def label_by_class(spark, d):
    return L.label_by_class(T.appsec(spark, d)).select("id", "label")


@query
def label_by_threshold(spark, d):
    return L.label_by_threshold(T.appsec(spark, d), 4, 10).select("id", "label")


@query
def label_2016(spark, d):
    return L.label_2016(T.appsec(spark, d)).select("id", "label")


@query
def label_both_years(spark, d):
    return L.label_both_years(T.appsec(spark, d)).select("id", "label", "real_label")


@query
def label_highconf_rest(spark, d):
    return L.label_highconf_rest(T.appsec(spark, d)).select("id", "label", "real_label")


@query
def temporal_holdout(spark, d):
    df = T.appsec(spark, d)
    base = L.base_set(df).select("id", F.lit("base").alias("part"), "label")
    return base.unionByName(L.temporal_holdout(df).select("id", F.lit("temporal").alias("part"), "label"))


@query
def changed_labels(spark, d):
    return L.changed_rows(L.label_both_years(T.appsec(spark, d))).select("id", "label", "real_label")


@query
def relabel_to_truth(spark, d):
    """Training labels replaced by the later ones."""
    return L.relabel_to_truth(L.label_both_years(T.appsec(spark, d))).select("id", "label", "real_label")


@query
def label_report(spark, d):
    """What keeps label columns from being fitted: other values than 0 and 1, no row with label 0."""
    df = L.label_both_years(T.appsec(spark, d)).withColumns({
        "shifted": F.col("label") + 1, "only_positive": F.when(F.col("label") == 1, 1.0), "doubtful": F.col("real_label") * 2 - 1,
    })
    out = label_check(df, ["label", "real_label", "shifted", "only_positive", "doubtful"])
    return out.select("column", big("n"), big("n_bad"), big("n_unlabeled"), "problem")


@query
def shape_report(spark, d):
    """Rows whose feature arrays do not fit a model of 64 weights, and the first size that is wrong."""
    rows = T.vectors(spark, d).select("id", F.when(F.col("id") % 97 == 0, F.slice("features", 1, 60)).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("features")).alias("features"))
    model = LinearModel(tuple(given_weights(64)), 0.0)
    return model.shape_report(rows, "features").select("problem", big("size"), big("n"))


@query
def changed_label_counts(spark, d):
    return L.changed_counts(L.label_both_years(T.appsec(spark, d))).select(big("n"), big("n_changed"), big("n_to_positive"))


@query
def class_counts(spark, d):
    """Judged and unjudged documents: the truth is NULL where nobody looked."""
    return L.class_counts(T.docs(spark, d)).select("source", "value", big("n"))


@query
def union_roles(spark, d):
    # the count and the three roles read one narrow table: labels are worked out once
    df = S.inject_noise(settled(_labeled(spark, d).select("id", "label")), 0.01).select("id", "label", "real_label")
    hidden = df.filter("real_label = 1")
    return L.union_roles(
        df.filter("label = 1").withColumn("role", F.lit("labeled")),
        hidden.withColumn("role", F.lit("hidden")),
        df.filter("label = 0 AND real_label IS NULL").withColumn("role", F.lit("unlabeled")),
    )


# ---- features -----------------------------------------------------------------------------------------------------


@query
def feature_assemble(spark, d):
    df = T.appsec(spark, d)
    vec = FE.assemble(df, FE.feature_columns(df), ["id"])
    out = FE.unpivot(vec, FE.FeatureSet.in_column("features", 10), ["id"])
    return out.select("id", big("feature"), "value")


@query
def feature_subset(spark, d):
    """Indices 7, 2, 5 in this order, and the same with the old width kept."""
    df = T.appsec(spark, d)
    vec = FE.assemble(df, FE.feature_columns(df), ["id"])
    narrow = FE.unpivot(FE.subset(vec, [7, 2, 5]), FE.FeatureSet.in_column("features", 3), ["id"])
    wide = FE.unpivot(FE.subset(vec, [7, 2, 5], sparse=True, size=10), FE.FeatureSet.in_column("features", 10), ["id"])
    both = narrow.withColumn("form", F.lit("dense")).unionByName(wide.withColumn("form", F.lit("sparse")))
    return both.select("form", "id", big("feature"), "value")


@query
def feature_subset_per_bag(spark, d):
    """Bag b keeps the features b, b+3 and b+6 (modulo ten)."""
    bagging = B.assign_bags(_labeled(spark, d), 7)
    bags = B.share_over_bags(bagging.rows, bagging)
    lists = spark.range(bagging.n_bags).select(
        F.col("id").cast("int").alias("bag_id"),
        F.array(*[((F.col("id") + s) % 10).cast("int") for s in (0, 3, 6)]).alias("indices"),
    )
    out = FE.subset_per_bag(bags, lists, T.appsec_features(), n_bags=bagging.n_bags)
    return out.select(big("bag_id"), "id", *[F.col("features")[i].alias(f"x{i}") for i in range(3)])


@query
def feature_prefix_filter(spark, d):
    """Features of the part table whose brand name does not start with the given prefixes."""
    names = T.read_table(spark, d, "part").select(F.col("p_brand").alias("name")).where("name is not null").distinct()
    return FE.named_features(names).where(~FE.has_prefix(F.col("name"), ["Brand#1", "Brand#3"])).select(big("feature"), "name")


@query
def discrete_check(spark, d):
    counts = FE.discrete_report(T.appsec(spark, d), T.appsec_features(), 0, 9).withColumn("source", F.lit("counts"))
    reals = FE.discrete_report(T.vectors(spark, d), T.vector_features()).withColumn("source", F.lit("vectors"))
    return counts.unionByName(reals).select("source", big("feature"), big("n_not_whole"), big("n_out_of_range"))


@query
def feature_std(spark, d):
    wide = FE.feature_std(_labeled(spark, d), T.appsec_features()).withColumn("source", F.lit("counts"))
    packed = FE.feature_std(T.vectors(spark, d), T.vector_features()).withColumn("source", F.lit("vectors"))
    return wide.unionByName(packed).select("source", big("feature"), dbl("mean"), dbl("std"))


# ---- sampling, folds, bags ----------------------------------------------------------------------------------------


@query
def hash_sample(spark, d):
    return S.hash_sample(T.appsec(spark, d), 0.05, 11).select("id")


@query
def hash_split(spark, d):
    return S.hash_split(T.appsec(spark, d), [0.67, 0.33], 11).select("id", big("split"))


@query
def kfold_assign(spark, d):
    return S.kfold_assign(T.appsec(spark, d), 5, 11).select("id", big("fold"))


@query
def inject_noise(spark, d):
    return S.inject_noise(_labeled(spark, d), 0.02, 0.5).select("id", "label", "real_label")


@query
def undersample(spark, d):
    rows = S.kfold_assign(_labeled(spark, d), 3, 11)
    return S.undersample(rows, fold_col="fold").select("id", "label", big("fold"), big("train_fold"))


@query
def balanced_bags(spark, d):
    return B.balanced_bags(_labeled(spark, d).select("id", "label"), 7).select(big("bag_id"), "id", "label")


@query
def bag_dropping(spark, d):
    bagging = B.assign_bags(_labeled(spark, d).select("id", "label"), 7)
    bags = B.share_over_bags(bagging.rows, bagging)
    return B.drop_bags(bags, B.kept_bags(spark, bagging.n_bags, 0.5, 7)).select(big("bag_id"), "id", "label")


@query
def family_one_shot(spark, d):
    df = L.label_2016(T.appsec(spark, d)).select("id", "family", "label")
    out = S.family_one_shot(df.filter("label = 1"), df.filter("label = 0"))
    return out.select("id", "family", "role", "label", "real_label")


@query
def random_features(spark, d):
    """k random features out of those that occur (non-zero) in the table."""
    seen = FE.nonzero_long(T.bits(spark, d), T.vector_features(), ["id"])
    return S.random_subset(seen, 12, 7).select(big("rank"), big("feature"))


# ---- ranking ------------------------------------------------------------------------------------------------------


@query
def contingency(spark, d):
    return R.contingency(_labeled(spark, d), T.appsec_features()).select(big("feature"), "value", "label", big("n"))


@query
def mi_relevance(spark, d):
    return R.mi_relevance(_labeled(spark, d), T.appsec_features(), labels=BINARY).select(big("feature"), dbl("mi"))


@query
def mi_relevance_sparse(spark, d):
    """The sign bits as sparse vectors: only stored entries are counted."""
    from pyspark.ml.feature import VectorAssembler

    bits = T.bits(spark, d)
    names = [f"b{i}" for i in range(T.VECTOR_SIZE)]
    wide = bits.select("label", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    sparse = VectorAssembler(inputCols=names, outputCol="features").transform(wide).select("label", "features")
    return R.mi_relevance(sparse, T.vector_features()).select(big("feature"), dbl("mi"))


@query
def mi_redundancy(spark, d):
    return R.mi_redundancy(_labeled(spark, d), T.appsec_features(), 1, labels=BINARY).select(big("feature"), dbl("mi"), dbl("cmi"))


@query
def mim_topk(spark, d):
    scores = R.mi_relevance(T.bits(spark, d), T.vector_features())
    return R.top_features(scores, 10).select(big("rank"), big("feature"), dbl("score"))


def _rank_query(criterion: str):
    def run(spark, d):
        fs = T.vector_features()
        out = R.greedy_ranking(T.bits(spark, d), fs, criterion, fs.size, labels=BINARY)
        return out.select(big("rank"), big("feature"), dbl("score"))

    return run


for _c in ("mifs", "jmi", "mrmr", "icap", "cmim", "if"):
    QUERIES[f"rank_{_c}"] = _rank_query(_c)


@query
def rank_cmim_lazy(spark, d):
    """The ranking of rank_cmim with the scores brought up to date only where they could win."""
    fs = T.vector_features()
    return R.lazy_cmim(T.bits(spark, d), fs, fs.size, labels=BINARY).ranking.select(big("rank"), big("feature"), dbl("score"))


def _bag_relevance(spark, d) -> DataFrame:
    bagging = B.assign_bags(_bit_classes(spark, d), 7)
    return R.mi_relevance(bagging.rows, T.vector_features(), ["bag_id"], labels=[0.0, 1.0], shared=bagging)


@query
def merged_ranking(spark, d):
    top = R.top_features(R.merged_scores(_bag_relevance(spark, d)), 10, "score")
    return top.select(big("rank"), big("feature"), dbl("score"))


@query
def topk_per_bag(spark, d):
    top = R.top_per_group(_bag_relevance(spark, d), "bag_id", 5, "mi")
    return top.select(big("bag_id"), big("rank"), big("feature"), dbl("score"))


@query
def svm_ranking(spark, d):
    """Signed weights after up to 100 subgradient steps."""
    return R.svm_ranking(T.bits(spark, d), T.vector_features()).select(big("feature"), dbl("score"))


# ---- models -------------------------------------------------------------------------------------------------------


@query
def nb_params_by_class(spark, d):
    p = nb_params(_labeled(spark, d), T.appsec_features())
    out = p.select("label", "log_prior", F.posexplode("log_theta").alias("feature", "log_theta"))
    return out.select("label", big("feature"), dbl("log_prior"), dbl("log_theta"))


QUERIES["nb_params"] = QUERIES.pop("nb_params_by_class")


@query
def nb_predict(spark, d):
    df = _labeled(spark, d)
    m = fit_nb(df, T.appsec_features()).without_threshold()
    scored = df.withColumn("margin", m.margins(df, T.appsec_features())[0])
    return scored.select(
        "id", rounded(sigmoid(F.col("margin"))).alias("p1"), F.when(F.col("margin") > 0, 1.0).otherwise(0.0).alias("prediction")
    )


def _objective(spark, d, divergence: str) -> DataFrame:
    fs = T.appsec_features()
    fit = Fit("given", "pu", p_tilde=0.05, lambda_u=2.0, reg_param=0.001, divergence=divergence)
    w = np.array(given_weights())
    with held(_labeled(spark, d)) as df:
        sums = evaluate(df, fs, fit, w, inverse_std(df, fs, [fit])[0])
    loss, grad = loss_and_gradient(fit, sums, w)
    rows = [("loss", -1, float(loss)), ("p_hat", -1, float(sums.p_hat()))] + [("gradient", j, float(g)) for j, g in enumerate(grad)]
    return spark.createDataFrame(rows, "item string, feature bigint, value double").withColumn("value", rounded(F.col("value")))


@query
def lrlr_objective(spark, d):
    return _objective(spark, d, "kl")


@query
def lrlr_objective_bh(spark, d):
    return _objective(spark, d, "bhattacharyya")


@query
def lrlr_sgd_step(spark, d):
    """One full-batch update from the given weights, and the penalty after it."""
    fs = T.appsec_features()
    fit = Fit("given", "pu", p_tilde=0.01, lambda_u=10.0, reg_param=0.01)
    w = np.array(given_weights())
    with held(_labeled(spark, d)) as df:
        sums = evaluate(df, fs, fit, w, inverse_std(df, fs, [fit])[0])
    w_next, penalty = pu_step(fit, sums, w, 1.0, 1)
    rows = [("penalty", -1, float(penalty))] + [("weight", j, float(v)) for j, v in enumerate(w_next)]
    return spark.createDataFrame(rows, "item string, feature bigint, value double").withColumn("value", rounded(F.col("value")))


@query
def lrlr_sgd_fit(spark, d):
    """Up to 100 full-batch steps from zero weights."""
    done = fit_label_regularized_sgd(_labeled(spark, d), T.appsec_features(), 0.05, 1.0, step=0.5)
    out = spark.createDataFrame(list(enumerate(done.model.weights)), "feature bigint, weight double")
    return out.select("feature", dbl("weight"))


@query
def mean_unlabeled_score(spark, d):
    df = S.kfold_assign(_labeled(spark, d), 3, 11)
    s = sigmoid(weighted_sum(T.appsec_features().scalars(df), given_weights()))
    out = df.groupBy("fold").agg(F.avg(F.when(F.col("label") == 0, s)).alias("p_hat"))
    return out.select(big("fold"), dbl("p_hat"))


@query
def lr_predict(spark, d):
    df = _labeled(spark, d)
    return df.select("id", LinearModel(tuple(given_weights()), -0.3).predict(df, T.appsec_features()).alias("prediction"))


@query
def lr_score(spark, d):
    df = _labeled(spark, d)
    model = LinearModel(tuple(given_weights()), -0.3).without_threshold()
    return df.select("id", rounded(model.predict(df, T.appsec_features())).alias("score"))


@query
def multinomial_predict(spark, d):
    """Three classes at given weights, with and without a bias per class."""
    df = _labeled(spark, d)
    fs = T.appsec_features()
    plain = tuple(math.sin(j + 1 + 10 * c) / 10 for c in range(2) for j in range(10))
    biased = tuple(v for c in range(2) for v in [*plain[10 * c : 10 * c + 10], 0.1 * (c + 1)])
    return df.select(
        "id",
        LinearModel(plain, 0.0, 10, 3).predict(df, fs).alias("plain"),
        LinearModel(biased, 0.0, 10, 3).predict(df, fs).alias("biased"),
    )


@query
def lrlr_fit(spark, d):
    """Label-regularized fit: final loss, gradient norm and weights."""
    df = _labeled(spark, d)
    fs = T.appsec_features()
    done = fit_label_regularized(df, fs, 0.05, 1.0, reg_param=0.001)
    rows = [("loss", -1, float(done.losses[-1])), ("iterations", -1, float(len(done.losses) - 1))]
    rows += [("weight", j, w) for j, w in enumerate(done.model.weights)]
    return spark.createDataFrame(rows, "item string, feature bigint, value double")


@query
def baseline_lr(spark, d):
    """Plain logistic regression with label-0 rows as negatives, on scaled features: Newton steps."""
    done = fit_newton(_labeled(spark, d), T.appsec_features(), [Fit("lr", "logistic")])[0]
    out = spark.createDataFrame(list(enumerate(done.model.weights)), "feature bigint, weight double")
    return out.select("feature", dbl("weight"))


@query
def lr_newton(spark, d):
    """Three features, no penalty and a small one, all rows and each fold left out: eight fits in the same passes."""
    fs = FE.FeatureSet.wide(FEATURES[:3])
    rows = S.kfold_assign(_labeled(spark, d), 3, 11).select("label", "fold", *FEATURES[:3])
    fits = [
        Fit(f"{out}/{reg}", "logistic", fold_col=None if out < 0 else "fold", left_out=None if out < 0 else out, reg_param=reg, scale=False)
        for out in (-1, 0, 1, 2) for reg in (0.0, 0.01)
    ]
    rows = [(*f.fit.name.split("/"), j, w) for f in fit_newton(rows, fs, fits) for j, w in enumerate(f.model.weights)]
    out = spark.createDataFrame([(int(a), float(b), j, w) for a, b, j, w in rows], "left_out bigint, reg double, feature bigint, weight double")
    return out.select("left_out", "reg", "feature", dbl("weight"))


@query
def lrlr_minibatch(spark, d):
    """A hundred steps on about a tenth of the rows each, read by bucket."""
    done = fit_minibatch(_labeled(spark, d), T.appsec_features(), 0.05, 1.0, step=0.5, tol=0.0)
    out = spark.createDataFrame([*enumerate(done.model.weights), (-1, float(done.rows_read))], "feature bigint, weight double")
    return out.select("feature", dbl("weight"))


@query
def baseline_svm(spark, d):
    """Linear SVM, 200 subgradient steps, regularisation .01, no intercept."""
    fit = Fit("svm", "hinge", reg_param=0.01, scale=False)
    m = fit_many(_labeled(spark, d), T.appsec_features(), [fit], max_iter=200)[0].model
    out = spark.createDataFrame([(j, w) for j, w in enumerate(m.weights)], "feature bigint, weight double")
    return out.select("feature", dbl("weight"))


# ---- committees ---------------------------------------------------------------------------------------------------


def _bag_committee(spark, d) -> tuple[DataFrame, Committee]:
    df = _labeled(spark, d)
    models = bag_models(bag_sums(B.assign_bags(df, 7), T.appsec_features()), len(FEATURES))
    return df, Committee([models[b] for b in sorted(models)])


@query
def committee_vote(spark, d):
    df, committee = _bag_committee(spark, d)
    return committee.score(df, T.appsec_features()).select("id", big("votes"), F.col("vote").alias("prediction"))


@query
def committee_expert(spark, d):
    df, committee = _bag_committee(spark, d)
    return committee.score(df, T.appsec_features()).select("id", dbl("certainty"), F.col("expert").alias("prediction"))


@query
def committee_avg_auprc(spark, d):
    fs = T.appsec_features()
    with held(_labeled(spark, d)) as df:
        models = bag_models(bag_sums(B.assign_bags(df, 7), fs), fs.size)
        committee = Committee([models[b] for b in sorted(models)])
        mean = committee.average_auprc(df, fs).select(F.lit("average").alias("rule"), F.col("average_auprc").alias("auprc"))
        return mean.unionByName(committee.areas(df, fs).select("rule", "auprc")).select("rule", dbl("auprc"))


@query
def committee_per_bag_features(spark, d):
    """Bag b sees the features b, b+3 and b+6 (modulo ten) only."""
    df = _labeled(spark, d)
    bagging = B.assign_bags(df, 7)
    lists = {b: [(b + s) % 10 for s in (0, 3, 6)] for b in range(bagging.n_bags)}
    models = bag_models(bag_sums(bagging, T.appsec_features()), len(FEATURES), indices=lists)
    scored = Committee([models[b] for b in sorted(models)]).score(df, T.appsec_features())
    return scored.select("id", big("votes"), dbl("certainty"), "vote", "expert")


@query
def committee_own_top_features(spark, d):
    """Each bag's model sees the five features that rank best in its own bag."""
    df = _bit_classes(spark, d)
    fs = T.vector_features()
    bagging = B.assign_bags(df, 7)
    lists: dict[int, list[int]] = {}
    for r in R.rank_bags(bagging, fs, "mim", 5).orderBy("bag_id", "rank").collect():  # bags x 5 rows
        lists.setdefault(r["bag_id"], []).append(r["feature"])
    models = bag_models(bag_sums(bagging, fs), fs.size, indices=lists)
    scored = Committee([models[b] for b in sorted(models)]).score(df, fs)
    return scored.select("id", big("votes"), dbl("certainty"), "vote", "expert")


@query
def committee_vote_linear(spark, d):
    """Four linear models at given weights; two against two is a tie and goes to class 0."""
    df = _labeled(spark, d)
    models = [LinearModel(tuple(math.sin((j + 1) * (b + 1)) for j in range(10)), -0.5) for b in range(4)]
    return Committee(models).score(df, T.appsec_features()).select("id", big("votes"), F.col("vote").alias("prediction"))


@query
def hetero_ensemble(spark, d):
    """A drawn technique per bag, all its ranked features, vote and expert areas on all rows."""
    df = _bit_classes(spark, d)
    committee, chosen = C.mixed_committee(B.assign_bags(df, 7), T.vector_features())
    areas = M.areas_hard(committee.score(df, T.vector_features()), prediction="vote").first()
    rows = [(b, t, r + 1, f, float(areas["auprc"])) for b, (t, ix) in sorted(chosen.items()) for r, f in enumerate(ix)]
    return spark.createDataFrame(rows, "bag_id bigint, technique string, rank bigint, feature bigint, auprc double")


@query
def hetero_draws(spark, d):
    """The technique that each bag draws."""
    bagging = B.assign_bags(_bit_classes(spark, d), 7)
    return C.technique_draws(spark, bagging.n_bags).select(big("bag_id"), "technique")


@query
def single_schemes(spark, d):
    """The six schemes that fit on one part and measure on another: single models, and committees over balanced bags."""
    rows = S.kfold_assign(_bit_classes(spark, d), 3, 11)
    fs = T.vector_features()
    with held(rows.filter("fold <> 0")) as train, held(rows.filter("fold = 0")) as test:
        bagging = B.assign_bags(train, 7)
        lists = {b: [b % fs.size, (7 * b + 3) % fs.size] for b in range(bagging.n_bags)}
        found = {
            "naive_bayes": C.measure_naive_bayes(train, test, fs),
            "svm": C.measure_svm(train, test, fs),
            "naive_bayes_committee": C.measure_naive_bayes_committee(bagging, test, fs),
            "naive_bayes_committee_lists": C.measure_naive_bayes_committee(bagging, test, fs, lists),
            "svm_committee": C.measure_svm_committee(bagging, test, fs),
            "mixed_committee": C.measure_mixed_committee(bagging, test, fs),
        }
        out = [(name, r["auprc"], r["auroc"], r["expert_auprc"] if "expert_auprc" in df.columns else None) for name, df in found.items() for r in df.collect()]
    return spark.createDataFrame(out, "scheme string, auprc double, auroc double, expert_auprc double")


@query
def committee_debug_dump(spark, d):
    """The two prediction lists that a committee of one member leaves behind."""
    df, fs = _labeled(spark, d), T.appsec_features()
    path = new_folder(spark, "debug")
    Committee([fit_nb(df, fs)]).expert_auprc(df, fs, debug_path=path).collect()
    lists = [results.read_predictions(spark, f"{path}/{name}").withColumn("list", F.lit(name)) for name in ("expert", "member")]
    return lists[0].unionByName(lists[1]).groupBy("list", "prediction", "label").agg(F.count("*").alias("n"))


# ---- metrics ------------------------------------------------------------------------------------------------------


def _nb_pairs(df: DataFrame) -> DataFrame:
    """Predictions of one Naive Bayes model on its own rows; ``score`` is the posterior of class 1."""
    m = fit_nb(df, T.appsec_features())
    margin = m.margins(df, T.appsec_features())[0]
    return df.withColumns({"prediction": F.when(margin > 0, 1.0).otherwise(0.0), "score": rounded(sigmoid(margin))})


@query
def pr_curve_binned(spark, d):
    """Curves of 100 bins for four models in three folds, from one mergeable sketch."""
    fs = T.appsec_features()
    df = S.kfold_assign(_labeled(spark, d), 3, 11)
    models = [LinearModel(tuple(math.sin((j + 1) * (b + 1)) / 10 for j in range(10)), -0.1 * b) for b in range(4)]
    scores = F.array(*[rounded(sigmoid(m.margins(df, fs)[0]), 9) for m in models])
    scored = df.select(big("fold"), "label", F.posexplode(scores).alias("model", "score"))
    out = M.binned_curve(M.score_sketch(scored, ["model", "fold"]), ["model", "fold"], 100)
    return out.select(big("model"), "fold", big("bin"), dbl("threshold"), dbl("recall"), dbl("precision"))


def _two_vintages(spark, d) -> DataFrame:
    return L.label_both_years(T.appsec(spark, d)).select("id", "label", "real_label", *FEATURES)


@query
def metrics_basic(spark, d):
    pairs = S.kfold_assign(_nb_pairs(_labeled(spark, d)), 3, 11)
    out = M.metrics_basic(pairs, ["fold"])
    return out.select(big("fold"), big("n"), *[dbl(c) for c in ("tp_rate_all", "recall", "precision", "f1_ref", "f1")])


@query
def confusion_matrix(spark, d):
    return M.confusion_matrix(_nb_pairs(_labeled(spark, d)), 2).select(big("actual"), big("predicted"), big("n"))


@query
def temporal_rate(spark, d):
    df = T.appsec(spark, d)
    m = fit_nb(L.base_set(df), T.appsec_features())
    later = L.temporal_holdout(df)
    pairs = later.withColumn("prediction", F.when(m.margins(later, T.appsec_features())[0] > 0, 1.0).otherwise(0.0))
    return M.positive_rate(pairs).select(dbl("rate"))


@query
def pos_total_recall(spark, d):
    rows = S.inject_noise(_labeled(spark, d), 0.02)
    pairs = _nb_pairs(rows).filter(L.any_positive(rows))
    return M.positive_rate(pairs).select(dbl("rate"))


@query
def changed_metrics(spark, d):
    pairs = L.changed_rows(_nb_pairs(_two_vintages(spark, d)))
    out = M.metrics_basic(pairs, label="real_label")
    return out.select(big("n"), *[dbl(c) for c in ("tp_rate_all", "precision", "f1_ref")])


@query
def auprc_hard(spark, d):
    pairs = S.kfold_assign(_nb_pairs(_labeled(spark, d)), 3, 11)
    a = M.areas_hard(pairs, ["fold"]).withColumn("curve_start", F.lit("spark"))
    b = M.areas_hard(pairs, ["fold"], curve_start="legacy").withColumn("curve_start", F.lit("legacy"))
    return a.unionByName(b).select("curve_start", big("fold"), dbl("auprc"))


@query
def auroc_hard(spark, d):
    pairs = S.kfold_assign(_nb_pairs(_labeled(spark, d)), 3, 11)
    return M.areas_hard(pairs, ["fold"]).select(big("fold"), dbl("auroc"))


@query
def auprc_score(spark, d):
    pairs = S.kfold_assign(_nb_pairs(_labeled(spark, d)), 3, 11)
    both = F.explode(
        F.array(
            F.struct(F.lit("spark").alias("curve_start"), F.col("auprc")),
            F.struct(F.lit("legacy").alias("curve_start"), F.col("auprc_legacy").alias("auprc")),
        )
    )
    out = M.areas_scored(pairs, ["fold"]).select("fold", "auroc", both.alias("a"))
    return out.select("a.curve_start", big("fold"), rounded(F.col("a.auprc")).alias("auprc"), dbl("auroc"))


@query
def pr_curve(spark, d):
    out = M.pr_curve(_nb_pairs(_labeled(spark, d)))
    return out.select(dbl("threshold"), dbl("recall"), dbl("precision"))


# ---- cross-validation with Naive Bayes, repeated in SQL -----------------------------------------------------------


def _nb_sweep(df, cases, metrics, truth) -> DataFrame:
    sweep = X.run_cases(df, T.appsec_features(), cases, "nb", metrics, truth=truth)
    return sweep.results.select(
        F.coalesce(F.col("params")["setting"], F.lit("all")).alias("setting"), big("fold"), "metric", dbl("value")
    )


@query
def cv_summary(spark, d):
    """Five folds of Naive Bayes at two noise levels: mean area over the folds."""
    df = _labeled(spark, d)
    counts = S.positive_counts(df)
    rows = S.kfold_assign(df.withColumn("truth", F.col("label")), 5, 11).withColumns(
        {"v0": S.noise_role(0.0, 0.5, counts, 11), "v1": S.noise_role(0.02, 0.5, counts, 11)}
    )
    cases = [
        X.Case(v, v, v, tuple(range(5)), {"setting": v}, ("naive_bayes",)) for v in ("v0", "v1")
    ]
    folds = X.run_cases(rows, T.appsec_features(), cases, "nb", ["truth_auprc"], truth="truth").results
    out = M.mean_over_folds(folds.withColumn("setting", F.col("params")["setting"]), ["setting", "metric"])
    return out.select("setting", "metric", dbl("value"), big("n_folds"))


@query
def cv_temporal(spark, d):
    """Naive Bayes without and with changed rows in training, tested on the old labels and on the changed rows."""
    rows = S.kfold_assign(_two_vintages(spark, d), 3, 11).withColumn("kept", F.when(~L.is_changed(), F.col("label")))
    cases = [
        X.Case(c, c, "label", (0, 1, 2), {"setting": c}, ("naive_bayes",)) for c in ("kept", "label")
    ]
    return _nb_sweep(rows, cases, ["label_auprc", "changed_tp_rate_all", "changed_f1_ref"], "real_label")


@query
def cv_highconf(spark, d):
    """Naive Bayes on high confidence against the rest, tested where the truth is known."""
    df = L.label_highconf_rest(T.appsec(spark, d))
    rows = S.kfold_assign(df, 3, 11).withColumn("test", F.when(F.col("real_label") != L.UNKNOWN, F.col("label")))
    cases = [X.Case("all", "label", "test", (0, 1, 2), {}, ("naive_bayes",))]
    return _nb_sweep(rows, cases, ["truth_auprc", "truth_precision"], "real_label")


# ---- sweeps over their whole parameter lists, folds and iterations -------------------------------------------------


def _report(sweep: X.Sweep) -> DataFrame:
    return sweep.summary().select("experiment", "setting", "model", "metric", "value", big("n_folds"))


@query
def x_noise(spark, d):
    return _report(X.noise_sweep(_labeled(spark, d), T.appsec_features(), reg_param=0.0))


@query
def x_labeled_amount(spark, d):
    return _report(
        X.labeled_amount_sweep(_labeled(spark, d), T.appsec_features(), reg_param=0.0)
    )


@query
def x_lambdas(spark, d):
    return _report(X.lambda_sweep(_labeled(spark, d), T.appsec_features()))


@query
def x_temporal(spark, d):
    return _report(
        X.temporal_sweep(_two_vintages(spark, d), T.appsec_features(), reg_param=0.0)
    )


@query
def x_changed_train(spark, d):
    return _report(
        X.changed_training_sweep(
            _two_vintages(spark, d), T.appsec_features(), reg_param=0.0
        )
    )


@query
def x_family(spark, d):
    df = L.label_2016(T.appsec(spark, d)).select("id", "family", "label", *FEATURES)
    return _report(
        X.family_sweep(
            df.filter("label = 1"), df.filter("label = 0"), T.appsec_features(), reg_param=0.0
        )
    )


@query
def x_highconf(spark, d):
    df = L.label_highconf_rest(T.appsec(spark, d)).select("id", "label", "real_label", *FEATURES)
    return _report(X.highconf_sweep(df, T.appsec_features(), reg_param=0.0))


@query
def x_noisy_benign(spark, d):
    with held(T.appsec(spark, d).select("id", "scannersCount", *FEATURES), name="scanned") as df:  # two sweeps read it
        a = _report(X.noisy_benign_sweep(df, T.appsec_features(), reg_param=0.0))
        b = _report(X.noisy_benign_sweep(df, T.appsec_features(), vary="min_malware", reg_param=0.0))
    return a.unionByName(b)


@query
def x_android(spark, d):
    df = T.appsec(spark, d)
    base = L.base_set(df).select("id", "label", *FEATURES)
    one = _report(X.single_split(base, T.appsec_features(), reg_param=0.0))
    more = _report(
        X.unlabeled_sweep(base, T.appsec_features(), L.temporal_holdout(df), reg_param=0.0)
    )
    return one.unionByName(more)


def _committee_report(df: DataFrame) -> DataFrame:
    p = F.col("params")
    keyed = df.select(p["features"].alias("features"), p["share"].alias("share"), "model", "metric", "value")
    return M.mean_over_folds(keyed, ["features", "share", "model", "metric"])


@query
def x_rank_committee(spark, d):
    return _committee_report(C.rank_committee(_bit_classes(spark, d), T.vector_features()))


@query
def x_bag_dropping(spark, d):
    return _committee_report(C.bag_dropping(_bit_classes(spark, d), T.vector_features()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, folds, label-regularized fits and baselines, tested per fold: the noise sweep end to end."""
    return QUERIES["x_noise"](spark, sf_dir)
