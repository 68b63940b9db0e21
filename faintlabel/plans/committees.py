"""Feature ranking with balanced bags, and committees on the ranked features."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlabel.functions.hashing import hash32
from faintlabel.learning.bayes import bag_models, bag_sums, combine_sums, fit_nb, label_sums, model_of
from faintlabel.learning.committee import Committee, CommitteeTest, committee_counts
from faintlabel.learning.fits import Fit
from faintlabel.learning.models import LinearModel
from faintlabel.learning.ranking import (
    greedy_ranking, merged_scores, mi_relevance, rank_bags, rank_bags_mixed, svm_fits, svm_ranking,
    svm_ranking_per_bag, top_features,
)
from faintlabel.learning.training import fit_many
from faintlabel.operators.bags import Bagging, assign_bags, kept_bags
from faintlabel.operators.features import FeatureSet
from faintlabel.operators.metrics import areas_hard
from faintlabel.operators.sampling import kfold_assign, random_subset
from faintlabel.session import held
from faintlabel.sources.results import RESULT_SCHEMA

# The techniques a mixed committee draws from, the shares of bags, and the seeds.
TECHNIQUES = ("svm", "mim", "mifs", "jmi", "mrmr")
BAG_SHARES = (1.0, 0.75, 0.5, 0.25, 0.05)
FOLD_SEED = 7
BAG_SEED = 7
MIXED_TOP = 100


def _indices(ranked: DataFrame) -> list[int]:
    return [r["feature"] for r in ranked.orderBy("rank").collect()]  # at most one row per feature


def feature_lists(df: DataFrame, features: FeatureSet, technique: str, k: int, seed: int = BAG_SEED) -> dict[str, list[int]]:
    """The three feature lists of the committee tests: merged over bags, ranked on all rows, and random."""
    bagging = assign_bags(df, seed)
    if technique == "mim":
        per_bag = mi_relevance(bagging.rows, features, ["bag_id"], labels=[0.0, 1.0], shared=bagging)
        merged = merged_scores(per_bag)
        base = top_features(mi_relevance(df, features, labels=[0.0, 1.0]), k)
    elif technique == "svm":
        merged = merged_scores(svm_ranking_per_bag(bagging, features), "score")
        signed = svm_ranking(df, features)
        base = top_features(signed.withColumn("score", F.abs("score")), k, "score")
    else:
        merged = merged_scores(rank_bags(bagging, features, technique), "score")
        base = greedy_ranking(df, features, technique, k)
    every = df.sparkSession.range(features.size).select(F.col("id").cast("int").alias("feature"))
    return {
        "merged": _indices(top_features(merged, k, "score")),
        "base": _indices(base),
        "random": _indices(random_subset(every, k, seed)),
    }


def _svm_models(rows: DataFrame, features: FeatureSet, lists: dict[str, list[int]], bags: Sequence[int], iterations: int):
    """SVM per (list, bag or all rows), all stepped in the same passes: a list is a mask on the weights."""
    fits = []
    for name, indices in lists.items():
        base = dict(kind="hinge", reg_param=0.01, scale=False, only=tuple(indices))
        fits.append(Fit(name, **base))
        fits += [Fit(name, bag_col="bag_id", bag=b, **base) for b in bags]
    done = fit_many(rows, features, fits, max_iter=iterations, hold="none")
    out: dict[str, tuple[LinearModel, list[LinearModel]]] = {}
    for d in done:
        if d.fit.bag is None:
            out[d.fit.name] = (d.model, [])
        else:
            out[d.fit.name][1].append(d.model)
    return out


def rank_committee(
    df: DataFrame, features: FeatureSet, technique: str = "mim", k: int = 150, folds: int = 3, key: str = "id",
    shares: Sequence[float] | None = None, svm: bool = True, svm_iterations: int = 100, hold: str = "auto",
) -> DataFrame:
    """Cross-validated committees and single models on ranked features.

    Per fold and feature list: a committee over the balanced bags of the training rows, and a single model for the
    lists ``merged`` and ``base``.  ``shares`` keeps only a share of the bags (all by default): the members stand in drop
    order, so all shares are prefixes of one committee and each member is scored once, on its own fold's rows.  Naive
    Bayes needs no pass per list: the models of every list follow from the same per-bag sums.
    """
    k = min(k, features.size)
    spark = df.sparkSession
    keep = list(dict.fromkeys([key, "label", *features.inputs]))
    out = []
    with held(kfold_assign(df.select(*keep), folds, FOLD_SEED, key), hold, "committee") as rows:
        lists = feature_lists(rows, features, technique, k)
        n_base = assign_bags(rows, BAG_SEED, key).n_bags
        tests: list[CommitteeTest] = []
        info: dict[str, tuple] = {}

        def add(fold: int, kind: str, name: str, models: Sequence[LinearModel], members: dict[float, int]) -> None:
            """One test for all shares; ``members``: how many of the models each share keeps."""
            there = {share: n for share, n in members.items() if n}
            if there:
                tag = str(len(tests))
                info[tag] = (there, fold, kind, name)
                tests.append(CommitteeTest(tag, tuple(models), "fold", fold, tuple(sorted(set(there.values())))))

        for fold in range(folds):
            train = rows.filter(F.col("fold") != fold)
            with held(assign_bags(train, BAG_SEED, key).rows, hold, "bags") as bag_rows:
                n_bags = (bag_rows.agg(F.max("bag_id").alias("m")).first()["m"] or 0) + 1
                bagging = Bagging(bag_rows, n_bags)
                sums = bag_sums(bagging, features)
                whole = {r["label"]: r for r in label_sums(bag_rows, features, []).collect()}  # one row per label
                nb = {n: bag_models(sums, features.size, indices=ix) for n, ix in lists.items()}
                svms = _svm_models(bag_rows, features, lists, range(n_bags), svm_iterations) if svm else {}
                order = [r["bag_id"] for r in kept_bags(spark, n_bags, 1.0, BAG_SEED).collect()]  # one row per bag
                members = {share: min(n_bags, int(share * n_base)) for share in shares or (1.0,)}
                single = dict.fromkeys(members, 1)
                for name, ix in lists.items():
                    kept = [b for b in order if b in nb[name]]
                    add(fold, "nb_committee", name, [nb[name][b] for b in kept], {s: sum(b in nb[name] for b in order[:n]) for s, n in members.items()})
                    if name != "random":
                        add(fold, "nb_single", name, [model_of(whole.get(0.0), whole.get(1.0), features.size, 1.0, ix)], single)
                    if name in svms:
                        alone, of_bags = svms[name]
                        add(fold, "svm_committee", name, [of_bags[b] for b in order], members)
                        if name != "random":
                            add(fold, "svm_single", name, [alone], single)
        counts = committee_counts(rows, features, tests)
        areas = areas_hard(counts.withColumnRenamed("n", "w"), ["name", "members", "rule"], weight="w")
        run = uuid.uuid4().hex
        for r in areas.collect():  # a few rows per test
            there, fold, kind, name = info[r["name"]]
            for share in [s for s, n in there.items() if n == r["members"]]:
                params = {"features": name, "share": str(share), "technique": technique, "k": str(k)}
                if r["rule"] == "vote":
                    out += [(run, "rank_committee", params, fold, kind, m, r[m]) for m in ("auprc", "auroc")]
                elif kind == "nb_committee":
                    out.append((run, "rank_committee", params, fold, kind, "expert_auprc", r["auprc"]))
    return spark.createDataFrame(out, RESULT_SCHEMA)


def bag_dropping(df: DataFrame, features: FeatureSet, technique: str = "mim", k: int = 150, shares=BAG_SHARES, **options) -> DataFrame:
    """Naive Bayes committees on a shrinking share of the bags."""
    return rank_committee(df, features, technique, k, shares=shares, svm=False, **options)


def technique_draws(spark: SparkSession, n_bags: int, seed: int = BAG_SEED, techniques: Sequence[str] = TECHNIQUES) -> DataFrame:
    """(bag_id, technique): the ranking technique each bag draws."""
    names = F.array(*[F.lit(t) for t in techniques])
    drawn = F.get(names, (hash32(F.col("id"), seed) % len(techniques)).cast("int"))
    return spark.range(n_bags).select(F.col("id").cast("int").alias("bag_id"), drawn.alias("technique"))


def mixed_committee(
    bagging: Bagging, features: FeatureSet, top: int = MIXED_TOP, seed: int = BAG_SEED, techniques: Sequence[str] = TECHNIQUES
) -> tuple[Committee, dict[int, tuple[str, list[int]]]]:
    """Each bag ranks with a randomly drawn technique and trains Naive Bayes on its own best features."""
    spark = bagging.rows.sparkSession
    k = min(top, features.size)
    draws = technique_draws(spark, bagging.n_bags, seed, techniques)
    drawn = {r["bag_id"]: r["technique"] for r in draws.collect()}  # one row per bag
    chosen: dict[int, tuple[str, list[int]]] = {}
    quick = [(t, {b for b, d in drawn.items() if d == t}) for t in ("svm", "mim")]
    ranked = [rank_bags(bagging.restrict(bags), features, t, k) for t, bags in quick if bags]
    greedy = {b: t for b, t in drawn.items() if t not in ("svm", "mim")}
    if greedy:
        ranked.append(rank_bags_mixed(bagging, features, greedy, k))
    for frame in ranked:
        for r in frame.orderBy("bag_id", "rank").collect():  # bags x k rows
            chosen.setdefault(r["bag_id"], (drawn[r["bag_id"]], []))[1].append(r["feature"])
    lists = {b: ix for b, (_, ix) in chosen.items()}
    models = bag_models(bag_sums(bagging, features), features.size, indices=lists)
    return Committee([models[b] for b in sorted(models)]), chosen


# ---- single schemes: fit on one table, measure on another ---------------------------------------------------------


def measure_naive_bayes(train: DataFrame, test: DataFrame, features: FeatureSet) -> DataFrame:
    """(auprc, auroc) of one Naive Bayes model."""
    return areas_hard(_single(fit_nb(train, features), test, features))


def measure_svm(train: DataFrame, test: DataFrame, features: FeatureSet, iterations: int = 100) -> DataFrame:
    """(auprc, auroc) of one linear SVM."""
    fit = Fit("svm", "hinge", reg_param=0.01, scale=False)
    return areas_hard(_single(fit_many(train, features, [fit], max_iter=iterations)[0].model, test, features))


def _single(model: LinearModel, test: DataFrame, features: FeatureSet) -> DataFrame:
    return test.withColumn("prediction", F.when(model.margins(test, features)[0] > 0, 1.0).otherwise(0.0))


def measure_naive_bayes_committee(
    bagging: Bagging, test: DataFrame, features: FeatureSet, indices: dict[int, Sequence[int]] | None = None
) -> DataFrame:
    """(auprc, auroc, expert_auprc) of one model per bag, on all features or on a list per bag."""
    if indices is not None and set(indices) != set(range(bagging.n_bags)):
        raise ValueError(f"{bagging.n_bags} bags but {len(indices)} feature lists")
    models = bag_models(bag_sums(bagging, features), features.size, indices=indices)
    return _committee_areas(Committee(list(models.values())), test, features)


def measure_svm_committee(bagging: Bagging, test: DataFrame, features: FeatureSet, iterations: int = 100) -> DataFrame:
    """(auprc, auroc, expert_auprc) of one SVM per bag."""
    fitted = fit_many(bagging.rows, features, svm_fits(bagging.ids), max_iter=iterations)
    return _committee_areas(Committee([f.model for f in fitted]), test, features)


def measure_mixed_committee(bagging: Bagging, test: DataFrame, features: FeatureSet, top: int = MIXED_TOP) -> DataFrame:
    """(auprc, auroc, expert_auprc) of the mixed committee."""
    return _committee_areas(mixed_committee(bagging, features, top)[0], test, features)


def _committee_areas(committee: Committee, test: DataFrame, features: FeatureSet) -> DataFrame:
    areas = committee.areas(test, features)
    vote, expert = F.col("rule") == "vote", F.col("rule") == "expert"
    return areas.agg(
        F.max(F.when(vote, F.col("auprc"))).alias("auprc"),
        F.max(F.when(vote, F.col("auroc"))).alias("auroc"),
        F.max(F.when(expert, F.col("auprc"))).alias("expert_auprc"),
    )
