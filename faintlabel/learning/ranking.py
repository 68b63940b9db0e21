"""Feature ranking by information theory, from contingency counts.

Mutual information is a difference of entropies, and each entropy is a sum of n*log2(n) over counts, so

    I(X;Y)   = log2 N + (S_xy - S_x - S_y) / N
    I(X;Z|Y) = (S_xzy - S_xy - S_zy + S_y) / N          with S_t = sum over the cells of t of n*log2(n)

needs group-by counts only: map-side combine shrinks the shuffle to the number of distinct cells, and no table is
transposed or joined with itself.  Zero entries are never generated; their cell is the marginal minus the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlabel.functions.scalar import xlog2x
from faintlabel.learning.fits import Fit
from faintlabel.learning.pairs import Marginals, PairTable, marginals_of, pair_cells, pair_sums
from faintlabel.learning.training import Fitted, fit_many
from faintlabel.operators.bags import Bagging, share_over_bags
from faintlabel.operators.features import ROW_MARK, FeatureSet, nonzero_long
from faintlabel.session import held, settled


@dataclass(frozen=True)
class Pool:
    """State of the candidates of one greedy search: relevance and running redundancy sums."""

    relevance: np.ndarray
    sum_mi: np.ndarray
    sum_cmi: np.ndarray
    sum_excess: np.ndarray  # sum of max(0, mi - cmi)
    max_excess: np.ndarray  # max of mi - cmi, not below 0
    picked: int


def _mifs(p: Pool, beta: float) -> np.ndarray:
    return p.relevance - beta * p.sum_mi


def _mrmr(p: Pool, beta: float) -> np.ndarray:
    return p.relevance - p.sum_mi / max(p.picked, 1)


def _jmi(p: Pool, beta: float) -> np.ndarray:
    return p.relevance - (p.sum_mi - p.sum_cmi) / max(p.picked, 1)


# name -> score of every candidate; the formulas follow Brown, Pocock, Zhao and Lujan (JMLR 2012).
CRITERIA: dict[str, Callable[[Pool, float], np.ndarray]] = {
    "mim": lambda p, beta: p.relevance,
    "mifs": _mifs,
    "jmi": _jmi,
    "mrmr": _mrmr,
    "icap": lambda p, beta: p.relevance - p.sum_excess,
    "cmim": lambda p, beta: p.relevance - p.max_excess,
    "if": lambda p, beta: p.relevance - (p.sum_mi - p.sum_cmi),
}


def label_values(df: DataFrame, label: str = "label") -> list[float]:
    """The distinct classes, sorted; their number is the number of classes, not of rows."""
    return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]


def _per_label(labels: list[float], label: str) -> list[Column]:
    return [F.count(F.when(F.col(label) == y, 1)).alias(f"n{i}") for i, y in enumerate(labels)]


def contingency(df: DataFrame, features: FeatureSet, keys: list[str] | None = None, label: str = "label") -> DataFrame:
    """(keys, feature, value, label, n) for all cells that occur, the zero cells found by subtraction."""
    keys = keys or []
    counted = settled(
        nonzero_long(df, features, [*keys, label], mark_rows=True)
        .groupBy(*keys, "feature", "value", label)
        .agg(F.count("*").alias("n"))
    )  # one scan of the rows; only cells from here on
    cells = counted.filter(F.col("feature") != ROW_MARK)
    sizes = counted.filter(F.col("feature") == ROW_MARK).select(*keys, label, F.col("n").alias("_all"))
    seen = cells.groupBy(*keys, "feature", label).agg(F.sum("n").alias("_seen"))
    every = sizes.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(features.size - 1))))
    zero = (
        every.join(seen, [*keys, "feature", label], "left")
        .select(*keys, "feature", F.lit(0.0).alias("value"), label, (F.col("_all") - F.coalesce("_seen", F.lit(0))).alias("n"))
        .filter("n > 0")
    )
    return cells.unionByName(zero)


def _sum(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def entropy_sums(
    df: DataFrame, features: FeatureSet, labels: list[float], keys: list[str] | None = None, label: str = "label",
    shared: Bagging | None = None,
) -> DataFrame:
    """(keys, feature, s_x, s_xy, n_all, s_y) per feature, the group totals repeated.  One scan.

    Every row also counts as one entry of a pseudo feature, which carries the group sizes through the same shuffle.
    With ``shared`` bags the rows of NULL ``bag_id`` belong to every bag; they are counted once and the counts, not
    the rows, are given to the bags.
    """
    keys = keys or []
    ns = [f"n{i}" for i in range(len(labels))]
    counts = [F.col(c) for c in ns]
    entries = nonzero_long(df, features, [*keys, label], mark_rows=True)
    cells = entries.groupBy(*keys, "feature", "value").agg(*_per_label(labels, label))
    if shared is not None:
        cells = share_over_bags(cells, shared).groupBy(*keys, "feature", "value").agg(*[F.sum(c).alias(c) for c in ns])
    per_feature = cells.groupBy(*keys, "feature").agg(
        F.sum(xlog2x(_sum(counts))).alias("sx"),
        F.sum(_sum([xlog2x(c) for c in counts])).alias("sxy"),
        *[F.sum(c).alias(c) for c in ns],
    )
    per_feature = settled(per_feature)  # groups x features rows
    total = per_feature.filter(F.col("feature") == ROW_MARK).select(*keys, *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ns)])
    every = total.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(features.size - 1))))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"e.{c}")) for c in keys] + [F.col("t.feature") == F.col("e.feature")]
    rows = every.alias("t").join(per_feature.alias("e"), same, "left").select(
        *[F.col(f"t.{c}").alias(c) for c in keys], F.col("t.feature").alias("feature"), "sx", "sxy", *ns, *[f"_t{i}" for i in range(len(ns))]
    )
    totals = [F.col(f"_t{i}") for i in range(len(ns))]
    zeros = [t - F.coalesce(F.col(c), F.lit(0)) for t, c in zip(totals, ns)]
    return rows.select(
        *keys,
        "feature",
        (F.coalesce("sx", F.lit(0.0)) + xlog2x(_sum(zeros))).alias("s_x"),
        (F.coalesce("sxy", F.lit(0.0)) + _sum([xlog2x(z) for z in zeros])).alias("s_xy"),
        _sum(totals).alias("n_all"),
        _sum([xlog2x(t) for t in totals]).alias("s_y"),
    )


def relevance_of_sums(sums: DataFrame, keys: list[str] | None = None) -> DataFrame:
    n = F.col("n_all")
    mi = F.log2(n.cast("double")) + (F.col("s_xy") - F.col("s_x") - F.col("s_y")) / n
    return sums.select(*(keys or []), "feature", F.greatest(mi, F.lit(0.0)).alias("mi"))


def mi_relevance(
    df: DataFrame, features: FeatureSet, keys: list[str] | None = None, label: str = "label",
    labels: list[float] | None = None, shared: Bagging | None = None,
) -> DataFrame:
    """(keys, feature, mi): mutual information of every feature with the class, in bits."""
    labels = labels or label_values(df, label)
    return relevance_of_sums(entropy_sums(df, features, labels, keys, label, shared), keys)


def pair_sums_with(df: DataFrame, features: FeatureSet, z: Column, labels: list[float], keys: list[str] | None = None,
              label: str = "label") -> DataFrame:
    """(keys, feature, d_xz, d_xzy): what S_xz and S_xzy of a feature exceed S_z and S_zy by.

    ``z`` rides along on the row before the features are unpivoted, so no self join is needed, and the pseudo feature
    of the rows carries the counts of z.  A feature that is zero everywhere has no row here: both excesses are 0.
    """
    keys = keys or []
    ns = [f"n{i}" for i in range(len(labels))]
    counts = [F.col(c) for c in ns]
    own = list(dict.fromkeys([*keys, label, *features.inputs]))
    with_z = df.select(*own, z.cast("double").alias("_z"))
    cells = nonzero_long(with_z, features, [*keys, label, "_z"], mark_rows=True).groupBy(
        *keys, "_z", "feature", "value"
    ).agg(*_per_label(labels, label))
    inner = cells.groupBy(*keys, "_z", "feature").agg(
        F.sum(xlog2x(_sum(counts))).alias("_sxz"),
        F.sum(_sum([xlog2x(c) for c in counts])).alias("_sxzy"),
        *[F.sum(c).alias(c) for c in ns],
    )
    same_z = Window.partitionBy(*keys, "_z")  # one row per feature
    sized = inner.withColumns({f"t{i}": F.max(F.when(F.col("feature") == ROW_MARK, F.col(c))).over(same_z) for i, c in enumerate(ns)})
    totals = [F.col(f"t{i}") for i in range(len(ns))]
    zeros = [t - c for t, c in zip(totals, counts)]
    return (
        sized.filter(F.col("feature") != ROW_MARK)
        .groupBy(*keys, "feature")
        .agg(
            F.sum(F.col("_sxz") + xlog2x(_sum(zeros)) - xlog2x(_sum(totals))).alias("d_xz"),
            F.sum(F.col("_sxzy") + _sum([xlog2x(c) for c in zeros]) - _sum([xlog2x(t) for t in totals])).alias("d_xzy"),
        )
    )


def mi_redundancy(
    df: DataFrame, features: FeatureSet, selected: int, label: str = "label", labels: list[float] | None = None
) -> DataFrame:
    """(feature, mi, cmi): I(X;Z) and I(X;Z|Y) of every feature X with the selected feature Z."""
    labels = labels or label_values(df, label)
    base = settled(entropy_sums(df, features, labels, label=label))  # one row per feature
    chosen = base.filter(F.col("feature") == selected).first()
    pairs = pair_sums_with(df, features, features.at(df, selected), labels, label=label)
    n, s_z, s_zy = F.col("n_all"), F.lit(chosen["s_x"]), F.lit(chosen["s_xy"])
    s_xz, s_xzy = s_z + F.coalesce("d_xz", F.lit(0.0)), s_zy + F.coalesce("d_xzy", F.lit(0.0))
    mi = F.log2(n.cast("double")) + (s_xz - F.col("s_x") - s_z) / n
    cmi = (s_xzy - F.col("s_xy") - s_zy + F.col("s_y")) / n
    return base.join(pairs, "feature", "left").select(
        "feature", F.greatest(mi, F.lit(0.0)).alias("mi"), F.greatest(cmi, F.lit(0.0)).alias("cmi")
    )


def _first_best(score: np.ndarray, valid: np.ndarray) -> int:
    """Index of the best valid score; near-equal scores go to the smaller index."""
    best = np.where(valid, score, -np.inf).max()
    return int(np.flatnonzero(valid & (score >= best - 1e-12 * max(1.0, abs(best))))[0])


#: Pairs of features, over all groups, whose redundancies the driver holds at once; beyond that each pick counts its own.
MOST_PAIRS = 2_000_000


def greedy_ranking(
    df: DataFrame, features: FeatureSet, criterion: str | dict, k: int, beta: float = 1.0, label: str = "label",
    group: str | None = None, labels: list[float] | None = None, hold: str = "auto",
) -> DataFrame:
    """(group, rank, feature, score) of a forward search in every group; with groups, ``criterion`` may name one per group.

    One pass counts all pairs of features, after which the search needs no more data.  Where the pairs would be too many
    for the driver, each pick is one counting job for all groups; the ranks are the same.  Stops early when the
    candidates run out.
    """
    for c in criterion.values() if isinstance(criterion, dict) else [criterion]:
        if c not in CRITERIA:
            raise ValueError(f"unknown criterion {c}, have {sorted(CRITERIA)}")
    if not 0 < k <= features.size:
        raise ValueError(f"k must be in 1..{features.size}, got {k}")
    keep = list(dict.fromkeys([*([group] if group else []), label, *features.inputs]))
    rows = df.select(*keep)
    labels = labels or label_values(rows, label)
    groups = 1 if group is None else len(criterion) if isinstance(criterion, dict) else rows.select(group).distinct().count()
    if features.size**2 * groups <= MOST_PAIRS:
        table = PairTable(rows, features, labels, label, group)
        relevance = {g: m.relevance() for g, m in table.marginals.items()}
        picks = _search(relevance, criterion, k, beta, lambda last: {g: (table.mi[g][z], table.cmi[g][z]) for g, z in last.items()})
    else:
        with held(rows, hold, "ranking") as rows:
            relevance, redundancy = _counted_per_pick(rows, features, label, group, labels)
            picks = _search(relevance, criterion, k, beta, redundancy)
    out = [(None if g is None else int(g), r + 1, f, s) for g in picks for r, (f, s) in enumerate(picks[g])]
    frame = df.sparkSession.createDataFrame(out, "grp int, rank int, feature int, score double")
    return frame.withColumnRenamed("grp", group) if group else frame.drop("grp")


def _search(
    relevance: dict[object, np.ndarray], criterion: str | dict, k: int, beta: float,
    redundancy: Callable[[dict[object, int]], dict[object, tuple[np.ndarray, np.ndarray]]],
) -> dict[object, list[tuple[int, float]]]:
    """The picks of every group; ``redundancy`` gives I(X;Z) and I(X;Z|Y) of all features with each group's last pick Z."""
    rule = {g: CRITERIA[criterion[g] if isinstance(criterion, dict) else criterion] for g in relevance}
    pools = {g: Pool(r, *(np.zeros(r.size) for _ in range(4)), 0) for g, r in relevance.items()}
    valid = {g: np.ones(r.size, dtype=bool) for g, r in relevance.items()}
    picks: dict[object, list[tuple[int, float]]] = {g: [] for g in relevance}
    only_relevance = all(f is CRITERIA["mim"] for f in rule.values())
    for step in range(k):
        if step and not only_relevance:
            for g, (mi, cmi) in redundancy({g: p[-1][0] for g, p in picks.items()}).items():
                p, excess = pools[g], mi - cmi
                pools[g] = Pool(
                    p.relevance, p.sum_mi + mi, p.sum_cmi + cmi, p.sum_excess + np.maximum(excess, 0.0),
                    np.maximum(p.max_excess, excess), p.picked + 1,
                )
        for g in relevance:
            if valid[g].any():
                score = rule[g](pools[g], beta)
                i = _first_best(score, valid[g])
                valid[g][i] = False
                picks[g].append((i, float(score[i])))
    return picks


def _counted_per_pick(rows: DataFrame, features: FeatureSet, label: str, group: str | None, labels: list[float]):
    """Relevance of all features per group, and the redundancies with given features by one counting job for all groups."""
    keys = [group] if group else []
    size = features.size
    stats: dict[object, dict] = {}
    for r in entropy_sums(rows, features, labels, keys, label).collect():  # groups x features rows
        s = stats.setdefault(
            r[group] if group else None, {"s_x": np.zeros(size), "s_xy": np.zeros(size), "n": r["n_all"], "s_y": r["s_y"]}
        )
        s["s_x"][r["feature"]], s["s_xy"][r["feature"]] = r["s_x"], r["s_xy"]

    def redundancy(last: dict[object, int]) -> dict[object, tuple[np.ndarray, np.ndarray]]:
        if group:
            index = rows.sparkSession.createDataFrame([(int(g), int(i)) for g, i in last.items()], f"{group} int, _last int")
            with_last = rows.join(F.broadcast(index), group)  # one row per group
            got = pair_sums_with(with_last, features, features.at(with_last, F.col("_last")), labels, keys, label)
        else:
            got = pair_sums_with(rows, features, features.at(rows, last[None]), labels, keys, label)
        d = {g: np.zeros((2, size)) for g in stats}
        for r in got.collect():  # groups x features rows
            d[r[group] if group else None][:, r["feature"]] = r["d_xz"], r["d_xzy"]
        out = {}
        for g, (d_xz, d_xzy) in d.items():
            s = stats[g]
            mi = np.maximum(math.log2(s["n"]) + (d_xz - s["s_x"]) / s["n"], 0.0)
            out[g] = mi, np.maximum((d_xzy - s["s_xy"] + s["s_y"]) / s["n"], 0.0)
        return out

    relevance = {g: np.maximum(math.log2(s["n"]) + (s["s_xy"] - s["s_x"] - s["s_y"]) / s["n"], 0.0) for g, s in stats.items()}
    return relevance, redundancy


@dataclass(frozen=True)
class LazyRanking:
    """A ranking, and what it cost: (feature, pick) pairs brought up to date and counting jobs."""

    ranking: DataFrame
    refreshed: int
    jobs: int


def lazy_cmim(
    df: DataFrame, features: FeatureSet, k: int, heads: int = 16, label: str = "label", labels: list[float] | None = None, hold: str = "auto",
) -> LazyRanking:
    """(rank, feature, score) by conditional mutual information maximisation, for many features.

    A feature's score falls with every pick or stays.  Each feature keeps its score over the picks it has been compared
    with, which bounds its score over all; only the features whose bound could still win are brought up to date,
    ``heads`` of them in one counting job over their columns alone.  Ranks and scores equal those of the full search.
    """
    if not 0 < k <= features.size:
        raise ValueError(f"k must be in 1..{features.size}, got {k}")
    rows = df.select(*dict.fromkeys([label, *features.inputs]))
    labels = labels or label_values(rows, label)
    with held(rows, hold, "ranking") as rows:
        return _lazy_search(rows, features, k, heads, label, labels)


def _lazy_search(rows: DataFrame, features: FeatureSet, k: int, heads: int, label: str, labels: list[float]) -> LazyRanking:
    classes = len(labels)
    cells = settled(marginal_cells(rows, features, labels, label))
    known = marginals_of(cells, features.size, classes)[None]
    bound = known.relevance()
    relevance, worst = bound.copy(), np.zeros(features.size)
    seen, valid = np.zeros(features.size, np.int64), np.ones(features.size, bool)
    picks: list[tuple[int, float]] = []
    refreshed = jobs = 0
    while len(picks) < k:
        fresh = valid & (seen == len(picks))
        least = bound[fresh].max() if fresh.any() else -np.inf
        stale = np.flatnonzero(valid & ~fresh & (bound >= least - 1e-9))
        if len(stale):
            chosen = stale[np.argsort(-bound[stale], kind="stable")[:heads]]
            wanted = [(f, z) for f in chosen.tolist() for z, _ in picks[seen[f] :]]
            for (f, _), excess in zip(wanted, _excesses(rows, features, labels, label, cells, known, wanted), strict=True):
                worst[f] = max(worst[f], excess)
            seen[chosen] = len(picks)
            bound[chosen] = relevance[chosen] - worst[chosen]
            refreshed, jobs = refreshed + len(wanted), jobs + 1
            continue
        best = _first_best(bound, fresh)
        valid[best] = False
        picks.append((best, float(bound[best])))
    out = rows.sparkSession.createDataFrame([(r + 1, f, s) for r, (f, s) in enumerate(picks)], "rank int, feature int, score double")
    return LazyRanking(out, refreshed, jobs)


def marginal_cells(rows: DataFrame, features: FeatureSet, labels: list[float], label: str = "label") -> DataFrame:
    """The cells of every feature with itself, and the rows, as ``pairs.pair_cells`` gives them."""
    counted = nonzero_long(rows, features, [label], mark_rows=True).groupBy("feature", "value").agg(*_per_label(labels, label))
    a, u = F.col("feature"), F.col("value")
    return counted.select(a.alias("a"), u.alias("u"), a.alias("b"), u.alias("v"), *[f"n{i}" for i in range(len(labels))])


def _excesses(rows, features, labels, label, marginals: DataFrame, known: Marginals, wanted: list[tuple[int, int]]) -> np.ndarray:
    """I(X;Z) - I(X;Z|Y) of the given pairs (x, z)."""
    classes = len(labels)
    x, z = np.array(wanted).T
    cells = pair_cells(rows, features, labels, label, left=sorted(set(x.tolist())), right=sorted(set(z.tolist())))
    of = marginals.where(F.col("a").isin(sorted({*x.tolist(), *z.tolist()})))
    met = {(r["a"], r["b"]): r for r in pair_sums(cells, of, classes).collect()}  # heads x picks rows
    got = [met.get((min(p), max(p))) for p in wanted]
    e, ey = (np.array([0.0 if r is None else r[c] for r in got]) for c in ("e", "ey"))
    both = np.array([[0 if r is None else r[f"m{i}"] for i in range(classes)] for r in got])
    mi, cmi = known.redundancy(x, z, e, ey, both)
    return mi - cmi


def top_features(scores: DataFrame, k: int, score: str = "mi") -> DataFrame:
    """(rank, feature, score): the k best, ties to the smaller index."""
    best = scores.orderBy(F.desc(F.round(score, 12)), "feature").limit(k)
    pairs = F.sort_array(
        F.collect_list(F.struct((-F.round(score, 12)).alias("o"), F.col("feature").alias("f"), F.col(score).alias("s")))
    )
    return best.agg(pairs.alias("a")).select(F.posexplode("a").alias("pos", "x")).select(
        (F.col("pos") + 1).alias("rank"), F.col("x.f").alias("feature"), F.col("x.s").alias("score")
    )


def top_per_group(scores: DataFrame, group: str, k: int | None, score: str) -> DataFrame:
    """(group, rank, feature, score): the k best by absolute score in each group (all of them for ``k=None``)."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round(F.abs(F.col(score)), 12)), "feature")
    ranked = scores.select(group, F.row_number().over(order).alias("rank"), "feature", F.col(score).alias("score"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def merged_scores(scores: DataFrame, score: str = "mi") -> DataFrame:
    """(feature, score): sum of absolute scores over the bags."""
    return scores.groupBy("feature").agg(F.sum(F.abs(F.col(score))).alias("score"))


def svm_fits(bags: list[int] | None = None) -> list[Fit]:
    """One hinge fit on all rows, or one per bag."""
    base = dict(kind="hinge", reg_param=0.01, scale=False)
    if bags is None:
        return [Fit("svm", **base)]
    return [Fit(f"svm-{b}", bag_col="bag_id", bag=b, **base) for b in bags]


def weights_frame(df: DataFrame, fitted: list[Fitted]) -> DataFrame:
    """(bag_id, feature, score): signed weights of linear models, bags x features rows."""
    rows = [(f.fit.bag, i, w) for f in fitted for i, w in enumerate(f.model.weights)]
    return df.sparkSession.createDataFrame(rows, "bag_id int, feature int, score double")


def svm_ranking(df: DataFrame, features: FeatureSet, iterations: int = 100) -> DataFrame:
    """(feature, score): signed weights of a linear SVM."""
    return weights_frame(df, fit_many(df, features, svm_fits(), max_iter=iterations)).drop("bag_id")


def svm_ranking_per_bag(bagging: Bagging, features: FeatureSet, iterations: int = 100) -> DataFrame:
    """(bag_id, feature, score): the SVM weights of every bag, all bags stepped in the same passes."""
    return weights_frame(bagging.rows, fit_many(bagging.rows, features, svm_fits(bagging.ids), max_iter=iterations))


def rank_bags(bagging: Bagging, features: FeatureSet, technique: str, k: int | None = None) -> DataFrame:
    """(bag_id, rank, feature, score) of one technique (``svm`` or a criterion) in every bag."""
    if technique == "svm":
        return top_per_group(svm_ranking_per_bag(bagging, features), "bag_id", k, "score")
    if technique == "mim":
        scores = mi_relevance(bagging.rows, features, ["bag_id"], labels=[0.0, 1.0], shared=bagging)
        return top_per_group(scores, "bag_id", k, "mi")
    return rank_bags_mixed(bagging, features, {b: technique for b in bagging.ids}, k)


def rank_bags_mixed(bagging: Bagging, features: FeatureSet, criteria: dict[int, str], k: int | None = None) -> DataFrame:
    """(bag_id, rank, feature, score) with a criterion per bag; all bags advance in the same counting jobs."""
    part = bagging.restrict(criteria)
    rows = share_over_bags(part.rows, part)
    return greedy_ranking(rows, features, criteria, k or features.size, group="bag_id", labels=[0.0, 1.0])
