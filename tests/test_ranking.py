from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from faintlabel.learning import pairs as P
from faintlabel.learning import ranking as R
from faintlabel.operators import bags as B
from faintlabel.operators.features import FeatureSet, require_discrete
from faintlabel.plans import committees as C


def mi(a, b):
    n = len(a)
    ca, cb, cab = Counter(a), Counter(b), Counter(zip(a, b))
    return sum(v / n * math.log2(v * n / (ca[x] * cb[y])) for (x, y), v in cab.items())


def cmi(a, b, y):
    return sum(
        len(idx) / len(y) * mi([a[i] for i in idx], [b[i] for i in idx])
        for c in set(y)
        for idx in [[i for i, v in enumerate(y) if v == c]]
    )


@pytest.fixture(scope="module")
def data():
    """400 rows, 6 discrete features: one copy of another, one constant zero, one three-valued."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    x = np.zeros((400, 6), dtype=int)
    x[:, 0] = np.where(rng.random(400) < 0.8, y, 1 - y)
    x[:, 1] = x[:, 0]
    x[:, 2] = np.where(rng.random(400) < 0.7, y * 2, 1)
    x[:, 3] = rng.integers(0, 2, 400)
    x[:, 4] = x[:, 3] ^ y ^ (rng.random(400) < 0.1)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(i, float(y[i]), *map(int, x[i])) for i in range(len(y))]
    names = [f"f{j}" for j in range(6)]
    return spark.createDataFrame(rows, ["id", "label", *names]).repartition(3).cache(), FeatureSet.wide(names)


def brute(x, y, criterion, k, beta=1.0):
    d = x.shape[1]
    rel = [mi(list(x[:, j]), list(y)) for j in range(d)]
    red = {}
    picked, scores = [], []
    for _ in range(k):
        best, at = None, None
        for j in range(d):
            if j in picked:
                continue
            ms = [red.setdefault((j, z), (mi(list(x[:, j]), list(x[:, z])), cmi(list(x[:, j]), list(x[:, z]), list(y)))) for z in picked]
            m, c = [a for a, _ in ms], [b for _, b in ms]
            n = max(len(ms), 1)
            s = {
                "mim": rel[j],
                "mifs": rel[j] - beta * sum(m),
                "mrmr": rel[j] - sum(m) / n,
                "jmi": rel[j] - (sum(m) - sum(c)) / n,
                "icap": rel[j] - sum(max(0.0, a - b) for a, b in ms),
                "cmim": rel[j] - max([a - b for a, b in ms] + [0.0]),
                "if": rel[j] - (sum(m) - sum(c)),
            }[criterion]
            if best is None or s > best + 1e-12:
                best, at = s, j
        picked.append(at)
        scores.append(best)
    return picked, scores


@pytest.mark.parametrize("criterion", sorted(R.CRITERIA))
def test_greedy_matches_brute_force(frame, data, criterion):
    df, fs = frame
    got = R.greedy_ranking(df, fs, criterion, 6).orderBy("rank").collect()
    picked, scores = brute(*data, criterion, 6)
    assert [r["feature"] for r in got] == picked
    assert [r["score"] for r in got] == pytest.approx(scores, abs=1e-9)


@pytest.mark.parametrize("criterion", sorted(R.CRITERIA))
def test_counting_per_pick_gives_the_same_ranks(frame, data, criterion, monkeypatch):
    df, fs = frame
    monkeypatch.setattr(R, "MOST_PAIRS", 0)
    got = R.greedy_ranking(df, fs, criterion, 6).orderBy("rank").collect()
    picked, scores = brute(*data, criterion, 6)
    assert [r["feature"] for r in got] == picked
    assert [r["score"] for r in got] == pytest.approx(scores, abs=1e-9)


def sparse_frame(df, fs):
    """The same rows as index and value arrays."""
    kept = F.filter(F.transform(fs.array(df), lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: e["v"] != 0)
    return df.select("*", kept.alias("_e")).select("id", "label", F.col("_e.i").alias("at"), F.col("_e.v").alias("there")), FeatureSet.entries("at", "there", fs.size)


@pytest.mark.parametrize("full", [0.0, 2.0])
def test_pair_cells_equal_a_self_join(frame, data, full, monkeypatch):
    """Multiplied or listed, over small blocks, wide or as entries: the cells are those of counting pairs of columns."""
    df, fs = frame
    x, y = data
    wanted = Counter()
    for row, label in zip(x.tolist(), y.tolist()):
        wanted[-1, 1.0, -1, 1.0, label] += 1
        for a, u in enumerate(row):
            for b, v in enumerate(row):
                if a <= b and u and v:
                    wanted[a, float(u), b, float(v), label] += 1
    sparse, entries = sparse_frame(df, fs)
    monkeypatch.setattr(P, "FULL", full)
    monkeypatch.setattr(P, "BLOCK", 3)
    monkeypatch.setattr(P, "PAIRS_AT_A_TIME", 50)
    monkeypatch.setattr(P, "MOST_CELLS", 10)
    for rows, features in ((df, fs), (sparse, entries)):
        got = Counter()
        for r in P.pair_cells(rows, features, [1.0, 0.0]).collect():
            for label, n in ((1, r["n0"]), (0, r["n1"])):
                got[r["a"], r["u"], r["b"], r["v"], label] += n
        assert +got == wanted
        part = P.pair_cells(rows, features, [1.0, 0.0], left=[4, 1], right=[2]).where("a < b").collect()
        assert {(r["a"], r["b"]) for r in part} == {(1, 2), (2, 4)}
        assert all((r["n0"], r["n1"]) == tuple(wanted[r["a"], r["u"], r["b"], r["v"], label] for label in (1, 0)) for r in part)


def test_one_pass_over_the_rows(frame, tmp_path):
    """The rows are read once, however many features are ranked."""
    df, fs = frame
    plan = P.pair_cells(df, fs, [0.0, 1.0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_unlabelled_rows_and_absent_pairs(spark):
    rows = [(1, None, 1, 1), (2, 1.0, 1, 0), (3, 0.0, 0, 2), (4, 1.0, 1, 0), (5, 7.0, 1, 1), (6, 0.0, 0, 0)]
    df, fs = spark.createDataFrame(rows, "id long, label double, f0 int, f1 int"), FeatureSet.wide(["f0", "f1"])
    cells = {(r["a"], r["b"]) for r in P.pair_cells(df, fs, [0.0, 1.0]).collect()}
    assert cells == {(-1, -1), (0, 0), (1, 1)}  # the two never meet in a row of a known class
    kept = df.where("label in (0.0, 1.0)")
    x = np.array([r[2:] for r in rows if r[1] in (0.0, 1.0)])
    y = np.array([int(r[1]) for r in rows if r[1] in (0.0, 1.0)])
    picked, scores = brute(x, y, "jmi", 2)
    got = R.greedy_ranking(kept, fs, "jmi", 2).orderBy("rank").collect()
    assert [r["feature"] for r in got] == picked and [r["score"] for r in got] == pytest.approx(scores, abs=1e-12)


def test_lazy_cmim_equals_the_full_search(frame, data):
    df, fs = frame
    for rows, features in ((df, fs), sparse_frame(df, fs)):
        lazy = R.lazy_cmim(rows, features, 6, heads=2)
        got = lazy.ranking.orderBy("rank").collect()
        picked, scores = brute(*data, "cmim", 6)
        assert [r["feature"] for r in got] == picked
        assert [r["score"] for r in got] == pytest.approx(scores, abs=1e-9)
        assert lazy.refreshed <= 15 and lazy.jobs <= lazy.refreshed


def test_lazy_cmim_looks_at_few_pairs(spark):
    """A few good features and many of chance: those stay behind their first bound and are never compared."""
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 3000)
    good = [np.where(draw.random(3000) < p, y, draw.integers(0, 2, 3000)) for p in (0.9, 0.8, 0.7, 0.6, 0.5)]
    chance = [draw.integers(0, 2, 3000) for _ in range(195)]
    x = np.stack([*good, *chance], axis=1)
    rows = [(i, float(y[i]), x[i].astype(float).tolist()) for i in range(3000)]
    df, fs = spark.createDataFrame(rows, "id long, label double, f array<double>"), FeatureSet.in_column("f", 200)
    lazy = R.lazy_cmim(df, fs, 5, heads=8)
    full = R.greedy_ranking(df, fs, "cmim", 5)
    assert [tuple(r)[:2] for r in lazy.ranking.orderBy("rank").collect()] == [tuple(r)[:2] for r in full.orderBy("rank").collect()]
    assert lazy.refreshed < 200 * 5 / 4, lazy


def test_wide_sparse_rows_cost_their_entries(spark):
    """A million features, four stored entries a row."""
    size = 1_000_000
    draw = np.random.default_rng(4)
    rows = []
    for i in range(300):
        at = sorted({int(v) for v in draw.integers(0, size, 3)} | {7 if i % 2 else 9})
        rows.append((i, float(i % 2), at, [1.0] * len(at)))
    df, fs = spark.createDataFrame(rows, "id long, label double, at array<int>, there array<double>"), FeatureSet.entries("at", "there", size)
    cells = {(r["a"], r["b"]): (r["n0"], r["n1"]) for r in P.pair_cells(df, fs, [0.0, 1.0]).where("a = b and a in (7, 9)").collect()}
    assert cells == {(7, 7): (0, 150), (9, 9): (150, 0)}
    best = R.mi_relevance(df, fs).orderBy(F.desc("mi"), "feature").limit(2).collect()
    assert [r["feature"] for r in best] == [7, 9] and best[0]["mi"] == pytest.approx(1.0)


def test_groups_equal_separate_runs(frame, monkeypatch):
    df, fs = frame
    for most in (R.MOST_PAIRS, 0):
        monkeypatch.setattr(R, "MOST_PAIRS", most)
        _groups_equal_separate_runs(df, fs)


def _groups_equal_separate_runs(df, fs):
    grouped = df.withColumn("g", (F.col("id") % 2).cast("int"))
    together = R.greedy_ranking(grouped, fs, {0: "jmi", 1: "mrmr"}, 3, group="g").collect()
    for g, criterion in ((0, "jmi"), (1, "mrmr")):
        alone = R.greedy_ranking(grouped.filter(F.col("g") == g), fs, criterion, 3).orderBy("rank").collect()
        mine = sorted((r for r in together if r["g"] == g), key=lambda r: r["rank"])
        assert [r["feature"] for r in mine] == [r["feature"] for r in alone]
        assert [r["score"] for r in mine] == pytest.approx([r["score"] for r in alone], abs=1e-12)


def test_relevance_is_symmetric_and_not_negative(frame, data):
    df, fs = frame
    x, y = data
    got = {r["feature"]: r["mi"] for r in R.mi_relevance(df, fs).collect()}
    assert got[5] == 0.0 and all(v >= 0 for v in got.values())
    for j in range(6):
        assert got[j] == pytest.approx(mi(list(y), list(x[:, j])), abs=1e-9)


def test_sparse_vectors_give_the_same_counts(frame):
    df, fs = frame
    v = VectorAssembler(inputCols=list(fs.columns), outputCol="features").transform(df).select("label", "features")
    packed = FeatureSet.in_column("features", 6)
    a = {r["feature"]: r["mi"] for r in R.mi_relevance(v, packed).collect()}
    b = {r["feature"]: r["mi"] for r in R.mi_relevance(df, fs).collect()}
    assert a == pytest.approx(b, abs=1e-12)
    assert R.contingency(v, packed).exceptAll(R.contingency(df, fs)).count() == 0
    rows, entries = sparse_frame(df, fs)
    c = {r["feature"]: r["mi"] for r in R.mi_relevance(rows, entries).collect()}
    assert c == pytest.approx(b, abs=1e-12)
    assert R.contingency(rows, entries).exceptAll(R.contingency(df, fs)).count() == 0


def test_shared_minority_equals_written_bags(frame):
    df, fs = frame
    small = df.filter((F.col("label") == 0) | (F.col("id") % 4 == 0))
    bagging = B.assign_bags(small, 3)
    a = R.mi_relevance(bagging.rows, fs, ["bag_id"], labels=[0.0, 1.0], shared=bagging)
    b = R.mi_relevance(B.share_over_bags(bagging.rows, bagging), fs, ["bag_id"], labels=[0.0, 1.0])
    x = {(r["bag_id"], r["feature"]): r["mi"] for r in a.collect()}
    y = {(r["bag_id"], r["feature"]): r["mi"] for r in b.collect()}
    assert len(x) == 6 * bagging.n_bags and x == pytest.approx(y, abs=1e-12)


def test_limits(frame):
    df, fs = frame
    with pytest.raises(ValueError, match="k must be"):
        R.greedy_ranking(df, fs, "mim", 7)
    with pytest.raises(ValueError, match="criterion"):
        R.greedy_ranking(df, fs, "best", 2)
    with pytest.raises(ValueError, match="not whole"):
        require_discrete(df.withColumn("f1", F.col("f1") + 0.5), fs)
    require_discrete(df, fs)


def test_mixed_committee_uses_its_own_features(frame):
    df, fs = frame
    small = df.filter((F.col("label") == 0) | (F.col("id") % 4 == 0))
    bagging = B.assign_bags(small, 3)
    committee, chosen = C.mixed_committee(bagging, fs, top=2, techniques=("mim", "jmi", "mrmr"))
    assert len(committee) == bagging.n_bags
    for b, (_, features) in chosen.items():
        assert len(features) == 2
        assert set(np.flatnonzero(committee.weights[b])) <= set(features)


def test_single_schemes(frame):
    df, fs = frame
    train, test = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    bagging = B.assign_bags(train.filter((F.col("label") == 0) | (F.col("id") % 5 == 0)), 3)
    for out in (
        C.measure_naive_bayes(train, test, fs), C.measure_svm(train, test, fs, 20),
        C.measure_naive_bayes_committee(bagging, test, fs), C.measure_svm_committee(bagging, test, fs, 10),
        C.measure_mixed_committee(bagging, test, fs, 3),
        C.measure_naive_bayes_committee(bagging, test, fs, {b: [0, 2] for b in range(bagging.n_bags)}),
    ):
        r = out.first()
        assert 0.5 <= r["auroc"] <= 1.0 and 0.4 <= r["auprc"] <= 1.0
    with pytest.raises(ValueError, match="feature lists"):
        C.measure_naive_bayes_committee(bagging, test, fs, {0: [1]})
