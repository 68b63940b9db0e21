from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faintlabel.operators import features as FE
from faintlabel.session import held, new_folder, shared_folder
from faintlabel.plans.queries import QUERIES
from faintlabel.sources import arff, libsvm, results
from faintlabel.plans.queries import QUERIES
from faintlabel.sources import tables as T


@pytest.fixture()
def folder(spark):
    return new_folder(spark, "test")


def write(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    return folder


def test_sparse_rows_with_and_without_blanks(spark, folder):
    lines = [
        "@attribute class {benign,malware}", "@attribute f1 numeric", "@attribute f2 numeric", "@data",
        "{0 malware,2 1.5}", "{1 2.0, 2 3.0}", "{ 1 4.0 , 0 malware }", "{}",
    ]
    rows, names = arff.read_sparse(spark, write(spark, folder, lines))
    assert names == ["class", "f1", "f2"]
    got = {(r["label"], tuple(r["x"])) for r in rows.withColumn("x", arff.sparse_features(names).array(rows)).collect()}
    assert got == {(1.0, (0.0, 0.0, 1.5)), (0.0, (0.0, 2.0, 3.0)), (1.0, (0.0, 4.0, 0.0))}


def test_dense_rows(spark, folder):
    lines = ["@attribute class x", "@attribute a numeric", "", "high_mal,1,2", "low_mal,3,4", "playdrone_benign,5,6.5"]
    rows, names = arff.read_dense(spark, write(spark, folder, lines))
    assert names == ["class", "a"]
    assert {(r["label"], *r["features"].toArray()) for r in rows.collect()} == {(1.0, 1.0, 2.0), (0.0, 5.0, 6.5)}


def test_family_rows(spark, folder):
    rows = arff.read_families(spark, write(spark, folder, ["@relation x", "fam-1,1,2", "fam-2,3,4", "other-x-1,5,6"]))
    assert sorted(r["family"] for r in rows.collect()) == ["fam", "fam", "other"]


def test_bad_number_fails(spark, folder):
    rows, _ = arff.read_dense(spark, write(spark, folder, ["@attribute c x", "high_mal,1,abc"]))
    with pytest.raises(Exception):
        rows.collect()


def test_file_sample_is_repeatable(spark, folder):
    path = write(spark, folder, ["@attribute c x"] + [f"high_mal,{i},1" for i in range(400)])
    a, _ = arff.read_dense(spark, path, 0.25)
    b, _ = arff.read_dense(spark, path, 0.25)
    assert 60 < a.count() < 140 and a.exceptAll(b).count() == 0


def test_libsvm_prepends_the_key(spark, folder):
    df = FE.assemble(spark.createDataFrame([(7, 1.0, 2.0, 0.0)], "id long, label double, a double, b double"), ["a", "b"], ["id", "label"])
    libsvm.write_libsvm(df, folder, "id")
    r = libsvm.read_libsvm(spark, folder, 3).first()
    assert (r["label"], list(r["features"].toArray())) == (1.0, [7.0, 2.0, 0.0])


def test_sparse_text_is_as_long_as_its_entries(spark, folder):
    """A row of a table of a million features is read and written by its entries."""
    size = 1_000_000
    rows = spark.createDataFrame([(1.0, [5, 999_999], [2.5, 1.0]), (0.0, [], []), (0.0, [7], [0.0])], "label double, at array<int>, there array<double>")
    lines = [r["value"] for r in _written(spark, folder, rows, FE.FeatureSet.entries("at", "there", size))]
    assert sorted(x for x in lines if x.startswith("{")) == ["{0 malware, 6 2.5, 1000000 1.0}", "{}", "{}"]
    assert sum(x.startswith("@") for x in lines) == size + 1


def _written(spark, folder, rows, features):
    arff.write_sparse(rows, folder, features)
    return spark.read.text(folder).collect()


def test_all_folds_in_one_job(spark, folder):
    rows = [(i, float(i % 2), float(i), 0.0, i % 3, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double, three int, five int")
    names = libsvm.write_folds(df, FE.FeatureSet.wide(["a", "b"]), folder, {3: "three", 5: "five"}, "id", files_per_part=2)
    assert len(names) == 16
    got = {}
    for r in libsvm.read_parts(spark, folder).collect():
        got.setdefault(r["part"], set()).add((r["label"], dict(zip(r["indices"], r["values"])).get(0, 0.0)))
        assert r["indices"] == sorted(r["indices"])
    assert sorted(got) == sorted(names)
    for k, at in ((3, 4), (5, 5)):
        for f in range(k):
            test = {(r[1], float(r[0])) for r in rows if r[at] == f}
            assert got[libsvm.part_name(k, f, "test")] == test
            assert got[libsvm.part_name(k, f, "train")] == {(r[1], float(r[0])) for r in rows} - test
    one = libsvm.read_libsvm(spark, f"{folder}/part={names[0]}", 3).select("label", "features").collect()
    assert len(one) == 40 and all(list(r["features"].toArray())[0] == list(r["features"].toArray())[1] for r in one)


def test_files_of_a_part_grow_with_the_table(spark, folder, monkeypatch):
    monkeypatch.setattr(libsvm, "ROWS_PER_FILE", 20)
    df = spark.range(100).select("id", F.lit(1.0).alias("label"), F.lit(2).alias("a"), (F.col("id") % 3).alias("three"))
    libsvm.write_folds(df, FE.FeatureSet.wide(["a"]), folder, {3: "three"}, "id")
    read = libsvm.read_parts(spark, folder)
    assert read.count() == 300
    assert read.where("part = 'fold-1-of-3_train'").select(F.input_file_name()).distinct().count() > 2


def test_a_run_written_twice_is_there_once(spark, folder):
    def run(name, values):
        rows = [(name, "e", {"a": "1"}, i, "m", "x", v) for i, v in enumerate(values)]
        results.append_results(spark.createDataFrame(rows, results.RESULT_SCHEMA), folder)

    run("1", [0.1, 0.2])
    run("2", [0.3])
    run("1", [0.1, 0.2])
    assert sorted((r["run_id"], r["value"]) for r in results.read_results(spark, folder).collect()) == [("1", 0.1), ("1", 0.2), ("2", 0.3)]
    run("2", [0.4, 0.5, 0.6])
    assert results.read_results(spark, folder).count() == 5


def test_predictions_are_not_overwritten(spark, folder):
    pairs = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "prediction double, label double")
    results.save_predictions(pairs, folder)
    results.save_predictions(pairs.limit(1), folder)
    assert results.read_predictions(spark, folder).count() == 2


def test_jdbc_needs_bounds_for_a_split_scan(spark):
    with pytest.raises(ValueError, match="bounds"):
        T.read_jdbc(spark, "jdbc:none:x", key="id")


def test_subset_lists_must_match_the_bags(spark):
    bags = spark.createDataFrame([(0, 1.0), (1, 2.0)], "bag_id int, f0 double")
    lists = spark.createDataFrame([(0, [0])], "bag_id int, indices array<int>")
    with pytest.raises(ValueError, match="2 bags but 1"):
        FE.subset_per_bag(bags, lists, FE.FeatureSet.wide(["f0"]), n_bags=2)
    with pytest.raises(Exception, match="no feature list for bag 1"):
        FE.subset_per_bag(bags, lists, FE.FeatureSet.wide(["f0"])).collect()


def test_held_table_is_removed_and_spread(spark):
    df = spark.range(0, 40_000, 1, 1).withColumn("x", F.col("id") * 2)
    with held(df, "table") as kept:
        assert kept.rdd.getNumPartitions() > 1
        assert kept.agg(F.sum("x")).first()[0] == df.agg(F.sum("x")).first()[0]
        files = kept.inputFiles()
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()


def test_folders_are_fresh(spark):
    a, b = new_folder(spark, "x"), new_folder(spark, "x")
    assert a != b and (shared_folder(spark) is None or a.startswith(shared_folder(spark)))


def test_prefix_filter(spark):
    assert FE.without_prefixes(["a::x", "b::y", "c"], ["a::", "c"]) == [1]
    names = [f"{p}{i}" for p in ("permission_", "api", "") for i in range(30)]
    named = FE.named_features(spark.createDataFrame([(n,) for n in names], "name string"))
    kept = named.where(~FE.has_prefix(F.col("name"), ["api"])).collect()
    assert {(r["feature"], r["name"]) for r in kept} == {(i, n) for i, n in enumerate(sorted(names)) if not n.startswith("api")}


def test_roles_read_one_table(spark):
    rows = QUERIES["union_roles"](spark, "/root/testdata/sf0.001")
    assert not [f for f in rows.inputFiles() if "lineitem" in f]  # labels are worked out before, once for all roles
    assert rows.select("role").distinct().count() == 3
