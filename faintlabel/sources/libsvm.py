"""LIBSVM text: ``label index:value ...``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.functions.hashing import hash_unit
from faintlabel.operators.features import FeatureSet
from faintlabel.session import held


def read_libsvm(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(label, features).  Giving ``size`` saves the pass that finds the largest index."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", str(size)) if size else reader).load(path)


def write_libsvm(df: DataFrame, path: str, id_col: str | None = None) -> None:
    """Write (label, features); with ``id_col`` the row key becomes feature 0."""
    if id_col is not None:
        key = F.array(F.col(id_col).cast("double"))
        df = df.withColumn("features", array_to_vector(F.concat(key, vector_to_array("features"))))
    df.select("label", "features").write.format("libsvm").save(path)


def part_name(k: int, fold: int, part: str) -> str:
    return f"fold-{fold + 1}-of-{k}_{part}"


#: Table rows for which each part gets a file of its own.
ROWS_PER_FILE = 200_000


def write_folds(df: DataFrame, features: FeatureSet, base: str, folds: dict[int, str], id_col: str, files_per_part: int | None = None) -> list[str]:
    """Train and test text of every fold of every k, the row key as feature 0: one job for all 2 * sum(k) parts.

    ``folds`` names the fold column of each k.  Each row is laid out once and goes to the parts it belongs to; a part is
    written in ``files_per_part`` files by ranges of the key's hash, so no task writes to every part; their number grows
    with the table if it is not given.  Returns the parts' names; ``read_parts`` reads them all, and each is a folder of
    LIBSVM text of its own, ``base/part=<name>``.
    """
    if files_per_part is None:
        with held(df, name="rows") as rows:
            return write_folds(rows, features, base, folds, id_col, max(1, -(-rows.count() // ROWS_PER_FILE)))
    entries = F.transform(
        F.filter(features.listed(df), lambda e: e["value"] != 0),
        lambda e: F.concat((e["feature"] + 2).cast("string"), F.lit(":"), e["value"].cast("string")),
    )
    key = F.concat(F.lit("1:"), F.col(id_col).cast("double").cast("string"))
    line = F.concat_ws(" ", F.col("label").cast("double").cast("string"), key, F.array_join(entries, " "))
    parts = [
        F.when(F.col(c) == f, F.lit(part_name(k, f, "test"))).otherwise(F.lit(part_name(k, f, "train")))
        for k, c in folds.items() for f in range(k)
    ]
    # lines and ranges are made before the rows are multiplied
    once = df.select(F.rtrim(line).alias("value"), F.floor(hash_unit(F.col(id_col), 0) * files_per_part).alias("_range"), F.array(*parts).alias("_parts"))
    laid = once.select("value", "_range", F.explode("_parts").alias("part"))
    names = [part_name(k, f, p) for k in folds for f in range(k) for p in ("train", "test")]
    laid.repartition(len(names) * files_per_part, "part", "_range").select("value", "part").write.partitionBy("part").text(base)
    return names


def read_parts(spark: SparkSession, base: str) -> DataFrame:
    """(part, label, indices, values) of LIBSVM text in parts; indices from 0, ascending as in the text."""
    words = F.split("value", " ")
    pairs = F.transform(F.slice(words, 2, F.size(words) - 1), lambda e: F.split(e, ":"))
    rows = spark.read.text(base).select("part", words[0].cast("double").alias("label"), pairs.alias("_e"))
    return rows.select(
        "part", "label",
        F.transform("_e", lambda e: e[0].cast("int") - 1).alias("indices"),
        F.transform("_e", lambda e: e[1].cast("double")).alias("values"),
    )
