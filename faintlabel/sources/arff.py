"""Attribute-relation text files: sparse rows ``{index value, ...}``, dense rows, and family rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.operators.features import FeatureSet

# Fixed values of the file format.
SPARSE_POSITIVE = "malware"
DENSE_POSITIVE = "high_mal"
DENSE_DROPPED = "low_mal"
SAMPLE_SEED = 11


def attribute_names(spark: SparkSession, path: str) -> list[str]:
    """Names from the ``@attribute`` header lines in file order.  The header is as long as the table is wide."""
    lines = (
        spark.read.text(path)
        .filter(F.col("value").startswith("@attribute"))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
        .orderBy("file", "block", "line")
        .select(F.split("value", " ")[1].alias("name"))
    )
    return [r["name"] for r in lines.collect()]


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").startswith("@") & (F.length("value") > 2))


def _sampled(df: DataFrame, sample: float) -> DataFrame:
    return df if sample >= 1.0 else df.sample(False, sample, SAMPLE_SEED)


def read_sparse(spark: SparkSession, path: str, sample: float = 1.0) -> tuple[DataFrame, list[str]]:
    """(label, indices, values) and the attribute names: the stored entries of every row, by ascending index.

    Attribute 0 is the class.  A row is positive if any of its values is the positive token.  Blanks around an
    entry are ignored.  ``sparse_features(names)`` tells where the features are; nothing is as wide as the header.
    """
    names = attribute_names(spark, path)
    rows = spark.read.text(path).filter(F.col("value").startswith("{") & (F.length("value") > 2))
    rows = _sampled(rows, sample)
    body = F.expr("substring(value, 2, length(value) - 2)")
    entries = F.filter(
        F.transform(F.split(body, ","), lambda e: F.split(F.trim(e), "\\s+")), lambda e: F.element_at(e, 1) != ""
    )
    numbers = F.array_sort(
        F.transform(
            F.filter(F.col("e"), lambda e: (e[0] != "0") & (e[1] != SPARSE_POSITIVE)),
            lambda e: F.struct(e[0].cast("int").alias("i"), e[1].cast("double").alias("v")),
        )
    )
    parsed = rows.select(entries.alias("e")).select(
        F.when(F.exists("e", lambda e: e[1] == SPARSE_POSITIVE), 1.0).otherwise(0.0).alias("label"),
        numbers.alias("n"),
    )
    return parsed.select("label", F.col("n.i").alias("indices"), F.col("n.v").alias("values")), names


def sparse_features(names: list[str]) -> FeatureSet:
    """Where ``read_sparse`` leaves the features; attribute 0, the class, is never stored."""
    return FeatureSet.entries("indices", "values", len(names))


def read_dense(spark: SparkSession, path: str, sample: float = 1.0) -> tuple[DataFrame, list[str]]:
    """(label, features) from ``class,f1,...``: one class is positive, one is dropped, the others are 0."""
    names = attribute_names(spark, path)
    parts = F.split("value", ",")
    rows = _sampled(_data_lines(spark, path), sample).filter(parts[0] != DENSE_DROPPED)
    return (
        rows.select(
            F.when(parts[0] == DENSE_POSITIVE, 1.0).otherwise(0.0).alias("label"),
            array_to_vector(F.slice(parts, 2, F.size(parts) - 1).cast("array<double>")).alias("features"),
        ),
        names,
    )


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(family, member, label 1, features) from ``family-rest,f1,...``."""
    parts = F.split("value", ",")
    return _data_lines(spark, path).select(
        F.split(parts[0], "-")[0].alias("family"),
        parts[0].alias("member"),
        F.lit(1.0).alias("label"),
        array_to_vector(F.slice(parts, 2, F.size(parts) - 1).cast("array<double>")).alias("features"),
    )


def write_sparse(df: DataFrame, path: str, features: FeatureSet, label: str = "label") -> None:
    """Header and sparse rows: the class is entry 0, shown only for positives, and feature i is attribute i + 1."""
    header = ["@attribute class {benign,malware}"] + [f"@attribute f{i + 1} numeric" for i in range(features.size)]
    entries = F.transform(
        F.filter(features.listed(df), lambda e: e["value"] != 0),
        lambda e: F.concat((e["feature"] + 1).cast("string"), F.lit(" "), e["value"].cast("string")),
    )
    cls = F.when(F.col(label) == 1, F.array(F.lit("0 malware"))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.lit("{"), F.array_join(F.concat(cls, entries), ", "), F.lit("}"))
    df.sparkSession.createDataFrame([("\n".join(header),)], ["value"]).coalesce(1).write.mode("append").text(path)
    df.select(body.alias("value")).write.mode("append").text(path)


def write_dense(df: DataFrame, path: str, columns: list[str], names: list[str]) -> None:
    """Header and ``value,value,...`` rows from the given columns."""
    header = "\n".join(f"@attribute {n} numeric" for n in names)
    df.sparkSession.createDataFrame([(header,)], ["value"]).coalesce(1).write.mode("append").text(path)
    df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("append").text(path)
