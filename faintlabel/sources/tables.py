"""Row tables: JDBC, parquet, and views over the given star-schema tables that have the expected shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.operators.features import FeatureSet

APPSEC_FEATURES = [f"f{i}" for i in range(10)]
VECTOR_SIZE = 64


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "appSec",
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Database table.  With a numeric ``key`` and its bounds the scan is split over ``partitions`` connections."""
    if key is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    if bounds is None:
        raise ValueError("a partitioned scan needs the bounds of its key")
    return spark.read.jdbc(
        url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions,
        properties=properties or {},
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appsec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leading columns (id, family, scannersCount, class), then ten integer features f0..f9.

    Line items are reduced per order before the join, so the join moves one small row per order, and the aggregate
    already has the join's partitioning.
    """
    def flag(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    li = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").alias("n_lines"),
            flag(F.col("l_returnflag") == "R").alias("n_r"),
            flag(F.col("l_returnflag") == "A").alias("n_a"),
            flag(F.col("l_linestatus") == "F").alias("n_f"),
            flag(F.col("l_quantity") > 25).alias("n_bulk"),
            flag(F.col("l_discount") >= 0.05).alias("n_disc"),
            flag(F.col("l_tax") >= 0.04).alias("n_tax"),
            flag(F.col("l_extendedprice") > 50000).alias("n_big"),
        )
    )
    counts = ["n_lines", "n_r", "n_a", "n_f", "n_bulk", "n_disc", "n_tax", "n_big"]
    full = read_table(spark, sf_dir, "orders").join(li, "o_orderkey", "left").na.fill(0, counts)
    key = F.col("o_orderkey")
    scanned = F.greatest(F.lit(0), F.col("n_r") * 4 - 3 + key % 5 - 2)
    cls = (
        F.when(F.col("o_orderstatus") == "P", "low_mal")
        .when(F.col("n_r") + F.col("n_f") >= 5, "high_mal")
        .otherwise("playdrone_benign")
    )
    return full.select(
        key.alias("id"),
        F.concat(F.lit("fam"), (F.col("o_custkey") % 40).cast("string")).alias("family"),
        F.when(key % 17 == 0, -1).otherwise(scanned).cast("int").alias("scannersCount"),
        cls.alias("class"),
        *[F.col(c).cast("int").alias(f"f{i}") for i, c in enumerate(counts)],
        F.substring("o_orderpriority", 1, 1).cast("int").alias("f8"),
        F.month("o_orderdate").cast("int").alias("f9"),
    )


def appsec_features() -> FeatureSet:
    return FeatureSet.wide(APPSEC_FEATURES)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label class (0..9), real_label (class <= 2), 64 doubles in one array column."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("group"),
        F.when(F.col("label") <= 2, 1.0).otherwise(0.0).alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vectors`` with the sign bits as features: non-negative and discrete."""
    return vectors(spark, sf_dir).withColumn(
        "features", F.transform("features", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    )


def vector_features() -> FeatureSet:
    return FeatureSet.in_column("features", VECTOR_SIZE)


DOC_FEATURES = ["n_len", "n_words", "n_lines", "n_digits"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text counts; ``real_label`` (toxic) is NULL where nobody judged the document."""
    judged = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("real_label"))
    text = F.col("text")
    return (
        read_table(spark, sf_dir, "documents")
        .select(
            "doc_id",
            F.length(text).alias("n_len"),
            (F.length(text) - F.length(F.translate(text, " ", "")) + 1).alias("n_words"),
            (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).alias("n_lines"),
            F.length(F.regexp_replace(text, "[^0-9]", "")).alias("n_digits"),
        )
        .join(judged, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"), F.coalesce("real_label", F.lit(0.0)).alias("label"), "real_label", *DOC_FEATURES
        )
    )
