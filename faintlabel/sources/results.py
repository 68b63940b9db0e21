"""Sinks for predictions and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "run_id string, experiment string, params map<string,string>, fold int, model string, metric string, value double"
)


def save_predictions(pairs: DataFrame, path: str) -> None:
    """CSV rows (prediction, label); an existing result is left alone."""
    pairs.select("prediction", "label").write.mode("ignore").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prediction double, label double").csv(path)


def append_results(results: DataFrame, path: str, timestamp: bool = True) -> None:
    """Add metric rows to a results table, stamped with the time of the run.

    The table is kept by ``run_id`` and a run's rows take the place of that run's rows, so a run that is written again,
    after a retry or by a second driver, is there once; other runs are left alone.
    """
    if timestamp:
        results = results.withColumn("at", F.date_format(F.current_timestamp(), "MM/dd/yyyy HH:mm:ss"))
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c != "run_id"]
    return rows.select(F.col("run_id").cast("string").alias("run_id"), *others)
