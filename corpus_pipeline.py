"""A corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the shared
folder and gives the next stage what it reads back.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.llm import minhash, ordinal, packing, quality_rules
from faintlabel.llm.common import stored, table


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, so that no column of theirs clashes with a stage's own."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose votes make poor quality likelier."""
    return quality_rules.judge(_rows(docs), ["_row"], text="_row.text").where("kept").select("_row.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the highest grade is under a half; trained on the labelled documents."""
    model = ordinal.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ordinal.score(_rows(docs), model, ["_row"], text="_row.text").where("kept").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).withColumnRenamed("digest", "ids_crc32")


STAGES = [
    ("quality rules", quality_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the fits of the first two stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
