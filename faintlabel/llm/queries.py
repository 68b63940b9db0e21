"""The registered queries of the corpus operators, each over its whole table, and the SQL that repeats them."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.llm import bpe, cover_tree, kd_shards, license_scan, minhash, ordinal, packing, periodic, quality_rules, quotes, secret_scan, spelling, warc
from faintlabel.llm.common import table
from faintlabel.llm.oracle import ORACLE
from faintlabel.session import new_folder

PACKING_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PACKING_END = 2
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), PACKING_VOCABULARY, PACKING_END)
    return pieces.withColumnRenamed("digest", "ids_crc32")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], BPE_RANKS, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.joined("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    return ordinal.score(docs, model, ["doc_id"])


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(table(spark, sf_dir, "documents"), 24, ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    read = warc.payloads(warc.reassembled(warc.read_records(spark, folder)))
    return read.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"), "status"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail with nested quotes, and rebuilt from it."""
    return quotes.conversations(quotes.as_mailbox(table(spark, sf_dir, "conversations")))


def _mistyped(counts: Counter, doc_id: int | None) -> None:
    """The contract's spelling slips: one letter of a run is left out where 199 divides the CRC of doc_id and run."""
    start = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    start = zlib.crc32(b":", start)
    slips = [(w, h % len(w)) for w in counts if (h := zlib.crc32(w.encode(), start)) % 199 == 0]
    # all are taken out first: what is left of a run may be another run that slips, and loses no second letter
    taken = [(w[:at] + w[at + 1 :], counts.pop(w)) for w, at in slips]
    for word, n in taken:
        counts[word] += n


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents; a null doc_id counts as no digits before the colon."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), alter=_mistyped)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as versions in a new ledger, and the findings of every document."""
    told = secret_scan.scan_versions(table(spark, sf_dir, "documents"), ["doc_id"])
    base = [r.name for r in secret_scan.BASE_RULES]
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return told.select("doc_id", *counts, F.sha2(secret_scan.told(of_base).cast("binary"), 256).alias("base_sha256"), secret_scan.told(F.col("spans")).alias("spans"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; where 10 divides the CRC of doc_id the words from some place on repeat in a period, both drawn from
    that CRC.  A null doc_id leaves its text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    drawn = docs.select("doc_id", "text", F.when(h % 10 == 0, split).alias("_w"), F.floor(h / 10).alias("_g"))
    drawn = drawn.withColumn("_n", F.size("_w").cast("long"))
    drawn = drawn.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    drawn = drawn.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0L, _n - 1), i -> element_at(_w, cast(if(i >= _a, _a + (i - _a) % _p, i) as int) + 1)), ' ')")
    return drawn.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods and six words or more in every document."""
    found = periodic.find_runs(looped(table(spark, sf_dir, "documents")), ["doc_id"])
    # quotients of word counts under 2**26 differ as doubles wherever they differ
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("o"), r["start"], r["period"], r["length"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_b.start").alias("start"),
        F.col("_b.length").alias("length"),
        F.col("_b.period").alias("period"),
        F.expr("1000 * _b.length div _b.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_cover_tree": op3_cover_tree,
    "op4_ordinal": op4_ordinal,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_quotes": op9_quotes,
    "op10_kd_shards": op10_kd_shards,
    "op11_spelling": op11_spelling,
    "op12_secret_scan": op12_secret_scan,
    "op13_runs": op13_runs,
}

__all__ = ["ORACLE", "QUERIES"]
