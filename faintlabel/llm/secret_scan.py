"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by the digest of its content.  The ledger, a folder of Parquet tables, says which
(blob, rule, rule version) have been scanned and what was found there.  An update scans only what the ledger does not
know yet, one version of each blob, and appends; findings are joined back to all paths that hold a blob.  A rule whose
version is raised is scanned anew on its own, and blobs that come back later cost nothing.

Findings are addressed by content too, so an update that was lost half-way and is done again adds nothing twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlabel.llm.common import slices, stored
from faintlabel.session import new_folder, ship_package

#: Versions that need no scan, up to this many, are named to all tasks that read the texts; more are joined by shuffle.
MOST_SENT = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost and do not overlap; those with fewer than ``least`` characters in ``group``
    are dropped.  A text that holds none of the ``hints`` (lower case, looked for in the lower-cased text) has no match."""

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hints: tuple[str, ...] = field(default=())

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The three base kinds, then further token formats that their issuers publish.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
        ("passw", "secret", "token", "api_key", "apikey"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 24, 0),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("private key",)),
    Rule("code_host", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}", hints=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("maps_key", 1, r"AIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    Rule("payment", 1, r"[rs]k_live_[A-Za-z0-9]{16,}", hints=("k_live_",)),
    Rule("address_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+=-]+@", hints=("://",)),
)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: str = "text") -> Column:
    """The content's address: SHA-256 of the UTF-8 bytes, null as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class Scanner:
    """Compiled rules; a match's place is told in code points, end exclusive."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, self._searched(r)) for r in rules]

    @staticmethod
    def _searched(rule: Rule) -> re.Pattern:
        """Runs of one class are searched with their least length at once: they are as long as they can be anyway."""
        run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
        return re.compile(f"{run[1]}{{{rule.least},}}" if run and rule.least and not rule.group else rule.pattern)

    def spans(self, text: str, wanted: set[str] | None = None) -> list[tuple[str, int, int, int]]:
        """(rule name, rule version, start, end) of all matches; of the rules whose keys are ``wanted`` (None: all)."""
        lower = text.lower()
        found = []
        for rule, pattern in self.rules:
            if wanted is not None and rule.key not in wanted or rule.hints and not any(h in lower for h in rule.hints):
                continue
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((rule.name, rule.version, m.start(), m.end()))
        return found


def scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rule, version, start and end of the findings in texts (blob, text, wanted: array of rule keys)."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        every = {r.key for r in rules}
        for batch in slices(batches):
            rows = []
            for blob, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "wanted")), strict=True):
                asked = set(wanted)
                rows += [(blob, *s) for s in scanner.spans(text or "", None if asked >= every else asked)]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["blob", "rule", "version", "start", "end"])

    return texts.select("blob", "text", "wanted").mapInArrow(run, "blob binary, rule string, version int, start long, end long")


class Ledger:
    """What has been scanned and found, in a folder that all executors share."""

    SCANNED = "blob binary, rules array<string>"
    FOUND = "blob binary, rule string, version int, start long, end long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        """blob and rules (keys name@version): a row per update that scanned the blob."""
        return self._read("scanned", self.SCANNED)

    def findings(self) -> DataFrame:
        """blob, rule, version, start and end, each once."""
        return self._read("findings", self.FOUND).distinct()

    def update(self, versions: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the unseen pairs of blobs and rules of ``versions`` (keys, text), and return keys and blob of all versions.

        Null and empty texts are one blob without findings; equal texts are scanned once, rows that repeat keys and text
        each, with their findings kept once; columns besides keys and text are not read.
        """
        given = versions.select(*keys, F.xxhash64(*keys).alias("_row"), blob_of().alias("_blob"), F.col("text").alias("_text"))
        held = stored(given.select(*keys, "_row", "_blob"), "versions")
        wanted = F.array(*[F.lit(r.key) for r in rules])
        chosen = held.groupBy("_blob").agg(F.min("_row").alias("_first"))
        known = self.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_known"))  # as many as rules ever were
        again = not known.isEmpty()
        if again:
            unseen = chosen.join(known, chosen["_blob"] == known["blob"], "left").drop("blob")
            unseen = unseen.withColumn("wanted", F.array_except(wanted, F.coalesce("_known", F.array().cast("array<string>"))))
            chosen = unseen.where(F.size("wanted") > 0).select("_blob", "_first", "wanted")
        else:
            chosen = chosen.withColumn("wanted", wanted)
        chosen = stored(chosen, "unseen")

        texts = given.select("_row", "_blob", "_text")
        few = chosen.select(F.col("_blob").alias("_b"), F.col("_first").alias("_r"), "wanted")
        met = (F.col("_blob") == F.col("_b")) & (F.col("_row") == F.col("_r"))
        if few.limit(MOST_SENT + 1).count() <= MOST_SENT and again:
            texts = texts.join(F.broadcast(few), met)
        elif again:
            texts = texts.join(few, met)
        else:  # nothing is known: all texts but further versions of the same content
            first = held.join(few.select("_b", "_r"), met, "left_anti").select(F.col("_blob").alias("_b"), F.col("_row").alias("_r")).distinct()
            first = stored(first, "further")
            first = F.broadcast(first) if first.limit(MOST_SENT + 1).count() <= MOST_SENT else first
            texts = texts.join(first, met, "left_anti").withColumn("wanted", wanted)
        found = scan(texts.select(F.col("_blob").alias("blob"), F.col("_text").alias("text"), "wanted"), rules)
        found.write.mode("append").parquet(f"{self.folder}/findings")
        # last: an update that is lost before this line is scanned again
        chosen.select(F.col("_blob").alias("blob"), F.col("wanted").alias("rules")).write.mode("append").parquet(f"{self.folder}/scanned")
        return held.select(*keys, F.col("_blob").alias("blob"))

    def report(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The rows of ``versions`` (keys, blob) with ``spans``: the findings of the given rules in their blob, an array of
        place (of the rule among the given), kind, start and end, by start, then place; empty where nothing was found."""
        order = self.spark.createDataFrame([(i, r.name, r.version) for i, r in enumerate(rules)], "place int, rule string, version int")
        span = F.struct("start", "place", F.col("rule").alias("kind"), "end")
        # a blob's findings grow with its text alone
        each = self.findings().join(F.broadcast(order), ["rule", "version"]).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
        each = each.withColumnRenamed("blob", "_b")
        out = versions.join(each, F.col("blob") == F.col("_b"), "left").drop("_b")
        empty = F.array().cast("array<struct<start: bigint, place: int, kind: string, end: bigint>>")
        return out.withColumn("spans", F.coalesce("spans", empty))


def scan_versions(versions: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys, blob and spans of all versions (keys, text), by a ledger of their own."""
    ledger = Ledger(versions.sparkSession, new_folder(versions.sparkSession, "ledger"))
    return ledger.report(ledger.update(versions, keys, rules), rules)


def told(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
