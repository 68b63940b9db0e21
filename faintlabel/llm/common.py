"""What the corpus operators share: stored intermediate tables, batches, gapless ranks and component labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faintlabel.session import new_folder, remove_folder

#: Rows that Python turns into objects at a time.
SLICE = 256


#: What this process remembers from task to task, for one operator at a time.
_memory: dict[object, Any] = {}


def remembered(key: object, make: Callable[[], Any]) -> Any:
    """The memory named ``key`` of this worker, made when first asked for.  Spark uses its Python workers again for the
    next operator, so what another one has left behind is dropped."""
    if key not in _memory:
        _memory.clear()
        pa.default_memory_pool().release_unused()
        _memory[key] = make()
    return _memory[key]


#: Bytes that a generation of a worker's memory may take; the one before is kept, and what is met again moves on.
GENERATION = 24 << 20
#: What a word costs besides its letters and ids.
ENTRY = 180


class Words:
    """Ids of words by two generations of bounded size: what is met again moves to the younger."""

    def __init__(self, most: int = GENERATION) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def turn(self) -> None:
        """Between texts: a full generation becomes the old one."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0

    def add(self, word: str, ids: bytes) -> None:
        self.young[word] = ids
        self.size += ENTRY + len(word) + len(ids)

    def drop(self, words: list[str]) -> None:
        for word in words:
            self.old.pop(word, None)
            ids = self.young.pop(word, None)
            if ids is not None:
                self.size -= ENTRY + len(word) + len(ids)

    def missing(self, words: set[str]) -> set[str]:
        """The words that neither generation has; the others are in the younger then."""
        new = words.difference(self.young)
        for word in [w for w in new if w in self.old]:
            self.add(word, self.old[word])
            new.discard(word)
        return new


def portions(found: Iterator[Any]) -> Iterator[tuple[int, list[Any]]]:
    """What was found for ``SLICE`` texts at a time, with the place of the first."""
    at = 0
    while part := list(islice(found, SLICE)):
        yield at, part
        at += len(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the cluster's shared folder and read back: ends the lineage, so a lost executor costs a re-read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_folder(df.sparkSession, path)


def with_keys(df: DataFrame, keys: list[str], more: str) -> StructType:
    """Schema of a batch function's result: the given key columns, then the columns of ``more``."""
    return StructType([df.schema[k] for k in keys] + StructType.fromDDL(more).fields)


def slices(batches: Iterator[pa.RecordBatch], step: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()  # Arrow keeps what earlier batches have freed


def text_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty; ``name`` may be a field of a struct column."""
    first, *fields = name.split(".")
    column = batch.column(first)
    for field in fields:
        column = pc.struct_field(column, field)
    return [x or "" for x in column.to_pylist()]


def with_text(docs: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns that a task needs, and where the text is among them.  A text inside of a key, as ``_row.text``, travels
    with it and not once more."""
    if text.split(".")[0] in keys:
        return docs.select(*keys), text
    return docs.select(*keys, F.col(text).alias("_text")), "_text"


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """Adds a gapless rank from 0 within ``keys``: rows are ranked inside hash buckets of ``spread`` and shifted by the
    counts of the buckets before, so that no key's rows meet in one task.  The keys must not be null."""
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        cut.withColumn("_inside", inside)
        .join(base, [*keys, "_bucket"])
        .withColumn(name, F.col("_base") + F.col("_inside") - 1)
        .drop("_bucket", "_inside", "_base")
    )


def running(df: DataFrame, value: str, order: list[Column], name: str, buckets: int = 64) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in an order by hash buckets of ``order`` and ``order`` within them."""
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    base = cut.groupBy("_bucket").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    base = base.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(base, "_bucket")
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_bucket", "_inside", "_base")
    )


def bucket_count(rows: int, least: int = 64, each: int = 1_000_000) -> int:
    """Hash buckets for ``ranked``: grows with the rows, so that a bucket never holds more than about ``each`` of them."""
    return max(least, -(-rows // each))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node reachable over the given links, for every node that has one.

    Large-star and small-star steps in turns: every step is an aggregate with map-side combine and a join back.  The
    minima are written before they are joined, so that a node with very many links is a skewed join, which Spark splits;
    the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    u, v = F.greatest(a, b), F.least(a, b)
    now = stored(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u <> v").distinct()
        large = stored(large, "links")
        small_least = stored(large.groupBy("u").agg(F.min("v").alias("_m")), "least")
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct("u", F.col("_m").alias("v")))).alias("_e"))
            .select("_e.u", "_e.v")
            .where("u <> v")
            .distinct()
        )
        after = stored(small, "links")
        for old in (now, least, large, small_least):
            forget(old)
        now = after
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError("the components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return pairs.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
