"""Balanced bags: the majority class cut into chunks as large as the minority class.

Each bag holds one chunk of the majority and all minority rows.  Since the minority part is the same in every bag,
aggregates over bags never need the copies: ``assign_bags`` marks minority rows as shared (``bag_id`` NULL) and the
learners add their sums to every bag.  ``balanced_bags`` writes the copies out for callers that want the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faintlabel.functions.hashing import hash32, key_digest

# Hash ranges for the distributed rank.  Their counts are a bounded table: 2**12 ranges, or 2**16 for a majority of more
# than ROWS_PER_BUCKET * 2**12 rows.
BUCKETS = 1 << 12
MORE_BUCKETS = 1 << 16
ROWS_PER_BUCKET = 200_000


@dataclass(frozen=True)
class Bagging:
    """Rows with ``bag_id`` (NULL on minority rows, which belong to every bag) and the number of bags.

    ``only`` restricts the work to some of the bags.
    """

    rows: DataFrame
    n_bags: int
    only: tuple[int, ...] | None = None

    @property
    def ids(self) -> list[int]:
        return list(range(self.n_bags)) if self.only is None else list(self.only)

    def restrict(self, bags) -> Bagging:
        ids = tuple(sorted(bags))
        keep = F.col("bag_id").isNull() | F.col("bag_id").isin(list(ids))
        return Bagging(self.rows.filter(keep), self.n_bags, ids)


def _bucket_count(n_rows: int, finest: int) -> int:
    """Power of two, so that a bucket is a contiguous range of the hash."""
    buckets = 1
    while buckets * ROWS_PER_BUCKET < n_rows and buckets < finest:
        buckets *= 2
    return buckets


def _range_counts(df: DataFrame, fine: Column, is_min: Column) -> tuple[dict[int, int], int, int]:
    """Majority rows per hash range, and the totals of both classes."""
    rows = df.groupBy(fine.alias("b"), is_min.alias("m")).agg(F.count("*").alias("n")).collect()  # 2 per range
    per_range = {r["b"]: r["n"] for r in rows if not r["m"]}
    return per_range, sum(r["n"] for r in rows if r["m"]), sum(per_range.values())


def assign_bags(
    df: DataFrame, seed: int, key: str = "id", minority: float = 1.0, bag_col: str = "bag_id", n_buckets: int | None = None
) -> Bagging:
    """Give every majority row the bag ``rank // n_minority`` in seeded hash order.

    The global rank needs no single-partition window.  One aggregate counts the rows of every hash range (a bounded
    number of ranges); rows are then ranked inside ranges of about equal size and shifted by the running count.
    """
    is_min = F.col("label") == minority

    def ranges(n: int) -> Column:
        return F.floor(hash32(F.col(key), seed) / F.lit((1 << 32) // n)).cast("int")

    finest = BUCKETS
    per_range, n_min, n_maj = _range_counts(df, ranges(finest), is_min)
    if n_maj > ROWS_PER_BUCKET * finest:
        finest = MORE_BUCKETS
        per_range, n_min, n_maj = _range_counts(df, ranges(finest), is_min)
    if n_min == 0:
        raise ValueError("no minority rows: bags cannot be balanced")
    n_bags = -(-n_maj // n_min)
    fine = ranges(finest)
    buckets = n_buckets or _bucket_count(n_maj, finest)
    width = finest // buckets
    sizes = [0] * buckets
    for b, n in per_range.items():
        sizes[b // width] += n
    order = Window.partitionBy("_bucket", "_minority").orderBy(key_digest(F.col(key), seed), F.col(key))
    ranked = df.withColumns({"_bucket": F.floor(fine / F.lit(width)).cast("int"), "_minority": is_min}).withColumn(
        "_pos", F.row_number().over(order) - 1
    )
    if buckets == 1:
        ranked = ranked.withColumn("_offset", F.lit(0))
    else:
        offsets = df.sparkSession.createDataFrame(list(enumerate(_running(sizes))), "_bucket int, _offset bigint")
        ranked = ranked.join(F.broadcast(offsets), "_bucket")  # two numbers per bucket, at most MORE_BUCKETS rows
    bag = F.floor((F.col("_offset") + F.col("_pos")) / n_min).cast("int")
    return Bagging(ranked.withColumn(bag_col, F.when(~F.col("_minority"), bag)).select(*df.columns, bag_col), n_bags)


def _running(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for n in sizes:
        out.append(total)
        total += n
    return out


def share_over_bags(rows: DataFrame, bagging: Bagging, bag_col: str = "bag_id") -> DataFrame:
    """Give every shared row (``bag_id`` NULL) to each of the bags; other rows stay as they are."""
    if bagging.n_bags == 0:
        return rows
    if bagging.only is None:
        every = F.sequence(F.lit(0), F.lit(bagging.n_bags - 1))
    else:
        every = F.array(*[F.lit(int(b)) for b in bagging.only])
    own = F.array(F.col(bag_col))
    return rows.withColumn(bag_col, F.explode(F.when(F.col(bag_col).isNull(), every).otherwise(own)))


def balanced_bags(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """Materialised bags: about twice the majority in rows, whatever the imbalance."""
    bagging = assign_bags(df, seed, key)
    return share_over_bags(bagging.rows, bagging)


def kept_bags(spark: SparkSession, n_bags: int, share: float, seed: int, n_total: int | None = None) -> DataFrame:
    """``floor(share * n_total)`` of the bag ids in a seeded random order."""
    keep = int(share * (n_bags if n_total is None else n_total))
    ids = spark.range(n_bags).select(F.col("id").cast("int").alias("bag_id"))
    return ids.orderBy(key_digest(F.col("bag_id"), seed), "bag_id").limit(keep)


def drop_bags(bags: DataFrame, kept: DataFrame) -> DataFrame:
    """Only the rows of the kept bags; the id list is as small as the number of bags."""
    return bags.join(kept, "bag_id", "left_semi")
