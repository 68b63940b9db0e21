"""A training table in hash buckets, of which a gradient step reads a few."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlabel.functions.hashing import HASH_RANGE, hash32
from faintlabel.session import new_folder, remove_folder

BUCKET = "_bucket"


def _hash(key: object, seed: int) -> int:
    """What ``hash32`` gives for one key."""
    return int(md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16)


def bucket_numbers(keys: Sequence[object], n: int, seed: int) -> list[int]:
    return [_hash(k, seed) % n for k in keys]


def drawn_buckets(step: int, fraction: float, seed: int, n: int) -> list[int]:
    """The buckets of a step: each is in with probability ``fraction``, drawn anew for every step."""
    return [b for b in range(n) if _hash(b, seed + step) / HASH_RANGE < fraction]


@dataclass
class Bucketed:
    """Rows written once, a folder per bucket; leave the context to delete them."""

    rows: DataFrame
    path: str
    n: int

    @staticmethod
    def write(df: DataFrame, key: str, n: int, seed: int) -> Bucketed:
        spark = df.sparkSession
        path = new_folder(spark, "buckets")
        bucket = (hash32(F.col(key), seed) % n).cast("int")
        df.withColumn(BUCKET, bucket).repartition(n, BUCKET).write.partitionBy(BUCKET).parquet(path)
        return Bucketed(spark.read.schema(df.withColumn(BUCKET, F.lit(0)).schema).parquet(path), path, n)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_: object) -> None:
        remove_folder(self.rows.sparkSession, self.path)

    def drawn(self, step: int, fraction: float, seed: int) -> list[int]:
        return drawn_buckets(step, fraction, seed, self.n)

    def sample(self, step: int, fraction: float, seed: int) -> DataFrame:
        """The rows of a step's buckets; the scan lists their folders alone."""
        return self.rows.where(F.col(BUCKET).isin(self.drawn(step, fraction, seed)))
