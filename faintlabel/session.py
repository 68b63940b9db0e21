"""Where intermediate data goes: the shared folder of the cluster, or memory when there is none."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, by its setting or by the context's checkpoint folder; None if it names none."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    return named or spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder.  Without one only a local session (a test) gets a temporary folder."""
    base = shared_folder(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="faintlabel-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder`` through the file system it lives on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


ROWS_PER_TASK = 5_000


@contextmanager
def held(df: DataFrame, mode: str = "auto", name: str = "held", spread: bool = True) -> Iterator[DataFrame]:
    """Keep a table that many passes will read.

    ``table`` writes it as parquet to the shared folder: the lineage ends there, so a lost executor costs one re-read
    of its splits, and 100 TB need no executor memory.  ``memory`` persists with spill to disk.  ``auto`` writes a
    table where the cluster names a shared folder.  ``none`` leaves the table to the caller.  ``spread`` tells that small
    tables should keep all cores busy.
    """
    spark = df.sparkSession
    if mode == "auto":
        mode = "table" if shared_folder(spark) else "memory"
    if mode == "table":
        paths = [new_folder(spark, name)]
        df.write.parquet(paths[0])
        try:
            yield _spread(spark, paths, name) if spread else spark.read.parquet(paths[0])
        finally:
            for path in paths:
                remove_folder(spark, path)
    elif mode == "memory":
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield kept
        finally:
            kept.unpersist()
    else:
        yield df


def _spread(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """The written table, rewritten once if it has too few splits to keep all cores busy in the passes to come.

    Only a table smaller than cores x split size is ever rewritten, and the gain repeats in every pass.
    """
    rows = spark.read.parquet(paths[0])
    cores = spark.sparkContext.defaultParallelism
    splits = rows.rdd.getNumPartitions()  # from the file listing; runs no job
    if splits >= cores:
        return rows
    wanted = min(cores, rows.count() // ROWS_PER_TASK)
    if wanted <= splits:
        return rows
    paths.append(new_folder(spark, name))
    rows.repartition(wanted).write.parquet(paths[1])
    return spark.read.parquet(paths[1])


def settled(df: DataFrame) -> DataFrame:
    """A small intermediate result that several branches of a lazy plan read: computed once.

    Checkpointed where the cluster names a shared folder, persisted with spill to disk else.
    """
    return df.checkpoint() if shared_folder(df.sparkSession) else df.persist(StorageLevel.MEMORY_AND_DISK)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so tasks can import it on any node."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():
        return  # already imported from a shipped archive
    archive = Path(tempfile.mkdtemp(prefix="faintlabel-")) / "faintlabel.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
