"""Spark session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. UTC keeps dates equal on every host; the adaptive settings let
# Spark pick join strategies and partition counts from the sizes it has measured.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tonearm", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session may fall back to
    a temporary folder of this machine, which goes when Python ends; a cluster without the setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix=f"tonearm-{os.getpid()}-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tonearm-{uuid.uuid4().hex}"


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write a result that is read several times to the shared folder and read it back.

    One pass over the sources then serves all readers, with column pruning, and a lost executor
    costs no recomputation. ``batch_rows`` bounds the Arrow batches of its Python steps where rows are large.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go as soon as it ends.

    Otherwise they stay until the driver happens to collect its garbage, so jobs of several passes over texts hold
    the shuffles of all of them. Spark before 4.1 doesn't know the setting and keeps them.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a stored table out evenly if it has fewer splits than there are cores.

    A table of many splits is read as it lies: its texts are not shuffled before steps that work row by row.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def gather(df: DataFrame) -> DataFrame:
    """Rows of a folder of small files in a few tasks for each core.

    Spark counts every file as some MB that it opens, so it makes a task for a handful of them. Each task takes
    as many bytes as a split may have, or its share of the files.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.coalesce(max(8 * spark.sparkContext.defaultParallelism, -(-size // split)))
