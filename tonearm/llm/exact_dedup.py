"""Exact deduplication as a stream with keyed state on disk.

Two streams read what has arrived since they last ran. The first writes a slim log: digest, identifier and content locator
(file and row) of every document. The second keeps one state entry for each digest, without expiry, in RocksDB, with checkpoints in
the shared folder: the document that stays, by identifier and locator, and the number of documents. Every batch appends the
entries that it changed. A digest that was hit is then checked on the full bytes: the whole texts behind its locators are
grouped by all their bytes, and texts that only share the digest are told apart.

Only built-in functions are used. Copies are combined before each shuffle, so a text that a third of all documents hold
reaches a task once for each task that read some of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import hot_keys, spans
from tonearm.session import materialize, scratch

# State in RocksDB with one bounded cache for all stores of an executor, uploading changes only. Stores don't reserve
# disk ahead (4 MB each otherwise, whatever they hold).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Bits of the map of digests that were hit: 8 MB at most, whatever the number of digests. It only keeps texts that
# nobody shares out of the shuffle; beyond some tens of millions of hits it lets more of them through.
HIT_BITS = 1 << 26
# Bits in one row of a bitmap, by Spark's definition.
ROW_BITS = 32768

LOCATOR = ("file", "line")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text: str = "text") -> Column:
    """A-Z in lower case; null counts as empty."""
    return spans.ascii_lower(F.coalesce(F.col(text), F.lit("")))


def located(docs: DataFrame, id: str, text: str, digest: Callable[[Column], Column], whole: bool = False) -> DataFrame:
    """Identifier, locator and digest of documents that are read from files, ``whole``: and the normalised text."""
    words = normalised(text)
    columns = [F.col(id).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"), digest(words).alias("digest")]
    return docs.select(*columns, *([words.alias("words")] if whole else []))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; a pattern lets both be read."""
    path = path.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _append(changed: DataFrame, batch: int, path: str) -> None:
    """A batch has a folder of its own, so running it again changes nothing."""
    changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest(spark: SparkSession, path: str, store: str, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> None:
    """Take up the documents below ``path`` that ``store`` hasn't seen. A run that dies goes on where it stopped."""
    log = f"{store}/log"
    arrived = located(_stream(spark, path), id, text, digest)
    writer = arrived.writeStream.format("parquet").option("path", log).option("checkpointLocation", f"{store}/log-progress")
    writer.trigger(availableNow=True).start().awaitTermination()

    seen = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    state = seen.groupBy("digest").agg(F.max(F.struct("id", *LOCATOR)).alias("keeper"), F.count(F.lit(1)).alias("size"))
    writer = state.writeStream.outputMode("update").foreachBatch(partial(_append, path=f"{store}/entries"))
    with _settings(spark, STATE):
        query = writer.option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def entries(spark: SparkSession, store: str) -> DataFrame:
    """digest, keeper (id, file, line) and size of all digests seen; sizes only grow, so the largest entry is the last."""
    changes = spark.read.option("recursiveFileLookup", "true").parquet(f"{store}/entries")
    return changes.groupBy("digest").agg(F.max(F.struct("size", "keeper")).alias("last")).select("digest", "last.keeper", "last.size")


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose digest may be one of ``keys``, by a bitmap of bounded size on every executor."""
    def place(digest: str) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(HIT_BITS)) + 1

    marked = keys.groupBy(F.bitmap_bucket_number(place("digest")).alias("_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("digest"))).alias("_bits"))
    bit = F.bitmap_bit_position(place("digest"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn("_row", F.bitmap_bucket_number(place("digest"))).join(F.broadcast(marked), "_row")
    return found.where(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))) % 2 == 1).select(*rows.columns)


def _by_bytes(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Groups (digest, words, keeper, size) of equal whole texts among those whose digest is one of ``keys``.

    An inner join with the distinct keys, as Spark would move a semi join in front of the bitmap and shuffle all texts.
    """
    chosen = _maybe(texts, keys).join(keys.select("digest"), "digest")
    return chosen.groupBy("digest", "words").agg(F.max(F.struct("id", *LOCATOR)).alias("keeper"), F.count(F.lit(1)).alias("size"))


def deduplicate(spark: SparkSession, path: str, id: str = "doc_id", text: str = "text", store: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each document below ``path``: id, file, line, digest, keep_id, size, kept.

    Two texts are equal when all bytes are, after lower-casing A-Z; a null text counts as empty, so null and empty texts
    are one group. Of equal texts the row with the largest id stays; a null id is below all others, and of rows
    with one id that with the greatest locator stays, so exactly one row of a group is kept. ``keep_id`` is
    null if all ids of the group are. Texts of any length are read whole. Extra columns are not read; an empty
    table gives no rows.

    ``store`` keeps log, state and entries for the next run, which then only takes up new files; without it a new folder below the
    shared one is used. Files must not change or go.
    """
    store = store or scratch(spark)
    ingest(spark, path, store, id, text, digest)
    known = entries(spark, store)
    texts = located(spark.read.parquet(path), id, text, digest, whole=True)
    known = materialize(known)

    checked = materialize(_by_bytes(texts, known.where("size > 1")).select("digest", "keeper", "size"))
    several = checked.groupBy("digest").count().where("count > 1")
    rows = hot_keys.join_lookup(spark.read.parquet(f"{store}/log"), known, "digest", "size", "line")
    if not several.isEmpty():
        # Texts that only share a digest: each of their documents gets the group of its own bytes.
        groups = _by_bytes(texts, several).withColumnsRenamed({"keeper": "own_keeper", "size": "own_size"})
        told = _maybe(texts, several).join(groups, ["digest", "words"]).select(*LOCATOR, "own_keeper", "own_size")
        rows = rows.join(told, [*LOCATOR], "left").withColumns(
            {"keeper": F.coalesce("own_keeper", "keeper"), "size": F.coalesce("own_size", "size")})
    kept = (F.col("file") == F.col("keeper.file")) & (F.col("line") == F.col("keeper.line"))
    return rows.select("id", *LOCATOR, "digest", F.col("keeper.id").alias("keep_id"), "size", kept.alias("kept"))
