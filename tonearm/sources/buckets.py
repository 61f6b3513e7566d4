"""Keyed tables in hash buckets under a manifest.

A table is a folder of numbered versions. A version holds only the buckets that it changed, one folder each; its manifest
says for every bucket which version has it. So a merge reads and writes the buckets of the keys it brings and nothing
else, and a reader of one key opens one bucket. The manifest is written last, by a rename: a job that dies leaves the table as it
was, and what it wrote is never looked at. Manifests have one short entry for each bucket, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
# Name of the folders of buckets, and of the column while rows are written.
BUCKET = "table_bucket"
# Where a row lies: its file, and its number in that.
FILE, ROW = "row_file", "row_number"
_MARKS = 32_768  # rows of one bitmap of Spark's functions
_VERSION, _MANIFEST = "buckets-", "manifest-"

OPTIONS = {
    "csv": {"header": "true", "escape": '"', "emptyValue": "", "encoding": "UTF-8", "multiLine": "true"},
    "json": {"ignoreNullFields": "false"},
    "parquet": {},
}


class Conflict(Exception):
    """Another writer has committed the version that this one started from."""


@dataclass(frozen=True)
class Manifest:
    """State of a table: where its buckets are and what their files look like."""

    kind: str
    key: tuple[str, ...]
    buckets: int = BUCKETS
    version: int = 0
    # Bucket -> version that holds it; version -> schema of its files.
    places: dict[int, int] = field(default_factory=dict)
    schemas: dict[int, str] = field(default_factory=dict)
    # What the writers of a table keep about it.
    notes: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def parse(content: str) -> Manifest:
        found = json.loads(content)
        for name in ("places", "schemas"):
            found[name] = {int(key): value for key, value in found[name].items()}
        return Manifest(**(found | {"key": tuple(found["key"])}))


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str, prefix: str) -> list[str]:
    place, system = _files(spark, path)
    folder = place(path)
    if not system.exists(folder):
        return []
    return sorted(name for name in (status.getPath().getName() for status in system.listStatus(folder)) if name.startswith(prefix))


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return [int(name.removeprefix(prefix).removesuffix(".json")) for name in _listed(spark, path, prefix)]


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/{_MANIFEST}{version:06d}.json"


def _version_path(path: str, version: int) -> str:
    return f"{path}/{_VERSION}{version:06d}"


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest manifest of a table, or that of a version; None if there is none."""
    known = _numbers(spark, path, _MANIFEST)
    if not known:
        return None
    content = spark.read.text(_manifest_path(path, known[-1] if version is None else version), wholetext=True).first()["value"]
    return Manifest.parse(content)


def bucket_of(key: Sequence[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int") if key else F.lit(0)


def touched(rows: DataFrame, known: Manifest) -> list[int]:
    """Buckets of the keys of ``rows``: at most as many numbers as there are buckets."""
    return sorted(row[0] for row in rows.select(bucket_of(known.key, known.buckets)).distinct().collect())


def located(scan: DataFrame) -> DataFrame:
    """A Parquet scan with the place of its rows, for ``split_off``."""
    return scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def split_off(rows: DataFrame, keys: DataFrame, key: str, keep: bool) -> DataFrame:
    """Rows of a ``located`` scan whose key is among ``keys``, or with ``keep`` false the others; neither shuffles a row.

    Keys are joined with keys and places alone. What comes of it is a bit for each row of a file; these bitmaps are broadcast,
    a megabyte for eight million rows.
    """
    position, chunk = (F.col(ROW) % _MARKS).cast("int"), F.floor(F.col(ROW) / _MARKS)
    found = rows.select(key, FILE, ROW).join(keys.select(key), key, "left_semi")
    marks = found.groupBy(FILE, chunk.alias("_chunk")).agg(
        F.bitmap_construct_agg(position.cast("long")).alias("_bits"), F.max(position).alias("_last"))
    short = marks.select(FILE, "_chunk", F.expr("substring(_bits, 1, _last div 8 + 1)").alias("_bits"))
    joined = rows.withColumn("_chunk", chunk).join(F.broadcast(short), [FILE, "_chunk"], "left")
    byte = F.expr(f"conv(hex(substring(_bits, cast({ROW} % {_MARKS} div 8 as int) + 1, 1)), 16, 10)").cast("long")
    marked = F.coalesce(F.getbit(byte, (F.col(ROW) % 8).cast("int")) == 1, F.lit(False))
    return joined.where(marked if keep else ~marked).drop(FILE, ROW, "_chunk", "_bits")


def read(
    spark: SparkSession, path: str, known: Manifest | None = None, only: Iterable[int] | None = None, places: bool = False,
) -> DataFrame | None:
    """Rows of the table, or of the buckets ``only``; None if there are none. One scan for each version that still holds buckets.

    ``places`` adds where each row lies (see ``located``), of Parquet tables only.
    """
    known = known or manifest(spark, path)
    if known is None:
        return None
    wanted = known.places if only is None else {b: known.places[b] for b in only if b in known.places}
    scans = []
    for version in sorted(set(wanted.values())):
        folders = [f"{_version_path(path, version)}/{BUCKET}={b}" for b, at in sorted(wanted.items()) if at == version]
        schema = StructType.fromJson(json.loads(known.schemas[version]))
        scan = spark.read.format(known.kind).options(**OPTIONS[known.kind]).schema(schema).load(folders)
        scans.append(located(scan) if places else scan)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans) if scans else None


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table; one that has no rows left keeps its columns."""
    known = manifest(spark, path)
    if known is None:
        raise ValueError(f"there is no table at {path}")
    rows = read(spark, path, known)
    if rows is not None:
        return rows
    return spark.createDataFrame([], StructType.fromJson(json.loads(known.schemas[known.version])))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is still kept."""
    return _numbers(spark, path, _MANIFEST)


def rewrite(
    rows: DataFrame, path: str, known: Manifest, changed: Iterable[int], note: Callable[[DataFrame | None], dict] | None = None,
    deal: bool = True, **options: str,
) -> Manifest:
    """Commit a version in which the buckets ``changed`` hold ``rows`` and all others stay as they are.

    Small buckets are written together and large ones by several tasks, by the sizes that Spark has measured. With ``deal``
    false rows are written where they are, for texts: no shuffle, and a file for each task and bucket. ``note`` gives the
    manifest's notes from the rows as they were written. ``Conflict`` if another writer was faster; nothing is changed then.
    """
    spark = rows.sparkSession
    version = max([known.version, *_numbers(spark, path, _VERSION), *_numbers(spark, path, _MANIFEST)]) + 1
    target = _version_path(path, version)
    dealt = rows.withColumn(BUCKET, bucket_of(known.key, known.buckets))
    if deal:
        dealt = dealt.hint("rebalance", BUCKET)
    dealt.write.format(known.kind).options(**OPTIONS[known.kind], **options).partitionBy(BUCKET).save(target)
    places = {b: at for b, at in known.places.items() if b not in set(changed)}
    places |= {int(name.partition("=")[2]): version for name in _listed(spark, target, f"{BUCKET}=")}
    schemas = {at: known.schemas[at] for at in set(places.values()) if at != version} | {version: rows.schema.json()}
    made = replace(known, version=version, places=places, schemas=schemas)
    if note is not None:
        made = replace(made, notes=note(read(spark, path, made, [b for b, at in places.items() if at == version])))
    _commit(spark, path, known.version, made)
    return made


def _commit(spark: SparkSession, path: str, base: int, made: Manifest) -> None:
    place, system = _files(spark, path)
    known = _numbers(spark, path, _MANIFEST)
    if known and known[-1] != base:
        raise Conflict(f"{path}: version {known[-1]} was committed after version {base}")
    temporary = place(f"{path}/.{uuid.uuid4().hex}")
    out = system.create(temporary, False)
    out.write(bytearray(made.text().encode()))
    out.close()
    target = place(_manifest_path(path, made.version))
    if system.exists(target) or not system.rename(temporary, target):
        raise Conflict(f"{path}: version {made.version} was committed by another writer")


def merge(
    rows: DataFrame, path: str, key: Sequence[str], fold: Callable[[DataFrame | None, DataFrame], DataFrame],
    kind: str = "parquet", buckets: int = BUCKETS, batch: int | None = None,
) -> Manifest:
    """Replace the buckets of the keys in ``rows`` by ``fold(their stored rows or None, rows)``.

    ``batch`` numbers the batches of one stream; one that is committed already changes nothing. ``rows`` is read
    twice, for its buckets and for the fold.
    """
    spark = rows.sparkSession
    known = manifest(spark, path) or Manifest(kind, tuple(key), buckets)
    if batch is not None and batch <= known.notes.get("batch", -1):
        return known
    changed = touched(rows, known)
    if not changed:
        return known
    if batch is not None:
        known = replace(known, notes=known.notes | {"batch": batch})
    return rewrite(fold(read(spark, path, known, changed), rows), path, known, changed)


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete what only manifests older than the newest ``keep`` point to, and those manifests."""
    place, system = _files(spark, path)
    numbers = _numbers(spark, path, _MANIFEST)
    kept = [manifest(spark, path, number) for number in numbers[-keep:]]
    if not kept:
        return
    needed = {at for one in kept for at in one.places.values()}
    for number in numbers[:-keep]:
        system.delete(place(_manifest_path(path, number)), False)
    for number in _numbers(spark, path, _VERSION):
        # A version above the newest manifest may be one that is being written.
        if number not in needed and number < kept[0].version:
            system.delete(place(_version_path(path, number)), True)
