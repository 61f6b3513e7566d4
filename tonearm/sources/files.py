"""Readers. Each gives a DataFrame with explicit order columns where row order carries meaning."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from io import BytesIO
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tonearm import session, vocab
from tonearm.functions import text
from tonearm.operators import merge, similarity, snapshots
from tonearm.sources import buckets

# Columns that ``read_jsonl`` finds by itself, at most; a table with more is read by the names of the wanted ones.
JSONL_COLUMNS = 10_000
AUDIO_EXTENSIONS = ("mp3", "flac", "wav", "m4a", "aac", "ogg")  # fixed value
# Extensions of files that Spark unpacks, and characters of paths that it takes for patterns.
_PACKED = (".bz2", ".deflate", ".gz", ".lz4", ".passthrough", ".snappy", ".zst")
_GLOB = frozenset("{}[]*?\\")
# Bytes of texts that a task holds at once, beside the file it reads.
_HELD = 4 << 20


def _stem(path: str = "_metadata.file_name") -> Column:
    return F.regexp_replace(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), r"\.[^.]*\z", "")


def place() -> Column:
    """Where a row just read stands in its table: part file, block in it, row in the block.

    Spark reads parts by size, so the row number alone is no order. Writers name parts in order.
    """
    return F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def read_csv(spark: SparkSession, path: str | Sequence[str], *extra: Column) -> DataFrame:
    """One CSV file or a set with equal headers, all text, with file and row order.

    ``row_order`` is a struct that compares in the order of the parts (see ``place``). Files whose headers differ are
    an error. ``extra`` are further columns on the files' metadata.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False)
    tagged = df.select(
        "*",
        F.col("_metadata.file_name").alias("source_csv"),
        place().alias("row_order"),
        *extra,
    )
    return tagged.toDF(*[name.strip().lstrip("﻿") for name in tagged.columns])


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, length, modified) of files; file contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    listed = session.gather(reader.load(folder))
    return listed.select(
        "path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "length",
        F.col("modificationTime").alias("modified"),
    )


def csv_headers(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[tuple[str, list[tuple[int, str]]]]:
    """Distinct headers of a folder's CSV files, each with the (place in name order, address) of its files.

    One scan over the lines finds all headers; empty files have none and are left out. What comes to the driver
    is a list of files, as Spark itself keeps one for every table.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    bare = F.regexp_replace("value", "^﻿", "")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.select(F.col("_metadata.file_path").alias("address"), bare.alias("line"), at.alias("at")).where("line <> ''").groupBy("address").agg(
        F.min_by("line", "at").alias("header"))
    found = sorted(first.collect(), key=lambda row: unquote(row["address"]).rsplit("/", 1)[-1])
    groups: dict[str, list[tuple[int, str]]] = {}
    for order, row in enumerate(found):
        groups.setdefault(row["header"], []).append((order, row["address"]))
    return list(groups.items())


def read_csv_union(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All CSV tables of a folder by column name; ``file_order`` is a file's place in name order.

    Files with one header are read by one scan, so the plan grows with the headers and not with the files. A single
    read of all files would match columns by position.
    """
    groups = csv_headers(spark, folder, pattern)
    if not groups:
        raise ValueError(f"no table in {folder} matches {pattern}")
    frames = []
    for _header, members in groups:
        order = spark.createDataFrame([(address, place) for place, address in members], "file_address string, file_order int")
        rows = read_csv(spark, [unquote(address) for _place, address in members], F.col("_metadata.file_path").alias("file_address"))
        frames.append(rows.join(order, "file_address").drop("file_address"))
    return merge.union_by_name(frames)


def read_tag_csvs(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv_union(spark, folder, "*song_tags.csv")


def _local_folder(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder of the local or mounted file system; None for what Spark alone has to read."""
    if _GLOB & set(folder):
        return None
    place, system = buckets._files(spark, folder)
    address = system.makeQualified(place(folder))
    if address.toUri().getScheme() != "file" or not system.exists(address) or not system.getFileStatus(address).isDirectory():
        return None
    return address.toUri().getPath()


def _list_names(spark: SparkSession, base: str, extension: str) -> DataFrame | None:
    """(name, length) of the files of a folder that aren't empty, stored; None if there are folders in it, which Spark may read too.

    One task goes through the folder, which can only be gone through as a whole, and holds a batch of its names.
    """

    def hidden(name: str) -> bool:
        """Names that Spark leaves out."""
        return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")

    def batch(found: list[tuple[str | None, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["name", "length"])

    def listed(once: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _row in once:
            found: list[tuple[str | None, int]] = []
            with os.scandir(base) as entries:
                for entry in entries:
                    if hidden(entry.name):
                        continue
                    try:
                        if entry.is_dir():
                            found.append((None, 0))
                        elif entry.name.endswith(extension) and (length := entry.stat().st_size):
                            found.append((entry.name, length))
                    except FileNotFoundError:
                        continue
                    if len(found) == 10_000:
                        yield batch(found)
                        found = []
            if found:
                yield batch(found)

    names = session.materialize(spark.range(0, 1, 1, 1).mapInArrow(listed, "name string, length long"))
    return None if names.where("name is null").limit(1).count() else names


def _contents(names: DataFrame, base: str) -> DataFrame:
    """(file_name, value) of the files of ``_list_names``, in as many tasks as ``session.gather`` would take."""
    spark = names.sparkSession

    def quoted(name: str) -> str:
        """A file's name as ``_metadata.file_name`` has it: quoted as Java quotes paths, which keeps letters beyond ASCII."""
        return "".join(
            x if ord(x) > 127 and unicodedata.category(x) not in ("Cc", "Zs", "Zl", "Zp") else quote(x, safe="!~'()*:@&=+$,;-._") for x in name)

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, bytes]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], ["file_name", "value"])

        for named in batches:
            for name in named.column(0).to_pylist():
                with open(os.path.join(base, name), "rb") as one:
                    content = one.read()
                found.append((quoted(name), content))
                held += len(content)
                if held >= _HELD or len(found) == 10_000:
                    yield batch()
                    found, held = [], 0
        if found:
            yield batch()

    count, size = names.agg(F.count("name"), F.coalesce(F.sum("length"), F.lit(0))).first()
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    tasks = max(1, min(count, max(8 * spark.sparkContext.defaultParallelism, -(-size // split))))
    return names.select("name").repartition(tasks).mapInArrow(loaded, "file_name string, value binary")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(stem, file_name, value): whole text files; empty ones give no row.

    Files of one extension in a plain local or mounted folder are listed by a task, so no list of them comes to the
    driver. Spark lists all others.
    """
    extension = pattern[1:] if re.fullmatch(r"\*\.\w+", pattern, re.ASCII) else ""
    base = _local_folder(spark, folder) if extension and extension not in _PACKED else None
    names = _list_names(spark, base, extension) if base else None
    if names is not None:
        return _contents(names, base).select(_stem("file_name").alias("stem"), "file_name", F.col("value").cast("string").alias("value"))
    reader = spark.read.option("pathGlobFilter", pattern)
    return session.gather(reader.text(folder, wholetext=True)).select(
        _stem().alias("stem"), F.col("_metadata.file_name").alias("file_name"), "value"
    )


def read_lyrics(spark: SparkSession, folder: str) -> DataFrame:
    """(song_id, full_lyric): one text file per song; broken UTF-8 bytes are replaced on reading."""
    return read_texts(spark, folder, "*.txt").select(
        F.col("stem").alias("song_id"), text.strip("value").alias("full_lyric")
    )


def read_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): one JSON document per file; unreadable ones only enter the error table."""
    documents = read_texts(spark, folder, "*.json")
    readable = documents.where(F.try_parse_json("value").isNotNull())
    return readable, snapshots.unreadable(documents)


def _json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(value, row_order): lines that hold a JSON object."""
    lines = spark.read.text(path).select(text.strip(F.regexp_replace("value", "^﻿", "")).alias("value"), place().alias("row_order"))
    return lines.where(F.coalesce(snapshots.is_object(F.try_parse_json("value")), F.lit(False)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, row_order): one JSON object per line as a variant, whatever its keys; see ``read_jsonl``.

    Nothing about the keys is gathered: ``try_variant_get`` reads single ones.
    """
    return _json_objects(spark, path).select(F.try_parse_json("value").alias("record"), "row_order")


def read_jsonl(spark: SparkSession, path: str, ordered: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per line; blank lines and lines that are no object are dropped.

    Columns keep their text form: nested values stay JSON. ``columns`` names the wanted ones; without it a pass over the
    keys finds all of them, and more than ``JSONL_COLUMNS`` are an error, as they are no table (see ``read_records``).
    ``ordered`` adds ``row_order`` (see ``place``).
    """
    objects = _json_objects(spark, path)
    if columns is None:
        keys = objects.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().limit(JSONL_COLUMNS + 1)
        columns = sorted(row["k"] for row in keys.collect())
        if len(columns) > JSONL_COLUMNS:
            raise ValueError(f"{path} has more than {JSONL_COLUMNS} keys: name the wanted columns or use read_records")
    if not columns:
        return objects.limit(0)
    fields = F.from_json("value", StructType([StructField(name, StringType()) for name in columns]))
    return objects.select(fields.alias("r"), "row_order").select("r.*", *["row_order"] * ordered)


def read_parquet(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    named = df.select("*", *[place().alias("row_order")] * ordered)
    return named.toDF(*[name.strip() for name in named.columns])


def read_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """(song_id, vector) from a folder of ``.npy`` files, one vector each.

    No vector at all, or vectors of different sizes, are an error. Files are opened once: their vectors are stored.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = [np.load(BytesIO(content)).astype(np.float32).reshape(-1) for content in pdf["content"]]
            yield pd.DataFrame({"song_id": pdf["stem"].str.strip(), "vector": vectors})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    files = session.gather(files)
    stems = F.regexp_extract("path", r"([^/]*)\.npy\z", 1)
    loaded = files.select(stems.alias("stem"), "content").mapInPandas(decode, "song_id string, vector array<float>")
    return similarity.check_vectors(session.materialize(loaded.where(F.col("song_id") != "")))


def list_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below a folder by extension, any letter case."""
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)\z", 1))
    return list_files(spark, folder, recursive=True).where(suffix.isin(*AUDIO_EXTENSIONS)).withColumn(
        "stem", F.regexp_replace("name", r"\.[^.]*\z", "")
    )


HISTORY_LISTS = """
all_tags language style emotion theme scene audio lyric_terms lyric_semantic comment_semantic artists
title_terms
""".split()
HISTORY_SCHEMA = "selected_at string, action string, song_id string, name string, artist_names string, album_name string, " + ", ".join(
    f"{name} array<string>" for name in HISTORY_LISTS
)


def read_history(spark: SparkSession, path: str, size: int = vocab.HISTORY_SIZE) -> DataFrame:
    """Last entries of a JSON array file with their position.

    Anything but an array gives no entries; members that are no object are dropped.
    """
    document = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d"))
    members = F.filter(
        snapshots.items("d", "$"), lambda member: F.coalesce(snapshots.is_object(member), F.lit(False))
    )
    kept = F.slice("m", F.greatest(F.size("m") - size, F.lit(0)) + 1, size)
    rows = document.select(members.alias("m")).where(F.size("m") > 0).select(F.posexplode(kept).alias("position", "entry"))
    return rows.select("position", F.from_json(F.to_json("entry"), HISTORY_SCHEMA).alias("e")).select("position", "e.*")


def preview(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """First rows of a table as text, between 5 and 200 of them."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.limit(max(5, min(200, int(n))))


def parse_id_list(lines: DataFrame, content: str = "value", order: str = "position") -> DataFrame:
    """(song_id, first): distinct ids of comma or blank separated lists in first-seen order.

    A ``#`` starts a comment. A part that is no integer is an error, raised when the rows are read.
    """
    bare = F.regexp_replace(content, r"#[^\n]*", "")
    parts = lines.select(order, F.posexplode(F.split(bare, r"(?U)[,\s]+")).alias("at", "part"))
    checked = parts.where(F.col("part") != "").withColumn(
        "song_id",
        F.coalesce(
            F.col("part").try_cast("long"),
            F.raise_error(F.concat(F.lit("Invalid song id: "), F.col("part"))).cast("long"),
        ),
    )
    return checked.groupBy("song_id").agg(F.min(F.struct(order, "at")).alias("first"))


def source_fingerprint(files: DataFrame, version: str, base: str = "") -> DataFrame:
    """One-row signature of a set of files: version, count, and each path, size and time.

    Every file gets a digest and the digests are summed piecewise, so no task holds the whole list
    and the order of the files does not matter.
    """
    relative = F.regexp_replace("path", f"^{base}", "") if base else F.col("path")
    digest = F.md5(F.concat_ws(":", relative, F.col("length").cast("string"), F.unix_micros("modified").cast("string")))
    words = [F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(20,0)") for start in (1, 9, 17, 25)]
    sums = [F.coalesce(F.sum(word), F.lit(0)).cast("string") for word in words]
    return files.agg(F.md5(F.concat_ws("|", F.lit(version), F.count(F.lit(1)).cast("string"), *sums)).alias("fingerprint"))


def is_stale(stored: Sequence[str], current: str) -> bool:
    """Whether derived tables must be rebuilt."""
    return not stored or stored[-1] != current
