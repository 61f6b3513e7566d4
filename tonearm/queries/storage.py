"""Sources and sinks: driver tables are written to a new shared folder and read back; streams."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm import session
from tonearm.operators import features
from tonearm.operators import history as past
from tonearm.plans import feature_store
from tonearm.queries import documents, model
from tonearm.queries.registry import query, table
from tonearm.sources import buckets, files, sinks
from tonearm.streaming import history as streams

SONG_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS song_id, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part"


def _part(spark, folder):
    return table(spark, folder, "part").select(
        F.concat(F.lit(" "), "p_partkey").alias("song_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_size").cast("string").alias("size"), F.col("p_partkey").alias("place"))


# A second, later load: half of the rows with a new name, blank brands and a new column.
MERGED_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS song_id, CASE WHEN p_size > 25 THEN 'new ' || p_name ELSE p_name END AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size,
  CASE WHEN p_size > 25 THEN p_type ELSE '' END AS kind FROM part"""


def _update(spark, folder):
    return table(spark, folder, "part").where("p_size > 25").select(
        F.col("p_partkey").cast("string").alias("song_id"), F.concat(F.lit("new "), "p_name").alias("name"), F.lit(" ").alias("brand"),
        F.col("p_type").alias("kind"), F.col("p_partkey").alias("place"))


def _blank_filled(df, *names):
    return df.select(*[F.coalesce(F.col(name), F.lit("")).alias(name) for name in names])


@query("csv_round_trip", """
SELECT doc_id AS song_id, text, lang, length(text) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents)""")
def csv_round_trip(spark, folder):
    path = session.scratch(spark)
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"), "text", "lang", F.col("doc_id").alias("place"))
    stored = sinks.merge_csv(path, docs, "place")
    return sinks.read_merged(spark, stored).select("song_id", "text", "lang", F.length("text").cast("long").alias("n"))


@query("csv_union", """
SELECT CAST(p_partkey AS VARCHAR) AS song_id, CASE WHEN p_size > 25 THEN p_brand END AS brand, CASE WHEN p_size <= 25 THEN p_type END AS kind, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS file_order FROM part""")
def csv_union(spark, folder):
    path = session.scratch(spark)
    part = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    first = part.where("p_size > 25").select(F.col("p_brand").alias(" brand "), key.alias("song_id"))
    second = part.where("p_size <= 25").select(key.alias("song_id"), F.col("p_type").alias("kind"))
    for name, df in (("a_song_tags", first), ("b_song_tags", second)):
        df.coalesce(1).write.option("header", "true").csv(f"{path}/{name}")
    frames = [files.read_csv(spark, f"{path}/{name}") for name in ("a_song_tags", "b_song_tags")]
    from tonearm.operators import merge

    return merge.union_by_name(frames).select("song_id", "brand", "kind", F.col("file_order").cast("int").alias("file_order"))


@query("merge_sink", MERGED_SQL)
def merge_sink(spark, folder):
    path = session.scratch(spark)
    sinks.merge_csv(path, _part(spark, folder), "place")
    stored = sinks.merge_csv(path, _update(spark, folder), "place")
    return _blank_filled(sinks.read_merged(spark, stored), "song_id", "name", "brand", "size", "kind")


@query("jsonl_round_trip", MERGED_SQL)
def jsonl_round_trip(spark, folder):
    path = session.scratch(spark)
    sinks.merge_jsonl(path, _part(spark, folder), "place", semantics_writer=True)
    stored = sinks.merge_jsonl(path, _update(spark, folder), "place", semantics_writer=True)
    return _blank_filled(sinks.read_merged(spark, stored), "song_id", "name", "brand", "size", "kind")


@query("parquet_round_trip", MERGED_SQL)
def parquet_round_trip(spark, folder):
    path = session.scratch(spark)
    sinks.merge_parquet(path, _part(spark, folder), "place")
    stored = sinks.merge_parquet(path, _update(spark, folder), "place")
    return _blank_filled(sinks.read_merged(spark, stored), "song_id", "name", "brand", "size", "kind")


@query("lyric_files", """
SELECT CAST(d.doc_id AS VARCHAR) AS song_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS full_lyric
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) <> 1""")
def lyric_files(spark, folder):
    stored = sinks.write_lyrics(documents._flat_documents(spark, folder), session.scratch(spark))
    return spark.read.parquet(stored).select("song_id", "full_lyric")


@query("flat_songs_sink", """
SELECT CAST(d.doc_id AS VARCHAR) AS song_id, source || ' | ' || lang AS artist_names, CAST(n_chars AS VARCHAR) AS comment_total
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) <> 1""")
def flat_songs_sink(spark, folder):
    stored = sinks.write_flat_songs(documents._flat_documents(spark, folder), session.scratch(spark))
    return files.read_csv(spark, stored).select("song_id", "artist_names", "comment_total")


@query("snapshot_files", "SELECT CAST(doc_id AS VARCHAR) AS stem, text AS value FROM documents")
def snapshot_files(spark, folder):
    """Whole documents, one row each, through the document store of assembled snapshots."""
    docs = table(spark, folder, "documents")
    songs = docs.select(
        F.col("doc_id").alias("song_id"), F.lit("n").alias("name"), F.lit(1).alias("album_id"), F.lit("a").alias("album_name"), F.lit(1).alias("duration_ms"),
        F.lit("t").alias("collected_at"), F.lit(None).cast("string").alias("artists_json"), F.lit(None).cast("string").alias("raw_detail_json"))
    results = docs.select(
        F.col("doc_id").alias("song_id"), F.lit("lyric").alias("endpoint"), F.lit(1).alias("id"), F.lit(200).alias("status"), F.lit(200).alias("code"),
        F.lit(None).cast("string").alias("error"), F.lit("t").alias("collected_at"), F.lit("{}").alias("params_json"),
        F.to_json(F.struct("text")).alias("response_json"))
    stored = spark.read.parquet(sinks.write_snapshots(songs, results, session.scratch(spark)))
    return stored.select(F.col("song_id").cast("string").alias("stem"), F.get_json_object("document", "$.api_results.lyric[0].response.text").alias("value"))


@query("file_listing", "SELECT n_name AS stem, 1 AS files FROM nation")
def file_listing(spark, folder):
    """Audio files below a folder: one folder per nation with a text file each, listed by extension."""
    path = session.scratch(spark)
    table(spark, folder, "nation").select(F.col("n_name").alias("nation"), F.lit("x").alias("value")).repartition("nation").write.partitionBy("nation").option(
        "compression", "none").text(path)
    listed = files.list_files(spark, path, "*.txt", recursive=True)
    stem = F.url_decode(F.regexp_extract("path", r"nation=([^/]*)/", 1))
    return listed.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).cast("int").alias("files"))


def _write_tables(rows: DataFrame, suffix: str) -> str:
    """A folder with one CSV file for each ``name`` of (name, ...), of which there are few.

    Spark writes a folder for each name; its one part is then renamed, ``name`` + ``suffix``.
    """
    spark = rows.sparkSession
    made, target = session.scratch(spark), session.scratch(spark)
    rows.repartition("name").write.partitionBy("name").option("header", "true").csv(made)
    place, system = buckets._files(spark, made)
    system.mkdirs(place(target))
    for named in system.listStatus(place(made)):
        if named.isDirectory():
            name = named.getPath().getName().removeprefix("name=")
            for found in system.globStatus(place(named.getPath(), "part-*")):
                system.rename(found.getPath(), place(target, name + suffix))
    return target


def _write_files(rows: DataFrame, suffix: str, within: str = "") -> str:
    """What a user's folder of small files looks like: one for each row, ``name`` + ``suffix``, below the folder ``within``."""
    target = session.scratch(rows.sparkSession)
    sinks.write_files(rows.withColumn("name", F.concat("name", F.lit(suffix))), f"{target}/{within}" if within else target)
    return target


@query("tag_csv_folder", """
WITH p AS (SELECT *, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS b FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS song_id, CASE WHEN b % 2 = 0 THEN p_type END AS kind, CASE WHEN b % 2 = 1 THEN CAST(p_size AS VARCHAR) END AS size,
  CAST(b AS VARCHAR) || '_song_tags.csv' AS source_csv, CAST(dense_rank() OVER (ORDER BY CAST(b AS VARCHAR) || '_song_tags.csv') - 1 AS INT) AS file_order FROM p""")
def tag_csv_folder(spark, folder):
    """A file for each brand with one of two headers, read as a folder."""
    part = table(spark, folder, "part").withColumn("name", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"))
    key = F.col("p_partkey").cast("string").alias("song_id")
    even = _write_tables(part.where("name % 2 = 0").select("name", key, F.col("p_type").alias(" kind ")), "_song_tags.csv")
    odd = _write_tables(part.where("name % 2 = 1").select("name", F.col("p_size").alias("size"), key), "_song_tags.csv")
    place, system = buckets._files(spark, even)
    for found in system.listStatus(place(odd)):
        system.rename(found.getPath(), place(even, found.getPath().getName()))
    return files.read_tag_csvs(spark, even).select("song_id", "kind", "size", "source_csv", "file_order")


@query("lyric_folder", "SELECT 'c ' || c_custkey AS song_id, c_name || chr(10) || '词 ' || c_mktsegment AS full_lyric FROM customer")
def lyric_folder(spark, folder):
    """A text file for each customer; names hold a blank, texts have white space around them."""
    customer = table(spark, folder, "customer")
    texts = customer.select(
        F.concat(F.lit("c "), "c_custkey").alias("name"), F.concat(F.lit(" \n"), "c_name", F.lit("\n词 "), "c_mktsegment", F.lit(" \n")).alias("value"))
    return files.read_lyrics(spark, _write_files(texts, ".txt")).select("song_id", "full_lyric")


@query("snapshot_folder", """
SELECT CAST(s_suppkey AS VARCHAR) AS stem, s_suppkey % 3 <> 0 AS readable, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS song_name FROM supplier""")
def snapshot_folder(spark, folder):
    """A JSON document for each supplier, every third one broken off; both outputs of the reader."""
    supplier = table(spark, folder, "supplier")
    whole = F.to_json(F.struct(F.struct(F.col("s_name").alias("name")).alias("song")))
    texts = supplier.select(
        F.col("s_suppkey").cast("string").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, whole).otherwise(F.substring(whole, 1, 12)).alias("value"))
    readable, errors = files.read_snapshots(spark, _write_files(texts, ".json"))
    good = readable.select("stem", F.lit(True).alias("readable"), F.get_json_object("value", "$.song.name").alias("song_name"))
    bad = errors.select(F.regexp_replace("file_name", r"\.json\z", "").alias("stem"), F.lit(False).alias("readable"), F.lit(None).cast("string").alias("song_name"))
    return good.unionByName(bad)


@query("audio_folder", """
WITH k AS (SELECT s_suppkey, ['mp3', 'FLAC', 'txt', 'Wav', 'm4a', 'aac', 'Ogg', 'wave', 'mp4'][s_suppkey % 9 + 1] AS kind FROM supplier)
SELECT s_suppkey || ' - a.b' AS stem, kind FROM k WHERE lower(kind) IN ('mp3', 'flac', 'wav', 'm4a', 'aac', 'ogg')""")
def audio_folder(spark, folder):
    """Files of nine extensions below a folder, listed by ``list_audio``."""
    kinds = F.array(*map(F.lit, ("mp3", "FLAC", "txt", "Wav", "m4a", "aac", "Ogg", "wave", "mp4")))
    kind = F.element_at(kinds, (F.col("s_suppkey") % 9 + 1).cast("int"))
    rows = table(spark, folder, "supplier").select(F.concat("s_suppkey", F.lit(" - a.b."), kind).alias("name"), F.lit("x").alias("value"))
    listed = files.list_audio(spark, _write_files(rows, "", within="disc 1/side a"))
    return listed.select("stem", F.regexp_extract("name", r"([^.]*)\z", 1).alias("kind"))


@query("embedding_files", "SELECT CAST(vec_id AS VARCHAR) AS song_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, list_sum(CAST(embedding AS DOUBLE[])) AS total FROM embeddings")
def embedding_files(spark, folder):
    """A ``.npy`` file for each vector."""

    @F.pandas_udf("binary")
    def stored(vectors: pd.Series) -> pd.Series:
        out = []
        for vector in vectors:
            content = io.BytesIO()
            np.save(content, np.asarray(vector, dtype=np.float32))
            out.append(content.getvalue())
        return pd.Series(out)

    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("name"), stored("embedding").alias("value"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    vectors = files.read_embeddings(spark, _write_files(rows, ".npy"))
    return vectors.select("song_id", F.size("vector").cast("long").alias("n"), F.col("vector")[0].cast("double").alias("first"), total.alias("total"))


@query("jsonl_records", "SELECT CAST(doc_id AS VARCHAR) AS song_id, lang, length(text) AS n, source FROM documents")
def jsonl_records(spark, folder):
    """Documents as JSON lines with a key of their own each: named columns beside single values of the records."""
    path = session.scratch(spark)
    docs = table(spark, folder, "documents").select(
        F.to_json(F.create_map(F.lit("song_id"), F.col("doc_id").cast("string"), F.lit("text"), "text", F.lit("lang"), "lang", F.concat(F.lit("k"), "doc_id"), "source")).alias("value"))
    docs.write.text(path)
    named = files.read_jsonl(spark, path, columns=["song_id", "lang", "text"]).select("song_id", "lang", F.length("text").cast("long").alias("n"))
    record = files.read_records(spark, path).select(F.to_json("record").alias("r"))
    own = record.select(F.get_json_object("r", "$.song_id").alias("song_id"), F.from_json("r", "map<string,string>").alias("m"))
    return named.join(own.select("song_id", F.element_at("m", F.concat(F.lit("k"), "song_id")).alias("source")), "song_id")


HISTORY_LOG_SQL = """log AS (SELECT event_id, user_id, event_type AS action, json_extract_string(props, '$.k') AS song_id FROM events)"""


def _log(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("song_id"))


@query("history_file", "WITH " + HISTORY_LOG_SQL + " SELECT event_id, song_id FROM log ORDER BY event_id DESC LIMIT 80")
def history_file(spark, folder):
    stored = sinks.write_history(_log(spark, folder), session.scratch(spark), ["event_id"])
    return spark.read.json(stored).select("event_id", "song_id")


@query("history_array_file", """
WITH h AS (SELECT event_id, event_type, user_id, row_number() OVER (ORDER BY event_id DESC) AS back FROM events)
SELECT CAST(80 - back AS INT) AS position, CAST(event_id AS VARCHAR) AS song_id, event_type AS action, event_type || ',' || user_id AS all_tags FROM h WHERE back <= 80""")
def history_array_file(spark, folder):
    """The last 200 events as one JSON array with members that are no object in it, read with its limit of 80."""
    path = session.scratch(spark)
    last = table(spark, folder, "events").orderBy(F.desc("event_id")).limit(200)
    entry = F.to_json(F.struct(F.col("event_id").cast("string").alias("song_id"), F.col("event_type").alias("action"), F.array("event_type", F.col("user_id").cast("string")).alias("all_tags")))
    entries = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]).alias("e"))
    entries.select(F.concat(F.lit("[\n5, "), F.array_join("e", ",\nnull, "), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return files.read_history(spark, path).select("position", "song_id", "action", F.array_join("all_tags", ",").alias("all_tags"))


@query("feature_tables", "WITH " + model.LONG_SQL + " SELECT feature, item, cnt FROM counts")
def feature_tables(spark, folder):
    """Preprocessed catalogue stored with its counters; the second call reuses the stored tables."""
    path = session.scratch(spark)
    for _call in range(2):
        _wide, _rows, counts = sinks.load_or_build(spark, path, "v1", lambda: model.wide(spark, folder).drop("search_text"))
    return counts.select("feature", "item", "cnt")


@query("feature_tables_refreshed", "WITH " + model.LONG_SQL + " SELECT feature, item, cnt FROM counts")
def feature_tables_refreshed(spark, folder):
    """Counters that follow the catalogue from an earlier state: songs were added, changed and removed since."""
    path, songs, song = session.scratch(spark), model.songs(spark, folder), F.col("song_id").cast("long")
    changed = F.when(song % 3 == 0, F.concat(F.lit("nigh grandand\n"), "full_lyric")).otherwise(F.col("full_lyric"))
    earlier = songs.where(song % 5 != 0).withColumn("full_lyric", changed)
    removed = songs.where(song % 7 == 0).withColumn("song_id", F.concat(F.lit("gone "), "song_id"))
    feature_store.refresh(earlier.unionByName(removed), path, model.derived, "v1", n=8)
    _wide, _rows, counts = feature_store.refresh(songs, path, model.derived, "v1", n=8)
    return counts.select("feature", "item", "cnt")


@query("feature_table_rows", "WITH " + model.LONG_SQL + " SELECT song_id, feature, item FROM feature_rows")
def feature_table_rows(spark, folder):
    return features.feature_rows(model.wide(spark, folder)).select("song_id", "feature", "item")


def _digest_sum(start: int) -> str:
    return f"CAST(coalesce(sum(CAST('0x' || substr(digest, {start}, 8) AS UBIGINT)), 0) AS VARCHAR)"


@query("source_fingerprint", f"""
WITH f AS (SELECT md5('documents/' || doc_id || ':' || n_chars || ':' || doc_id * 1000003) AS digest FROM documents)
SELECT md5(concat_ws('|', 'v7', CAST(count(*) AS VARCHAR), {', '.join(map(_digest_sum, (1, 9, 17, 25)))})) AS fingerprint FROM f""")
def source_fingerprint(spark, folder):
    """Signature of a list of files with the sizes and times of documents."""
    listed = table(spark, folder, "documents").select(
        F.concat(F.lit("/base/documents/"), "doc_id").alias("path"), F.col("n_chars").alias("length"), F.timestamp_micros(F.col("doc_id") * 1000003).alias("modified"))
    return files.source_fingerprint(listed, "v7", "/base/")


@query("preview", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part ORDER BY part.p_partkey LIMIT 200")
def preview(spark, folder):
    path = session.scratch(spark)
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    part.orderBy("p_partkey").coalesce(1).write.option("header", "true").csv(path)
    return files.preview(spark, path, 300)


def _as_stream(spark, df, parts: int = 4):
    """The rows as a file stream of several batches."""
    path = session.scratch(spark)
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("last_n_stream", "WITH " + HISTORY_LOG_SQL + """
SELECT event_id, user_id, song_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM log) WHERE rn <= 10""")
def last_n_stream(spark, folder):
    log = _log(spark, folder)
    path = session.scratch(spark)
    streams.keep_last_n(_as_stream(spark, log), path, session.scratch(spark), 10, ["event_id"], ["user_id"]).awaitTermination()
    return buckets.read(spark, path).select("event_id", "user_id", "song_id")


@query("history_stream", "WITH " + HISTORY_LOG_SQL + """
SELECT event_id, l.song_id, CASE WHEN d.doc_id IS NULL THEN '' ELSE source || ' | ' || lang END AS artist_names FROM log l LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = l.song_id WHERE action <> 'view'""")
def history_stream(spark, folder):
    """Streamed interactions joined with the static catalogue, appended to a table."""
    songs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("song_id"), F.lit("n").alias("name"), F.concat_ws(" | ", "source", "lang").alias("artist_names"), F.lit("").alias("album_name"),
        F.split("lang", ",").alias("language_tags"))
    log = _log(spark, folder).withColumn("action", F.when(F.col("action") == "view", "select").otherwise(F.col("action")))
    entries = streams.history_entries(_as_stream(spark, log), songs, False, clicks=past.song_clicks(log))
    path = session.scratch(spark)
    entries.writeStream.format("parquet").option("checkpointLocation", session.scratch(spark)).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path).select("event_id", "song_id", F.coalesce("artist_names", F.lit("")).alias("artist_names"))


@query("upsert_stream", "WITH " + documents.UPSERT_SQL + """ SELECT song_id, endpoint, sha256('{"level": "' || level || '"}') AS params_hash, '{"q":' || best[1] || '}' AS response_json, collected_at FROM upserted""")
def upsert_stream(spark, folder):
    path = session.scratch(spark)
    streams.upsert_stream(_as_stream(spark, documents._results(spark, folder)), path, session.scratch(spark)).awaitTermination()
    return buckets.read(spark, path).select("song_id", "endpoint", "params_hash", "response_json", "collected_at")


