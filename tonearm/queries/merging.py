"""Unions, merges and joins of keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.operators import joins, merge
from tonearm.queries import model
from tonearm.queries.registry import query, table


def _two_sources(spark, folder):
    """part as two source tables with different columns; the second holds every name again."""
    part = table(spark, folder, "part")
    first = part.select(F.col("p_name").alias("song_id"), F.col("p_brand").alias("brand"),
                        F.when(F.col("p_size") > 20, F.col("p_type")).alias("kind"), F.col("p_partkey").alias("row_order"))
    second = part.select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("song_id"),
                         F.when(F.col("p_size") < 10, F.lit("  ")).otherwise(F.col("p_size").cast("string")).alias("size"),
                         F.lit("").alias("blank"), F.col("p_partkey").alias("row_order"))
    return merge.union_by_name([first, second])


TWO_SOURCES_SQL = """two_sources AS (
  SELECT p_name AS song_id, p_brand AS brand, CASE WHEN p_size > 20 THEN p_type END AS kind, NULL AS size, NULL AS blank, 0 AS file_order, p_partkey AS row_order FROM part
  UNION ALL
  SELECT ' ' || p_name || ' ', NULL, NULL, CASE WHEN p_size < 10 THEN '  ' ELSE CAST(p_size AS VARCHAR) END, '', 1, p_partkey FROM part)"""


@query("union_by_name", "WITH " + TWO_SOURCES_SQL + " SELECT song_id, brand, kind, size, blank, file_order, row_order FROM two_sources")
def union_by_name(spark, folder):
    return _two_sources(spark, folder)


@query("dedup_most_complete", "WITH " + TWO_SOURCES_SQL + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trim(song_id) ORDER BY
    CASE WHEN trim(coalesce(brand, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(kind, '')) <> '' THEN 1 ELSE 0 END
    + CASE WHEN trim(coalesce(size, '')) <> '' THEN 1 ELSE 0 END DESC, file_order DESC, row_order DESC) AS rn FROM two_sources)
SELECT trim(song_id) AS song_id, brand, kind, size, blank, file_order, row_order FROM ranked WHERE rn = 1""")
def dedup_most_complete(spark, folder):
    return merge.dedup_most_complete(_two_sources(spark, folder))


def _latest_sql(columns: dict[str, str]) -> str:
    picked = ", ".join(
        f"coalesce(arg_max({value}, file_order * 1000000000 + row_order) FILTER (WHERE trim({name}) <> ''), '') AS {name}"
        for name, value in columns.items()
    )
    return "WITH " + TWO_SOURCES_SQL + f""" SELECT trim(song_id) AS song_id, {picked},
  max(file_order * 1000000000 + row_order) AS last_position FROM two_sources GROUP BY ALL"""


def _flat_position(df):
    position = F.col("last_order.file_order") * F.lit(1000000000) + F.col("last_order.row_order")
    return df.withColumn("last_position", position).drop("last_order")


@query("latest_nonblank_merge", _latest_sql({"brand": "trim(brand)", "kind": "trim(kind)", "size": "trim(size)"}))
def latest_nonblank_merge(spark, folder):
    return _flat_position(merge.latest_nonblank(_two_sources(spark, folder), keep_blank_columns=False))


@query("latest_nonblank_merge_semantics", _latest_sql({"brand": "brand", "kind": "kind", "size": "size", "blank": "blank"}))
def latest_nonblank_merge_semantics(spark, folder):
    return _flat_position(merge.latest_nonblank(_two_sources(spark, folder), trim_values=False))


@query("merge_tag_tables", "WITH " + TWO_SOURCES_SQL + """
SELECT trim(song_id) AS song_id, coalesce(arg_max(trim(kind), file_order * 1000000000 + row_order) FILTER (WHERE trim(kind) <> ''), '') AS style_tags,
  coalesce(arg_max(trim(size), file_order * 1000000000 + row_order) FILTER (WHERE trim(size) <> ''), '') AS generated_language_tags
FROM two_sources GROUP BY ALL""")
def merge_tag_tables(spark, folder):
    named = _two_sources(spark, folder).withColumnsRenamed({"kind": "style_tags", "size": "language_tags", "blank": "scene_tags"})
    return merge.merge_tag_tables(named).drop("last_order")


@query("keep_last", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def keep_last(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return merge.keep_last(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("left_joins", "WITH " + model.TAGS_SQL + """
SELECT s.song_id, coalesce(t.style_tags, '') AS style_tags, coalesce(t.all_tags, '') AS all_tags, '' AS mert_cluster,
  coalesce(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), '') AS full_lyric
FROM songs s LEFT JOIN (SELECT * FROM tag_table WHERE contains(all_tags, 'calm')) t USING (song_id)
LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') d ON CAST(d.doc_id AS VARCHAR) = s.song_id""")
def left_joins(spark, folder):
    base = model.songs(spark, folder).select("song_id")
    tagged = joins.with_tags(base, model.tag_table(spark, folder).where(F.contains("all_tags", F.lit("calm"))))
    lyrics = table(spark, folder, "documents").where("lang <> 'de'").select(
        F.col("doc_id").cast("string").alias("song_id"), F.col("text").alias("full_lyric"))
    return joins.with_lyrics(tagged, lyrics).select("song_id", "style_tags", "all_tags", "mert_cluster", "full_lyric")


def _match_table(spark, folder):
    """One file per document with a label, as a match table."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("song_id"), F.concat(F.lit("/music/"), "doc_id").alias("file_path"),
        (F.col("quality") / 2 + 0.5).alias("match_score"), F.lit("r").alias("match_reason"), F.lit("metadata").alias("match_source"),
        F.lit("t").alias("audio_title"), F.lit("a").alias("audio_artist"), F.lit("b").alias("audio_album"),
        F.lit(1.5).alias("local_duration_seconds"), F.lit(None).cast("double").alias("duration_diff_seconds"))


@query("left_join_matches", """
SELECT CAST(d.doc_id AS VARCHAR) AS song_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE '/music/' || l.doc_id END AS local_audio_path,
  CASE WHEN l.doc_id IS NULL THEN '' WHEN quality = 1 THEN '1.0' ELSE '0.5' END AS audio_match_score, '' AS duration_diff_seconds,
  coalesce(nullif(CAST(quality AS VARCHAR), ''), '') AS quality, CAST(toxic AS INTEGER) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_matches(spark, folder):
    ids = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"))
    matched = joins.with_matches(ids, _match_table(spark, folder))
    more = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("song_id"), F.col("quality").cast("string").alias("quality"), "toxic",
        F.lit("x").alias("local_audio_path"))
    joined = joins.with_features(matched, more)
    return joined.select("song_id", "local_audio_path", "audio_match_score", "duration_diff_seconds",
                         F.coalesce("quality", F.lit("")).alias("quality"), "toxic")


@query("selected_or_top", """
SELECT 'selected' AS mode, o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77
UNION ALL (SELECT 'top' AS mode, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 1)""")
def selected_or_top(spark, folder):
    orders = table(spark, folder, "orders")
    order, key = ("o_totalprice", "o_orderdate"), "o_orderkey"

    def picked(mode, selected):
        chosen = joins.selected_or_top(orders, selected, order, key)
        return chosen.select(F.lit(mode).alias("mode"), "o_orderkey", "o_totalprice")

    return picked("selected", 77).unionByName(picked("top", None))
