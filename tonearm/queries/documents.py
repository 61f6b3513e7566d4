"""Nested documents: flattening, harvesting, licence filter, upsert, assembly, id lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import text, udfs
from tonearm.operators import snapshots
from tonearm.queries.registry import query, table
from tonearm.sources import files


def _object(**fields):
    return F.struct(*[(value if not isinstance(value, (str, int, float)) else F.lit(value)).alias(name) for name, value in fields.items()])


FLAT = ["source_file", "song_id", "name", "aliases", "artist_names", "artist_ids", "album_id", "album_name", "duration_ms", "duration_text", "publish_date",
        "popularity", "playable", "max_bitrate", "privilege_status"]


def _flat_documents(spark, folder):
    """Documents whose lists hold one kind of object each."""
    labels = table(spark, folder, "labels")
    part = table(spark, folder, "part")
    joined = table(spark, folder, "documents").join(labels, "doc_id", "left").join(part, F.col("p_partkey") == F.col("doc_id"), "left")
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    song = _object(
        id=k, name=F.col("p_name"), dt=F.col("n_chars") * 97, publishTime=(k + 1) * 86400000 * 30,
        al=_object(id=k * 2, name=F.col("p_brand"), picUrl=F.concat(F.lit("http://pic/"), "doc_id")), alia=F.array("p_type", F.lit(" ")),
        pop=F.pmod("n_chars", F.lit(101)), sq=_object(br=F.col("n_chars") * 10, size=F.col("n_chars"), sr=44100))
    other = _object(
        id=k + 1, name="other", dt=F.lit(1).cast("long"), publishTime=F.lit(1).cast("long"), al=_object(id=k, name="no", picUrl="no"), alia=F.array(F.lit("no"), F.lit("no")),
        pop=F.lit(0).cast("long"), sq=_object(br=F.lit(0).cast("long"), size=F.lit(0).cast("long"), sr=0))

    def result(error, response):
        return _object(error=error, response=response)

    def comments(total, content, likes, user):
        return _object(total=total, hotComments=F.array(_object(content=content, likedCount=likes, user=_object(nickname=user))))

    def url(level, own, link, br):
        return _object(params=_object(level=level), response=_object(data=F.array(_object(url=link, br=br, size=F.col("n_chars"), type="flac", code=200, md5="m", level=own))))

    api = _object(
        lyric_new=F.array(result(none, _object(lrc=_object(lyric=F.concat(F.lit("[00:01.00]"), "text")), tlyric=_object(lyric=F.when(F.col("toxic") == 1, "tr").otherwise(""))))),
        comment_music=F.array(result(F.lit("rate limit"), comments(F.lit(0).cast("long"), F.lit("none"), F.lit(0), F.lit("no"))),
                              result(none, comments(F.col("n_chars"), F.col("text"), F.col("p_size"), F.col("source")))),
        song_url_v1=F.array(url("lossless", "x", F.lit("old"), 1), url("lossless", "x", F.concat(F.lit("http://u/"), "doc_id"), 900000), url("", "hires", F.lit("h"), 2)),
        simi_song=F.array(_object(response=_object(songs=F.array(
            _object(id=7, name=F.col("p_name"), artists=F.array(_object(name=F.lit("y")), _object(name=F.col("lang")))),
            _object(id=8, name=F.lit("s2"), artists=F.array(_object(name=F.lit("z")), _object(name=F.lit(" ")))))))),
        song_wiki_summary=F.array(_object(response=_object(data=_object(title=F.col("lang"), list=F.array(_object(zz="no", text=F.col("p_brand")), _object(zz="no", text=F.lit("BPM | 128"))), desc=F.col("p_type"))))),
        check_music=F.array(_object(response=_object(success=F.col("quality") == 1, message=F.when(F.col("toxic") == 1, f"此歌曲{vocab.UNLICENSED_MARKER}").otherwise("ok")))))
    document = _object(
        song_id=F.when(F.col("lang") != "de", k), name=F.when(F.col("lang") == "en", F.concat(F.lit("Own "), "p_name")).otherwise(""),
        duration_ms=F.when(F.col("lang") == "fr", F.col("n_chars") * 100).otherwise(0), artists=F.array(_object(id=k + 5, name=F.col("source")), _object(id=k + 6, name=F.col("lang"))),
        raw_detail=_object(songs=F.when(F.col("lang") == "de", F.array(song, other)).otherwise(F.array(other, song)), privileges=F.array(_object(id=k, pl=F.coalesce("quality", F.lit(0)), maxbr=999000, st=-1))),
        collected_at="2024-01-01T00:00:00+00:00", api_results=api)
    return joined.select(F.concat("doc_id", F.lit(".json")).alias("file_name"), "doc_id", "text", F.to_json(document).alias("value"))


SNAPSHOT_SQL = """base AS (SELECT d.doc_id, text, lang, source, n_chars, quality, toxic, p_name, p_brand, p_type, p_size FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN part ON p_partkey = d.doc_id),
flat AS (SELECT *, trim(replace('[00:01.00]' || """ + "regexp_replace(text, '\\s+$', '')" + """, chr(10), ' / ')) AS lyric_flat, trim(replace(text, chr(10), ' / ')) AS text_flat,
  CASE WHEN lang = 'fr' AND n_chars > 0 THEN n_chars * 100 ELSE n_chars * 97 END AS ms FROM base)"""


@query("snapshot_flatten", "WITH " + SNAPSHOT_SQL + """
SELECT doc_id || '.json' AS source_file, CAST(doc_id AS VARCHAR) AS song_id, CASE WHEN lang = 'en' THEN 'Own ' || p_name ELSE p_name END AS name, p_type AS aliases,
  source || ' | ' || lang AS artist_names, (doc_id + 5) || ' | ' || (doc_id + 6) AS artist_ids, CAST(doc_id * 2 AS VARCHAR) AS album_id, p_brand AS album_name, CAST(ms AS VARCHAR) AS duration_ms,
  CASE WHEN round_even(ms / 1000, 0) >= 3600 THEN CAST(round_even(ms / 1000, 0) AS BIGINT) // 3600 || ':' || lpad(CAST(CAST(round_even(ms / 1000, 0) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0')
    ELSE CAST(CAST(round_even(ms / 1000, 0) AS BIGINT) // 60 AS VARCHAR) END || ':' || lpad(CAST(CAST(round_even(ms / 1000, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration_text,
  CASE WHEN (doc_id + 1) * 30 < 2932896 THEN strftime(CAST('1970-01-01' AS DATE) + CAST((doc_id + 1) * 30 AS INTEGER), '%Y-%m-%d') ELSE '' END AS publish_date,
  CAST(n_chars % 101 AS VARCHAR) AS popularity, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS playable, '999000' AS max_bitrate, '-1' AS privilege_status,
  CAST(n_chars AS VARCHAR) AS comment_total, '1' AS hot_comment_count, source AS first_hot_comment_user, CAST(p_size AS VARCHAR) AS first_hot_comment_likes,
  CASE WHEN length(text_flat) <= 500 THEN text_flat ELSE rtrim(substr(text_flat, 1, 497)) || '...' END AS first_hot_comment,
  'true' AS has_lyric, CASE WHEN length(lyric_flat) <= 500 THEN lyric_flat ELSE rtrim(substr(lyric_flat, 1, 497)) || '...' END AS lyric_excerpt,
  CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS has_translation, '7 | 8' AS similar_song_ids, p_name || ' | s2' AS similar_song_names, 'y/' || lang || ' | z' AS similar_artist_names,
  lang || ' | ' || p_brand || ' | BPM | 128 | ' || p_type AS wiki_summary_excerpt, CAST(n_chars * 10 AS VARCHAR) AS sq_br, '' AS hr_br,
  'http://u/' || doc_id AS lossless_url, '900000' AS lossless_br, 'h' AS hires_url, '' AS standard_url,
  CASE WHEN quality = 1 THEN 'true' WHEN quality = 0 THEN 'false' ELSE '' END AS check_success FROM flat""")
def snapshot_flatten(spark, folder):
    flat = snapshots.flatten_snapshots(_flat_documents(spark, folder))
    return flat.select(
        *FLAT, "comment_total", "hot_comment_count", "first_hot_comment_user", "first_hot_comment_likes", "first_hot_comment", "has_lyric", "lyric_excerpt", "has_translation",
        "similar_song_ids", "similar_song_names", "similar_artist_names", "wiki_summary_excerpt", "sq_br", "hr_br", "lossless_url", "lossless_br", "hires_url", "standard_url", "check_success")


@query("deep_harvest", "WITH " + SNAPSHOT_SQL + " SELECT doc_id, concat_ws('#', lang, nullif(trim(text, ' ' || chr(10)), ''), 'ok') AS texts FROM base")
def deep_harvest(spark, folder):
    documents = table(spark, folder, "documents")
    nested = F.to_json(_object(name=F.col("lang"), skip=_object(other="x", list=F.array(_object(text=F.col("text")))), content=F.array(F.lit("ok"), F.lit(" "))))
    return documents.select("doc_id", F.array_join(udfs.harvest_texts(nested), "#").alias("texts"))


@query("unlicensed_filter", "SELECT d.doc_id || '.json' AS file_name, coalesce(toxic, 0) = 1 AS unlicensed FROM documents d LEFT JOIN labels USING (doc_id)")
def unlicensed_filter(spark, folder):
    return snapshots.with_unlicensed_flag(_flat_documents(spark, folder)).select("file_name", "unlicensed")


@query("licensed_documents", "SELECT d.doc_id FROM documents d LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1")
def licensed_documents(spark, folder):
    return snapshots.licensed(_flat_documents(spark, folder)).select("doc_id")


@query("unreadable_documents", "SELECT page_id || '.json' AS file_name, 'not valid JSON' AS error FROM pages")
def unreadable_documents(spark, folder):
    pages = table(spark, folder, "pages").select(F.concat("page_id", F.lit(".json")).alias("file_name"), F.col("html").alias("value"))
    good = table(spark, folder, "labels").select(F.concat("doc_id", F.lit("g.json")).alias("file_name"), F.to_json(F.struct("doc_id")).alias("value"))
    return snapshots.unreadable(pages.unionByName(good))


def _results(spark, folder):
    """Collected results: lineitem as (song, endpoint, parameters) with a collection time."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("song_id"), F.col("l_returnflag").alias("endpoint"),
        text.params_hash({"level": F.col("l_linestatus")}).alias("params_hash"),
        F.to_json(F.struct(F.col("l_linestatus").alias("level"))).alias("params_json"),
        F.to_json(F.struct(F.col("l_quantity").cast("long").alias("q"))).alias("response_json"),
        F.lit(200).alias("status"), F.lit(200).alias("code"), F.lit("").alias("error"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("collected_at"),
        ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("id"))


UPSERT_SQL = """results AS (SELECT l_orderkey AS song_id, l_returnflag AS endpoint, l_linestatus AS level, CAST(l_quantity AS BIGINT) AS q, (l_linenumber * 1000000 + l_partkey) * 2 + (l_linestatus = 'O')::INT AS id,
  CAST(epoch(l_shipdate) AS BIGINT) * 1000000 + l_linenumber * 100000 + l_suppkey AS collected_at FROM lineitem),
upserted AS (SELECT song_id, endpoint, level, arg_max(row(q, id), collected_at) AS best, max(collected_at) AS collected_at FROM results GROUP BY ALL)"""


@query("snapshot_upsert", "WITH " + UPSERT_SQL + """ SELECT song_id, endpoint, sha256('{"level": "' || level || '"}') AS params_hash, '{"q":' || best[1] || '}' AS response_json, collected_at FROM upserted""")
def snapshot_upsert(spark, folder):
    results = _results(spark, folder)
    upserted = snapshots.upsert_results(results.where("song_id % 2 = 0").unionByName(results.where("collected_at % 3 = 0")), results)
    return upserted.select("song_id", "endpoint", "params_hash", "response_json", "collected_at")


@query("snapshot_assemble", "WITH " + UPSERT_SQL + """, entries AS (SELECT song_id, endpoint, string_agg('"q":' || best[1], ',' ORDER BY best[2]) AS qs, count(*) AS n FROM upserted GROUP BY ALL)
SELECT song_id, string_agg(endpoint || '=' || qs, ';' ORDER BY endpoint) AS results FROM entries GROUP BY song_id""")
def snapshot_assemble(spark, folder):
    upserted = snapshots.upsert_results(_results(spark, folder).limit(0), _results(spark, folder))
    songs = upserted.select("song_id").distinct().select(
        "song_id", F.lit("n").alias("name"), F.lit(1).alias("album_id"), F.lit("a").alias("album_name"), F.lit(5).alias("duration_ms"),
        F.lit("2024").alias("collected_at"), F.lit('[{"id":1}]').alias("artists_json"), F.lit(None).cast("string").alias("raw_detail_json"))
    documents = snapshots.assemble_snapshots(songs, upserted)
    parsed = documents.select("song_id", F.explode(F.from_json(F.get_json_object("document", "$.api_results"), "map<string,array<struct<response:string>>>")).alias("endpoint", "rows"))
    shown = parsed.select("song_id", F.concat("endpoint", F.lit("="), F.array_join(F.transform("rows", lambda row: F.regexp_extract(row["response"], r"\{(.*)\}", 1)), ",")).alias("e"))
    return shown.groupBy("song_id").agg(F.array_join(F.array_sort(F.collect_list("e")), ";").alias("results"))


@query("playlist_ids", """
WITH ids AS (SELECT o_custkey, l_partkey, min(row(l_orderkey, l_linenumber, l_partkey)) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey <> 0 GROUP BY ALL)
SELECT o_custkey AS playlist_id, l_partkey AS song_id FROM ids""")
def playlist_ids(spark, folder):
    lines = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    listed = lines.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id")))).alias("ids"))
    tracks = F.to_json(F.struct(F.struct(F.struct(F.col("ids").alias("trackIds")).alias("playlist")).alias("body")))
    songs = F.to_json(F.struct(F.struct(F.col("ids").alias("songs")).alias("body")))
    documents = listed.select(F.col("o_custkey").alias("playlist_id"), F.when(F.col("o_custkey") % 2 == 0, songs).otherwise(tracks).alias("value"))
    return snapshots.playlist_track_ids(documents).select("playlist_id", "song_id")


@query("id_list", "SELECT DISTINCT l_partkey AS song_id FROM lineitem")
def id_list(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("position"), F.concat(F.lit(" "), F.concat_ws(", ", "l_partkey", "l_partkey"), F.lit(" # 99999999 x")).alias("value"))
    return files.parse_id_list(lines).select("song_id")
