"""Filters, sorting, pages, profiles and charts of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.operators import catalog, features, filters, joins, profile
from tonearm.plans import tags as tag_plan
from tonearm.queries import model, scores
from tonearm.queries.registry import query, table

BASE = "WITH " + model.WIDE_BASE_SQL


def _wide(spark, folder):
    return model.wide(spark, folder, terms=False)


@query("keyword_filter", BASE + " SELECT song_id, name FROM wide_base WHERE contains(search_text, 'tion') AND contains(search_text, 'blue') AND contains(search_text, 'economy')")
def keyword_filter(spark, folder):
    return filters.keyword_filter(_wide(spark, folder), "TION, blue，Economy").select("song_id", "name")


@query("lyric_filter", "SELECT CAST(doc_id AS VARCHAR) AS song_id FROM documents WHERE contains(lower(text), 'hand') AND contains(lower(text), 'the.')")
def lyric_filter(spark, folder):
    lyrics = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"), F.col("text").alias("full_lyric"))
    return filters.lyric_filter(lyrics, "Hand the.").select("song_id")


@query("has_any", BASE + " SELECT song_id FROM wide_base WHERE list_has_any(artist_list, ['fr', 'src7']) AND list_has_any(language_list, ['fr', 'en'])")
def has_any(spark, folder):
    wide = _wide(spark, folder)
    return wide.where(filters.has_any("artist_list", ["fr", "src7"]) & filters.has_any("language_tags", ["fr", "en"])
                      & filters.has_any("language_tags", [])).select("song_id")


@query("blocked_tags", BASE + " SELECT song_id, all_tags FROM wide_base WHERE NOT list_has_any(string_split(all_tags, ' | '), ['calm', 'heavy'])")
def blocked_tags(spark, folder):
    return _wide(spark, folder).where(filters.without_blocked("generated_tag_list", ["calm", "heavy"])).select("song_id", "all_tags")


@query("isin_filter", BASE + " SELECT song_id, quality FROM wide_base WHERE quality IN ('Hi-Res', '标准')")
def isin_filter(spark, folder):
    songs = catalog.derive_catalog(model.songs(spark, folder))
    return songs.where(filters.is_in("quality", ["Hi-Res", "标准"])).select("song_id", "quality")


@query("flag_filter", "WITH " + model.SONGS_SQL + " SELECT song_id FROM songs WHERE playable AND has_lyric AND has_translation")
def flag_filter(spark, folder):
    return model.songs(spark, folder).where(filters.flags(True, True, True)).select("song_id")


@query("range_filter", BASE + " SELECT song_id FROM wide_base WHERE popularity >= 20 AND comment_total >= 100 AND (publish_year IS NULL OR publish_year BETWEEN 1980 AND 1999)")
def range_filter(spark, folder):
    songs = catalog.derive_catalog(model.songs(spark, folder))
    return songs.where(filters.ranges(20, 100, (1980, 1999))).select("song_id")


@query("find_by_name", """
SELECT p_partkey, p_name FROM part WHERE contains(lower(trim(p_name)), 'widget') ORDER BY lower(trim(p_name)) = 'widget' DESC, p_partkey LIMIT 1""")
def find_by_name(spark, folder):
    return filters.find_by_name(table(spark, folder, "part"), " WIDGET ", "p_partkey", "p_name").select("p_partkey", "p_name")


@query("batch", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position, (row_number() OVER (ORDER BY o_orderkey) - 1) // 250 AS batch FROM orders""")
def batch(spark, folder):
    work = table(spark, folder, "orders").select("o_orderkey")
    return filters.batches(work, "o_orderkey", 250)


@query("limit_rows", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate LIMIT 500")
def limit_rows(spark, folder):
    ordered = table(spark, folder, "lineitem").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return ordered.limit(500).select("l_orderkey", "l_partkey", "l_quantity")


@query("contains_marker", "SELECT page_id AS song_id FROM pages WHERE contains(html, 'script>var')")
def contains_marker(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("html").alias("value"), F.col("page_id").cast("string").alias("stem"))
    named = pages.unionByName(pages.withColumn("stem", F.concat(F.lit("x"), "stem"))).unionByName(pages)
    return filters.marked_documents(named, "script>var")


@query("top_candidates", "WITH " + model.LONG_SQL + ", " + scores.score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS) + """
SELECT song_id, dynamic_score, comment_total FROM scored JOIN wide_base USING (song_id) ORDER BY dynamic_score DESC, comment_total DESC, song_id LIMIT 20""")
def top_candidates(spark, folder):
    return joins.top_candidates(scores._scored(spark, folder)).select("song_id", "dynamic_score", "comment_total")


@query("global_sort", """
SELECT o_orderkey, o_totalprice FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS price FROM orders) ORDER BY price ASC NULLS LAST, o_orderkey""")
def global_sort(spark, folder):
    orders = table(spark, folder, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")))
    return joins.global_sort(orders, "price", True, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 60 OFFSET 120")
def page(spark, folder):
    return joins.page(table(spark, folder, "orders"), "o_totalprice", 2, key="o_orderkey").select("o_orderkey", "o_totalprice")


@query("value_counts", "SELECT trim(l_returnflag) AS item, count(*) AS cnt FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def value_counts(spark, folder):
    items = table(spark, folder, "lineitem").withColumn(
        "shown", F.when(F.col("l_returnflag") == "N", "NaN").otherwise(F.concat(F.lit(" "), "l_returnflag")))
    return profile.value_counts(items, "shown")


@query("year_histogram", "SELECT CAST(year(l_shipdate) AS INTEGER) AS publish_year, count(*) AS cnt FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL")
def year_histogram(spark, folder):
    items = table(spark, folder, "lineitem").select(F.when(F.col("l_returnflag") != "R", F.year("l_shipdate")).alias("publish_year"))
    return profile.year_histogram(items)


@query("top_counts", """
WITH w AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS x FROM documents)) WHERE word <> '')
SELECT word AS item, count(DISTINCT doc_id) AS cnt FROM w GROUP BY word ORDER BY cnt DESC, min(row(doc_id, pos)) LIMIT 12""")
def top_counts(spark, folder):
    words = table(spark, folder, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return profile.top_counts(words, "words", "doc_id")


@query("chart_table", "WITH " + model.LONG_SQL + """
SELECT feature, item, cnt, CAST(rank AS INTEGER) AS rank, rank <= 15 AS in_bar FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, item) AS rank FROM counts) WHERE rank <= 150""")
def chart_table(spark, folder):
    return profile.chart_table(features.frequency_counts(model.rows(model.wide(spark, folder))))


@query("headline_metrics", "WITH " + model.LONG_SQL + ", " + scores.score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS) + """,
shown AS (SELECT * FROM wide_base JOIN scored USING (song_id) WHERE playable)
SELECT count(*) AS shown, (SELECT count(*) FROM songs) AS total, (SELECT count(DISTINCT a) FROM (SELECT unnest(artist_list) AS a FROM shown)) AS artists,
  count(*) FILTER (WHERE has_lyric) AS with_lyric, count(*) FILTER (WHERE playable) AS playable, round(avg(dynamic_score), 4) AS mean_score FROM shown""")
def headline_metrics(spark, folder):
    scored = scores._scored(spark, folder)
    return profile.headline_metrics(scored.where("playable"), scored).withColumn("mean_score", F.round("mean_score", 4))


@query("distinct_values", BASE + """
SELECT DISTINCT 'artists' AS feature, unnest(artist_list) AS item FROM wide_base UNION SELECT 'language', unnest(language_list) FROM wide_base
UNION SELECT 'all_tags', unnest(string_split(all_tags, ' | ')) FROM wide_base WHERE all_tags <> ''""")
def distinct_values(spark, folder):
    columns = {"artists": "artist_list", "language": "language_tags", "all_tags": "generated_tag_list"}
    return profile.distinct_values(_wide(spark, folder), columns)


@query("min_max", BASE + """
SELECT min(popularity) AS min_popularity, max(popularity) AS max_popularity, min(comment_total) AS min_comment_total, max(comment_total) AS max_comment_total,
  min(publish_year) AS min_publish_year, max(publish_year) AS max_publish_year FROM wide_base""")
def min_max(spark, folder):
    songs = catalog.derive_catalog(model.songs(spark, folder))
    return profile.bounds(songs, ("popularity", "comment_total", "publish_year"))


@query("dataset_profile", " UNION ALL ".join(
    f"SELECT '{name}' AS artefact, count(*) AS row_count FROM {name}"
    for name in ("documents", "labels", "part", "embeddings", "events", "conversations", "pages", "benchmark")))
def dataset_profile(spark, folder):
    names = ("documents", "labels", "part", "embeddings", "events", "conversations", "pages", "benchmark")
    return profile.dataset_profile({name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names})


@query("file_profile", "SELECT '/library/' || source AS folder, count(*) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM documents GROUP BY source")
def file_profile(spark, folder):
    listed = table(spark, folder, "documents").select(F.concat(F.lit("/library/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("n_chars").alias("length"))
    return profile.file_profile(listed)


@query("only_new_results", """
SELECT CAST(doc_id AS VARCHAR) AS song_id, CASE WHEN doc_id % 3 = 0 THEN 'stored' ELSE 'made' END AS origin, n_chars FROM documents WHERE doc_id % 5 <> 0""")
def only_new_results(spark, folder):
    """A second run of a job over four fifths of the songs, when a third of all are stored."""
    songs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"), "n_chars", "doc_id")
    stored = songs.where("doc_id % 3 = 0").select("song_id", F.lit("stored").alias("origin"), "n_chars")
    return tag_plan.only_new(stored, songs.where("doc_id % 5 <> 0"), lambda new: new.select("song_id", F.lit("made").alias("origin"), "n_chars"))


@query("filtered_profile", BASE + """, kept AS (SELECT * FROM wide_base WHERE popularity >= 20)
SELECT 'artists' AS feature, item, count(*) AS cnt FROM (SELECT DISTINCT song_id, unnest(artist_list) AS item FROM kept) GROUP BY item
UNION ALL SELECT 'tags', item, count(*) FROM (SELECT DISTINCT song_id, unnest(string_split(all_tags, ' | ')) AS item FROM kept WHERE all_tags <> '') GROUP BY item
UNION ALL SELECT 'languages', item, count(*) FROM (SELECT DISTINCT song_id, unnest(language_list) AS item FROM kept) GROUP BY item
UNION ALL SELECT 'quality', quality, count(*) FROM kept GROUP BY quality""")
def filtered_profile(spark, folder):
    return profile.filtered_profile(_wide(spark, folder).where("popularity >= 20"))


@query("library_profile", "WITH " + model.LONG_SQL + """
SELECT feature, item, cnt FROM counts WHERE feature IN ('all_tags', 'artists', 'title_terms', 'lyric_terms', 'comment_semantic', 'emotion')""")
def library_profile(spark, folder):
    return profile.library_profile(features.frequency_counts(model.rows(model.wide(spark, folder))))


@query("song_detail", BASE + """, s AS (SELECT * FROM wide_base WHERE song_id = '7')
SELECT song_id, field, content FROM (
  SELECT song_id, 'name' AS field, name AS content FROM s UNION ALL SELECT song_id, 'artists_album', artist_names || ' · ' || album_name FROM s
  UNION ALL SELECT song_id, 'quality', quality FROM s UNION ALL SELECT song_id, 'tags', all_tags FROM s
  UNION ALL SELECT song_id, 'comments', CAST(CAST(comment_total AS BIGINT) AS VARCHAR) FROM s
  UNION ALL SELECT song_id, 'duration', printf('%.1f', duration_minutes) || ' min' FROM s
  UNION ALL SELECT song_id, 'local_audio', local_audio_path FROM s UNION ALL SELECT song_id, 'playback_url', standard_url FROM s
  UNION ALL SELECT song_id, 'lyric', regexp_replace(full_lyric, '^\\s+|\\s+$', '', 'g') FROM s)""")
def song_detail(spark, folder):
    wide = _wide(spark, folder).withColumn("recommend_score", F.lit(0))
    shown = ["name", "artists_album", "quality", "tags", "comments", "duration", "local_audio", "playback_url", "lyric"]
    return catalog.song_detail(wide, "7").where(F.col("field").isin(shown))


@query("analysis_text", """
SELECT CAST(d.doc_id AS VARCHAR) AS song_id,
  regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(CASE WHEN lang = 'de' THEN '' ELSE text END, ''), concat_ws(' ', '', '', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')), '\\[[^\\]]+\\]', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS lyric,
  trim(coalesce(h, '') || ' ' || coalesce(r, '')) AS comments
FROM documents d LEFT JOIN (SELECT conv_id, regexp_replace(max(text) FILTER (WHERE turn = 0), '^\\s+|\\s+$', '', 'g') AS h, regexp_replace(max(text) FILTER (WHERE turn = 1), '^\\s+|\\s+$', '', 'g') AS r FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id""")
def analysis_text(spark, folder):
    talk = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("first_hot_comment"),
        F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("first_comment"))
    documents = table(spark, folder, "documents")
    joined = documents.join(talk, F.col("conv_id") == F.col("doc_id"), "left").select(
        F.col("doc_id").cast("string").alias("song_id"), F.when(F.col("lang") == "de", "").otherwise(F.col("text")).alias("full_lyric"),
        F.col("text").alias("lyric_excerpt"), "first_hot_comment", "first_comment")
    return joined.select("song_id", catalog.lyric_analysis_text(joined.columns).alias("lyric"),
                         catalog.comment_text(joined.columns).alias("comments"))


