"""Scalar functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import arrays, numbers, text
from tonearm.operators import catalog, filters
from tonearm.queries import model
from tonearm.queries.registry import query, table

FULL_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("conform_schema", "WITH " + model.SONGS_SQL + """
SELECT song_id, name, popularity, comment_total, lyric_line_count, duration_seconds, hires_br, lossless_br,
  exhigh_br, hot_comment_count, playable, has_lyric, has_translation, has_romaji, check_success FROM songs""")
def conform_schema(spark, folder):
    return model.songs(spark, folder).select(
        "song_id", "name", "popularity", "comment_total", "lyric_line_count", "duration_seconds", "hires_br",
        "lossless_br", "exhigh_br", "hot_comment_count", "playable", "has_lyric", "has_translation", "has_romaji",
        "check_success",
    )


@query("normalize_key", """
SELECT trim(p_name) AS song_id, p_type AS generated_language_tags, p_brand AS brand FROM part WHERE trim(coalesce(p_name, '')) <> ''""")
def normalize_key(spark, folder):
    part = table(spark, folder, "part").select(
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias(" song_id"), F.col("p_type").alias("language_tags "),
        F.col("p_brand").alias("brand"),
    )
    return catalog.normalize_key(part)


@query("parse_bool", """
SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR l_returnflag = 'A' AS flag, l_linenumber = 1 AS number_flag FROM lineitem""")
def parse_bool(spark, folder):
    shown = F.when(F.col("l_returnflag") == "R", " Yes ").when(F.col("l_returnflag") == "A", "TRUE").otherwise("no")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.parse_bool(shown).alias("flag"),
        numbers.parse_bool("l_linenumber").alias("number_flag"),
    )


@query("to_number", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS amount,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS amount_or_null FROM orders""")
def to_number(spark, folder):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return table(spark, folder, "orders").select(
        "o_orderkey", numbers.to_number(raw).alias("amount"), numbers.to_number(raw, None).alias("amount_or_null"))


@query("split_tags", """
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '#'), '') AS parts,
  CAST(len(list_filter(list_transform(string_split(replace(text, ',', '|'), '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS BIGINT) AS n FROM documents""")
def split_tags(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select(
        "doc_id", F.array_join(text.split_pipe("text"), "#").alias("parts"),
        F.size(text.split_pipe(F.replace("text", F.lit(","), F.lit("|")))).cast("long").alias("n"),
    )


WORDS_SQL = "words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM documents))"


@query("unique_items", "WITH " + WORDS_SQL + """, firsts AS (SELECT doc_id, word, min(pos) AS first FROM words WHERE word <> '' GROUP BY ALL)
SELECT d.doc_id, coalesce(l, '') AS items FROM documents d LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY first) AS l FROM firsts GROUP BY doc_id) USING (doc_id)""")
def unique_items(spark, folder):
    words = F.split(text.collapse_blanks("text"), " ")
    return table(spark, folder, "documents").select("doc_id", F.array_join(arrays.unique_items(words), " ").alias("items"))


@query("union_tags", "WITH " + model.TAGS_SQL + """, parts AS (
  SELECT song_id, 1 AS step, unnest(string_split(style_tags, ' | ')) AS tag, generate_subscripts(string_split(style_tags, ' | '), 1) AS pos FROM tag_table
  UNION ALL SELECT song_id, 2, unnest(string_split(all_tags, ' | ')), generate_subscripts(string_split(all_tags, ' | '), 1) FROM tag_table
  UNION ALL SELECT song_id, 3, unnest(string_split(scene_tags, ' | ')), generate_subscripts(string_split(scene_tags, ' | '), 1) FROM tag_table),
firsts AS (SELECT song_id, tag, min(step * 1000 + pos) AS first FROM parts WHERE tag <> '' GROUP BY ALL)
SELECT t.song_id, coalesce(u, '') AS united FROM tag_table t LEFT JOIN (SELECT song_id, string_agg(tag, ' | ' ORDER BY first) AS u FROM firsts GROUP BY song_id) USING (song_id)""")
def union_tags(spark, folder):
    return model.tag_table(spark, folder).select(
        "song_id", F.array_join(arrays.union_tags("style_tags", "all_tags", "scene_tags"), " | ").alias("united"))


@query("coerce_list", """
SELECT conv_id, string_agg(t, '#' ORDER BY turn) AS items FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) WHERE t <> '' GROUP BY conv_id""")
def coerce_list(spark, folder):
    listed = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda item: item["text"]).alias("texts"))
    return listed.select("conv_id", F.array_join(arrays.coerce_list("texts", True), "#").alias("items"))


@query("normalize_search_text", "SELECT doc_id, regexp_replace(lower(" + FULL_STRIP.format("text") + "), '\\s+', ' ', 'g') AS search FROM documents")
def normalize_search_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.normalize_for_search("text").alias("search"))


_PUNCT = "[`~!@#$%^&*_=+\\[\\]{}\\\\|;:''\",.<>/?，。、《》？；：‘’“”【】！￥…—·]"


@query("normalize_match_text", f"""
SELECT page_id, trim(compact) AS compact, regexp_replace(compact, '\\s+', '', 'g') AS match_key FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(html), '\\[[^\\]]*\\]|\\([^)]*\\)|（[^）]*）', ' ', 'g'), '{_PUNCT}', ' ', 'g'), '\\s+', ' ', 'g') AS compact FROM pages)""")
def normalize_match_text(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.compact_text("html").alias("compact"), text.match_key("html").alias("match_key"))


@query("clean_lyric_text", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lrc, '\\[[^\\]]+\\]', ' ', 'g'),
  '(?im)^\\s*(作词|作曲|编曲|制作人|OP|SP|Publisher)\\s*[:：].*$', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned
FROM (SELECT doc_id, '[00:01.00]' || source || chr(10) || ' op : ' || lang || chr(10) || text AS lrc FROM documents)""")
def clean_lyric_text(spark, folder):
    lrc = F.concat(F.lit("[00:01.00]"), "source", F.lit("\n op : "), "lang", F.lit("\n"), "text")
    return table(spark, folder, "documents").select("doc_id", text.clean_lyric(lrc).alias("cleaned"))


@query("excerpt", """
SELECT doc_id, CASE WHEN length(flat) <= 300 THEN flat ELSE rtrim(substr(flat, 1, 297)) || '...' END AS short,
  CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(substr(flat, 1, 77)) || '...' END AS shorter
FROM (SELECT doc_id, trim(replace(replace(text, chr(13), ' '), chr(10), ' / ')) AS flat FROM documents)""")
def excerpt(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.excerpt("text").alias("short"), text.excerpt("text", 80).alias("shorter"))


@query("line_count", """
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS n FROM documents""")
def line_count(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.line_count("text").cast("long").alias("n"))


@query("normalize_token", """
SELECT item_id, regexp_replace(lower(""" + FULL_STRIP.format("text") + """), '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g') AS token FROM benchmark""")
def normalize_token(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", text.normalize_token("text").alias("token"))


@query("duration_text", """
SELECT l_orderkey, l_linenumber, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
  ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS shown
FROM (SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * 50 / 1000, 0) AS BIGINT) AS s FROM lineitem)""")
def duration_text(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.duration_text(F.col("l_extendedprice") * 50).alias("shown"))


@query("epoch_ms_to_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, '' AS bad, '' AS negative FROM orders""")
def epoch_ms_to_date(spark, folder):
    ms = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000 + 86399999
    return table(spark, folder, "orders").select(
        "o_orderkey", numbers.epoch_ms_to_date(ms).alias("day"), numbers.epoch_ms_to_date("o_orderpriority").alias("bad"),
        numbers.epoch_ms_to_date(-ms).alias("negative"))


@query("publish_year", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS publish_year FROM orders""")
def publish_year(spark, folder):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("x"), day)).otherwise(day)
    return table(spark, folder, "orders").select("o_orderkey", numbers.publish_year(shown).alias("publish_year"))


@query("decade_tag", "WITH " + model.RAW_SONGS_SQL + f"""
SELECT song_id, CASE WHEN CAST(substr(publish_date, 1, 4) AS INTEGER) >= 1970 THEN (CAST(substr(publish_date, 1, 4) AS INTEGER) // 10 * 10) || '{vocab.DECADE_SUFFIX}' END AS decade FROM raw_songs""")
def decade_tag(spark, folder):
    return model.raw_songs(spark, folder).select("song_id", numbers.decade_tag("publish_date").alias("decade"))


@query("parse_bpm", "WITH " + model.RAW_SONGS_SQL + """
SELECT song_id, CAST(regexp_extract(wiki_summary_excerpt, 'BPM \\| (\\d{2,3})', 1) AS INTEGER) AS noted,
  CASE WHEN popularity BETWEEN 40 AND 260 THEN CAST(popularity AS INTEGER) ELSE CAST(regexp_extract(wiki_summary_excerpt, 'BPM \\| (\\d{2,3})', 1) AS INTEGER) END AS bpm FROM raw_songs""")
def parse_bpm(spark, folder):
    return model.raw_songs(spark, folder).select(
        "song_id", numbers.summary_bpm("wiki_summary_excerpt").alias("noted"),
        numbers.row_bpm(["popularity"], "wiki_summary_excerpt").alias("bpm"))


@query("fold_tempo", """
WITH tempos AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 90 AS t FROM lineitem),
octaves AS (SELECT t, t * f AS c FROM (SELECT DISTINCT t FROM tempos), (VALUES (0.25), (0.5), (1.0), (2.0), (4.0)) v(f)),
ranked AS (SELECT t, first(c ORDER BY CASE WHEN c BETWEEN 72 AND 145 THEN 0 ELSE 1 END, abs(c - 100), c) AS best
  FROM octaves WHERE c BETWEEN 55 AND 190 GROUP BY ALL)
SELECT x.l_orderkey, x.l_linenumber, round(coalesce(best, CASE WHEN x.t < 55 THEN x.t * pow(2, ceil(log2(55 / x.t))) ELSE x.t / pow(2, ceil(log2(x.t / 190))) END), 6) AS tempo
FROM tempos x LEFT JOIN ranked r USING (t)""")
def fold_tempo(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numbers.fold_tempo(F.col("l_extendedprice") / 90), 6).alias("tempo"))


@query("round_half_even", """
SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS halves, round_even(l_quantity / 4, 0) AS quarters,
  round_even(l_quantity / 8, 1) AS tenths FROM lineitem""")
def round_half_even(spark, folder):
    quantity = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.round_half_even(quantity / 2).alias("halves"),
        numbers.round_half_even(quantity / 4).alias("quarters"), numbers.round_half_even(quantity / 8, 1).alias("tenths"))


@query("math_functions", """
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_extendedprice / 50000)), 6) AS clipped,
  round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS sigmoid, round(ln(1 + l_quantity), 6) AS log1p,
  round(exp(l_discount) / (exp(l_discount) + exp(l_tax) + exp(0.05)), 6) AS softmax_first FROM lineitem""")
def math_functions(spark, folder):
    soft = numbers.softmax(F.array("l_discount", "l_tax", F.lit(0.05)))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numbers.clip(F.col("l_extendedprice") / 50000, 0, 1), 6).alias("clipped"),
        F.round(numbers.sigmoid((F.col("l_quantity") - 25) / 10), 6).alias("sigmoid"),
        F.round(F.log1p("l_quantity"), 6).alias("log1p"), F.round(F.get(soft, 0), 6).alias("softmax_first"))


@query("join_parts", """
SELECT c_custkey, concat_ws(' | ', trim(c_name), nullif(CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END, ''), CAST(c_nationkey AS VARCHAR)) AS joined FROM customer""")
def join_parts(spark, folder):
    parts = F.array(
        F.concat(F.lit(" "), "c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("  "),
        F.col("c_nationkey").cast("string"), F.lit(None).cast("string"))
    return table(spark, folder, "customer").select("c_custkey", text.join_parts(parts).alias("joined"))


@query("safe_text", """
SELECT l.doc_id, CASE WHEN quality = 1 THEN CAST(l.doc_id AS VARCHAR) ELSE '' END AS shown, """ + FULL_STRIP.format("text") + """ AS stripped
FROM documents d JOIN labels l USING (doc_id)""")
def safe_text(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return joined.select(
        "doc_id", text.safe_text(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("shown"),
        text.safe_text(F.concat(F.lit("\n\t "), "text")).alias("stripped"))


@query("as_text", """
SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'true' ELSE 'false' END AS flag,
  '{"name":"' || n_name || '","regions":[' || n_regionkey || ']}' AS object FROM nation""")
def as_text(spark, folder):
    nested = F.struct(F.col("n_name").alias("name"), F.array("n_regionkey").alias("regions"))
    return table(spark, folder, "nation").select(
        "n_nationkey", text.as_text(F.col("n_regionkey") == 1).alias("flag"), text.as_text(nested, "object").alias("object"))


@query("contains_any", """
SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), 'éau') OR contains(lower(text), '%') AS found FROM documents""")
def contains_any(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.contains_any("text", ["TION", "Éau", "%"]).alias("found"))


@query("parse_filename", """
SELECT p_partkey, trim(CASE WHEN p_size % 4 = 3 THEN '' ELSE p_brand END) AS artist,
  trim(CASE WHEN p_size % 4 = 3 THEN p_brand || ' ' || p_name ELSE p_name || '-' || p_type END) AS title FROM part""")
def parse_filename(spark, folder):
    part = table(spark, folder, "part")
    marks = F.when(F.col("p_size") % 4 == 0, " - ").when(F.col("p_size") % 4 == 1, " – ").otherwise(" — ")
    stem = F.when(F.col("p_size") % 4 == 3, F.concat("p_brand", F.lit(" "), "p_name")).otherwise(
        F.concat("p_brand", marks, "p_name", F.lit("-"), "p_type"))
    return part.withColumn("_i", text.file_name_identity(stem)).select("p_partkey", "_i.artist", "_i.title")


@query("score_string", """
SELECT o_orderkey, o_orderpriority || ':' || printf('%.4f', o_totalprice / 1000) AS shown FROM orders""")
def score_string(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", text.score_text("o_orderpriority", F.col("o_totalprice") / 1000).alias("shown"))


@query("lyric_lines", """
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split(lrc, chr(10)), lambda x: NOT starts_with(ltrim(x), '{')),
  lambda x: trim(regexp_replace(x, '\\[[^\\]]*\\]', '', 'g'))), lambda x: x <> ''), chr(10)) AS plain
FROM (SELECT doc_id, '{"c":1}' || chr(10) || '[00:1]' || text || chr(10) || '  {x' AS lrc FROM documents)""")
def lyric_lines(spark, folder):
    lrc = F.concat(F.lit('{"c":1}\n[00:1]'), "text", F.lit("\n  {x"))
    return table(spark, folder, "documents").select("doc_id", text.lyric_file_text(lrc).alias("plain"))


@query("lyric_json_lines", """
SELECT doc_id, lang || source || chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS resolved,
  """ + FULL_STRIP.format("text") + """ AS untouched FROM documents""")
def lyric_json_lines(spark, folder):
    first = F.to_json(F.struct(F.array(F.struct(F.col("lang").alias("tx")), F.struct(F.col("source").alias("tx"))).alias("c")))
    lrc = F.concat(first, F.lit("\n{broken\n"), "text")
    return table(spark, folder, "documents").select(
        "doc_id", text.lyric_json_lines(lrc).alias("resolved"), text.lyric_json_lines("text").alias("untouched"))


@query("max_score_map", """
WITH m AS (SELECT l_orderkey, l_returnflag, l_linestatus, max(l_quantity) AS top FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR) AS source, min(row(l_linenumber, l_quantity, CAST(l_suppkey AS VARCHAR))) AS first FROM lineitem GROUP BY ALL)
SELECT m.l_orderkey, m.l_returnflag AS category, m.l_linestatus AS tag, top AS score, string_agg(source, ',' ORDER BY first) AS sources
FROM m JOIN s USING (l_orderkey, l_returnflag, l_linestatus) GROUP BY ALL""")
def max_score_map(spark, folder):
    entries = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(
            "l_linenumber", F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("tag"),
            F.col("l_quantity").alias("score"), F.col("l_suppkey").cast("string").alias("source")))).alias("entries"))
    merged = entries.select("l_orderkey", F.inline(arrays.max_scores("entries")))
    return merged.select("l_orderkey", "category", "tag", "score", F.array_join("sources", ",").alias("sources"))


@query("l2_normalize", """
SELECT vec_id, pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 5) AS x FROM (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings)""")
def l2_normalize(spark, folder):
    unit = table(spark, folder, "embeddings").select("vec_id", F.posexplode(arrays.l2_normalize("embedding")).alias("pos", "x"))
    return unit.select("vec_id", "pos", F.round("x", 5).alias("x"))


@query("dot_product", """
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 4) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def dot_product(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(arrays.dot("v", "w"), 4).alias("dot"))


@query("record_link", """
SELECT page_id, 'https://example.org/song/' || page_id AS link, sha256('{"id": "' || page_id || '", "level": ' || to_json(url) || '}') AS params_hash,
  CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE md5('{"artist_names": "a", "link": ' || to_json(url) || ', "name": "n"}') END AS token FROM pages""")
def record_link(spark, folder):
    shown = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    return table(spark, folder, "pages").select(
        "page_id", text.record_link("page_id", "https://example.org/song/").alias("link"),
        text.params_hash({"level": "url", "id": F.col("page_id").cast("string")}).alias("params_hash"),
        text.event_token(shown, F.lit("n"), F.lit(" a "), "url").alias("token"))


@query("valid_link", "SELECT page_id, starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://') AS valid, false AS bare FROM pages")
def valid_link(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.has_web_scheme(F.upper("url")).alias("valid"), text.has_web_scheme(F.concat(F.lit("x"), "url")).alias("bare"))


@query("has_value", "WITH " + model.RAW_SONGS_SQL + """
SELECT song_id, local_audio_path FROM raw_songs WHERE local_audio_path <> '' AND standard_url = ''""")
def has_value(spark, folder):
    return filters.has_value(model.raw_songs(spark, folder), "local_audio_path", "standard_url").select("song_id", "local_audio_path")
