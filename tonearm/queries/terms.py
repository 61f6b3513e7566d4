"""Tokens, terms, language and rule tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators import features, tags
from tonearm.queries import model
from tonearm.queries.registry import query, table


@query("tokenize_en", """
SELECT doc_id, array_to_string(CASE WHEN regexp_matches(text, '[a-zA-Z]{3,}') THEN regexp_extract_all(text, '[a-zA-Z][a-zA-Z'']+') ELSE [] END, ' ') AS tokens FROM documents""")
def tokenize_en(spark, folder):
    none = F.array().cast("array<string>")
    return table(spark, folder, "documents").select("doc_id", F.array_join(text.tokens("text", none), " ").alias("tokens"))


def _cjk_text():
    """Each text with its letters moved into the CJK and kana blocks, so that runs exist."""
    return F.translate(F.translate("text", "abcdefgh", "一丁丂七丄丅丆万"), "mnopqr", "ぁあぃいぅう")


@query("tokenize_cjk", """
SELECT doc_id, array_to_string(list_concat(
  CASE WHEN regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') THEN regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]{2,}') ELSE [] END,
  CASE WHEN regexp_matches(t, '[\\x{3040}-\\x{30ff}]') THEN regexp_extract_all(t, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]{2,}') ELSE [] END,
  CASE WHEN regexp_matches(t, '[a-zA-Z]{3,}') THEN regexp_extract_all(t, '[a-zA-Z][a-zA-Z'']+') ELSE [] END), ' ') AS tokens
FROM (SELECT doc_id, translate(translate(text, 'abcdefgh', '一丁丂七丄丅丆万'), 'mnopqr', 'ぁあぃいぅう') AS t FROM documents)""")
def tokenize_cjk(spark, folder):
    none = F.array().cast("array<string>")
    documents = table(spark, folder, "documents").select("doc_id", _cjk_text().alias("t"))
    return documents.select("doc_id", F.array_join(text.tokens("t", none), " ").alias("tokens"))


@query("lyric_terms_topk", "WITH " + model.RAW_SONGS_SQL + ", songs AS (SELECT * FROM raw_songs), " + model.LYRIC_TERMS_SQL + """
SELECT song_id, term, CAST(rank - 1 AS INTEGER) AS pos FROM lyric_terms""")
def lyric_terms_topk(spark, folder):
    songs = model.raw_songs(spark, folder).select("song_id", "full_lyric", "lyric_excerpt").withColumn(
        "language_tags", F.array().cast("array<string>"))
    terms = features.lyric_terms(songs).select("song_id", F.posexplode_outer("lyric_terms").alias("pos", "term"))
    return terms.where(F.col("pos").isNotNull())


@query("title_terms", "WITH " + model.SONGS_SQL + ", " + model.TITLE_TERMS_SQL + """
SELECT song_id, string_agg(term, ' ' ORDER BY first) AS terms FROM title_terms GROUP BY song_id""")
def title_terms(spark, folder):
    songs = model.songs(spark, folder).withColumn("language_tags", F.array().cast("array<string>"))
    return features.title_terms(songs).where(F.size("title_terms") > 0).select(
        "song_id", F.array_join("title_terms", " ").alias("terms"))


@query("language_tags", "WITH " + model.WIDE_BASE_SQL + " SELECT song_id, array_to_string(language_list, ' | ') AS language_tags FROM wide_base")
def language_tags(spark, folder):
    tagged = model.songs(spark, folder).drop("name").join(
        model.tag_table(spark, folder).select("song_id", F.col("language_tags").alias("generated")), "song_id")
    return tagged.select("song_id", F.array_join(text.language_tags("wiki_summary_excerpt", "generated", model.LANGUAGES), " | ").alias("language_tags"))


@query("keyword_rules", "WITH " + model._rule_values("style_rules", model.RULES.style) + """
SELECT d.doc_id, coalesce(t, '') AS tags FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(tag, ' | ' ORDER BY rule) AS t FROM (
    SELECT DISTINCT doc_id, rule, tag FROM documents, style_rules WHERE contains(lower(text), needle)) GROUP BY doc_id) USING (doc_id)""")
def keyword_rules(spark, folder):
    lowered = table(spark, folder, "documents").select("doc_id", F.lower("text").alias("t"))
    return lowered.select("doc_id", F.array_join(text.matching_tags("t", model.RULES.style), " | ").alias("tags"))


@query("assemble_tags", "WITH " + model.TAGS_SQL + " SELECT * FROM tag_table")
def assemble_tags(spark, folder):
    return model.tag_table(spark, folder).withColumn("has_lyric", F.col("has_lyric").cast("string"))


@query("local_tag", "WITH " + model.TAGS_SQL + """
SELECT song_id, CASE WHEN local_audio_path <> '' THEN concat_ws(' | ', nullif(audio_tags, ''), 'local') ELSE audio_tags END AS audio_tags,
  CASE WHEN local_audio_path <> '' THEN concat_ws(' | ', nullif(all_tags, ''), 'local') ELSE all_tags END AS all_tags
FROM tag_table JOIN (SELECT song_id, local_audio_path FROM songs) USING (song_id)""")
def local_tag(spark, folder):
    files = model.songs(spark, folder).select("song_id", "local_audio_path")
    return tags.add_local_tag(model.tag_table(spark, folder).join(files, "song_id"), model.LOCAL_TAG).select(
        "song_id", "audio_tags", "all_tags")


@query("merge_feature_tags", "WITH " + model.TAGS_SQL + f""", extra AS (
  SELECT song_id, CASE WHEN local_audio_path <> '' THEN 'calm | extra' ELSE '' END AS more FROM songs),
parts AS (
  SELECT song_id, 'emotion' AS target, 1 AS step, unnest({model.STYLE_SPLIT.format('emotion_tags')}) AS tag, generate_subscripts({model.STYLE_SPLIT.format('emotion_tags')}, 1) AS pos FROM tag_table
  UNION ALL SELECT song_id, 'all', 1, unnest({model.STYLE_SPLIT.format('all_tags')}), generate_subscripts({model.STYLE_SPLIT.format('all_tags')}, 1) FROM tag_table
  UNION ALL SELECT song_id, t, 2, unnest({model.STYLE_SPLIT.format('more')}), generate_subscripts({model.STYLE_SPLIT.format('more')}, 1) FROM extra, (VALUES ('emotion'), ('all')) v(t)),
merged AS (SELECT song_id, target, string_agg(tag, ' | ' ORDER BY first) AS tags FROM (
  SELECT song_id, target, tag, min(step * 1000 + pos) AS first FROM parts GROUP BY ALL) GROUP BY ALL)
SELECT t.song_id, coalesce(e.tags, '') AS emotion_tags, coalesce(a.tags, '') AS all_tags FROM tag_table t
LEFT JOIN merged e ON e.song_id = t.song_id AND e.target = 'emotion' LEFT JOIN merged a ON a.song_id = t.song_id AND a.target = 'all'""")
def merge_feature_tags(spark, folder):
    extra = model.songs(spark, folder).select(
        "song_id", F.when(F.col("local_audio_path") != "", "calm | extra").otherwise("").alias("more"))
    merged = tags.merge_feature_tags(model.tag_table(spark, folder).join(extra, "song_id"), "emotion_tags", "more")
    return merged.select("song_id", "emotion_tags", "all_tags")
