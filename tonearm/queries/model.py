"""The driver tables seen as a song catalogue, in Spark and in SQL.

documents are the songs (the text is the lyric), labels their availability, part their names, embeddings
their vectors, events the interactions, conversations the comments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm import session, vocab
from tonearm.functions import text
from tonearm.operators import catalog, features, tags
from tonearm.plans import features as feature_plan
from tonearm.plans import tags as tag_plan
from tonearm.queries.registry import table

LANGUAGES = ("en", "fr", "de", "es")
RULES = tags.TagRules(
    languages=LANGUAGES,
    style=(
        ("tionic", ("tion", "sion")), ("eau", ("eau",)), ("undic", ("und ", " und")), ("ring", ("ring",)),
        ("blue", ("Blue",)), ("heavy", ("PROMO", "LARGE")),
    ),
    emotion=(
        ("calm", ("ere ", "the of")), ("bright", ("Leau", "ing the")), ("sad", ("nder", "ênê")),
        ("brave", ("erer", "thwh")), ("tender", ("ouou", "lyly")),
    ),
    theme=(
        ("thread", ("three", "thread")), ("water", ("eaux", "wasser")), ("bolt", ("bolt", "gear")),
        ("tionic", ("ationation",)),
    ),
    scene=(
        ("study", ("that", "dass")), ("sleep", ("nachts", "hand")), ("drive", ("for the", "pour")),
        ("calm", ("medium plate",)),
    ),
    explicit_emotions={"SMALL": "calm", "ECONOMY": "bright"},
    explicit_themes={"PROMO": "event"},
    instrumental_placeholder="ionion",
    instrumental_tag="STANDARD",
    relax_tag="relax",
)
LOCAL_TAG = "local"
FAST, MEDIUM, SLOW = vocab.FAST, vocab.MEDIUM, vocab.SLOW


def raw_songs(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue source rows as a source table would hold them (text and numbers, no defaults)."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    vectors = table(spark, folder, "embeddings").select("vec_id")
    joined = (
        documents.join(labels, "doc_id", "left")
        .join(part, F.col("doc_id") == F.col("p_partkey"), "left")
        .join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    )
    n = F.col("n_chars")
    return joined.select(
        F.col("doc_id").cast("string").alias("song_id"),
        F.coalesce("p_name", F.lit("")).alias("name"),
        F.coalesce("p_type", F.lit("")).alias("aliases"),
        F.lit("").alias("translations"),
        F.concat_ws(" | ", "source", "lang").alias("artist_names"),
        F.coalesce("p_brand", F.lit("")).alias("album_name"),
        (n / 10.0).alias("duration_seconds"),
        F.date_add(F.lit("1965-01-01").cast("date"), F.pmod(F.col("doc_id") * 17, F.lit(20000)).cast("int"))
        .cast("string").alias("publish_date"),
        F.pmod(n, F.lit(101)).alias("popularity"),
        F.pmod(n * 7, F.lit(1000)).alias("comment_total"),
        text.line_count("text").alias("lyric_line_count"),
        F.when(F.col("quality") == 1, "true").when(F.col("quality") == 0, "no").otherwise("").alias("playable"),
        F.lit("yes").alias("has_lyric"),
        F.when(F.col("toxic") == 1, "1").otherwise("0").alias("has_translation"),
        F.when(F.col("lang") == "de", "Y").otherwise("").alias("has_romaji"),
        F.when(F.col("quality") == 1, "999000").otherwise("n/a").alias("hires_br"),
        F.when(F.col("p_size") > 40, "900000").otherwise("").alias("lossless_br"),
        F.when(F.col("p_size") > 20, 320000).otherwise(0).alias("exhigh_br"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("HTTP://a/"), F.col("doc_id"))).otherwise("").alias("standard_url"),
        F.concat_ws(" | ", "lang", F.coalesce("p_type", F.lit("")), F.lit("BPM"), (F.pmod(n, F.lit(200)) + 40).cast("string"))
        .alias("wiki_summary_excerpt"),
        F.col("text").alias("full_lyric"),
        text.excerpt("text", 500).alias("lyric_excerpt"),
        F.when(F.col("p_size") > 30, F.concat(F.lit("/music/"), F.col("p_name"), F.lit(".flac"))).otherwise("").alias("local_audio_path"),
        F.when(F.col("vec_id").isNotNull(), F.concat(F.lit("/vectors/"), F.col("vec_id"), F.lit(".npy"))).otherwise("").alias("mert_embedding_path"),
    )


RAW_SONGS_SQL = """raw_songs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS song_id,
    coalesce(p_name, '') AS name, coalesce(p_type, '') AS aliases, '' AS translations,
    source || ' | ' || lang AS artist_names, coalesce(p_brand, '') AS album_name,
    n_chars / 10.0 AS duration_seconds,
    CAST(CAST('1965-01-01' AS DATE) + CAST(d.doc_id * 17 % 20000 AS INTEGER) AS VARCHAR) AS publish_date,
    n_chars % 101 AS popularity, n_chars * 7 % 1000 AS comment_total,
    CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), ''))
      + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS lyric_line_count,
    CASE WHEN quality = 1 THEN 'true' WHEN quality = 0 THEN 'no' ELSE '' END AS playable,
    'yes' AS has_lyric, CASE WHEN toxic = 1 THEN '1' ELSE '0' END AS has_translation,
    CASE WHEN lang = 'de' THEN 'Y' ELSE '' END AS has_romaji,
    CASE WHEN quality = 1 THEN '999000' ELSE 'n/a' END AS hires_br,
    CASE WHEN p_size > 40 THEN '900000' ELSE '' END AS lossless_br,
    CASE WHEN p_size > 20 THEN 320000 ELSE 0 END AS exhigh_br,
    CASE WHEN lang = 'fr' THEN 'HTTP://a/' || d.doc_id ELSE '' END AS standard_url,
    lang || ' | ' || coalesce(p_type, '') || ' | BPM | ' || (n_chars % 200 + 40) AS wiki_summary_excerpt,
    text AS full_lyric,
    CASE WHEN length(flat) <= 500 THEN flat ELSE rtrim(substr(flat, 1, 497)) || '...' END AS lyric_excerpt,
    CASE WHEN p_size > 30 THEN '/music/' || p_name || '.flac' ELSE '' END AS local_audio_path,
    CASE WHEN vec_id IS NOT NULL THEN '/vectors/' || vec_id || '.npy' ELSE '' END AS mert_embedding_path
  FROM (SELECT *, trim(replace(text, chr(10), ' / ')) AS flat FROM documents) d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN part p ON p.p_partkey = d.doc_id
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def songs(spark: SparkSession, folder: str) -> DataFrame:
    """Conformed catalogue rows."""
    return catalog.conform(raw_songs(spark, folder), ["name", "aliases", "album_name", "publish_date"])


SONGS_SQL = RAW_SONGS_SQL + """, songs AS (
  SELECT * REPLACE (
      coalesce(TRY_CAST(popularity AS DOUBLE), 0) AS popularity,
      coalesce(TRY_CAST(comment_total AS DOUBLE), 0) AS comment_total,
      coalesce(TRY_CAST(lyric_line_count AS DOUBLE), 0) AS lyric_line_count,
      coalesce(TRY_CAST(duration_seconds AS DOUBLE), 0) AS duration_seconds,
      coalesce(TRY_CAST(hires_br AS DOUBLE), 0) AS hires_br,
      coalesce(TRY_CAST(lossless_br AS DOUBLE), 0) AS lossless_br,
      coalesce(TRY_CAST(exhigh_br AS DOUBLE), 0) AS exhigh_br,
      lower(trim(playable)) IN ('true', '1', 'yes', 'y') AS playable,
      lower(trim(has_lyric)) IN ('true', '1', 'yes', 'y') AS has_lyric,
      lower(trim(has_translation)) IN ('true', '1', 'yes', 'y') AS has_translation,
      lower(trim(has_romaji)) IN ('true', '1', 'yes', 'y') AS has_romaji),
    CAST(0 AS DOUBLE) AS hot_comment_count, CAST(0 AS DOUBLE) AS standard_br, false AS check_success
  FROM raw_songs)"""


# --- tags -------------------------------------------------------------------------------------------


def tag_table(spark: SparkSession, folder: str) -> DataFrame:
    return tags.song_tags(songs(spark, folder), RULES)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rule_values(name: str, rules) -> str:
    rows = [
        f"({order}, {_quoted(tag)}, {_quoted(needle.lower())})"
        for order, (tag, needles) in enumerate(rules)
        for needle in needles
    ]
    return f"{name}(rule, tag, needle) AS (VALUES {', '.join(rows)})"


def rule_hits_sql(source: str, column: str, table_name: str) -> str:
    """One row per (song, rule tag) with a needle in the column."""
    return f"SELECT DISTINCT song_id, rule, tag FROM {source}, {table_name} WHERE contains({column}, needle)"


def _tags_sql() -> str:
    language_values = ", ".join(f"({i}, {_quoted(tag)})" for i, tag in enumerate(LANGUAGES))
    explicit = [("2", tag, target, "0.86") for tag, target in RULES.explicit_emotions.items()]
    explicit += [("3", tag, target, "0.82") for tag, target in RULES.explicit_themes.items()]
    explicit_values = ", ".join(f"({c}, {_quoted(t)}, {_quoted(target)}, {s})" for c, t, target, s in explicit)

    def rules_part(step: int, category: int, column: str, name: str, score: str, source: str) -> str:
        return (
            f"SELECT song_id, {category} AS category, tag, {score} AS score, {_quoted(source)} AS source, {step} AS step, rule AS pos "
            f"FROM ({rule_hits_sql('tag_texts', column, name)})"
        )

    union = " UNION ALL ".join([
        "SELECT song_id, 0 AS category, tag, CASE WHEN contains(summary, tag) THEN 0.95 ELSE 0.65 END AS score, "
        "CASE WHEN contains(summary, tag) THEN 'csv.wiki_summary_excerpt' ELSE 'csv.metadata' END AS source, 1 AS step, pos "
        "FROM tag_texts, language_names WHERE contains(summary, tag) OR contains(metadata, tag)",
        rules_part(2, 1, "style_lower", "style_rules", "0.78", "csv.text"),
        rules_part(3, 1, "lower(summary)", "style_rules", "0.92", "csv.wiki_summary_excerpt"),
        rules_part(4, 2, "lower(metadata)", "emotion_rules", "0.62", "csv.metadata"),
        "SELECT song_id, category, target AS tag, score, 'csv.wiki_explicit_tag' AS source, 5 AS step, 0 AS pos "
        "FROM (SELECT song_id, unnest(list_transform(string_split(summary, '|'), lambda x: trim(x))) AS token FROM tag_texts) "
        "JOIN explicit_tags USING (token)",
        rules_part(6, 3, "lower(metadata)", "theme_rules", "0.56", "csv.metadata"),
        rules_part(7, 4, "lower(metadata)", "scene_rules", "0.62", "csv.metadata"),
        rules_part(8, 2, "lower(lyric)", "emotion_rules", "0.76", "lyrics"),
        rules_part(9, 3, "lower(lyric)", "theme_rules", "0.78", "lyrics"),
        rules_part(10, 4, "lower(lyric)", "scene_rules", "0.62", "lyrics"),
        f"SELECT song_id, category, tag, score, 'lyrics' AS source, 11 AS step, 0 AS pos FROM tag_texts, "
        f"(VALUES (0, 'STANDARD', 0.98), (1, 'STANDARD', 0.96), (4, 'relax', 0.55)) t(category, tag, score) "
        f"WHERE contains(lyric, 'ionion') OR (contains(summary, 'STANDARD') AND has_lyric <> 'true')",
        f"SELECT song_id, 5 AS category, CASE WHEN bpm >= 125 THEN '{FAST}' WHEN bpm <= 80 THEN '{SLOW}' ELSE '{MEDIUM}' END AS tag, "
        "CASE WHEN bpm >= 125 OR bpm <= 80 THEN 0.82 ELSE 0.62 END AS score, 'csv.wiki_bpm' AS source, 12 AS step, 0 AS pos FROM tag_texts WHERE bpm > 0",
        f"SELECT song_id, 4 AS category, decade || '{vocab.DECADE_SUFFIX}' AS tag, 0.52 AS score, 'csv.publish_date' AS source, 13 AS step, 0 AS pos "
        "FROM tag_texts WHERE decade >= 1970",
    ])
    names = ", ".join(
        f"coalesce(string_agg(tag, ' | ' ORDER BY score DESC, tag) FILTER (WHERE category = {i}), '') AS {name}_tags"
        for i, name in enumerate(tags.CATEGORIES)
    )
    return ", ".join([
        _rule_values("style_rules", RULES.style), _rule_values("emotion_rules", RULES.emotion),
        _rule_values("theme_rules", RULES.theme), _rule_values("scene_rules", RULES.scene),
        f"language_names(pos, tag) AS (VALUES {language_values})",
        f"explicit_tags(category, token, target, score) AS (VALUES {explicit_values})",
        """tag_texts AS (
  SELECT song_id, wiki_summary_excerpt AS summary, full_lyric AS lyric, CAST(has_lyric AS VARCHAR) AS has_lyric,
    concat_ws(' ', name, aliases, '', artist_names, album_name, trim(lyric_excerpt), '', '') AS metadata,
    lower(concat_ws(' ', name, aliases, '', artist_names, album_name, trim(lyric_excerpt), '', '', '', '', wiki_summary_excerpt)) AS style_lower,
    CAST(regexp_extract(wiki_summary_excerpt, 'BPM \\| (\\d+)', 1) AS INTEGER) AS bpm,
    CAST(substr(publish_date, 1, 4) AS INTEGER) // 10 * 10 AS decade
  FROM songs)""",
        f"hits AS ({union})",
        "category_scores AS (SELECT song_id, category, tag, max(score) AS score FROM hits GROUP BY ALL)",
        f"category_tags AS (SELECT song_id, {names} FROM category_scores GROUP BY song_id)",
        "tag_scores AS (SELECT song_id, tag, arg_max(score, category) AS score FROM category_scores GROUP BY ALL)",
        "all_tags AS (SELECT song_id, string_agg(tag, ' | ' ORDER BY score DESC, tag) AS all_tags, max(score) AS top FROM tag_scores GROUP BY ALL)",
        "first_sources AS (SELECT song_id, tag, source, min(step * 1000 + pos) AS first FROM hits GROUP BY ALL)",
        "source_lists AS (SELECT song_id, tag, string_agg('\"' || source || '\"', ', ' ORDER BY first) AS listed FROM first_sources GROUP BY ALL)",
        "tag_sources AS (SELECT song_id, '{' || string_agg('\"' || tag || '\": [' || listed || ']', ', ' ORDER BY tag) || '}' AS tag_sources FROM source_lists GROUP BY ALL)",
        """tag_table AS (
  SELECT s.song_id, s.name, s.artist_names, CAST(s.has_lyric AS VARCHAR) AS has_lyric,
    language_tags, style_tags, emotion_tags, theme_tags, scene_tags, audio_tags,
    coalesce(all_tags, '') AS all_tags, coalesce(round(top, 3), 0) AS tag_confidence,
    coalesce(tag_sources, '{}') AS tag_sources, x.bpm
  FROM songs s JOIN tag_texts x USING (song_id) LEFT JOIN category_tags USING (song_id)
  LEFT JOIN all_tags USING (song_id) LEFT JOIN tag_sources USING (song_id))""",
    ])


TAGS_SQL = SONGS_SQL + ", " + _tags_sql()


# --- preprocessed catalogue -------------------------------------------------------------------------


def wide(spark: SparkSession, folder: str, terms: bool = True) -> DataFrame:
    """Preprocessed catalogue: tags, derived columns, list features, search text."""
    return derived(songs(spark, folder), terms)


def derived(base: DataFrame, terms: bool = True) -> DataFrame:
    rules = tags.assemble_tags(tags.tag_texts(base), tags.tag_hits(RULES, base.columns)).drop("_summary", "_metadata", "_lyric", "_summary_lower", "_metadata_lower", "_style_lower", "_lyric_lower")
    # Columns of their own: each needle looks at the text once lowered.
    lowered = rules.withColumns({"_lyric": F.lower("full_lyric"), "_excerpt": F.lower("lyric_excerpt")})
    named = lowered.withColumnRenamed("language_tags", "generated_language_tags").withColumns(
        {
            "lyric_semantic_tags": F.array_join(text.matching_tags("_lyric", LYRIC_LABELS), " | "),
            "comment_semantic_tags": F.array_join(text.matching_tags("_excerpt", COMMENT_LABELS), " | "),
        }
    ).drop("_lyric", "_excerpt")
    return feature_plan.preprocess(named, "https://example.org/song/", terms, LANGUAGES)


LYRIC_LABELS = (("love", ("lover", "andand")), ("night", ("nigh", "ght")), ("road", ("tionre", "street")), ("home", ("onde", "haus")))
COMMENT_LABELS = (("memory", ("memo", "ereth")), ("praise", ("goodgo", "best")), ("laugh", ("haha",)))


def lists(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue without its long texts, stored once: the texts are read and tokenised a single time."""
    slim = wide(spark, folder).drop(
        "full_lyric", "lyric_excerpt", "search_text", "tag_sources", "wiki_summary_excerpt", *tags.METADATA_FIELDS[5:]
    )
    return session.materialize(slim)


def rows(df: DataFrame) -> DataFrame:
    return features.feature_rows(df)


def _labels_sql(name: str, rules) -> str:
    return _rule_values(name, rules)


STOP_SQL = ", ".join(_quoted(word) for word in vocab.STOP_WORDS)
STYLE_SPLIT = "list_filter(list_transform(string_split({0}, '|'), lambda x: trim(x)), lambda x: x <> '')"

WIDE_BASE_SQL = TAGS_SQL + ", " + _labels_sql("lyric_rules", LYRIC_LABELS) + ", " + _labels_sql("comment_rules", COMMENT_LABELS) + f""",
lyric_labels AS (SELECT song_id, string_agg(tag, ' | ' ORDER BY rule) AS lyric_semantic
  FROM ({rule_hits_sql('(SELECT song_id, lower(full_lyric) AS t FROM songs)', 't', 'lyric_rules')}) GROUP BY song_id),
comment_labels AS (SELECT song_id, string_agg(tag, ' | ' ORDER BY rule) AS comment_semantic
  FROM ({rule_hits_sql('(SELECT song_id, lower(lyric_excerpt) AS t FROM songs)', 't', 'comment_rules')}) GROUP BY song_id),
language_lists AS (
  SELECT song_id, list(tag ORDER BY first) AS language_list FROM (
    SELECT song_id, tag, min(pos) AS first FROM (
      SELECT song_id, tag, pos FROM tag_texts, language_names WHERE contains(summary, tag)
      UNION ALL
      SELECT song_id, unnest({STYLE_SPLIT.format('language_tags')}) AS tag,
        100 + generate_subscripts({STYLE_SPLIT.format('language_tags')}, 1) AS pos FROM tag_table)
    GROUP BY ALL) GROUP BY song_id),
wide_base AS (
  SELECT s.*, t.language_tags AS generated_language_tags, t.style_tags, t.emotion_tags, t.theme_tags, t.scene_tags, t.audio_tags,
    t.all_tags, coalesce(lyric_semantic, '') AS lyric_semantic, coalesce(comment_semantic, '') AS comment_semantic,
    coalesce(language_list, ['{vocab.UNKNOWN}']) AS language_list,
    CAST(substr(publish_date, 1, 4) AS INTEGER) AS publish_year, duration_seconds / 60 AS duration_minutes,
    {STYLE_SPLIT.format('s.artist_names')} AS artist_list,
    CASE WHEN hires_br > 0 THEN 'Hi-Res' WHEN lossless_br > 0 THEN '无损' WHEN exhigh_br > 0 THEN '极高'
      WHEN standard_url <> '' THEN '标准' ELSE '{vocab.UNKNOWN}' END AS quality,
    length(full_lyric) AS lyrics_chars,
    regexp_replace(lower(concat_ws(' ', s.name, aliases, '', s.artist_names, album_name, trim(lyric_excerpt), '', '', '', '',
      wiki_summary_excerpt, '', '', style_tags, emotion_tags, theme_tags, scene_tags, audio_tags,
      coalesce(lyric_semantic, ''), all_tags, regexp_replace(full_lyric, '^\\s+|\\s+$', '', 'g'))), '\\s+', ' ', 'g') AS search_text
  FROM songs s JOIN tag_table t USING (song_id) LEFT JOIN lyric_labels USING (song_id)
  LEFT JOIN comment_labels USING (song_id) LEFT JOIN language_lists USING (song_id))"""

# Lyric words in text order, and the forty most frequent of each song.
LYRIC_TERMS_SQL = f"""clean_lyrics AS (
  SELECT song_id, trim(regexp_replace(regexp_replace(trim(full_lyric), '\\[[^\\]]+\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS lyric FROM songs),
lyric_words AS (
  SELECT song_id, pos, regexp_replace(lower(word), '^[^\\w]+|[^\\w]+$', '', 'g') AS term FROM (
    SELECT song_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (
      SELECT song_id, regexp_extract_all(lyric, '[a-zA-Z][a-zA-Z'']+') AS words FROM clean_lyrics
      WHERE regexp_matches(lyric, '[a-zA-Z]{{3,}}')))),
lyric_counts AS (
  SELECT song_id, term, count(*) AS cnt, min(pos) AS first FROM lyric_words
  WHERE length(term) >= 2 AND term NOT IN ({STOP_SQL}) GROUP BY ALL),
lyric_terms AS (
  SELECT song_id, term, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY cnt DESC, first) AS rank FROM lyric_counts) WHERE rank <= 40)"""

TITLE_TERMS_SQL = f"""title_texts AS (
  SELECT song_id, lower(concat_ws(' ', name, aliases, translations, album_name)) AS t, name, aliases, album_name FROM songs),
title_words AS (
  SELECT song_id, name, aliases, album_name, pos, regexp_replace(lower(word), '^[^\\w]+|[^\\w]+$', '', 'g') AS term FROM (
    SELECT *, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (
      SELECT *, list_concat(CASE WHEN regexp_matches(t, '[a-zA-Z]{{3,}}') THEN regexp_extract_all(t, '[a-zA-Z][a-zA-Z'']+') ELSE [] END,
        regexp_split_to_array(t, '[\\s,/|:;_()\\[\\]{{}}<>"''!?-]+')) AS words FROM title_texts))),
title_terms AS (
  SELECT song_id, term, min(pos) AS first FROM title_words
  WHERE length(term) BETWEEN 2 AND 12 AND term NOT IN ({STOP_SQL})
    AND term NOT IN (lower(name), lower(aliases), lower(album_name)) GROUP BY ALL)"""


def _long_sql() -> str:
    lists = {
        "all_tags": "all_tags", "style": "style_tags", "emotion": "emotion_tags", "theme": "theme_tags",
        "scene": "scene_tags", "audio": "audio_tags", "lyric_semantic": "lyric_semantic",
        "comment_semantic": "comment_semantic",
    }
    parts = [f"SELECT song_id, '{f}' AS feature, unnest({STYLE_SPLIT.format(c)}) AS item FROM wide_base" for f, c in lists.items()]
    parts += [
        "SELECT song_id, 'language' AS feature, unnest(language_list) AS item FROM wide_base",
        "SELECT song_id, 'artists' AS feature, unnest(artist_list) AS item FROM wide_base",
        "SELECT song_id, 'title_terms' AS feature, term AS item FROM title_terms",
        "SELECT song_id, 'lyric_terms' AS feature, term AS item FROM lyric_terms",
    ]
    return "feature_rows AS (" + " UNION ALL ".join(parts) + "), counts AS (SELECT feature, item, count(*) AS cnt FROM feature_rows GROUP BY ALL)"


WIDE_SQL = WIDE_BASE_SQL + ", " + LYRIC_TERMS_SQL + ", " + TITLE_TERMS_SQL
LONG_SQL = WIDE_SQL + ", " + _long_sql()


def tag_job(spark: SparkSession, folder: str, **tables) -> DataFrame:
    return tag_plan.full_tag_table(songs(spark, folder), rules=RULES, local_tag=LOCAL_TAG, **tables)
