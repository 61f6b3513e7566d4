"""Counters, scores, catalogue preprocessing and the recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm import session, vocab
from tonearm.operators import catalog, features, filters, joins, scoring
from tonearm.plans import feature_store
from tonearm.plans import features as feature_plan
from tonearm.plans import recommend as plan
from tonearm.queries import model
from tonearm.queries.registry import query, table

TAG_WEIGHTS = {"calm": 1.5, "tionic": -0.5, "bright": 2.0, vocab.FAST: 0.3, "en": 0.8}
ARTIST_WEIGHTS = {"src1": 2.0, "de": -1.0}
TERM_WEIGHTS = {"tion": 3.0, "ing": 0.5}
WEIGHTS = {"tags": TAG_WEIGHTS, "artists": ARTIST_WEIGHTS, "lyric_terms": TERM_WEIGHTS}


def _weights_sql() -> str:
    rows = ", ".join(f"('{feature}', '{item}', {weight})" for feature, item, weight in scoring.weight_rows(WEIGHTS))
    return f"weights(feature, item, weight) AS (VALUES {rows})"


@query("frequency_counter", "WITH " + model.LONG_SQL + " SELECT feature, item, cnt FROM counts")
def frequency_counter(spark, folder):
    return features.frequency_counts(model.rows(model.wide(spark, folder)))


@query("frequency_distinct", """
SELECT word AS item, count(DISTINCT doc_id) AS cnt FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def frequency_distinct(spark, folder):
    words = table(spark, folder, "documents").select("doc_id", F.split("text", " ").alias("words"))
    rows = features.feature_rows(features.distinct_lists(words, {"w": "words"}), {"w": "words"}, "doc_id")
    return features.frequency_counts(rows).select("item", "cnt")


@query("max_scale", """
SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 8) AS scaled, CAST(0 AS DOUBLE) AS negative FROM orders""")
def max_scale(spark, folder):
    orders = table(spark, folder, "orders").withColumn("minus", -F.col("o_totalprice"))
    return orders.select("o_orderkey", F.round(features.max_scale("o_totalprice", orders), 8).alias("scaled"),
                         features.max_scale("minus", orders).alias("negative"))


@query("base_scores", """
SELECT l_shipdate::DATE AS day, round(10 * ln(1 + count(*)), 6) AS base FROM lineitem GROUP BY ALL""")
def base_scores(spark, folder):
    counts = table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).count()
    return counts.select("day", F.round(scoring.base_score("count"), 6).alias("base"))


@query("feature_score", "WITH " + model.LONG_SQL + ", " + _weights_sql() + """
SELECT song_id, feature, round(sum(10 * ln(1 + cnt) * coalesce(weight, 1)) / sqrt(count(*)), 4) AS score
FROM feature_rows JOIN counts USING (feature, item) LEFT JOIN weights USING (feature, item) GROUP BY ALL""")
def feature_score(spark, folder):
    rows = model.rows(model.lists(spark, folder))
    scored = scoring.multi_feature_scores(rows, features.frequency_counts(rows), WEIGHTS)
    return scored.withColumn("score", F.round("score", 4))


@query("single_feature_score", """
SELECT o_orderkey AS song_id, o_orderpriority AS item,
  round(10 * ln(1 + count(*) OVER (PARTITION BY o_orderpriority)) * CASE WHEN o_orderpriority = '1-URGENT' THEN 2.5 ELSE 1 END, 5) AS score FROM orders""")
def single_feature_score(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("song_id"), F.lit("artists").alias("feature"), F.col("o_orderpriority").alias("item"))
    scored = scoring.single_feature_score(rows, features.frequency_counts(rows), {"artists": {"1-URGENT": 2.5}})
    return scored.select("song_id", "item", F.round("score", 5).alias("score"))


@query("derive_catalog", "WITH " + model.WIDE_BASE_SQL + """
SELECT song_id, publish_year, round(duration_minutes, 6) AS duration_minutes, array_to_string(artist_list, '#') AS artists, quality,
  'https://example.org/song/' || song_id AS record_link, lyrics_chars FROM wide_base""")
def derive_catalog(spark, folder):
    derived = catalog.derive_catalog(model.songs(spark, folder), "https://example.org/song/")
    return derived.select("song_id", "publish_year", F.round("duration_minutes", 6).alias("duration_minutes"),
                          F.array_join("artist_list", "#").alias("artists"), "quality", "record_link",
                          F.col("lyrics_chars").cast("long").alias("lyrics_chars"))


@query("preferred_quality", "WITH " + model.WIDE_BASE_SQL + " SELECT quality, count(*) AS cnt FROM wide_base GROUP BY ALL")
def preferred_quality(spark, folder):
    songs = model.songs(spark, folder)
    return songs.groupBy(catalog.preferred_quality(songs.columns).alias("quality")).agg(F.count(F.lit(1)).alias("cnt"))


@query("split_features", "WITH " + model.TAGS_SQL + f""" SELECT song_id, CAST(len({model.STYLE_SPLIT.format('all_tags')}) AS INTEGER) AS n_all,
  array_to_string({model.STYLE_SPLIT.format('style_tags')}, '#') AS style FROM tag_table""")
def split_features(spark, folder):
    blank = {name: F.lit("") for name in ("lyric_semantic_tags", "comment_semantic_tags")}
    split = catalog.split_feature_columns(model.tag_table(spark, folder).withColumns(blank))
    return split.select("song_id", F.size("generated_tag_list").alias("n_all"), F.array_join("style_tag_list", "#").alias("style"))


@query("search_text", "WITH " + model.WIDE_BASE_SQL + " SELECT song_id, search_text FROM wide_base")
def search_text(spark, folder):
    return model.wide(spark, folder, terms=False).select("song_id", "search_text")


@query("build_features_job", "WITH " + model.WIDE_SQL + """
SELECT song_id, quality, publish_year, array_to_string(language_list, '#') AS languages,
  coalesce(tt, '') AS title_terms, coalesce(lt, '') AS lyric_terms,
  greatest(0, least(100, round_even(popularity / (SELECT max(popularity) FROM songs) * 34 + pow(comment_total / (SELECT max(comment_total) FROM songs), 0.45) * 28
    + lyric_line_count / (SELECT max(lyric_line_count) FROM songs) * 14 + has_translation::INT * 8 + playable::INT * 10 + has_romaji::INT * 4
    + (quality IN ('Hi-Res', '无损'))::INT * 8, 0))) AS recommend_score
FROM wide_base LEFT JOIN (SELECT song_id, string_agg(term, ' ' ORDER BY first) AS tt FROM title_terms GROUP BY ALL) USING (song_id)
LEFT JOIN (SELECT song_id, string_agg(term, ' ' ORDER BY rank) AS lt FROM lyric_terms GROUP BY ALL) USING (song_id)""")
def build_features_job(spark, folder):
    sources = model.raw_songs(spark, folder).drop("full_lyric").withColumns(
        {"file_order": F.lit(0), "row_order": F.col("song_id").cast("long")})
    lyrics = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"), F.col("text").alias("full_lyric"))
    tag_rows = model.tag_table(spark, folder).drop("name", "artist_names", "has_lyric").withColumns(
        {"file_order": F.lit(0), "row_order": F.col("song_id").cast("long")})
    built = feature_plan.build_features(sources, tag_rows, lyrics, languages=model.LANGUAGES)
    return feature_plan.with_recommend_score(built).select(
        "song_id", "quality", "publish_year", F.array_join("language_tags", "#").alias("languages"),
        F.array_join("title_terms", " ").alias("title_terms"), F.array_join("lyric_terms", " ").alias("lyric_terms"),
        "recommend_score")


# --- dynamic score ----------------------------------------------------------------------------------


def score_sql(dimension_weights, history: bool = False, history_weight: float = 1.0) -> str:
    """CTE ``scored``: raw and rounded score and the breakdown, as wide and long SQL."""
    parts = []
    for feature, _column, label, scale in vocab.SCORED_FEATURES:
        factor = dimension_weights.get(label, 1.0) * scale
        parts.append((label, f"coalesce(max(score) FILTER (WHERE feature = '{feature}'), 0) * {factor}"))
    listed = ", ".join(f"{value} AS p{i}" for i, (_label, value) in enumerate(parts))
    # Fixed order of the numeric parts.
    numbers = [
        "popularity / (SELECT max(popularity) FROM songs) * 35", "lyric_line_count / (SELECT max(lyric_line_count) FROM songs) * 24",
        "(quality IN ('Hi-Res', '无损'))::INT * 18", "playable::INT * 12", "(local_audio_path <> '')::INT * 18",
        "(mert_embedding_path <> '')::INT * 14",
    ]
    labels = [label for label, _value in parts] + [label for label, _scale in vocab.NUMERIC_PARTS]
    values = [f"coalesce(p{i}, 0)" for i in range(len(parts))]
    values += [f"{value} * {dimension_weights.get(label, 1.0)}" for value, (label, _scale) in zip(numbers, vocab.NUMERIC_PARTS)]
    if history:
        labels.append(vocab.HISTORY_PART)
        values.append(f"coalesce(history, 0) * {history_weight}")
    rows = " UNION ALL ".join(
        f"SELECT song_id, {i} AS ord, '{label}' AS label, CAST({value} AS DOUBLE) AS part FROM wide_parts"
        for i, (label, value) in enumerate(zip(labels, values)))
    return _weights_sql() + f""", song_scores AS (
  SELECT song_id, feature, sum(10 * ln(1 + cnt) * coalesce(weight, 1)) / sqrt(count(*)) AS score
  FROM feature_rows JOIN counts USING (feature, item) LEFT JOIN weights USING (feature, item) GROUP BY ALL),
list_parts AS (SELECT song_id, {listed} FROM song_scores GROUP BY song_id),
wide_parts AS (SELECT * FROM wide_base LEFT JOIN list_parts USING (song_id) {'LEFT JOIN history_parts USING (song_id)' if history else ''}),
part_rows AS ({rows}),
ranked_parts AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY part DESC, ord) AS rank FROM part_rows),
scored AS (
  SELECT song_id, sum(part) AS raw, CAST(round_even(sum(part), 0) AS BIGINT) AS dynamic_score,
    coalesce(string_agg(label || ':' || printf('%.1f', part), ' | ' ORDER BY rank) FILTER (WHERE rank <= 5 AND abs(part) >= 0.1), '') AS score_breakdown
  FROM ranked_parts GROUP BY song_id)"""


def _scored(spark, folder):
    wide = model.lists(spark, folder)
    rows = model.rows(wide)
    return scoring.dynamic_score(wide, rows, features.frequency_counts(rows), weights=WEIGHTS)


@query("dynamic_score", "WITH " + model.LONG_SQL + ", " + score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS) + " SELECT song_id, round(raw, 4) AS raw, dynamic_score FROM scored")
def dynamic_score(spark, folder):
    return _scored(spark, folder).select("song_id", F.round("dynamic_score_raw", 4).alias("raw"), "dynamic_score")


@query("score_breakdown", "WITH " + model.LONG_SQL + ", " + score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS) + " SELECT song_id, score_breakdown FROM scored")
def score_breakdown(spark, folder):
    return _scored(spark, folder).select("song_id", "score_breakdown")


@query("recommend_score", "WITH " + model.WIDE_BASE_SQL + """
SELECT song_id, greatest(0, least(100, round_even(popularity / (SELECT max(popularity) FROM songs) * 34 + pow(comment_total / (SELECT max(comment_total) FROM songs), 0.45) * 28
    + lyric_line_count / (SELECT max(lyric_line_count) FROM songs) * 14 + has_translation::INT * 8 + playable::INT * 10 + has_romaji::INT * 4
    + (quality IN ('Hi-Res', '无损'))::INT * 8, 0))) AS recommend_score FROM wide_base""")
def recommend_score(spark, folder):
    songs = catalog.derive_catalog(model.songs(spark, folder))
    return feature_plan.with_recommend_score(songs).select("song_id", "recommend_score")


@query("min_score", "WITH " + model.LONG_SQL + ", " + score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS) + """
SELECT song_id, dynamic_score FROM scored WHERE dynamic_score >= (SELECT CASE WHEN min(dynamic_score) <= 0 AND max(dynamic_score) >= 0 THEN 0 ELSE min(dynamic_score) END FROM scored)""")
def min_score(spark, folder):
    return filters.min_score(_scored(spark, folder)).select("song_id", "dynamic_score")


# --- the recommendation -----------------------------------------------------------------------------

REQUEST = plan.Request(
    keywords="tion, WIDGET", artists=("en", "fr", "src3"), tags=("calm", "bright", "tionic"), blocked_tags=("heavy",),
    min_popularity=5, min_comments=10, years=(1970, 2015), weights=WEIGHTS,
)
RECOMMEND_FILTER_SQL = """NOT list_has_any(string_split(all_tags, ' | '), ['heavy'])"""


def recommend_sql(extra_cte: str, threshold: str) -> str:
    return "WITH " + model.LONG_SQL + ", " + extra_cte + f""",
allowed AS (SELECT w.*, s.dynamic_score, s.score_breakdown FROM wide_base w JOIN scored s USING (song_id) WHERE {RECOMMEND_FILTER_SQL}),
passing AS (SELECT * FROM allowed WHERE dynamic_score >= {threshold}
  AND contains(search_text, 'tion') AND contains(search_text, 'widget') AND list_has_any(artist_list, ['en', 'fr', 'src3'])
  AND list_has_any(string_split(all_tags, ' | '), ['calm', 'bright', 'tionic']) AND playable
  AND popularity >= 5 AND comment_total >= 10 AND (publish_year IS NULL OR publish_year BETWEEN 1970 AND 2015))"""


DEFAULT_THRESHOLD_SQL = "(SELECT CASE WHEN min(dynamic_score) <= 0 AND max(dynamic_score) >= 0 THEN 0 ELSE min(dynamic_score) END FROM allowed)"


@query("recommend", recommend_sql(score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS), DEFAULT_THRESHOLD_SQL) + """
SELECT song_id, name, dynamic_score, score_breakdown FROM passing ORDER BY dynamic_score DESC, comment_total DESC, song_id LIMIT 20""")
def recommend(spark, folder):
    found = plan.recommend_from(model.wide(spark, folder), REQUEST)
    return joins.top_candidates(found).select("song_id", "name", "dynamic_score", "score_breakdown")


@query("recommend_stored", recommend_sql(score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS), DEFAULT_THRESHOLD_SQL) + """
SELECT song_id, name, dynamic_score, score_breakdown FROM passing ORDER BY dynamic_score DESC, comment_total DESC, song_id LIMIT 20""")
def recommend_stored(spark, folder):
    """The same request on stored features."""
    store = session.scratch(spark)
    feature_store.refresh(model.songs(spark, folder), store, model.derived, "v1", n=8)
    found = plan.recommend_stored(spark, store, REQUEST)
    return joins.top_candidates(found).select("song_id", "name", "dynamic_score", "score_breakdown")
