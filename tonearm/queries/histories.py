"""Interaction history: entries, trimming, bonus, profile, clicks; and the user's weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm import session, vocab
from tonearm.operators import features, history, joins, scoring
from tonearm.plans import recommend as plan
from tonearm.queries import model, scores
from tonearm.queries.registry import query, table


def events(spark, folder):
    """Interactions: the song is the event's key ``k``; views stand for selections."""
    key = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(
        "event_id", "user_id", key.alias("song_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("selected_at"),
        F.when(F.col("event_type") == "view", "select").otherwise(F.col("event_type")).alias("action"))


EVENTS_SQL = """interactions AS (
  SELECT event_id, user_id, json_extract_string(props, '$.k') AS song_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS selected_at,
    CASE WHEN event_type = 'view' THEN 'select' ELSE event_type END AS action FROM events)"""


def _slim(spark, folder):
    return model.lists(spark, folder)


@query("history_entry", "WITH " + model.WIDE_BASE_SQL + ", " + EVENTS_SQL + """
SELECT event_id, action, i.song_id, selected_at, coalesce(name, '') AS name, coalesce(artist_names, '') AS artist_names, coalesce(array_to_string(artist_list, '#'), '') AS artists,
  coalesce(replace(all_tags, ' | ', '#'), '') AS tags FROM interactions i LEFT JOIN wide_base w ON w.song_id = i.song_id WHERE trim(coalesce(i.song_id, '')) <> '' OR trim(coalesce(name, '')) <> ''""")
def history_entry(spark, folder):
    entries = history.history_entry(events(spark, folder), model.wide(spark, folder, terms=False))
    return entries.select("event_id", "action", "song_id", "selected_at", F.coalesce("name", F.lit("")).alias("name"),
                          F.coalesce("artist_names", F.lit("")).alias("artist_names"),
                          F.coalesce(F.array_join("artists", "#"), F.lit("")).alias("artists"),
                          F.coalesce(F.array_join("all_tags", "#"), F.lit("")).alias("tags"))


@query("last_n", "WITH " + EVENTS_SQL + """
SELECT 'all' AS scope, event_id, user_id FROM (SELECT * FROM interactions ORDER BY event_id DESC LIMIT 80)
UNION ALL SELECT 'user' AS scope, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM interactions) WHERE rn <= 10""")
def last_n(spark, folder):
    log = events(spark, folder)
    overall = history.last_n(log, 80, ["event_id"]).select(F.lit("all").alias("scope"), "event_id", "user_id")
    by_user = history.last_n(log, 10, ["event_id"], ["user_id"]).select(F.lit("user").alias("scope"), "event_id", "user_id")
    return overall.unionByName(by_user)


@query("action_switch", "WITH " + EVENTS_SQL + " SELECT event_id, action FROM interactions WHERE action <> 'select'")
def action_switch(spark, folder):
    return history.recorded(events(spark, folder), False).select("event_id", "action")


# History of all recorded interactions with known songs, as (feature, item) counts.
LIKED_SQL = EVENTS_SQL + """, liked AS (
  SELECT feature, item, count(*) AS history_cnt FROM (
    SELECT DISTINCT event_id, feature, item FROM interactions JOIN feature_rows USING (song_id)) GROUP BY ALL),
totals AS (SELECT feature, greatest(sum(cnt), 1) AS total FROM counts GROUP BY feature)"""


def _bonus_sql() -> str:
    scales = ", ".join(
        f"('{feature}', {vocab.DEFAULT_DIMENSION_WEIGHTS.get(label, 1.0)})" for feature, _c, label, _s in vocab.SCORED_FEATURES)
    return LIKED_SQL + f""", scales(feature, scale) AS (VALUES {scales}),
bonuses AS (SELECT feature, item, history_cnt, history_cnt * ln(1 + (coalesce(total, 1) + 1) / (coalesce(cnt, 0) + 1)) * scale AS bonus
  FROM liked LEFT JOIN counts USING (feature, item) LEFT JOIN totals USING (feature) JOIN scales USING (feature) WHERE scale > 0)"""


def _liked(spark, folder, slim):
    return history.counts_from_log(events(spark, folder), model.rows(slim))


@query("history_bonus", "WITH " + model.LONG_SQL + ", " + _bonus_sql() + " SELECT feature, item, history_cnt, round(bonus, 4) AS bonus FROM bonuses")
def history_bonus(spark, folder):
    slim = _slim(spark, folder)
    counts = features.frequency_counts(model.rows(slim))
    bonus = history.rarity_bonus(_liked(spark, folder, slim), counts)
    return bonus.withColumn("bonus", F.round("bonus", 4))


@query("history_preference", "WITH " + model.LONG_SQL + ", " + _bonus_sql() + " SELECT feature, item, history_cnt, round(bonus, 4) AS bonus FROM bonuses")
def history_preference(spark, folder):
    slim = _slim(spark, folder)
    counts = features.frequency_counts(model.rows(slim))
    return history.rarity_bonus(_liked(spark, folder, slim), counts).withColumn("bonus", F.round("bonus", 4))


def _history_parts_sql() -> str:
    scales = ", ".join(f"('{feature}', {scale})" for feature, _c, _l, scale in vocab.SCORED_FEATURES)
    return f"""feature_scales(feature, part_scale) AS (VALUES {scales}),
history_parts AS (SELECT song_id, sum(score * part_scale) AS history FROM (
    SELECT song_id, feature, sum(coalesce(bonus, 0)) / sqrt(count(*)) AS score FROM feature_rows LEFT JOIN bonuses USING (feature, item) GROUP BY ALL)
  JOIN feature_scales USING (feature) GROUP BY song_id)"""


@query("history_score", "WITH " + model.LONG_SQL + ", " + _bonus_sql() + ", " + _history_parts_sql() + ", "
       + scores.score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS, True, 0.01) + " SELECT song_id, round(raw, 3) AS raw, score_breakdown FROM scored")
def history_score(spark, folder):
    slim = _slim(spark, folder)
    rows = model.rows(slim)
    counts = features.frequency_counts(rows)
    bonus = history.rarity_bonus(_liked(spark, folder, slim), counts)
    scored = scoring.dynamic_score(slim, rows, counts, weights=scores.WEIGHTS, bonus=bonus, history_weight=0.01)
    return scored.select("song_id", F.round("dynamic_score_raw", 3).alias("raw"), "score_breakdown")


@query("history_profile", "WITH " + model.LONG_SQL + ", " + LIKED_SQL + """
SELECT feature, item, history_cnt AS cnt FROM liked WHERE feature IN ('all_tags', 'artists', 'title_terms', 'lyric_terms', 'comment_semantic', 'emotion')""")
def history_profile(spark, folder):
    entries = history.history_entry(events(spark, folder), model.wide(spark, folder))
    return history.preference_profile(entries)


HISTORY_TABLE_SQL = EVENTS_SQL + """, kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM interactions),
numbered AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS number, selected_at, action, k.song_id, coalesce(name, '') AS name,
  coalesce(artist_names, '') AS artist_names, coalesce(album_name, '') AS album_name, coalesce(array_to_string(string_split(nullif(all_tags, ''), ' | ')[1:6], ' | '), '') AS tags
  FROM kept k LEFT JOIN wide_base w ON w.song_id = k.song_id WHERE rn <= 80)"""


def _history_table(spark, folder):
    kept = history.last_n(events(spark, folder), 80, ["event_id"], ["user_id"])
    entries = history.history_entry(kept, model.wide(spark, folder, terms=False))
    numbered = history.history_table(entries, ["event_id"], ["user_id"])
    return numbered.withColumns({name: F.coalesce(name, F.lit("")) for name in ("name", "artist_names", "album_name", "tags")})


@query("history_table", "WITH " + model.WIDE_BASE_SQL + ", " + HISTORY_TABLE_SQL + " SELECT * FROM numbered")
def history_table(spark, folder):
    return _history_table(spark, folder)


@query("anti_delete", "WITH " + model.WIDE_BASE_SQL + ", " + HISTORY_TABLE_SQL + " SELECT user_id, number, song_id FROM numbered WHERE action <> 'error'")
def anti_delete(spark, folder):
    numbered = _history_table(spark, folder)
    return history.delete_entries(numbered, numbered.where("action = 'error'"), ["user_id", "number"]).select("user_id", "number", "song_id")


@query("resolve_click", """
SELECT c.conv_id AS click_id, c.turn, p.page_id IS NOT NULL AS known_item, CASE WHEN c.role = 'user' THEN 'https://own/' || c.conv_id ELSE p.url END AS link
FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id WHERE c.role = 'user' OR p.url IS NOT NULL""")
def resolve_click(spark, folder):
    clicks = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("click_id"), "turn", F.col("conv_id").cast("string").alias("token"),
        F.when(F.col("role") == "user", F.concat(F.lit("https://own/"), "conv_id")).otherwise("ftp://x").alias("target"))
    items = table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("token"), F.col("url").alias("link"), F.col("page_id").alias("song_id"))
    return history.resolve_clicks(clicks, items).select("click_id", "turn", "known_item", "link")


@query("weights", "WITH " + model.LONG_SQL + ", " + scores._weights_sql() + """
SELECT feature, item, coalesce(weight, 1) AS weight FROM counts LEFT JOIN weights USING (feature, item)""")
def weights(spark, folder):
    counts = features.frequency_counts(model.rows(model.wide(spark, folder)))
    return counts.select("feature", "item", scoring.item_weight(scores.WEIGHTS).alias("weight"))


RECOMMEND_HISTORY = plan.Request(
    keywords="tion, WIDGET", artists=("en", "fr", "src3"), tags=("calm", "bright", "tionic"), blocked_tags=("heavy",),
    min_popularity=5, min_comments=10, years=(1970, 2015), weights=scores.WEIGHTS, history_weight=0.01, min_score=120,
)


@query("recommend_with_history", scores.recommend_sql(
    _bonus_sql() + ", " + _history_parts_sql() + ", " + scores.score_sql(vocab.DEFAULT_DIMENSION_WEIGHTS, True, 0.01), "120") + """
SELECT song_id, dynamic_score FROM passing ORDER BY dynamic_score DESC, comment_total DESC, song_id LIMIT 20""")
def recommend_with_history(spark, folder):
    wide = model.wide(spark, folder).withColumn("_passes", plan.passes(RECOMMEND_HISTORY))
    slim = session.materialize(wide.drop("full_lyric", "search_text", "lyric_excerpt", "tag_sources"))
    rows = model.rows(slim)
    counts = features.frequency_counts(rows)
    found = plan.recommend(slim, rows, counts, RECOMMEND_HISTORY, liked=_liked(spark, folder, slim))
    return joins.top_candidates(found).select("song_id", "dynamic_score")
