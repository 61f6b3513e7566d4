"""Interaction history: entries, trimming, rarity bonus, profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonearm import vocab
from tonearm.functions import arrays, text
from tonearm.operators import features
from tonearm.operators.scoring import LABELS

ENTRY_FIELDS = ["song_id", "name", "artist_names", "album_name"]
SWITCHED_ACTION = "select"  # fixed value: the one action the setting can turn off


def song_clicks(events: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, cnt): interactions of each song, combined before the shuffle."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def hot_songs(clicks: DataFrame, key: str = "song_id") -> DataFrame:
    """(key, salts): songs with more than a quarter of a shuffle partition's share of all interactions.

    A song gets a salt for each such quarter, so there are at most HOT_SHARES times the partitions of songs here and at
    most twice as many salts.
    """
    quarters = features.HOT_SHARES * int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = clicks.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total")).first()["total"]
    share = F.col("cnt") * F.lit(quarters).cast("long")
    return clicks.where(share > total).select(key, F.ceil(share / F.lit(max(1, total))).cast("int").alias("salts"))


def history_entry(events: DataFrame, songs: DataFrame, key: str = "song_id", clicks: DataFrame | None = None) -> DataFrame:
    """Join interactions with the catalogue: song fields and twelve distinct feature lists.

    Works for a static and for a streaming ``events`` (time, action and key columns). Entries
    without id and name are dropped. ``clicks`` (key, cnt) says how often songs are chosen; a static log counts its own
    if there is none, a stream takes those of its past. Interactions of a hot song are dealt over its salts, by a hash of
    their columns, and its catalogue row is copied to each; only ids of hot songs are broadcast. Interactions without
    a song are dealt out too. The result is that of the plain join, whatever ``clicks`` says.
    """
    lists = {feature: column for feature, column in features.FEATURE_COLUMNS.items() if column in songs.columns}
    payload = songs.select(
        key,
        *[text.safe_text(name).alias(name) if name in songs.columns else F.lit("").alias(name)
          for name in ENTRY_FIELDS if name != key],
        *[arrays.unique_items(arrays.coerce_list(column, True)).alias(feature)
          for feature, column in lists.items()],
    )
    if clicks is None and not events.isStreaming:
        clicks = song_clicks(events, key)
    if clicks is None:
        joined = events.join(payload, key, "left")
    else:
        hot = F.broadcast(hot_songs(clicks, key))
        deal = F.xxhash64(*events.columns)
        parts = F.lit(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salt = F.when(F.col(key).isNull(), F.pmod(deal, parts)).otherwise(F.pmod(deal, F.coalesce("salts", F.lit(1))))
        dealt = events.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("salts")
        every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        copied = payload.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("salts")
        joined = dealt.join(copied, [key, "_salt"], "left").drop("_salt")
    return joined.where(~(text.is_blank(key) & text.is_blank("name")))


def recorded(events: DataFrame, selection_writes_history: bool = True) -> DataFrame:
    """Interactions that enter the history under the setting; link and file opens always do."""
    return events if selection_writes_history else events.where(F.col("action") != SWITCHED_ACTION)


def last_n(entries: DataFrame, n: int = vocab.HISTORY_SIZE, order: Sequence[str] = ("selected_at",), by: Sequence[str] = ()) -> DataFrame:
    """Last n entries by arrival, overall or per user.

    Overall it is a top-n sort. Per user the rank filter lets Spark keep only n rows per user and
    map partition before the shuffle, so a user with a third of all events stays cheap.
    """
    if n <= 0:
        return entries.limit(0)
    latest = [F.col(name).desc() for name in order]
    if not by:
        return entries.orderBy(*latest).limit(n)
    ranked = entries.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*latest)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def history_counts(entries: DataFrame, key: str = "event_id") -> DataFrame:
    """(feature, item, cnt): in how many entries an item occurs; entry lists are distinct."""
    columns = {feature: feature for feature in features.FEATURE_COLUMNS if feature in entries.columns}
    rows = features.feature_rows(features.distinct_lists(entries, columns), columns, key)
    return features.frequency_counts(rows)


def counts_from_log(log: DataFrame, rows: DataFrame, key: str = "song_id") -> DataFrame:
    """As ``history_counts`` for a log of song ids and the catalogue's long table.

    Interactions are first counted per song, so items are never repeated per interaction and a song
    with a third of all clicks is one row after the map-side combine.
    """
    clicks = log.where(~text.is_blank(key)).groupBy(key).agg(F.count(F.lit(1)).alias("clicks"))
    items = rows.join(clicks, key).select(key, "feature", "item", "clicks").distinct()
    return items.groupBy("feature", "item").agg(F.sum("clicks").alias("cnt"))


def rarity_bonus(
    liked: DataFrame,
    counts: DataFrame,
    dimension_weights: Mapping[str, float] = vocab.DEFAULT_DIMENSION_WEIGHTS,
) -> DataFrame:
    """(feature, item, history_cnt, bonus): liked items, rare catalogue items count for more.

    ``bonus = history count * log1p((feature total + 1) / (catalogue count + 1)) * scale``. The
    totals have one row per feature. Features with a scale of 0 or less have no bonus.
    """
    totals = counts.groupBy("feature").agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("total"))
    scales = F.create_map(
        *[
            F.lit(value)
            for feature in features.FEATURE_COLUMNS
            for value in (feature, float(dimension_weights.get(LABELS[feature], 1.0)))
        ]
    )
    joined = (
        liked.withColumnRenamed("cnt", "history_cnt")
        .join(counts, ["feature", "item"], "left")
        .join(totals, "feature", "left")
        .withColumn("scale", F.coalesce(F.try_element_at(scales, F.col("feature")), F.lit(1.0)))
        .where(F.col("scale") > 0)
    )
    rarity = F.log1p((F.coalesce("total", F.lit(1)) + 1) / (F.coalesce("cnt", F.lit(0)) + 1))
    return joined.select(
        "feature", "item", "history_cnt", (F.col("history_cnt") * rarity * F.col("scale")).alias("bonus")
    )


def history_table(entries: DataFrame, order: Sequence[str] = ("selected_at",), by: Sequence[str] = ()) -> DataFrame:
    """Numbered display rows with at most six tags. The history is bounded by ``last_n``."""
    oldest_first = Window.partitionBy(*by).orderBy(*order)
    tags = F.array_join(F.slice(F.col("all_tags"), 1, 6), " | ")
    return entries.select(
        *by,
        F.row_number().over(oldest_first).alias("number"),
        "selected_at", "action", *ENTRY_FIELDS,
        tags.alias("tags"),
    )


def delete_entries(numbered: DataFrame, selected: DataFrame, keys: Sequence[str] = ("number",)) -> DataFrame:
    """History without the selected positions."""
    return numbered.join(selected.select(*keys).distinct(), list(keys), "left_anti")


def resolve_clicks(clicks: DataFrame, items: DataFrame) -> DataFrame:
    """Clicks with the link to open: the click's own link, else the item's; others are rejected."""
    payload = items.select("token", F.col("link").alias("item_link"), "song_id")
    joined = clicks.join(payload, "token", "left")
    own = F.when(text.has_web_scheme("target"), F.col("target"))
    fallback = F.when(text.has_web_scheme("item_link"), text.safe_text("item_link"))
    return joined.withColumns(
        {"link": F.coalesce(own, fallback), "known_item": F.col("song_id").isNotNull()}
    ).where(F.col("link").isNotNull()).drop("item_link")


def preference_profile(entries: DataFrame, key: str = "event_id") -> DataFrame:
    """Counters behind the history charts."""
    shown = ["all_tags", "artists", "title_terms", "lyric_terms", "comment_semantic", "emotion"]
    return history_counts(entries, key).where(F.col("feature").isin(shown))
