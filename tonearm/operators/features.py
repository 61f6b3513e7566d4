"""Feature lists of the catalogue and the one long table that scores, charts and history read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import arrays, numbers, text, udfs

FEATURE_COLUMNS = {feature: column for feature, column, _label, _scale in vocab.SCORED_FEATURES}

# A lookup row is treated as hot when its key holds more than one part in this many, times the
# shuffle partitions, of all rows: a quarter of what a partition holds. At most so many keys can do so,
# which bounds what is broadcast.
HOT_SHARES = 4


def lyric_terms(
    df: DataFrame, limit: int = 40, stop_words: Sequence[str] = tuple(vocab.STOP_WORDS),
    make_segmenter: Callable[[], Callable[[str], list[str]]] | None = None,
) -> DataFrame:
    """Add ``lyric_terms``: the most frequent words of the whole lyric, counted inside the row.

    ``make_segmenter`` gives a word segmenter, text -> words, that replaces the built-in tokenizers.
    """
    lyric = F.coalesce(F.nullif(F.col("full_lyric"), F.lit("")), F.col("lyric_excerpt"))
    if make_segmenter is not None:
        segmented = df.withColumn("_found", udfs.segment_words(text.clean_lyric(lyric), make_segmenter))
        found = text.lyric_words("_found", "language_tags", stop_words, F.col("_found"))
        return segmented.withColumn("lyric_terms", arrays.most_common(found, limit)).drop("_found")
    words = numbers.bind(text.clean_lyric(lyric), lambda cleaned: text.lyric_words(cleaned, "language_tags", stop_words))
    return df.withColumn("lyric_terms", arrays.most_common(words, limit))


def title_terms(df: DataFrame) -> DataFrame:
    names = ("name", "aliases", "translations", "album_name")
    fields = [F.col(name) if name in df.columns else F.lit("") for name in names]
    return df.withColumn("title_terms", text.title_terms(*fields, "language_tags"))


def feature_rows(df: DataFrame, columns: Mapping[str, str] = FEATURE_COLUMNS, key: str = "song_id") -> DataFrame:
    """Long table (key, feature, item, pos) of all list features, in one pass over the rows."""

    def entries(feature: str, column: str) -> Column:
        name = F.lit(feature).alias("feature")
        return F.transform(
            F.coalesce(F.col(column), text.no_items()),
            lambda item, pos: F.struct(name, item.alias("item"), pos.alias("pos")),
        )

    present = [entries(feature, column) for feature, column in columns.items() if column in df.columns]
    # The outer form keeps the optimizer from testing the size of the lists in a filter of its own,
    # which would evaluate tokens and tags of every row again.
    return df.select(key, F.inline_outer(F.concat(*present))).where(F.col("feature").isNotNull())


def frequency_counts(rows: DataFrame, once_per_row: bool = False, key: str = "song_id") -> DataFrame:
    """(feature, item, cnt). In-row duplicates count unless ``once_per_row`` is set.

    Rows made by ``feature_rows`` from distinct lists need no second look; otherwise duplicates
    are removed per (key, feature, item) before counting.
    """
    if once_per_row:
        rows = rows.select(key, "feature", "item").distinct()
    return rows.groupBy("feature", "item").agg(F.count(F.lit(1)).alias("cnt"))


def distinct_lists(df: DataFrame, columns: Mapping[str, str] = FEATURE_COLUMNS) -> DataFrame:
    """Lists reduced to first-seen distinct non-blank items, inside the row."""
    return df.withColumns(
        {column: arrays.unique_items(column) for column in columns.values() if column in df.columns}
    )


def attach_counts(rows: DataFrame, lookup: DataFrame, spread_by: str = "song_id", heat: str = "cnt") -> DataFrame:
    """Left-join a (feature, item, ...) lookup onto the long table without a hot partition.

    A common item may hold a third of all rows. ``heat`` is the number of rows an item has, so the
    hot items can be read off the lookup: at most HOT_SHARES times the partitions of them exist,
    and only those are broadcast. Their rows are answered by that map and get a spread key that
    matches nothing in the shuffled join, which then only works on cold keys.
    """
    values = [name for name in lookup.columns if name not in ("feature", "item")]
    hot_parts = HOT_SHARES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.agg(F.coalesce(F.sum(heat), F.lit(0)).alias("total"))
    hot = lookup.where(F.col(heat) * hot_parts > total.scalar()).select(
        "feature", "item", F.struct(*values).alias("_hot")
    )
    cold = lookup.select("feature", "item", F.lit(0).alias("_spread"), F.struct(*values).alias("_cold"))
    known = rows.join(F.broadcast(hot), ["feature", "item"], "left")
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(
        (F.pmod(F.xxhash64(spread_by), F.lit(max(1, 4 * hot_parts))) + 1).cast("int")
    )
    joined = known.withColumn("_spread", spread).join(cold, ["feature", "item", "_spread"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.withColumns({name: found[name] for name in values}).drop("_hot", "_cold", "_spread")


def max_scale(value: str, df: DataFrame) -> Column:
    """``value`` divided by its maximum over ``df``; 0 where the maximum is not positive."""
    number = numbers.to_number(value)
    top = df.agg(F.max(number).alias("top")).scalar()
    return F.when(top > 0, number / top).otherwise(F.lit(0.0))


def recommend_score(df: DataFrame) -> Column:
    """Static 0..100 score of a catalogue row."""
    # Part weights.
    score = (
        max_scale("popularity", df) * 34
        + F.pow(max_scale("comment_total", df), F.lit(0.45)) * 28
        + max_scale("lyric_line_count", df) * 14
        + F.col("has_translation").cast("int") * 8
        + F.col("playable").cast("int") * 10
        + F.col("has_romaji").cast("int") * 4
        + F.col("quality").isin(vocab.HIGH_QUALITY).cast("int") * 8
    )
    return numbers.clip(F.rint(score), 0, 100)
