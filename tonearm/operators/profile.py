"""Counts and ranges for pickers, tiles and charts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonearm.functions import text
from tonearm.operators import features


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of stripped values; blanks and ``nan`` are dropped."""
    label = text.safe_text(column)
    return (
        df.select(label.alias("item"))
        .where((F.col("item") != "") & (F.lower("item") != "nan"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def year_histogram(df: DataFrame, column: str = "publish_year") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def top_counts(df: DataFrame, column: str, order: str, limit: int = 12, once_per_row: bool = True) -> DataFrame:
    """Most frequent items of an array column; equal counts keep first-appearance order."""
    items = F.array_distinct(F.col(column)) if once_per_row else F.col(column)
    return (
        df.select(F.col(order).alias("_row"), F.posexplode(items).alias("_pos", "item"))
        .where(F.col("item") != "")
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("_row", "_pos")).alias("_first"))
        .orderBy(F.desc("cnt"), "_first")
        .limit(limit)
        .select("item", "cnt")
    )


def chart_table(counts: DataFrame, top: int = 15, table: int = 150) -> DataFrame:
    """Per feature the ``table`` most frequent items with rank; ``in_bar`` marks the ``top`` ones.

    The rank filter reaches below the shuffle, so only ``table`` candidates per feature and map
    partition move. Equal counts are ordered by item.
    """
    order = Window.partitionBy("feature").orderBy(F.desc("cnt"), "item")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= table)
    return ranked.withColumn("in_bar", F.col("rank") <= top)


def headline_metrics(shown: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Rows shown and total, distinct artists, rows with lyric, playable rows, mean score."""
    artists = shown.select(F.explode("artist_list").alias("artist")).agg(
        F.countDistinct("artist").alias("artists")
    )
    total = all_rows.agg(F.count(F.lit(1)).alias("total"))
    return shown.agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if("has_lyric").alias("with_lyric"),
        F.count_if("playable").alias("playable"),
        F.coalesce(F.avg("dynamic_score"), F.lit(0.0)).alias("mean_score"),
    ).withColumns({"total": total.scalar(), "artists": artists.scalar()})


def distinct_values(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """(feature, item): distinct items of array columns, sorted, for pickers."""
    rows = features.feature_rows(df, columns)
    return rows.select("feature", "item").distinct().orderBy("feature", "item")


def bounds(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Minimum and maximum of each column in one row."""
    return df.agg(
        *[fn(name).alias(f"{label}_{name}") for name in columns for label, fn in (("min", F.min), ("max", F.max))]
    )


def dataset_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(artefact, row_count) for each table."""
    result = None
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("artefact"), "row_count")
        result = counted if result is None else result.unionByName(counted)
    return result


def file_profile(files: DataFrame) -> DataFrame:
    """(folder, file_count, total_bytes) of a file listing with ``path`` and ``length``."""
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    return files.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_bytes")
    )


FILTERED_PROFILE = {"artists": "artist_list", "tags": "generated_tag_list", "languages": "language_tags"}
LIBRARY_PROFILE = ["all_tags", "artists", "title_terms", "lyric_terms", "comment_semantic", "emotion"]


def filtered_profile(df: DataFrame) -> DataFrame:
    """(feature, item, cnt) of artists, tags, languages (once per row) and quality."""
    lists = features.frequency_counts(
        features.feature_rows(features.distinct_lists(df, FILTERED_PROFILE), FILTERED_PROFILE)
    )
    quality = value_counts(df, "quality").select(F.lit("quality").alias("feature"), "item", "cnt")
    return lists.unionByName(quality)


def library_profile(counts: DataFrame) -> DataFrame:
    """The six whole-library counters, in-row duplicates counted."""
    return counts.where(F.col("feature").isin(LIBRARY_PROFILE))
