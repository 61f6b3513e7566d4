"""Catalogue filters. All are plain column predicates, so Spark can push them to the scan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonearm.functions import text


def query_terms(query: str | None) -> list[str]:
    """Lower-case terms of a search box text (blank or comma separated)."""
    return [term.lower() for term in re.split(r"[,，\s]+", query or "") if term]


def contains_all(column: Column | str, query: str | None) -> Column:
    """All terms occur as literal substrings; no terms means no restriction."""
    condition = F.lit(True)
    for term in query_terms(query):
        condition = condition & F.contains(text.col(column), F.lit(term))
    return condition


def keyword_filter(df: DataFrame, query: str | None) -> DataFrame:
    return df.where(contains_all("search_text", query))


def lyric_filter(df: DataFrame, query: str | None) -> DataFrame:
    return df.where(contains_all(F.lower("full_lyric"), query))


def has_any(column: str, values: Sequence[str]) -> Column:
    """The array holds at least one of the values; no values means no restriction."""
    if not values:
        return F.lit(True)
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(value) for value in values]))


def without_blocked(column: str, blocked: Sequence[str]) -> Column:
    return ~has_any(column, blocked) if blocked else F.lit(True)


def is_in(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values)) if values else F.lit(True)


def flags(playable: bool = True, has_lyric: bool = False, has_translation: bool = False) -> Column:
    condition = F.lit(True)
    for name, wanted in (("playable", playable), ("has_lyric", has_lyric), ("has_translation", has_translation)):
        if wanted:
            condition = condition & F.col(name)
    return condition


def ranges(min_popularity: float | None = None, min_comments: float | None = None, years: tuple[int, int] | None = None) -> Column:
    """Lower bounds and an inclusive year range that keeps rows without a year."""
    condition = F.lit(True)
    if min_popularity is not None:
        condition = condition & (F.col("popularity") >= min_popularity)
    if min_comments is not None:
        condition = condition & (F.col("comment_total") >= min_comments)
    if years is not None:
        condition = condition & (F.col("publish_year").isNull() | F.col("publish_year").between(*years))
    return condition


def min_score(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows at or above the threshold; by default 0 when the scores span 0, else their minimum."""
    if threshold is not None:
        return df.where(F.col("dynamic_score") >= threshold)
    low, high = F.min("dynamic_score"), F.max("dynamic_score")
    # The upper bound of the slider is widened when all scores are equal.
    top = F.when(low >= high, low + 1).otherwise(high)
    default = df.agg(F.when((low <= 0) & (top >= 0), 0).otherwise(low).alias("threshold"))
    return df.where(F.col("dynamic_score") >= default.scalar())


def marked_documents(documents: DataFrame, marker: str, content: str = "value", stem: str = "stem") -> DataFrame:
    """Distinct integer ids of documents whose raw text holds the marker."""
    ids = documents.where(F.contains(F.col(content), F.lit(marker))).select(
        F.col(stem).try_cast("long").alias("song_id")
    )
    return ids.where(F.col("song_id").isNotNull()).distinct()


def has_value(df: DataFrame, column: str, error: str | None = None) -> DataFrame:
    """Rows with a non-blank value and, if asked, a blank error."""
    condition = ~text.is_blank(column)
    return df.where(condition & text.is_blank(error)) if error else df.where(condition)


def with_positions(df: DataFrame, order: str, ties: Sequence[str] = (), groups: int | None = None) -> DataFrame:
    """Add the 1-based position in the order of a numeric column without one task sorting all rows.

    Quantiles of the column cut the rows into ordered groups, as many as there are shuffle
    partitions unless ``groups`` is given; rows of one value share a group. Ranks inside the groups run
    in parallel and are shifted by the sizes of earlier groups, a table of at most ``groups`` rows.
    """
    groups = groups or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [step / groups for step in range(1, groups)]
    value = F.col(order)
    cuts = df.agg(F.percentile_approx(order, steps, 10000).alias("cuts"))
    grouped = df.withColumn("_cuts", cuts.scalar()).withColumn(
        "_group", F.size(F.filter("_cuts", lambda cut: cut <= value))
    ).drop("_cuts")
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_group", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_group").orderBy(order, *ties))
    ranked = grouped.withColumn("_inside", inside).join(F.broadcast(shifts), "_group", "left")
    return ranked.withColumn("position", F.col("_inside") + F.col("_shift")).drop("_group", "_inside", "_shift")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Cut a work list, in the order of a numeric column, into batches of a fixed size."""
    positioned = with_positions(df, order)
    return positioned.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def find_by_name(df: DataFrame, name: str, order: str, column: str = "name", needed: bool = False) -> DataFrame:
    """First row whose stripped, lower-case name equals the text, else the first containing it.

    With ``needed`` an unknown name is an error that shows the first 20 names.
    """
    wanted = name.strip().casefold()
    have = F.lower(text.safe_text(column))
    matching = df.where(F.contains(have, F.lit(wanted)))
    found = matching.orderBy((have == wanted).desc(), F.col(order)).limit(1)
    if needed and found.isEmpty():
        known = [row["n"] for row in df.orderBy(order).select(text.safe_text(column).alias("n")).limit(20).collect()]
        raise ValueError(f"no entry named {name!r}; there are: {', '.join(known)}")
    return found
