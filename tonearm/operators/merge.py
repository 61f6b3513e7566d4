"""Merging keyed tables: most complete row, latest non-blank value, ordered union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import text
from tonearm.operators.catalog import normalize_key

ORDER_COLUMNS = ("file_order", "row_order")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames by column name; each frame's place becomes ``file_order``."""
    result = None
    for order, frame in enumerate(frames):
        tagged = frame if "file_order" in frame.columns else frame.withColumn("file_order", F.lit(order))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def dedup_most_complete(df: DataFrame, key: str = "song_id", order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """One row per key: most non-blank columns, the later row on a tie.

    ``max_by`` keeps one running best per key on the map side, so a key with many copies is reduced
    before the shuffle.
    """
    values = [name for name in df.columns if name not in order]
    filled = sum((F.when(text.is_blank(name), 0).otherwise(1) for name in values), F.lit(0))
    rank = F.struct(filled, *[F.col(name) for name in order])
    best = (
        df.where(~text.is_blank(key))
        .withColumn(key, text.safe_text(key))
        .groupBy(key)
        .agg(F.max_by(F.struct(*[name for name in df.columns if name != key]), rank).alias("best"))
    )
    return best.select(key, "best.*").select(*df.columns)


def latest_nonblank(
    df: DataFrame,
    key: str = "song_id",
    order: Sequence[str] = ORDER_COLUMNS,
    columns: Sequence[str] | None = None,
    trim_values: bool = True,
    keep_blank_columns: bool = True,
) -> DataFrame:
    """Per key and column the last non-blank value; ``last_order`` tells where the key appeared last.

    All columns are reduced in one aggregation with map-side combine. Dropping columns that are
    blank everywhere changes the schema, so that variant first asks the data, in one pass over it.
    """
    names = [name for name in (columns or df.columns) if name in df.columns and name not in (key, *order)]
    position = F.struct(*[F.col(name) for name in order])

    def value(name: str) -> Column:
        kept = text.strip(F.col(name).cast("string")) if trim_values else F.col(name).cast("string")
        return F.coalesce(
            F.max_by(kept, F.when(~text.is_blank(name), position)), F.lit("")
        ).alias(name)

    keyed = df.where(~text.is_blank(key)).withColumn(key, text.safe_text(key))
    if not keep_blank_columns and names:
        names = non_blank_columns(keyed, names)
    return keyed.groupBy(key).agg(*[value(name) for name in names], F.max(position).alias("last_order"))


def non_blank_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns with at least one non-blank value (one row comes back to the driver)."""
    seen = df.agg(*[F.max(~text.is_blank(name)).alias(name) for name in names]).first()
    return [name for name in names if seen[name]]


def merge_tag_tables(df: DataFrame, order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """The catalogue's view of all tag tables: known columns only, latest non-blank value."""
    return latest_nonblank(
        normalize_key(df), order=order, columns=vocab.GENERATED_TAG_COLUMNS, keep_blank_columns=False
    )


def keep_last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last row per key by the order columns."""
    rest = [name for name in df.columns if name != key]
    last = F.max_by(F.struct(*rest), F.struct(*[F.col(name) for name in order]))
    return df.groupBy(key).agg(last.alias("last")).select(key, "last.*").select(*df.columns)
