"""Joining the catalogue with lyrics, tags, matches, features and vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import text

MATCH_RENAMES = {
    "file_path": "local_audio_path",
    "match_score": "audio_match_score",
    "match_reason": "audio_match_reason",
    "match_source": "match_source",
    "audio_title": "local_audio_title",
    "audio_artist": "local_audio_artist",
    "audio_album": "local_audio_album",
    "local_duration_seconds": "local_duration_seconds",
    "duration_diff_seconds": "duration_diff_seconds",
}


def with_tags(catalog: DataFrame, tags: DataFrame, key: str = "song_id") -> DataFrame:
    """Catalogue with merged tags; all known tag columns exist afterwards and are never null."""
    known = [name for name in vocab.GENERATED_TAG_COLUMNS if name in tags.columns]
    own = [name for name in catalog.columns if name not in known]
    joined = catalog.select(*own).join(tags.select(key, *known), key, "left")
    return joined.withColumns(
        {
            name: text.safe_raw(name) if name in joined.columns else F.lit("")
            for name in vocab.GENERATED_TAG_COLUMNS
        }
    )


def with_lyrics(catalog: DataFrame, lyrics: DataFrame, key: str = "song_id") -> DataFrame:
    """Catalogue with the stripped lyric file text, blank where there is none."""
    joined = catalog.join(lyrics.select(key, "full_lyric"), key, "left")
    return joined.withColumn("full_lyric", text.safe_text("full_lyric"))


def with_matches(tags: DataFrame, matches: DataFrame, key: str = "song_id") -> DataFrame:
    """Tags with the best file per song under the catalogue's column names, blank where unmatched."""
    renamed = matches.select(key, *[F.col(old).alias(new) for old, new in MATCH_RENAMES.items()])
    joined = tags.join(renamed, key, "left")
    return joined.withColumns({name: text.safe_raw(name) for name in MATCH_RENAMES.values()})


def with_features(tags: DataFrame, *tables: DataFrame, key: str = "song_id") -> DataFrame:
    """Tags with further one-row-per-song tables; columns already present are not repeated."""
    for table in tables:
        added = [name for name in table.columns if name == key or name not in tags.columns]
        tags = tags.join(table.select(*added), key, "left")
    return tags


def selected_or_top(df: DataFrame, song_id, order: Sequence[str] = ("dynamic_score", "comment_total"), key: str = "song_id") -> DataFrame:
    """The selected song if it is there, else the first by the order columns, descending."""
    chosen = F.lit(False) if song_id is None else F.col(key) == song_id
    return df.orderBy(chosen.desc(), *[F.desc(name) for name in order], key).limit(1)


def top_candidates(df: DataFrame, n: int = 20, key: str = "song_id") -> DataFrame:
    """Best rows by similarity and score if searched, else by score and comments."""
    searched = "audio_similarity_score" in df.columns
    order = ["audio_similarity_score", "dynamic_score"] if searched else ["dynamic_score", "comment_total"]
    return df.orderBy(*[F.desc(name) for name in order], key).limit(n)


def global_sort(df: DataFrame, column: str, ascending: bool = False, key: str = "song_id") -> DataFrame:
    """Sort by one column, nulls last in both directions, the key as tie-break."""
    by = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return df.orderBy(by, key)


def page(df: DataFrame, column: str, number: int, size: int = vocab.PAGE_SIZE, ascending: bool = False, key: str = "song_id") -> DataFrame:
    """Page ``number`` (from 0) of the sorted rows."""
    return global_sort(df, column, ascending, key).offset(number * size).limit(size)
