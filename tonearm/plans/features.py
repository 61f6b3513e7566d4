"""From raw tables to the preprocessed catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import text
from tonearm.operators import catalog, features, joins, merge


def build_features(
    sources: DataFrame, tags: DataFrame | None = None, lyrics: DataFrame | None = None, link_prefix: str = "",
    terms: bool = True, languages: Sequence[str] = tuple(vocab.LANGUAGE_TAGS),
) -> DataFrame:
    """One preprocessed row per song.

    ``sources`` is the union of source tables with their order columns; ``tags`` the union of tag
    tables with theirs; ``lyrics`` has (song_id, full_lyric). Shuffles: one per input by song_id.
    """
    songs = merge.dedup_most_complete(catalog.normalize_key(sources)).drop(*merge.ORDER_COLUMNS)
    texts = [name for name in (*vocab.TEXT_COLUMNS, "album_pic_url", "duration_text", "publish_date", "wiki_summary_excerpt")
             if name not in vocab.GENERATED_TAG_COLUMNS]
    songs = catalog.conform(songs, texts)
    if lyrics is not None:
        songs = joins.with_lyrics(songs, lyrics)
    elif "full_lyric" not in songs.columns:
        songs = songs.withColumn("full_lyric", F.lit(""))
    merged = merge.merge_tag_tables(tags) if tags is not None else songs.select("song_id")
    return preprocess(joins.with_tags(songs, merged), link_prefix, terms, languages)


def preprocess(
    songs: DataFrame, link_prefix: str = "", terms: bool = True, languages: Sequence[str] = tuple(vocab.LANGUAGE_TAGS)
) -> DataFrame:
    """Derived columns, list features and search text of joined catalogue rows, inside the row."""
    songs = songs.withColumn(
        "language_tags", text.language_tags("wiki_summary_excerpt", "generated_language_tags", languages)
    )
    songs = songs.withColumn("search_text", catalog.search_text(songs.columns))
    songs = catalog.split_feature_columns(catalog.derive_catalog(songs, link_prefix))
    if terms:
        songs = features.lyric_terms(features.title_terms(songs))
    return songs


def with_recommend_score(songs: DataFrame) -> DataFrame:
    return songs.withColumn("recommend_score", features.recommend_score(songs))
