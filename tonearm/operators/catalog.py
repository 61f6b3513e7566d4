"""Catalogue rows: keys, schema, derived columns, search text, detail records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import arrays, numbers, text


def normalize_key(df: DataFrame, key: str = "song_id") -> DataFrame:
    """Strip header names, make the key a stripped non-blank text, rename the language column."""
    df = df.toDF(*[name.strip() for name in df.columns])
    if "language_tags" in df.columns:
        df = df.withColumnRenamed("language_tags", "generated_language_tags")
    return df.withColumn(key, text.safe_text(key)).where(F.col(key) != "")


def conform(
    df: DataFrame,
    text_columns: Sequence[str] = (),
    numeric_columns: Sequence[str] = tuple(vocab.NUMERIC_COLUMNS),
    boolean_columns: Sequence[str] = tuple(vocab.BOOLEAN_COLUMNS),
) -> DataFrame:
    """Give the declared columns their type and default; missing ones are added."""
    present = set(df.columns)

    def cleaned(name: str, convert, default: Column) -> Column:
        return convert(name) if name in present else default

    return df.withColumns(
        {
            **{name: cleaned(name, text.safe_raw, F.lit("")) for name in text_columns},
            **{name: cleaned(name, numbers.to_number, F.lit(0.0)) for name in numeric_columns},
            **{name: cleaned(name, numbers.parse_bool, F.lit(False)) for name in boolean_columns},
        }
    )


def preferred_quality(columns: Sequence[str]) -> Column:
    """Best level that has a link or a positive bit rate."""
    label = F.lit(vocab.UNKNOWN)
    for level, name in reversed(vocab.QUALITY_LABELS):
        link, rate = f"{level}_url", f"{level}_br"
        has_link = ~text.is_blank(link) if link in columns else F.lit(False)
        has_rate = numbers.to_number(rate) > 0 if rate in columns else F.lit(False)
        label = F.when(has_link | has_rate, name).otherwise(label)
    return label


def derive_catalog(df: DataFrame, link_prefix: str = "") -> DataFrame:
    """Year, minutes, artist list, quality, record link and lyric length."""
    return df.withColumns(
        {
            "publish_year": numbers.publish_year("publish_date"),
            "duration_minutes": F.col("duration_seconds") / 60,
            "artist_list": text.split_pipe("artist_names"),
            "quality": preferred_quality(df.columns),
            "record_link": text.record_link("song_id", link_prefix),
            "lyrics_chars": F.length("full_lyric"),
        }
    )


SPLIT_COLUMNS = {
    "generated_tag_list": "all_tags",
    "style_tag_list": "style_tags",
    "emotion_tag_list": "emotion_tags",
    "theme_tag_list": "theme_tags",
    "scene_tag_list": "scene_tags",
    "audio_tag_list": "audio_tags",
    "lyric_semantic_tags": "lyric_semantic_tags",
    "comment_semantic_tags": "comment_semantic_tags",
}


def split_feature_columns(df: DataFrame) -> DataFrame:
    """Turn the eight joined tag columns into arrays."""
    return df.withColumns({name: text.split_pipe(source) for name, source in SPLIT_COLUMNS.items()})


def search_text(columns: Sequence[str], lyric: str = "full_lyric") -> Column:
    """One lower-case text over all searched columns and the whole lyric."""
    parts = [text.safe_text(name) if name in columns else F.lit("") for name in vocab.TEXT_COLUMNS]
    parts.append(text.safe_text(lyric))
    return text.normalize_for_search(F.concat_ws(" ", *parts))


def comment_text(df_columns: Sequence[str]) -> Column:
    parts = [
        text.safe_text(name) if name in df_columns else F.lit("")
        for name in ("first_hot_comment", "first_comment")
    ]
    return text.strip(F.concat_ws(" ", *parts))


def lyric_analysis_text(df_columns: Sequence[str], max_chars: int = 0) -> Column:
    """Cleaned lyric for labelling: the lyric file, else four other text columns.

    ``max_chars`` bounds the text for an encoder with a bounded input; 0 keeps the whole text.
    """
    fallback = [
        text.safe_text(name) if name in df_columns else F.lit("")
        for name in ("lyric_text", "translation_text", "lyric_excerpt", "translation_excerpt")
    ]
    source = F.coalesce(F.nullif(text.safe_raw("full_lyric"), F.lit("")), F.concat_ws(" ", *fallback))
    cleaned = text.clean_lyric(source)
    return text.strip(F.substring(cleaned, 1, max_chars)) if max_chars > 0 else cleaned


def song_detail(df: DataFrame, song_id: str) -> DataFrame:
    """One song as (field, content) rows, numbers formatted for display."""
    song = df.where(F.col("song_id") == song_id)

    def shown(name: str) -> Column:
        return text.safe_text(name) if name in df.columns else F.lit("")

    def listed(name: str, limit: int | None = None) -> Column:
        if name not in df.columns:
            return F.lit("")
        values = F.col(name) if limit is None else F.slice(F.col(name), 1, limit)
        return F.array_join(values, " | ")

    def labelled(prefix: str, *names: str) -> Column:
        value = F.coalesce(*[F.nullif(shown(name), F.lit("")) for name in names], F.lit(""))
        return F.when(value != "", F.concat(F.lit(f"{prefix} "), value)).otherwise("")

    def dotted(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda item: item != ""), " · ")

    playback = F.coalesce(
        *[F.nullif(shown(f"{level}_url"), F.lit("")) for level in reversed(vocab.URL_LEVELS)], F.lit("")
    )
    minutes = F.concat(text.decimals("duration_minutes", "0.0"), F.lit(" min"))
    score = "dynamic_score" if "dynamic_score" in df.columns else "recommend_score"
    similarity = (
        F.coalesce(text.decimals("audio_similarity_score", "0.0"), F.lit(""))
        if "audio_similarity_score" in df.columns
        else F.lit("")
    )
    fields = {
        "name": shown("name"),
        "artists_album": F.concat_ws(" · ", shown("artist_names"), shown("album_name")),
        "score": F.col(score).cast("long").cast("string"),
        "popularity": F.col("popularity").cast("long").cast("string"),
        "comments": F.col("comment_total").cast("long").cast("string"),
        "duration": F.coalesce(F.nullif(shown("duration_text"), F.lit("")), minutes),
        "publish_date": shown("publish_date"),
        "audio_similarity": similarity,
        "copyright_playable": F.concat_ws(" / ", shown("copyright"), F.col("playable").cast("string")),
        "quality": shown("quality"),
        "tags": shown("all_tags"),
        "score_breakdown": shown("score_breakdown"),
        "lyric_terms": listed("lyric_terms", 20),
        "lyric_semantic": listed("lyric_semantic_tags"),
        "comment_semantic": listed("comment_semantic_tags"),
        "local_audio": shown("local_audio_path"),
        "local_metadata": dotted(
            shown("local_audio_title"), shown("local_audio_artist"), shown("local_audio_album")
        ),
        "audio_features": dotted(
            tempo_text(shown("audio_tempo_bpm"), shown("audio_tempo_source"), shown("audio_tempo_raw_bpm")),
            shown("audio_feature_tags"),
        ),
        "vocal_instrumental": dotted(
            shown("vocal_instrumental_tags"),
            labelled("vocal", "vocal_presence_score"),
            labelled("instrumental", "instrumental_presence_score"),
        ),
        "separation": dotted(shown("source_separation_model"), shown("source_separation_error")),
        "separation_shares": dotted(
            labelled("vocals", "source_vocals_energy_ratio", "source_vocal_energy_ratio"),
            labelled("drums", "source_drums_energy_ratio"),
            labelled("bass", "source_bass_energy_ratio"),
            labelled("other", "source_other_energy_ratio"),
            labelled("instrumental", "source_instrumental_energy_ratio"),
        ),
        "embedding": dotted(labelled("cluster", "mert_cluster"), shown("mert_emotion_tags")),
        "lyric_lines": F.col("lyric_line_count").cast("long").cast("string"),
        "hot_comment": shown("first_hot_comment"),
        "similar_songs": shown("similar_song_names"),
        "playback_url": playback,
        "lyric": F.coalesce(F.nullif(shown("full_lyric"), F.lit("")), shown("lyric_excerpt")),
    }
    entries = F.array(
        *[F.struct(F.lit(name).alias("field"), value.alias("content")) for name, value in fields.items()]
    )
    return song.select("song_id", F.inline(entries))


def tempo_text(tempo: Column, source: Column, raw: Column) -> Column:
    """Tempo for display, marked as given by the source table or as an estimate."""

    def plain(value: Column) -> Column:
        number = value.try_cast("double")
        fixed = F.regexp_replace(text.decimals(number, "0.00"), r"\.?0+\z", "")
        return F.when(number == F.floor(number), number.cast("long").cast("string")).when(
            number.isNotNull(), fixed
        ).otherwise(value)

    shown, original = plain(tempo), plain(raw)
    note = (
        F.when(source == "source_csv", " (source)")
        .when((source == "audio_estimate") & (original != "") & (original != shown),
              F.concat(F.lit(" (estimate, raw "), original, F.lit(")")))
        .when(source == "audio_estimate", " (estimate)")
        .otherwise("")
    )
    return F.when(tempo == "", "").otherwise(F.concat(shown, F.lit(" BPM"), note))
