"""Keyword, summary, tempo and date tags of a song, assembled inside the row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import arrays, numbers, text

Rules = Sequence[tuple[str, Sequence[str]]]

# Category order (a later category's score wins for a tag in two categories), scores
# and source names of the rules.
CATEGORIES = ("language", "style", "emotion", "theme", "scene", "audio")
SUMMARY, METADATA, TEXT, LYRICS = "csv.wiki_summary_excerpt", "csv.metadata", "csv.text", "lyrics"
EXPLICIT, TEMPO, DATE = "csv.wiki_explicit_tag", "csv.wiki_bpm", "csv.publish_date"
METADATA_FIELDS = """
name aliases translations artist_names album_name lyric_excerpt first_hot_comment first_comment
""".split()
STYLE_FIELDS = ["similar_song_names", "similar_artist_names", "wiki_summary_excerpt"]


@dataclass(frozen=True)
class TagRules:
    """Rule tables as data, so the same operators serve any language."""

    languages: Sequence[str] = tuple(vocab.LANGUAGE_TAGS)
    style: Rules = tuple(vocab.STYLE_RULES)
    emotion: Rules = tuple(vocab.EMOTION_RULES)
    theme: Rules = tuple(vocab.THEME_RULES)
    scene: Rules = tuple(vocab.SCENE_RULES)
    explicit_emotions: Mapping[str, str] = field(default_factory=lambda: dict(vocab.EXPLICIT_EMOTIONS))
    explicit_themes: Mapping[str, str] = field(default_factory=lambda: dict(vocab.EXPLICIT_THEMES))
    instrumental_placeholder: str = vocab.INSTRUMENTAL_PLACEHOLDER
    instrumental_tag: str = vocab.INSTRUMENTAL_TAG
    relax_tag: str = vocab.RELAX_TAG


def _hits(category: str, tags: Column, score: float, source: str) -> Column:
    """Array of (category, tag, score, source) for an array of tags."""
    return F.transform(
        tags,
        lambda tag: F.struct(
            F.lit(CATEGORIES.index(category)).alias("category"),
            tag.alias("tag"),
            F.lit(float(score)).alias("score"),
            F.lit(source).alias("source"),
        ),
    )


def _when(condition: Column, *tags: str) -> Column:
    return F.when(condition, text.constant_array(tags)).otherwise(text.no_items())


def _mapped(values: Column, table: Mapping[str, str]) -> Column:
    if not table:
        return text.no_items()
    pairs = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
    return F.filter(F.transform(values, lambda item: F.try_element_at(pairs, item)), lambda tag: tag.isNotNull())


def tag_texts(df: DataFrame, lyric: str = "full_lyric") -> DataFrame:
    """Add the texts the rules look at: ``_summary``, ``_metadata``, ``_lyric`` and lower-case forms."""

    def joined(names: Sequence[str]) -> Column:
        return F.concat_ws(" ", *[text.safe_text(n) if n in df.columns else F.lit("") for n in names])

    def own(name: str) -> Column:
        return text.safe_text(name) if name in df.columns else F.lit("")

    blob = F.coalesce(F.nullif(own(lyric), F.lit("")), own("lyric_excerpt"))
    df = df.withColumns(
        {"_summary": own("wiki_summary_excerpt"), "_metadata": joined(METADATA_FIELDS), "_lyric": blob}
    )
    return df.withColumns(
        {
            "_summary_lower": F.lower("_summary"),
            "_metadata_lower": F.lower("_metadata"),
            "_style_lower": F.lower(F.concat_ws(" ", "_metadata", joined(STYLE_FIELDS))),
            "_lyric_lower": F.lower("_lyric"),
        }
    )


def tag_hits(rules: TagRules, columns: Sequence[str]) -> Column:
    """All rule hits of a row in the order the rules apply. Needs the columns of ``tag_texts``."""
    # Scores.
    names = text.constant_array(rules.languages)
    in_summary = F.filter(names, lambda tag: F.contains("_summary", tag))
    in_metadata = F.filter(names, lambda tag: F.contains("_metadata", tag) & ~F.contains("_summary", tag))
    language_hits = F.concat(
        _hits("language", in_summary, 0.95, SUMMARY), _hits("language", in_metadata, 0.65, METADATA)
    )
    explicit = text.split_pipe("_summary")
    has_lyric = text.safe_text("has_lyric") if "has_lyric" in columns else F.lit("")
    instrumental = F.contains("_lyric", F.lit(rules.instrumental_placeholder)) | (
        F.contains("_summary", F.lit(rules.instrumental_tag)) & (F.lower(has_lyric) != "true")
    )
    bpm = bpm_column(columns)
    tempo = numbers.tempo_label(bpm, fast=125, slow=80)
    decade = numbers.decade_tag("publish_date") if "publish_date" in columns else F.lit(None).cast("string")

    def rule_hits(category: str, source_text: str, table: Rules, score: float, source: str) -> Column:
        return _hits(category, text.matching_tags(source_text, table), score, source)

    return F.concat(
        language_hits,
        rule_hits("style", "_style_lower", rules.style, 0.78, TEXT),
        rule_hits("style", "_summary_lower", rules.style, 0.92, SUMMARY),
        rule_hits("emotion", "_metadata_lower", rules.emotion, 0.62, METADATA),
        _hits("emotion", _mapped(explicit, rules.explicit_emotions), 0.86, EXPLICIT),
        _hits("theme", _mapped(explicit, rules.explicit_themes), 0.82, EXPLICIT),
        rule_hits("theme", "_metadata_lower", rules.theme, 0.56, METADATA),
        rule_hits("scene", "_metadata_lower", rules.scene, 0.62, METADATA),
        rule_hits("emotion", "_lyric_lower", rules.emotion, 0.76, LYRICS),
        rule_hits("theme", "_lyric_lower", rules.theme, 0.78, LYRICS),
        rule_hits("scene", "_lyric_lower", rules.scene, 0.62, LYRICS),
        _hits("language", _when(instrumental, rules.instrumental_tag), 0.98, LYRICS),
        _hits("style", _when(instrumental, rules.instrumental_tag), 0.96, LYRICS),
        _hits("scene", _when(instrumental, rules.relax_tag), 0.55, LYRICS),
        F.transform(
            F.filter(F.array(tempo), lambda tag: tag.isNotNull() & (bpm > 0)),
            lambda tag: F.struct(
                F.lit(CATEGORIES.index("audio")).alias("category"),
                tag.alias("tag"),
                F.when(tag == vocab.MEDIUM, 0.62).otherwise(0.82).alias("score"),
                F.lit(TEMPO).alias("source"),
            ),
        ),
        _hits("scene", F.filter(F.array(decade), lambda tag: tag.isNotNull()), 0.52, DATE),
    )


def bpm_column(columns: Sequence[str]) -> Column:
    given = [name for name in ("bpm", "wiki_bpm", "audio_tempo_bpm") if name in columns]
    summary = "wiki_summary_excerpt" if "wiki_summary_excerpt" in columns else F.lit("")
    return numbers.row_bpm(given, summary)


def ranked_tags(scored: Column) -> Column:
    """Tags of (tag, score) structs by score descending, then name."""
    ordered = F.sort_array(
        F.transform(scored, lambda item: F.struct((-item["score"]).alias("minus"), item["tag"].alias("tag")))
    )
    return F.transform(ordered, lambda item: item["tag"])


def assemble_tags(df: DataFrame, hits: Column) -> DataFrame:
    """Turn the hits of a row into joined tag columns, confidence and sources, without a shuffle.

    The hits are evaluated once per row and everything else is derived from that one value. The columns come out of
    a generator of one row, so that a later filter on a tag column is not moved in front of it, where it would evaluate
    every rule with its texts again.
    """
    bundle = df.withColumn("_tags", numbers.bind(hits, _tag_bundle))
    names = [*(f"{name}_tags" for name in CATEGORIES), "all_tags", "tag_confidence", "tag_sources"]
    return bundle.select(*[name for name in df.columns if name not in names], F.inline(F.array("_tags")))


def _tag_bundle(hits: Column) -> Column:
    """Struct of the assembled columns of one row's hits."""

    def of(tag: Column) -> Column:
        return F.filter(hits, lambda hit: hit["tag"] == tag)

    def scored(tag: Column) -> Column:
        # The last category that holds the tag decides; inside it the highest score.
        best = F.array_max(
            F.transform(of(tag), lambda hit: F.struct(hit["category"].alias("category"), hit["score"].alias("score")))
        )
        return F.struct(tag.alias("tag"), best["score"].alias("score"))

    def sources(tag: Column) -> Column:
        quoted = F.transform(
            F.array_distinct(F.transform(of(tag), lambda hit: hit["source"])),
            lambda source: F.concat(F.lit('"'), source, F.lit('"')),
        )
        return F.concat(text.json_string(tag), F.lit(": ["), F.array_join(quoted, ", "), F.lit("]"))

    # Best score per (category, tag): hits sorted by category, score and tag keep their first copy.
    ordered = F.sort_array(
        F.transform(
            hits,
            lambda hit: F.struct(
                hit["category"].alias("category"), (-hit["score"]).alias("minus"), hit["tag"].alias("tag")
            ),
        )
    )

    def joined(index: int, ranked: Column) -> Column:
        mine = F.filter(ranked, lambda hit: hit["category"] == index)
        return F.array_join(F.array_distinct(F.transform(mine, lambda hit: hit["tag"])), " | ")

    def columns(ranked: Column) -> Column:
        names = F.array_distinct(F.transform(hits, lambda hit: hit["tag"]))
        return numbers.bind(
            F.transform(names, scored),
            lambda tags: F.struct(
                *[joined(index, ranked).alias(f"{name}_tags") for index, name in enumerate(CATEGORIES)],
                F.array_join(ranked_tags(tags), " | ").alias("all_tags"),
                F.coalesce(F.bround(F.array_max(F.transform(tags, lambda item: item["score"])), 3), F.lit(0.0))
                .alias("tag_confidence"),
                F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(names), sources), ", "), F.lit("}"))
                .alias("tag_sources"),
            ),
        )

    return numbers.bind(ordered, columns)


TAG_TABLE = [
    "song_id", "name", "artist_names", "has_lyric", *[f"{name}_tags" for name in CATEGORIES], "all_tags",
    "tag_confidence", "tag_sources", "bpm",
]


def song_tags(songs: DataFrame, rules: TagRules = TagRules()) -> DataFrame:
    """Rule tags of every song: one projection over the catalogue with lyrics, no shuffle."""
    texts = tag_texts(songs)
    with_bpm = texts.withColumn("_bpm", bpm_column(songs.columns))
    tagged = assemble_tags(with_bpm, tag_hits(rules, songs.columns)).withColumn("bpm", F.col("_bpm"))
    missing = {name: F.lit("") for name in ("name", "artist_names", "has_lyric") if name not in songs.columns}
    return tagged.withColumns(missing).select(*TAG_TABLE)


def add_local_tag(df: DataFrame, tag: str = vocab.LOCAL_AUDIO_TAG) -> DataFrame:
    """Append the local-audio tag where a file is known."""
    has_file = F.length(text.safe_raw("local_audio_path")) > 0

    def appended(name: str) -> Column:
        joined = text.join_parts(F.array(F.col(name), F.lit(tag)))
        return F.when(has_file, joined).otherwise(F.col(name))

    return df.withColumns({name: appended(name) for name in ("audio_tags", "all_tags")})


def merge_feature_tags(df: DataFrame, category: str, *sources: str, guard: str | None = None) -> DataFrame:
    """Union further joined tag columns into a category and ``all_tags`` where ``guard`` is filled."""
    filled = F.length(text.safe_raw(guard or sources[0])) > 0

    def merged(name: str) -> Column:
        union = F.array_join(arrays.union_tags(name, *sources), " | ")
        return F.when(filled, union).otherwise(F.col(name))

    return df.withColumns({name: merged(name) for name in (category, "all_tags")})
