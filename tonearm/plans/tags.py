"""The tag job: rules, matches, audio features and affect into one tag table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import session
from tonearm.functions import text
from tonearm.operators import audio, joins, matching, tags
from tonearm.sources import buckets, sinks


def full_tag_table(
    songs: DataFrame,
    matches: DataFrame | None = None,
    audio_table: DataFrame | None = None,
    affect_table: DataFrame | None = None,
    rules: tags.TagRules = tags.TagRules(),
    local_tag: str | None = None,
) -> DataFrame:
    """One tag row per song.

    ``matches``: best file per song. ``audio_table``: audio feature and separation columns.
    ``affect_table``: vector index, cluster and emotion columns. Each table joins by song_id.
    """
    table = tags.song_tags(songs, rules)
    if matches is not None:
        table = joins.with_matches(table, matches)
    else:
        table = table.withColumns({name: F.lit("") for name in joins.MATCH_RENAMES.values()})
    table = tags.add_local_tag(table, local_tag) if local_tag else tags.add_local_tag(table)
    if audio_table is not None:
        table = joins.with_features(table, audio_table)
        guarded = F.length(text.safe_raw("audio_feature_tags")) > 0
        presence = audio.vocal_instrumental(table.columns)
        table = table.withColumns({name: F.when(guarded, value) for name, value in presence.items()})
        table = tags.merge_feature_tags(table, "audio_tags", "audio_feature_tags", "vocal_instrumental_tags")
    if affect_table is not None:
        table = joins.with_features(table, affect_table)
        table = tags.merge_feature_tags(table, "emotion_tags", "mert_emotion_tags")
    return table


def only_new(stored: DataFrame | None, songs: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "song_id") -> DataFrame:
    """Results of ``build`` (matches, measures, vectors) for all songs; those that are stored are not made again.

    Stored results of songs that are gone are left out.
    """
    if stored is None:
        return build(songs)
    ids = songs.select(key).distinct()
    fresh = build(songs.join(stored.select(key).distinct(), key, "left_anti"))
    return stored.join(ids, key, "left_semi").unionByName(fresh)


SIGNATURE, FOUND = "input_signature", "has_result"


def stored_results(
    inputs: DataFrame, path: str, key: str, signature: Column, build: Callable[[DataFrame], DataFrame], n: int = buckets.BUCKETS,
) -> DataFrame:
    """Results of ``build`` (at most one row for each ``key``) for all inputs, kept in a bucketed table at ``path``.

    Only inputs that are new, or whose ``signature`` isn't the stored one, are built; what they give replaces what was stored
    in their buckets. Inputs without a result are remembered as such. Stored results of other inputs stay in the
    table and out of the answer. A null key has no stored result and is left out.
    """
    spark = inputs.sparkSession
    signed = inputs.where(F.col(key).isNotNull()).withColumn(SIGNATURE, signature)
    wanted = signed.select(key, SIGNATURE).distinct()
    known = buckets.read(spark, path)
    fresh = signed if known is None else signed.join(known.select(key, SIGNATURE), [key, SIGNATURE], "left_anti")
    made = build(fresh.drop(SIGNATURE)).withColumn(FOUND, F.lit(True))
    looked_at = fresh.select(key, SIGNATURE).distinct()
    rows = session.materialize(looked_at.join(made, key, "left").withColumn(FOUND, F.coalesce(FOUND, F.lit(False))))

    def replaced(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        if stored is None:
            return new
        return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)

    buckets.merge(rows, path, [key], replaced, buckets=n)
    every = buckets.read(spark, path)
    every = rows if every is None else every
    return every.where(FOUND).join(wanted, [key, SIGNATURE], "left_semi").drop(SIGNATURE, FOUND)


def digest_of(df: DataFrame) -> str:
    """A signature of all rows of a table, in any order: one number for each row is summed up."""
    row = F.md5(F.to_json(F.struct(*df.columns)))
    parts = [F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(20,0)")) for at in (1, 9, 17, 25)]
    return "|".join(map(str, df.agg(F.count(F.lit(1)), *parts).first()))


def run_tag_job(
    songs: DataFrame, store: str, files: DataFrame | None = None, catalog: DataFrame | None = None, recordings: DataFrame | None = None,
    vectors: DataFrame | None = None, affect: Callable[[DataFrame], DataFrame] | None = None,
    rules: tags.TagRules = tags.TagRules(), local_tag: str | None = None, threshold: float = matching.DEFAULT_THRESHOLD,
    order: str | None = None,
) -> DataFrame:
    """The tag table of all songs; matches, measures and affect that an earlier run left below ``store`` are used again.

    ``files`` are matched with ``catalog`` (see ``matching.fuzzy_match``): a file anew if its row changed, all if the catalogue
    did. ``recordings`` (path, content) are measured when their bytes are new; a path without its extension is the song. ``vectors``
    (song_id, vector) go through ``affect``, which gives (song_id, mert_emotion_tags, ...) row by row. With ``order``, a numeric column
    of ``songs``, the table is merged into the one at ``store``/tags by song.
    """
    matches = measures = feelings = None
    if files is not None:
        state = digest_of(catalog)
        mark = F.md5(F.concat_ws("|", F.lit(state), F.lit(str(threshold)), F.to_json(F.struct(*files.columns))))
        found = stored_results(files, f"{store}/matches", "file_path", mark, lambda new: matching.fuzzy_match(new, catalog, threshold))
        matches = matching.best_file_per_song(found)
    if recordings is not None:
        measured = stored_results(
            recordings, f"{store}/measures", "path", F.md5("content"), lambda new: audio.audio_features(audio.wave_measures(new)))
        measures = measured.withColumn("song_id", F.regexp_replace("path", r"\.[^./]*\z", "")).drop("path")
    if vectors is not None:
        mark = F.md5(F.to_json(F.struct("vector")))
        feelings = stored_results(vectors, f"{store}/affect", "song_id", mark, affect)
    table = full_tag_table(songs, matches, measures, feelings, rules, local_tag)
    if order is not None:
        sinks.merge_parquet(f"{store}/tags", table.join(songs.select("song_id", F.col(order).alias("_at")), "song_id"), "_at")
    return table
