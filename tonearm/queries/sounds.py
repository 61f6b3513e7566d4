"""Audio measures, labels and shares."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tonearm import session
from tonearm.operators import audio, similarity
from tonearm.plans import tags as tag_plan
from tonearm.queries import matches, model, vectors
from tonearm.queries.registry import query, table

RATE, REPEATS = 8000, 100


def wave_files(spark, folder):
    """A mono WAV file per vector: its elements as samples, repeated."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        for pdf in batches:
            contents = []
            for vector in pdf["embedding"]:
                samples = np.rint(np.asarray(vector, dtype=np.float64) * 20000).astype("<i2")
                buffer = io.BytesIO()
                with wave.open(buffer, "wb") as out:
                    out.setnchannels(1)
                    out.setsampwidth(2)
                    out.setframerate(RATE)
                    out.writeframes(np.tile(samples, REPEATS).tobytes())
                contents.append(buffer.getvalue())
            yield pd.DataFrame({"path": pdf["path"], "content": contents})

    named = table(spark, folder, "embeddings").select(F.concat("vec_id", F.lit(".wav")).alias("path"), "embedding")
    return named.mapInPandas(write, "path string, content binary")


@query("audio_measures", f"""
WITH s AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, round_even(CAST(unnest(embedding) AS DOUBLE) * 20000, 0) / 32768 AS x, len(embedding) AS n FROM embeddings),
p AS (SELECT *, lead(x) OVER (PARTITION BY vec_id ORDER BY i) AS next, first(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS start FROM s),
m AS (SELECT vec_id, any_value(n) AS n, sqrt(avg(x * x) + 1e-9) AS rms, max(abs(x)) AS peak, count(*) FILTER (WHERE next IS NOT NULL AND x * next < 0) * {REPEATS} + count(*) FILTER (WHERE next IS NULL AND x * start < 0) * {REPEATS - 1} AS crossings FROM p GROUP BY vec_id)
SELECT vec_id || '.wav' AS path, n * {REPEATS} / {RATE} AS audio_duration_seconds, {RATE} AS audio_sample_rate, round(rms, 5) AS audio_rms, round(crossings / (n * {REPEATS} - 1), 5) AS audio_zcr,
  round(peak / (rms + 1e-9), 2) AS audio_crest, '' AS audio_error FROM m""")
def audio_measures(spark, folder):
    measured = audio.wave_measures(wave_files(spark, folder))
    return measured.select("path", "audio_duration_seconds", "audio_sample_rate", F.round("audio_rms", 5).alias("audio_rms"), F.round("audio_zcr", 5).alias("audio_zcr"),
                           F.round("audio_crest", 2).alias("audio_crest"), "audio_error")


@query("audio_features", """
WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) / 97.31377 AS raw, CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS DOUBLE) * 3 WHEN l_linenumber = 3 THEN 0.0 END AS given, l_linenumber = 7 AS bad,
  CAST(l_discount AS DOUBLE) * 1.5 AS rms, CAST(l_extendedprice AS DOUBLE) / 17.31377 AS centroid, CAST(l_tax AS DOUBLE) * 2 AS zcr, CAST(l_quantity AS DOUBLE) / 4 AS crest, CAST(l_quantity AS DOUBLE) * 8 AS onset FROM lineitem),
octaves AS (SELECT raw, raw * f AS c FROM (SELECT DISTINCT raw FROM m), (VALUES (0.25), (0.5), (1.0), (2.0), (4.0)) v(f)),
ranked AS (SELECT raw, first(c ORDER BY CASE WHEN c BETWEEN 72 AND 145 THEN 0 ELSE 1 END, abs(c - 100), c) AS best FROM octaves WHERE c BETWEEN 55 AND 190 GROUP BY ALL),
folded AS (SELECT m.*, coalesce(best, CASE WHEN m.raw < 55 THEN m.raw * pow(2, ceil(log2(55 / m.raw))) ELSE m.raw / pow(2, ceil(log2(m.raw / 190))) END) AS estimate FROM m LEFT JOIN ranked USING (raw)),
x AS (SELECT *, CASE WHEN given > 0 THEN given ELSE estimate END AS t FROM folded)
SELECT l_orderkey, l_linenumber, CASE WHEN bad THEN '' ELSE concat_ws(' | ', CASE WHEN t >= 132 THEN '快节奏' WHEN t <= 72 THEN '慢节奏' WHEN t IS NOT NULL THEN '中速' END,
  CASE WHEN rms >= 0.13 THEN '高能量' WHEN rms <= 0.04 THEN '低能量' ELSE '中等能量' END, CASE WHEN centroid >= 3600 THEN '明亮' WHEN centroid <= 1300 AND rms < 0.13 THEN '柔和' END, CASE WHEN zcr >= 0.12 THEN '节奏颗粒感' END,
  CASE WHEN crest >= 8 THEN '动态大' END, CASE WHEN onset >= 260 THEN '律动明显' WHEN onset <> 0 AND onset <= 130 AND rms < 0.13 THEN '律动弱' END) END AS audio_feature_tags,
  CASE WHEN NOT bad THEN round(t, 2) END AS audio_tempo_bpm, CASE WHEN bad THEN '' WHEN given > 0 THEN 'source_csv' WHEN estimate IS NOT NULL THEN 'audio_estimate' ELSE '' END AS audio_tempo_source,
  round(centroid, 2) AS audio_centroid_hz, round_even(crest, 3) AS audio_crest, round_even(onset, 4) AS audio_onset_strength FROM x""")
def audio_features(spark, folder):
    """The columns made of the measures; the measures themselves are in audio_measures."""
    line, price, quantity = F.col("l_linenumber"), F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    measures = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(line == 2, quantity * 3).when(line == 3, 0.0).alias("given"), F.when(line == 7, "bad").otherwise("").alias("audio_error"),
        (price / 97.31377).alias("audio_tempo_raw_bpm"), (F.col("l_discount").cast("double") * 1.5).alias("audio_rms"), (price / 17.31377).alias("audio_centroid_hz"),
        (F.col("l_tax").cast("double") * 2).alias("audio_zcr"), (quantity / 4).alias("audio_crest"), (quantity * 8).alias("audio_onset_strength"),
        F.lit(1.0).alias("audio_duration_seconds"), F.lit(0.5).alias("audio_vocal_band_ratio"))
    made = audio.audio_features(measures, F.col("given"))
    return made.select("l_orderkey", "l_linenumber", "audio_feature_tags", "audio_tempo_bpm", "audio_tempo_source", "audio_centroid_hz", "audio_crest", "audio_onset_strength")


@query("feature_labels", """
SELECT l_orderkey, concat_ws(' | ', CASE WHEN t >= 132 THEN '快节奏' WHEN t <= 72 THEN '慢节奏' WHEN t IS NOT NULL THEN '中速' END,
  CASE WHEN r >= 0.13 THEN '高能量' WHEN r <= 0.04 THEN '低能量' ELSE '中等能量' END, CASE WHEN c >= 3600 THEN '明亮' WHEN c <= 1300 AND r < 0.13 THEN '柔和' END,
  CASE WHEN z >= 0.12 THEN '节奏颗粒感' END, CASE WHEN k >= 8 THEN '动态大' END, CASE WHEN o >= 260 THEN '律动明显' WHEN o <> 0 AND o <= 130 AND r < 0.13 THEN '律动弱' END) AS labels
FROM (SELECT l_orderkey, CASE WHEN l_linenumber <> 4 THEN l_quantity * 4 END AS t, l_discount * 1.5 AS r, l_extendedprice / 20 AS c, l_tax * 2 AS z, l_quantity / 5 AS k, l_quantity * 8 AS o FROM lineitem)""")
def feature_labels(spark, folder):
    measures = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") != 4, F.col("l_quantity") * 4).alias("t"), (F.col("l_discount") * 1.5).alias("r"), (F.col("l_extendedprice") / 20).alias("c"),
        (F.col("l_tax") * 2).alias("z"), (F.col("l_quantity") / 5).alias("k"), (F.col("l_quantity") * 8).alias("o"))
    return measures.select("l_orderkey", F.array_join(audio.feature_labels("t", "r", "c", "z", "k", "o"), " | ").alias("labels"))


@query("energy_ratios", """
WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS d, CAST(l_discount AS DOUBLE) * 128 AS b, CAST(l_tax AS DOUBLE) * 128 AS o, CAST(l_extendedprice AS DOUBLE) / 1024 AS v FROM lineitem),
t AS (SELECT *, d + b + o + v + 1e-12 AS t FROM e)
SELECT l_orderkey, l_linenumber, round_even(d / t, 4) AS source_drums_energy_ratio, round_even(b / t, 4) AS source_bass_energy_ratio, round_even(o / t, 4) AS source_other_energy_ratio,
  round_even(v / t, 4) AS source_vocals_energy_ratio, round_even(v / t, 4) AS source_vocal_energy_ratio, round_even((d + b + o) / t, 4) AS source_instrumental_energy_ratio FROM t""")
def energy_ratios(spark, folder):
    energies = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("d"), (F.col("l_discount").cast("double") * 128).alias("b"),
        (F.col("l_tax").cast("double") * 128).alias("o"), (F.col("l_extendedprice").cast("double") / 1024).alias("v"))
    return energies.select("l_orderkey", "l_linenumber", *[value.alias(name) for name, value in audio.energy_ratios("d", "b", "o", "v").items()])


@query("vocal_instrumental", """
WITH x AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_discount * 5 END AS v, CASE WHEN l_returnflag <> 'N' THEN 1 - l_discount * 4 END AS i, CASE WHEN l_linenumber = 1 THEN 'bad' ELSE '' END AS e,
  l_linestatus = 'O' AS lyric, l_tax * 6 AS b, CASE WHEN l_quantity > 40 THEN '钢琴 | x' ELSE 'y' END AS tags FROM lineitem),
g AS (SELECT *, v IS NOT NULL AND e = '' AS sep, greatest(0, least(1, 0.2 + CASE WHEN lyric THEN 0.38 ELSE 0 END + CASE WHEN b >= 0.44 THEN 0.22 WHEN b >= 0.34 THEN 0.12 ELSE 0 END - CASE WHEN contains(tags, '钢琴') THEN 0.35 ELSE 0 END)) AS gv FROM x),
h AS (SELECT *, greatest(1 - gv, CASE WHEN contains(tags, '钢琴') THEN 0.82 ELSE 0 END, CASE WHEN NOT lyric THEN 0.68 ELSE 0 END) AS gi FROM g)
SELECT l_orderkey, round(CASE WHEN sep THEN least(1, v) ELSE gv END, 2) AS vocal, CASE WHEN sep THEN CASE WHEN least(1, v) >= 0.34 THEN '人声强' WHEN i >= 0.78 THEN '器乐强' ELSE '人声/器乐均衡' END
  WHEN gv >= 0.62 THEN '人声强' WHEN gi >= 0.62 THEN '器乐强' ELSE '人声/器乐均衡' END AS tags FROM h""")
def vocal_instrumental(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 5).alias("source_vocal_energy_ratio"),
        F.when(F.col("l_returnflag") != "N", 1 - F.col("l_discount") * 4).alias("source_instrumental_energy_ratio"),
        F.when(F.col("l_linenumber") == 1, "bad").otherwise("").alias("source_separation_error"), (F.col("l_linestatus") == "O").alias("has_lyric"),
        (F.col("l_tax") * 6).alias("audio_vocal_band_ratio"), F.when(F.col("l_quantity") > 40, "钢琴 | x").otherwise("y").alias("all_tags"))
    result = audio.vocal_instrumental(rows.columns)
    return rows.select("l_orderkey", F.round(result["vocal_presence_score"], 2).alias("vocal"), result["vocal_instrumental_tags"].alias("tags"))


@query("chunk_windows", """
WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders),
w AS (SELECT o_orderkey, n, unnest(CASE WHEN n <= 50000 THEN [0] ELSE list_filter(range(0, n, 25000), lambda s: n - s >= 5000) END) AS s FROM x)
SELECT o_orderkey, s AS chunk_start, least(50000, n - s) AS chunk_length FROM w""")
def chunk_windows(spark, folder):
    recordings = table(spark, folder, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("n"), F.lit(10000).alias("rate"))
    return audio.chunk_windows(recordings, "n", "rate", 5.0, 2.5).select("o_orderkey", "chunk_start", "chunk_length")


def audio_table(measured):
    """Features by song: a file is named by its song."""
    return measured.withColumn("song_id", F.regexp_replace("path", r"\.wav\z", "")).drop("path")


@query("build_tags_job")
def build_tags_job(spark, folder):
    """The whole tag job: rules, best file per song, audio features, affect."""
    from tonearm.operators import matching

    found = matching.best_file_per_song(matching.fuzzy_match(matches.files(spark, folder), matches.catalog(spark, folder)))
    measured = audio.audio_features(audio.wave_measures(wave_files(spark, folder)))
    features = audio_table(measured)
    affect = vectors.emotion_from_affect(spark, folder).select(F.col("vec_id").cast("string").alias("song_id"), F.col("tags").alias("mert_emotion_tags"))
    return model.tag_job(spark, folder, matches=found, audio_table=features, affect_table=affect)


def _emotions_of(vectors):
    """Emotion tags of vectors by valence and arousal in their first two elements."""
    first, second = ((F.get("vector", at).cast("double") * scale + 1) / 2 for at, scale in ((0, 1), (1, 2)))
    scored = vectors.select("song_id", first.alias("v"), second.alias("a")).withColumn("s", similarity.emotion_scores("v", "a"))
    return scored.select("song_id", F.array_join(similarity.emotion_tags("s"), " | ").alias("mert_emotion_tags"))


def _job_sql() -> str:
    def joined(*columns: str) -> str:
        items = ", ".join(f"string_split({column}, ' | ')" for column in columns)
        return f"array_to_string(list_filter(flatten([{items}]), lambda x: x IS NOT NULL AND x <> ''), ' | ')"

    def unique(items: str) -> str:
        return f"""array_to_string(list_filter(string_split({items}, ' | '), lambda x, i: x <> '' AND list_position(string_split({items}, ' | '), x) = i), ' | ')"""

    local = f"CASE WHEN m.file_path IS NULL THEN NULL ELSE '{model.LOCAL_TAG}' END"
    return f"""WITH {model.TAGS_SQL}, matches AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY match_score DESC, file_path) AS rn FROM ({matches.FUZZY_SQL})) WHERE rn = 1),
emotions AS (SELECT CAST(vec_id AS VARCHAR) AS song_id, tags FROM ({vectors._emotion_sql()})),
tagged AS (SELECT t.song_id, m.file_path, m.match_score, m.match_reason, e.tags AS feeling, t.emotion_tags AS felt,
  {joined("t.audio_tags", local)} AS audio, {joined("t.all_tags", local)} AS every
  FROM tag_table t LEFT JOIN matches m USING (song_id) LEFT JOIN emotions e ON e.song_id = t.song_id)
SELECT song_id, coalesce(file_path, '') AS local_audio_path, match_score AS audio_match_score, coalesce(match_reason, '') AS audio_match_reason, coalesce(feeling, '') AS mert_emotion_tags,
  audio AS audio_tags, {unique(joined("felt", "feeling"))} AS emotion_tags, {unique(joined("every", "feeling"))} AS all_tags FROM tagged"""


@query("incremental_tag_job", _job_sql())
def incremental_tag_job(spark, folder):
    """The tag job run twice: first with a part of the files and vectors, then with all, of which only the rest is worked on."""
    store = session.scratch(spark)
    files, items = matches.files(spark, folder), vectors.vectors(spark, folder)
    run = partial(tag_plan.run_tag_job, model.songs(spark, folder), store, catalog=matches.catalog(spark, folder), affect=_emotions_of, rules=model.RULES, local_tag=model.LOCAL_TAG)
    run(files.where("duration > 100"), vectors=items.where("song_id like '%3%'"))
    table = run(files, vectors=items)
    return table.select(
        "song_id", "local_audio_path", F.col("audio_match_score").try_cast("double").alias("audio_match_score"), "audio_match_reason",
        F.coalesce("mert_emotion_tags", F.lit("")).alias("mert_emotion_tags"), "audio_tags", "emotion_tags", "all_tags")
