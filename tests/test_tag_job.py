"""The tag job on stored results: only what is new or changed is worked on."""

from pyspark.sql import functions as F

from tonearm.operators import audio
from tonearm.plans import tags as plan
from tonearm.queries import sounds

FOLDER = "/root/testdata/sf0.001"


def test_only_new_and_changed_inputs_are_built(spark, tmp_path):
    path, seen = str(tmp_path / "store"), []

    def build(new):
        rows = new.collect()
        seen.append(sorted(r["k"] for r in rows))
        return spark.createDataFrame([(r["k"], r["v"] * 2) for r in rows if r["v"] != 13], "k string, doubled long")

    def run(rows):
        frame = spark.createDataFrame(rows, "k string, v long")
        found = plan.stored_results(frame, path, "k", F.col("v").cast("string"), build, n=4)
        return {r["k"]: r["doubled"] for r in found.collect()}

    assert run([("a", 1), ("b", 13), (None, 5)]) == {"a": 2}
    assert run([("a", 1), ("b", 13), ("c", 3)]) == {"a": 2, "c": 6}
    assert run([("a", 7), ("c", 3)]) == {"a": 14, "c": 6}
    # What has no result is not looked at again, and what is gone comes back without work.
    assert run([("a", 7), ("b", 13)]) == {"a": 14}
    assert run([]) == {}
    assert seen == [["a", "b"], ["c"], ["a"], [], []]


def test_second_run_measures_new_recordings_only(spark, tmp_path):
    recordings = sounds.wave_files(spark, FOLDER).where("path < '12'")
    songs = recordings.select(F.regexp_replace("path", r"\.wav\z", "").alias("song_id"), F.lit("n").alias("name"), F.lit("").alias("full_lyric"), F.lit(3).alias("place"))
    store = str(tmp_path / "job")
    first = plan.run_tag_job(songs, store, recordings=recordings.where("path < '11'"))
    assert first.where("audio_feature_tags <> ''").count() == recordings.where("path < '11'").count()
    before = spark.read.parquet(*[str(p) for p in (tmp_path / "job" / "measures").glob("buckets-*")]).count()
    second = plan.run_tag_job(songs, store, recordings=recordings, order="place")
    whole = plan.full_tag_table(songs, audio_table=sounds.audio_table(audio.audio_features(audio.wave_measures(recordings))))
    columns = sorted(set(second.columns) & set(whole.columns))
    assert sorted(map(str, second.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    assert before == recordings.where("path < '11'").count()
    from tonearm.sources import sinks

    assert sinks.read_merged(spark, f"{store}/tags").count() == songs.count()


def test_digest_follows_rows_not_their_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert plan.digest_of(df) == plan.digest_of(df.orderBy(F.desc("x")))
    assert plan.digest_of(df) != plan.digest_of(df.withColumn("y", F.lit("a")))
