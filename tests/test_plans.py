"""Scale guards: no cross product, no nested-loop join, filters and columns reach the scan."""

import pytest

from tonearm.queries import catalogue

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dynamic_score", "recommend", "history_preference", "fuzzy_match", "frequency_counter", "chart_table", "batch", "last_n"])
def test_no_pair_joins(spark, name):
    plan = plan_of(catalogue.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_wise_tags_need_no_shuffle(spark):
    from tonearm.operators import tags
    from tonearm.queries import model

    songs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr(
        "cast(doc_id as string) song_id", "source name", "text full_lyric", "lang wiki_summary_excerpt")
    assert "Exchange" not in plan_of(tags.song_tags(songs, model.RULES))


def test_texts_in_many_splits_are_not_shuffled_for_row_wise_work(spark, tmp_path):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    documents.repartition(64).write.parquet(str(tmp_path / "documents.parquet"))
    for folder, dealt in ((str(tmp_path), False), (FOLDER, True)):
        df = catalogue.QUERIES["clean_lyric_text"](spark, folder)
        assert ("Exchange" in plan_of(df)) == dealt
    many = catalogue.QUERIES["clean_lyric_text"](spark, str(tmp_path))
    assert sorted(map(str, many.collect())) == sorted(map(str, df.collect()))


def test_stored_recommendation_makes_no_terms(spark, tmp_path):
    from tonearm.plans import feature_store, recommend
    from tonearm.queries import model, scores

    feature_store.refresh(model.songs(spark, FOLDER), str(tmp_path), model.derived, "v1", n=4)
    plan = plan_of(recommend.recommend_stored(spark, str(tmp_path), scores.REQUEST))
    assert "regexp" not in plan and "documents.parquet" not in plan and "CartesianProduct" not in plan


def test_last_n_is_limited_before_the_shuffle(spark):
    assert plan_of(catalogue.QUERIES["last_n"](spark, FOLDER)).count("WindowGroupLimit") >= 2


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(catalogue.QUERIES["match_score"](spark, FOLDER))
    assert "l_comment" not in plan and "l_shipdate" not in plan


def test_tag_job_puts_audio_tags_on_songs_that_have_a_file(spark):
    from pyspark.sql import functions as F

    from tonearm.operators import audio
    from tonearm.queries import model, sounds

    table = sounds.audio_table(audio.audio_features(audio.wave_measures(sounds.wave_files(spark, FOLDER))))
    rows = model.tag_job(spark, FOLDER, audio_table=table).select("song_id", "audio_feature_tags", "audio_tags").collect()
    with_file = {r["song_id"] for r in table.select("song_id").collect()}
    tagged = {r["song_id"] for r in rows if r["audio_feature_tags"]}
    assert tagged and tagged == {r["song_id"] for r in rows} & with_file
    assert table.where(F.col("song_id").endswith("wav")).count() == 0


def test_a_filter_on_tags_stays_behind_the_rules(spark):
    """Moved in front of the rules it would evaluate all of them with their texts a second time."""
    from tonearm.queries import catalogue

    plan = catalogue.QUERIES["blocked_tags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" :+-|").startswith("Filter")]
    assert not any("lower(" in line or "Lower" in line or "tionic" in line for line in filters)
    assert "Generate inline" in plan


def test_strings_are_measured_behind_the_distinct_step(spark):
    from pyspark.sql import functions as F

    from tonearm.operators import matching

    pairs = spark.range(100).selectExpr("concat('abcdef', id % 7) l", "concat('abcxyz', id % 5) r")
    rated = matching.rate_strings(pairs.unionByName(pairs), "l", "r", "score").where(F.col("score") >= 0.5)
    plan = rated._jdf.queryExecution().optimizedPlan().toString().splitlines()
    measured, folded = (next(at for at, line in enumerate(plan) if name in line) for name in ("ArrowEvalPython", "Aggregate"))
    assert measured < folded and sum("ArrowEvalPython" in line for line in plan) == 1
    bounded = matching.with_ratio(pairs.distinct(), "l", "r", "score", 0.5).where(F.col("score") >= 0.5)
    plan = bounded._jdf.queryExecution().optimizedPlan().toString().splitlines()
    measured, folded = (next(at for at, line in enumerate(plan) if name in line) for name in ("ArrowEvalPython", "Aggregate"))
    assert measured < folded and sum("ArrowEvalPython" in line for line in plan) == 1
    assert rated.count() == 30


@pytest.mark.parametrize("left, right", [("", ""), ("aab", "abb"), ("钢琴a", "a琴"), ("\ud800x", "x"), ("abc", "xyz")])
def test_shared_characters(left, right):
    from collections import Counter

    from tonearm.functions import udfs

    others = ["zz", right]
    assert udfs._shared([left, left], others).tolist() == [sum((Counter(left) & Counter(other)).values()) for other in others]
