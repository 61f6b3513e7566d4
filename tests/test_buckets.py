"""Bucketed tables: what a merge touches, replayed batches, writers in each other's way, streams."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.sources import buckets, files, sinks
from tonearm.streaming import history as streams


def places(spark, path):
    return buckets.manifest(spark, path).places


def table(spark, rows, schema="song_id string, v string, place int"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_one_changed_key_rewrites_one_bucket(spark, tmp_path, kind):
    merge = {"csv": sinks.merge_csv, "json": sinks.merge_jsonl, "parquet": sinks.merge_parquet}[kind]
    path = str(tmp_path / "t")
    merge(path, table(spark, [(str(i), f"v{i}", i) for i in range(200)]), "place", n=16)
    merge(path, table(spark, [(str(i), " ", i) for i in range(0, 200, 2)]), "place")
    before = places(spark, path)
    merge(path, table(spark, [("7", "new \"quoted\",\nline", 0)]), "place")
    after = places(spark, path)
    assert len(before) == 16 and sum(after[b] != before[b] for b in before) == 1
    got = {r["song_id"]: r["v"] for r in sinks.read_merged(spark, path).collect()}
    assert got == {str(i): f"v{i}" for i in range(200)} | {"7": "new \"quoted\",\nline"}


def test_random_merges_give_what_one_merge_of_all_rows_gives(spark, tmp_path):
    rng = random.Random(7)
    batches = [[(str(rng.randrange(30)), rng.choice(["", " ", "a", "b ", "c"]), rng.choice(["x", "", "y"]), i) for i in range(rng.randrange(1, 25))] for _ in range(5)]
    path = str(tmp_path / "t")
    want, seen = {}, []
    for number, batch in enumerate(batches):
        sinks.merge_parquet(path, spark.createDataFrame(batch, "song_id string, v string, w string, place int"), "place", n=8)
        for key, v, w, _ in batch:
            old = want.get(key, ("", ""))
            want[key] = (v.strip() or old[0], w or old[1])
            seen = [k for k in seen if k != key] + [key]
    got = [(r["song_id"], (r["v"] or "", r["w"] or "")) for r in sinks.read_merged(spark, path, ordered=True).collect()]
    assert got == [(key, want[key]) for key in seen]


def test_columns_that_are_blank_everywhere_are_not_shown(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_csv(path, spark.createDataFrame([("1", "a", " ", 0)], "song_id string, v string, w string, place int"), "place", n=4)
    assert sinks.read_merged(spark, path).columns == ["song_id", "v", "w"]
    sinks.merge_csv(path, table(spark, [("2", "b", 0)]), "place")
    assert sinks.read_merged(spark, path).columns == ["song_id", "v"]
    sinks.merge_csv(path, spark.createDataFrame([("3", "z", "now", 0)], "song_id string, w string, x string, place int").drop("v"), "place")
    assert sinks.read_merged(spark, path).columns == ["song_id", "v", "w", "x"]


def test_export_is_a_plain_table_in_order(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_csv(path, table(spark, [("b", "1", 0), ("a", "2", 1)]), "place", n=4)
    sinks.merge_csv(path, table(spark, [("b", "3", 0)]), "place")
    plain = sinks.export_merged(spark, path, str(tmp_path / "plain"))
    rows = files.read_csv(spark, plain).orderBy("row_order").collect()
    assert [(r["song_id"], r["v"]) for r in rows] == [("a", "2"), ("b", "3")]


def test_second_writer_from_the_same_version_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    known = buckets.merge(table(spark, [("1", "a", 0)]), path, ["song_id"], lambda stored, rows: rows)
    buckets.rewrite(table(spark, [("1", "b", 0)]), path, known, places(spark, path))
    with pytest.raises(buckets.Conflict):
        buckets.rewrite(table(spark, [("1", "c", 0)]), path, known, [0])
    assert buckets.read(spark, path).first()["v"] == "b"


def test_pruning_keeps_what_two_manifests_need(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(5):
        sinks.merge_parquet(path, table(spark, [("1", f"v{n}", 0), (str(n + 10), "x", 1)]), "place", n=8)
    buckets.prune(spark, path)
    left = {int(p.name.removeprefix("buckets-")) for p in (tmp_path / "t").glob("buckets-*")}
    known = buckets.manifest(spark, path)
    assert left == set(known.places.values()) | set(buckets.manifest(spark, path, known.version - 1).places.values())
    assert len(list((tmp_path / "t").glob("manifest-*"))) == 2
    assert {r["song_id"]: r["v"] for r in sinks.read_merged(spark, path).collect()} == {"1": "v4"} | {str(n + 10): "x" for n in range(5)}


def test_a_table_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_parquet(path, table(spark, []), "place")
    assert sinks.read_merged(spark, path).collect() == []


def entries(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, song_id string").coalesce(1).write.mode("append").parquet(path)


def test_a_batch_of_one_user_touches_one_bucket_and_a_replay_nothing(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / name) for name in ("in", "table", "progress"))
    entries(spark, source, [(i, i % 40, "s") for i in range(400)])
    stream = spark.readStream.schema("event_id long, user_id long, song_id string").parquet(source)
    run = lambda: streams.keep_last_n(stream, path, checkpoint, 3, ["event_id"], ["user_id"], buckets=16).awaitTermination()
    run()
    before = places(spark, path)
    entries(spark, source, [(1000, 7, "late"), (1001, 7, "later")])
    run()
    after = places(spark, path)
    assert sum(after[b] != before[b] for b in before) == 1
    got = {(r["user_id"], r["event_id"]) for r in buckets.read(spark, path).collect()}
    assert got == {(u, e) for u in range(40) if u != 7 for e in (320 + u, 360 + u, 280 + u)} | {(7, 367), (7, 1000), (7, 1001)}
    # The same batch once more, as after a crash between the table's commit and the stream's.
    batch = spark.createDataFrame([(5000, 7, "x")], "event_id long, user_id long, song_id string")
    known = buckets.manifest(spark, path)
    assert buckets.merge(batch, path, ["user_id"], lambda stored, rows: rows, batch=known.notes["batch"]) == known


def test_whole_history_without_users(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    entries(spark, source, [(i, i % 4, "s") for i in range(100)])
    stream = spark.readStream.schema("event_id long, user_id long, song_id string").parquet(source)
    streams.keep_last_n(stream, path, str(tmp_path / "progress"), 5, ["event_id"], []).awaitTermination()
    assert {r["event_id"] for r in buckets.read(spark, path).collect()} == set(range(95, 100))


def test_running_stream_takes_batches_as_they_come(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "song_id string, endpoint string, params_hash string, response_json string, collected_at string"
    rows = lambda day: spark.createDataFrame([(str(i), "e", "p", f"r{day}", f"2024-01-0{day}") for i in range(day * 3)], schema)
    rows(1).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = streams.upsert_stream(stream, path, str(tmp_path / "progress"), buckets=4, trigger={"processingTime": "100 milliseconds"})
    try:
        query.processAllAvailable()
        rows(2).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    got = buckets.read(spark, path)
    assert {(r["song_id"], r["response_json"]) for r in got.collect()} == {(str(i), "r2") for i in range(6)}
    assert buckets.manifest(spark, path).version == 2 and got.where(F.col("collected_at") < "2024-01-02").isEmpty()


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    path, key = str(tmp_path / "table"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        rows = spark.range(0, 40_000, 1, 8).select(F.col("id").cast("string").alias("song_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        buckets.merge(rows, path, ["song_id"], lambda stored, new: new, buckets=1)
    finally:
        spark.conf.set(key, before)
    stored = buckets.read(spark, path)
    assert len(stored.inputFiles()) > 3
    assert sorted(r["song_id"] for r in stored.collect()) == sorted(map(str, range(40_000)))


def test_upserts_sort_a_bounded_number_of_rows_in_a_task(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "song_id string, endpoint string, params_hash string, response_json string, collected_at string"
    spark.createDataFrame([(str(i % 900), "e", "p", f"r{i}", f"{i:04}") for i in range(1800)], schema).coalesce(1).write.parquet(source)
    seen, upsert = [], streams.snapshots.upsert_results
    monkeypatch.setattr(streams, "ROWS_A_TASK", 100, raising=False)
    monkeypatch.setattr(streams.snapshots, "upsert_results", lambda *a: seen.append(upsert(*a)) or seen[-1])
    streams.upsert_stream(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "progress"), buckets=4).awaitTermination()
    assert "song_id#" in (plan := seen[0]._jdf.queryExecution().executedPlan().toString()) and ", 18), REPARTITION_BY_NUM" in plan
    assert {(r["song_id"], r["response_json"]) for r in buckets.read(spark, path).collect()} == {(str(i), f"r{i + 900}") for i in range(900)}


def test_rows_split_off_by_keys_are_those_of_a_join(spark, tmp_path):
    path, n = str(tmp_path / "t"), 70_000
    rows = spark.range(n).select((F.col("id") % 60_000).cast("string").alias("k"), F.col("id").alias("v"))
    rows.coalesce(1).write.parquet(path)
    rows.where("v < 9").select("k", (F.col("v") + n).alias("v")).repartition(3).write.mode("append").parquet(path)
    keys = spark.range(n).where("id % 7 = 3 or id between 40000 and 41000 or id = 0").select(F.col("id").cast("string").alias("k"))
    scan = spark.read.parquet(path)
    for keep, how in ((True, "left_semi"), (False, "left_anti")):
        found = buckets.split_off(buckets.located(scan), keys.union(keys), "k", keep)
        assert found.columns == ["k", "v"]
        assert sorted(found.collect()) == sorted(scan.join(keys, "k", how).collect())
    none = keys.where("k is null")
    assert buckets.split_off(buckets.located(scan), none, "k", True).count() == 0
    assert buckets.split_off(buckets.located(scan), none, "k", False).count() == n + 9
