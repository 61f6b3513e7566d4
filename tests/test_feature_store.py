"""Stored features: what a refresh derives, and that its counters are those of a full build."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tonearm import session
from tonearm.operators import features
from tonearm.plans import feature_store
from tonearm.sources import buckets

SCHEMA = "song_id string, words string, extra string"


def deriver(seen):
    def derive(df):
        seen.append(sorted(row["song_id"] for row in df.collect()))
        return df.withColumn("generated_tag_list", F.split("words", " "))

    return derive


def counted(rows):
    found = {}
    for _song, words, _extra in rows:
        for word in words.split(" "):
            found[word] = found.get(word, 0) + 1
    return found


@pytest.fixture()
def run(spark, tmp_path):
    seen = []

    def refresh(rows, version="v1", fingerprint=None):
        wide, long, counts = feature_store.refresh(
            spark.createDataFrame(rows, SCHEMA), str(tmp_path / "store"), deriver(seen), version, fingerprint, n=4)
        kept = [r for r in rows if r[0] is not None]
        assert {r["song_id"] for r in wide.collect()} == {r[0] for r in kept}
        assert wide.count() == len(kept)
        assert {r["item"]: r["cnt"] for r in counts.collect()} == counted(kept)
        assert sorted(features.frequency_counts(long).collect()) == sorted(counts.collect())
        return seen[-1] if seen else None

    refresh.seen = seen
    return refresh


def test_only_changed_songs_are_derived(run):
    rows = [(str(i), f"a w{i % 5} w{i % 5}", None) for i in range(40)]
    assert len(run(rows)) == 40
    assert run(rows) == []
    rows[3] = ("3", "b b", None)
    rows[4] = ("4", rows[4][1], "now")
    assert run(rows + [("new", "c", "x")]) == ["3", "4", "new"]
    assert run(rows[:-2]) == []
    assert len(run(rows[:-2], version="v2")) == 38
    assert run([]) == []
    assert run([(None, "z", None), ("1", "", None)]) == ["1"]


def test_same_fingerprint_looks_at_nothing(run):
    rows = [("1", "a", None), ("2", "b", None)]
    run(rows, fingerprint="f1")
    run(rows, fingerprint="f1")
    assert len(run.seen) == 1
    run(rows[:1], fingerprint="f2")
    assert len(run.seen) == 2


def test_random_states_count_as_a_full_build_does(run):
    rng = random.Random(5)
    for _state in range(3):
        run([(str(i), " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))), None) for i in rng.sample(range(30), rng.randrange(1, 30))])


def test_counters_make_good_a_run_that_died(spark, tmp_path, monkeypatch):
    path, derive = str(tmp_path / "store"), deriver([])

    def frame(rows):
        return spark.createDataFrame(rows, SCHEMA)

    feature_store.refresh(frame([(str(i), "a", None) for i in range(20)]), path, derive, "v1", n=4)
    with monkeypatch.context() as broken:
        broken.setattr(feature_store, "_recounted", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            feature_store.refresh(frame([(str(i), "b", None) for i in range(15)]), path, derive, "v1", n=4)
    _, _, counts = feature_store.refresh(frame([(str(i), "b c" if i else "b", None) for i in range(15)]), path, derive, "v1", n=4)
    assert {r["item"]: r["cnt"] for r in counts.collect()} == {"b": 15, "c": 14}


def test_one_changed_song_rewrites_one_bucket(spark, tmp_path):
    path, rows = str(tmp_path / "store"), [(str(i), "a", None) for i in range(60)]
    feature_store.refresh(spark.createDataFrame(rows, SCHEMA), path, deriver([]), "v1", n=8)
    before = buckets.manifest(spark, f"{path}/wide").places
    rows[7] = ("7", "b", None)
    feature_store.refresh(spark.createDataFrame(rows, SCHEMA), path, deriver([]), "v1", n=8)
    after = buckets.manifest(spark, f"{path}/wide").places
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1


def size(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


def test_refresh_neither_shuffles_texts_nor_leaves_copies(spark, tmp_path, monkeypatch):
    rng, path, plans = random.Random(3), str(tmp_path / "store"), []
    rows = [(str(i), "a", rng.randbytes(10_000).hex()) for i in range(300)]
    write = buckets.rewrite

    def rewrite(df, where, *args, **options):
        if where.endswith("wide"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, where, *args, **options)

    monkeypatch.setattr(buckets, "rewrite", rewrite)
    monkeypatch.setattr(session, "scratch", lambda _spark: str(tmp_path / "kept" / uuid.uuid4().hex))
    local = [str(folder) for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    before, known = sum(map(size, local)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for state in (rows, [(key, words, extra[::-1] if int(key) % 2 else extra) for key, words, extra in rows[30:]]):
            feature_store.refresh(spark.createDataFrame(state, SCHEMA), path, deriver([]), "v1", n=4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    # Joins of rows are with the broadcast places of keys alone, and nothing but the store is left.
    assert len(plans) == 2 and "LeftAnti" not in plans[1] and plans[1].count("strategy=broadcast") == 2
    assert size(tmp_path / "kept") + sum(map(size, local)) - before < 300 * 10_000
