"""Readers and writers on small folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.sources import buckets, files, sinks


def write(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


def test_csv_union_by_name_with_bom_and_quotes(spark, tmp_path):
    write(tmp_path, "b.csv", "name,song_id\nlater,2\n")
    write(tmp_path, "a.csv", b"\xef\xbb\xbf song_id ,name\n1,\"x \"\"y\"\"\nz\"\n2,first\n")
    rows = files.read_csv_union(spark, str(tmp_path)).orderBy("file_order", "row_order").collect()
    assert [(r["song_id"], r["name"], r["source_csv"], r["file_order"]) for r in rows] == [
        ("1", 'x "y"\nz', "a.csv", 0), ("2", "first", "a.csv", 0), ("2", "later", "b.csv", 1)]


def test_csv_folder_has_one_scan_for_each_header(spark, tmp_path):
    for n in range(30):
        content = "song_id,name\r\n%d,x\r\n" if n % 3 else "name,song_id\ny,%d\n"
        write(tmp_path, f"{n:02d} a+b%{'' if n else '41'}_song_tags.csv", "\ufeff" * (n % 2) + content % n)
    write(tmp_path, "empty_song_tags.csv", "")
    write(tmp_path, "other.csv", "k\n1\n")
    df = files.read_tag_csvs(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4
    rows = df.orderBy("file_order", "row_order").collect()
    assert [(r["file_order"], r["song_id"], r["name"]) for r in rows] == [(n, str(n), "x" if n % 3 else "y") for n in range(30)]
    assert "k" not in df.columns
    with pytest.raises(ValueError, match="no table"):
        files.read_csv_union(spark, str(tmp_path), "*.tsv")


def test_files_with_other_headers_are_no_set(spark, tmp_path):
    paths = [write(tmp_path, "a.csv", "x,y\n1,2\n"), write(tmp_path, "b.csv", "y,x\n1,2\n")]
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, paths).collect()


def test_lyrics_are_named_by_stem_and_stripped(spark, tmp_path):
    write(tmp_path, "1.txt", " 词\n")
    write(tmp_path, "a+b c.txt", b"bad \xff byte")
    got = {r["song_id"]: r["full_lyric"] for r in files.read_lyrics(spark, str(tmp_path)).collect()}
    assert got == {"1": "词", "a+b c": "bad � byte"}


def test_folder_of_texts_is_listed_by_a_task_and_read_as_spark_reads_it(spark, tmp_path, monkeypatch):
    names = ["a+b c", "100%", "%41", "词 ü", "nb\u00a0sp", "w\u3000ide", "zw\u200bj", "\u0085c", "q?[x]{y}", "back\\slash", "p|i^p`e<>\"", "#h",
             "a;b,c=d&e@f!$'()*~", "_hidden", ".dot", "_k=v", "_metadata", "😀", "tab\there", "nl\nx", "two.b", "del\x7f"]
    for folder in ("plain 100%", "deeper"):
        for at, name in enumerate(names):
            write(tmp_path / folder, f"{name}.txt", b"\xef\xbb\xbf x\xff\r\n\x00%d" % at)
        for name in ("empty.txt", "other.json", "up.TXT", "x.txt._COPYING_"):
            write(tmp_path / folder, name, "" if name == "empty.txt" else "y")
        os.symlink("nowhere", tmp_path / folder / "broken.txt")
        os.symlink("100%.txt", tmp_path / folder / "link.txt")
    write(tmp_path / "deeper" / "k=v", "z.txt", "z")
    (tmp_path / "none").mkdir()

    def rows(df):
        return sorted(tuple(map(bytes, row)) for row in df.select(*[F.col(name).cast("binary") for name in ("stem", "file_name", "value")]).collect())

    def of_spark(folder):
        return spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(
            files._stem().alias("stem"), F.col("_metadata.file_name").alias("file_name"), "value")

    monkeypatch.setattr(files, "_HELD", 40)
    for folder in ("plain 100%", "deeper", "none"):
        read = files.read_texts(spark, str(tmp_path / folder), "*.txt")
        # Spark's own scan keeps an entry for each file at the driver.
        assert (len(read.inputFiles()) > 1) == (folder == "deeper")
        assert rows(read) == rows(of_spark(str(tmp_path / folder)))
    assert files.read_texts(spark, str(tmp_path / "plain 10*"), "*.txt").count() == 20
    assert files.read_texts(spark, str(tmp_path / "plain 100%" / "#h.txt"), "*.txt").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_texts(spark, str(tmp_path / "missing"), "*.txt")


def test_snapshots_split_unreadable_documents(spark, tmp_path):
    write(tmp_path, "1.json", '{"song_id": 1}')
    write(tmp_path, "2.json", "{oops")
    good, bad = files.read_snapshots(spark, str(tmp_path))
    assert [r["file_name"] for r in good.collect()] == ["1.json"]
    assert [r["file_name"] for r in bad.collect()] == ["2.json"]


def test_jsonl_drops_blank_lines_and_non_objects(spark, tmp_path):
    path = write(tmp_path, "t.jsonl", '﻿{"song_id": 1, "n": [1]}\n\n[2]\n{"song_id": "2"}\n')
    rows = files.read_jsonl(spark, path).orderBy("song_id").collect()
    assert [(r["song_id"], r["n"]) for r in rows] == [("1", "[1]"), ("2", None)]


def test_jsonl_with_very_many_keys_is_read_by_name(spark, tmp_path):
    lines = spark.range(20_000).select(F.to_json(F.create_map(F.concat(F.lit("k`"), "id"), "id", F.lit("v"), F.lit(-1).cast("long"))).alias("value"))
    path = str(tmp_path / "wide")
    lines.write.text(path)
    with pytest.raises(ValueError, match="more than 10000 keys"):
        files.read_jsonl(spark, path)
    named = files.read_jsonl(spark, path, columns=["k`7", "v"]).where("`k``7` is not null").collect()
    assert [r[:] for r in named] == [("7", "-1")]
    records = files.read_records(spark, path)
    assert records.where(F.try_variant_get("record", "$.v", "long") == -1).count() == 20_000


def test_embeddings_from_npy(spark, tmp_path):
    for name, vector in (("1", [1.0, 2.0]), ("2", [[3.0, 4.0]]), ("3", [])):
        np.save(os.path.join(tmp_path, f"{name}.npy"), np.array(vector, dtype=np.float32))
    got = {r["song_id"]: list(r["vector"]) for r in files.read_embeddings(spark, str(tmp_path)).collect()}
    assert got == {"1": [1.0, 2.0], "2": [3.0, 4.0]}


def test_audio_listing_by_extension(spark, tmp_path):
    for name in ("x/A - B.FLAC", "y.mp3", "z.txt"):
        write(tmp_path, name, "0")
    assert {r["stem"] for r in files.list_audio(spark, str(tmp_path)).collect()} == {"A - B", "y"}


@pytest.mark.parametrize("content, expected", [('[{"song_id":"1","all_tags":["a"]}, 5, {"name":"n"}]', 2), ('{"a":1}', 0), ("broken", 0)])
def test_history_file(spark, tmp_path, content, expected):
    path = write(tmp_path, "h.json", content)
    assert files.read_history(spark, path).count() == expected


def test_history_is_cut_to_its_size(spark, tmp_path):
    log = spark.range(200).select(F.col("id").alias("event_id"), F.lit("1").alias("song_id"))
    stored = sinks.write_history(log, str(tmp_path / "h"), ["event_id"])
    assert spark.read.json(stored).agg(F.min("event_id"), F.count("*")).first()[:] == (120, 80)


def test_id_list_reports_a_bad_id(spark):
    lines = spark.createDataFrame([(0, "3, 1 # x"), (1, "1\n2")], "position int, value string")
    rows = files.parse_id_list(lines).orderBy("first").collect()
    assert [r["song_id"] for r in rows] == [3, 1, 2]
    bad = spark.createDataFrame([(0, "3, y")], "position int, value string")
    with pytest.raises(Exception, match="Invalid song id: y"):
        files.parse_id_list(bad).collect()


def test_fingerprint_follows_content_changes(spark, tmp_path):
    write(tmp_path, "a.csv", "1")

    def sign(version="v1"):
        return files.source_fingerprint(files.list_files(spark, str(tmp_path)), version).first()["fingerprint"]

    first = sign()
    assert first == sign() and first != sign("v2")
    write(tmp_path, "b.csv", "2")
    assert first != sign()
    assert files.is_stale([], first) and not files.is_stale([first], first)


def test_incomplete_version_is_ignored(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("1", "a", 0)], "song_id string, v string, place int")
    sinks.merge_csv(path, df, "place")
    write(path, "buckets-000002/table_bucket=0/part-0.csv", "song_id,v\n9,z\n")
    assert buckets.manifest(spark, path).version == 1
    assert [(r["song_id"], r["v"]) for r in sinks.read_merged(spark, path).collect()] == [("1", "a")]
    sinks.merge_csv(path, df.withColumn("v", F.lit("b")), "place")
    assert buckets.manifest(spark, path).version == 3
    assert [(r["song_id"], r["v"]) for r in sinks.read_merged(spark, path).collect()] == [("1", "b")]


def test_first_tag_table_keeps_duplicates_but_semantics_do_not(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", 0), ("1", "b", 1)], "song_id string, v string, place int")
    tag = sinks.merge_csv(str(tmp_path / "tags"), df, "place")
    semantic = sinks.merge_csv(str(tmp_path / "semantics"), df, "place", semantics_writer=True)
    assert sinks.read_merged(spark, tag).count() == 2
    assert [r["v"] for r in sinks.read_merged(spark, semantic).collect()] == ["b"]
    assert sinks.read_merged(spark, semantic).columns == ["song_id", "v"]
    # The merge after the first one reduces all keys, also those that it doesn't bring.
    sinks.merge_csv(tag, df.withColumn("song_id", F.lit("2")).limit(1), "place")
    assert sorted((r["song_id"], r["v"]) for r in sinks.read_merged(spark, tag).collect()) == [("1", "b"), ("2", "a")]


@pytest.mark.parametrize("later_is_larger", [True, False])
@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_the_later_part_of_a_stored_table_wins(spark, tmp_path, kind, later_is_larger):
    """Spark reads parts by size; their names give the order."""
    small, large = 3, 3000
    sizes = (small, large) if later_is_larger else (large, small)
    path = str(tmp_path / "table")
    target = f"{path}/version-000001"
    for part, n in enumerate(sizes):
        rows = spark.range(n).select(F.col("id").cast("string").alias("song_id"), F.lit(f"part {part}").alias("style_tags"), F.repeat(F.lit("x"), 50).alias("pad"))
        frame = rows.coalesce(1).write.mode("append").format(kind)
        (frame.options(**sinks.CSV_OPTIONS) if kind == "csv" else frame).save(target)
    # Names of appended parts are not in order of writing, so they are given in order here.
    parts = sorted(tmp_path.glob("table/version-000001/part-*"), key=lambda p: p.stat().st_size, reverse=not later_is_larger)
    for number, part in enumerate(parts):
        part.rename(part.with_name(f"part-{number:05d}{part.suffix}"))
        crc = part.with_name(f".{part.name}.crc")
        crc.rename(crc.with_name(f".part-{number:05d}{part.suffix}.crc"))
    new = spark.createDataFrame([("9999", "new", 0)], "song_id string, style_tags string, at int")
    merge = {"csv": sinks.merge_csv, "json": sinks.merge_jsonl, "parquet": sinks.merge_parquet}[kind]
    got = {r["song_id"]: r["style_tags"] for r in sinks.read_merged(spark, merge(path, new, "at")).collect()}
    assert {got[str(i)] for i in range(small)} == {"part 1"} and got["9999"] == "new"


def test_embeddings_of_mixed_sizes_or_none_are_an_error(spark, tmp_path):
    np.save(tmp_path / "1.npy", np.zeros(3))
    assert files.read_embeddings(spark, str(tmp_path)).count() == 1
    np.save(tmp_path / "2.npy", np.zeros(4))
    with pytest.raises(ValueError, match="different sizes"):
        files.read_embeddings(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    np.save(tmp_path / "none" / "1.npy", np.zeros(0))
    with pytest.raises(ValueError, match="no usable vectors"):
        files.read_embeddings(spark, str(tmp_path / "none"))


def test_old_versions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in range(4):
        sinks.write_version(spark.range(n + 1), path, "parquet")
    sinks.prune(spark, path)
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["version-000003", "version-000004"]
    assert spark.read.parquet(sinks.latest_version(spark, path)).count() == 4
    sinks.prune(spark, path)
    assert sinks.latest_version(spark, path).endswith("version-000004")


def test_files_are_written_in_place_and_read_in_few_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("a+b "), "id", F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit(" x\n"), "id"), "UTF-8").alias("value"))
    folder = str(tmp_path / "one 100%" / "two")
    assert sinks.write_files(rows, folder) == 300
    assert sorted(os.listdir(folder)) == sorted(f"a+b {n}.txt" for n in range(300))
    with open(f"{folder}/a+b 7.txt", "rb") as one:
        assert one.read() == b" x\n7"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = files.read_lyrics(spark, folder)
        assert read.rdd.getNumPartitions() <= 64
        assert files.list_files(spark, folder).rdd.getNumPartitions() <= 64
        assert {(r["song_id"], r["full_lyric"]) for r in read.collect()} == {(f"a+b {n}", f"x\n{n}") for n in range(300)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
