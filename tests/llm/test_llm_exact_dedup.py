"""Stateful deduplication against grouping by whole texts in Python."""

from collections import defaultdict

from pyspark.sql import functions as F
from tonearm.llm import exact_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def groups(rows):
    """Of each normalised text: the id that stays and the number of rows."""
    found = defaultdict(list)
    for row in rows:
        found[(row["text"] or "").translate(UPPER)].append(row["doc_id"])
    return {text: (max((x for x in ids if x is not None), default=None), len(ids)) for text, ids in found.items()}


def check(spark, path, result):
    rows = spark.read.parquet(path).select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line")).collect()
    want = groups(rows)
    texts = {(row["file"], row["line"]): ((row["text"] or "").translate(UPPER), row["doc_id"]) for row in rows}
    kept = defaultdict(int)
    got = result.collect()
    assert len(got) == len(rows)
    for row in got:
        text, doc_id = texts.pop((row["file"], row["line"]))
        assert (row["id"], row["keep_id"], row["size"]) == (doc_id, *want[text])
        assert row["id"] == row["keep_id"] or not row["kept"]
        kept[text] += row["kept"]
    assert not texts and all(n == 1 for n in kept.values()) and len(kept) == len(want)


def test_odd_documents(spark, odd_documents, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    odd_documents.unionByName(odd_documents.withColumn("text", F.upper("text")).withColumn("doc_id", F.col("doc_id") + 100)).write.parquet(path)
    check(spark, path, exact_dedup.deduplicate(spark, path))


def test_only_ascii_letters_are_folded(spark, tmp_path):
    path = f"{tmp_path}/d.parquet"
    spark.createDataFrame([(1, "É A"), (2, "é a"), (3, "É a"), (4, "K"), (5, "K")], "doc_id long, text string").write.parquet(path)
    found = {row["id"]: row["keep_id"] for row in exact_dedup.deduplicate(spark, path).collect()}
    assert found == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_texts_that_share_a_digest_are_told_apart(spark, documents, tmp_path):
    path = f"{tmp_path}/d.parquet"
    documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1000)).write.parquet(path)
    check(spark, path, exact_dedup.deduplicate(spark, path, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1)))


def test_single_file_and_empty_table(spark, no_documents, tmp_path):
    assert exact_dedup.deduplicate(spark, "/root/testdata/sf0.001/documents.parquet").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    path = f"{tmp_path}/none.parquet"
    no_documents.write.parquet(path)
    assert exact_dedup.deduplicate(spark, path).collect() == []


def test_later_files_only_touch_their_digests(spark, tmp_path):
    path, store = f"{tmp_path}/d", f"{tmp_path}/store"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "B")], "doc_id long, text string").coalesce(1).write.parquet(path)
    check(spark, path, exact_dedup.deduplicate(spark, path, store=store))
    spark.createDataFrame([(9, "A"), (8, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    check(spark, path, exact_dedup.deduplicate(spark, path, store=store))
    changes = spark.read.parquet(f"{store}/entries").groupBy("batch").count().orderBy("batch").collect()
    assert [row["count"] for row in changes] == [2, 2]
    check(spark, path, exact_dedup.deduplicate(spark, path, store=store))
    assert spark.read.parquet(f"{store}/log").count() == 5
