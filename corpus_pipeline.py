"""From documents to packed training sequences: four stages, each an operator of tonearm.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import factor_machine, order_minhash, packing, ranks, string_kernel
from tonearm.llm.queries import WORD_BPE, remainder, vocabulary
from tonearm.session import materialize

# Share of the predicted language below which a text counts as in none of them.
LEAST_LANGUAGE = 0.4


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't mark; it learns from the table labels.

    Null and empty texts are scored like others. Repeated rows, rows without a doc_id and all columns come along as
    they are, texts are read whole, and an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return factor_machine.score(docs, labels, remainder(3) == 1, carry=True).where("predicted = 0").select("row.*")


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is one of those learnt, by a share of LEAST_LANGUAGE or more.

    Texts that are null, empty or without a letter go. Repeated rows, rows without a doc_id and all columns come
    along as they are; texts are read whole, of equal shares the first language's counts, and an empty table gives no rows.
    """
    found = string_kernel.classify(docs, remainder(4) == 2, carry=True)
    sure = (F.col("lang_pred") != string_kernel.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)
    return found.where(sure).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Rows that share a doc_id are one document only if their texts are equal too; any one of those rows stays.
    Rows without a doc_id all stay, and so do null and empty texts. Texts are read whole, other columns come
    along, and an empty table gives no rows.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        return _one_of_each_text(docs)
    gone = order_minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _one_of_each_text(docs: DataFrame) -> DataFrame:
    """``one_of_each`` where doc_ids repeat: rows go by their place in the order of doc_id and text digest."""
    rows = docs.where("doc_id is not null").select(F.lit(0).alias("all"), "doc_id", F.sha2("text", 256).alias("digest"), F.struct("*").alias("row"))
    placed = ranks.positions(rows.dropDuplicates(["doc_id", "digest"]), "all", ["doc_id", "digest"])
    keyed = materialize(placed.select(F.col("position").alias("doc_id"), "row.text", "row"))
    gone = order_minhash.near_duplicates(keyed).where(~F.col("kept")).select("doc_id").distinct()
    return keyed.join(gone, "doc_id", "left_anti").select("row.*").unionByName(docs.where("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with the checksum of each piece's ids.

    A null text counts as empty and is the end id alone. Repeated rows are packed each for itself, a null doc_id
    stays null, texts are packed whole, other columns are not looked at, and an empty table gives no rows.
    """
    pieces = packing.pack(docs, vocabulary(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", not_toxic), ("language", in_a_language), ("near_duplicates", one_of_each), ("packing", packed)]

# Trained models and Order MinHash have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is a Parquet table in the shared folder, which the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
