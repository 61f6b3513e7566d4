"""The operators with production parameters over the driver tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import bpe_automaton, conversation_repair, exact_dedup, factor_machine, license_rules, maxent_lm, merkle_manifest, order_minhash, packing, sign_hash, spans, string_kernel, tiled_topk, url_markov
from tonearm.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> str:
    """Content of a public tokenizer's file; ``folder`` overrides where the installed package has it."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = f"{folder}/{name}"
    with open(path, encoding="utf-8") as file:
        return file.read()


def remainder(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null doc_id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op1_order_minhash")
def order_minhash_near_duplicates(spark, folder):
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op2_string_kernel")
def languages(spark, folder):
    return string_kernel.classify(table(spark, folder, "documents"), remainder(4) == 2)


@query("op3_license_rules", license_rules.scan_sql())
def licenses(spark, folder):
    found = license_rules.scan(table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


@query("op4_factor_machine")
def toxicity(spark, folder):
    return factor_machine.score(table(spark, folder, "documents"), table(spark, folder, "labels"), remainder(3) == 1)


@query("op5_url_markov", url_markov.judge_sql())
def url_verdicts(spark, folder):
    return url_markov.judge(table(spark, folder, "pages")).withColumn("score", F.round("score", 6))


@query("op6_bpe_automaton")
def bpe_round_trip(spark, folder):
    return bpe_automaton.round_trip(table(spark, folder, "documents"), vocabulary(BYTE_BPE))


@query("op7_maxent_lm")
def lm_scores(spark, folder):
    return maxent_lm.score(table(spark, folder, "documents"), remainder(7) == 2)


@query("op8_tiled_topk", """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
    ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def exact_top_k(spark, folder):
    return tiled_topk.top_k(table(spark, folder, "embeddings"))


@query("op9_sign_hash")
def vector_near_duplicates(spark, folder):
    return sign_hash.near_duplicates(table(spark, folder, "embeddings"))


@query("op10_cost_packing")
def packed_sequences(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault in about a quarter of the rows, by the crc32 of conv_id and turn; nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")])
    filled = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("role", "text")],
        (F.crc32(key.cast("binary")) % 20).alias("_fault")).where("_fault != 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return filled.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


@query("op11_conversation_repair")
def repaired_conversations(spark, folder):
    conversations = table(spark, folder, "conversations")
    found = conversation_repair.repair(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    counts = {name: F.coalesce(name, F.lit(0)).cast("long") for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return every.withColumns(counts | empty)


@query("op12_exact_dedup", """
    WITH d AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def exact_copies(spark, folder):
    found = exact_dedup.deduplicate(spark, f"{folder}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


@query("op13_merkle_manifest", merkle_manifest.manifest_sql())
def dataset_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    values = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(remainder(5) == 0, merkle_manifest.leaf(*values, spans.ascii_lower(F.col("text"))))
    leaves = materialize(docs.select("doc_id", "source", merkle_manifest.leaf(*values, F.col("text")).alias("leaf"), tampered.alias("tampered")))
    proved = merkle_manifest.manifest(leaves, "source", ["doc_id"])
    folded = F.aggregate("proof", F.coalesce("tampered", "leaf"), lambda d, step: F.sha2(F.concat(step["left"], d, step["right"]), 256))
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["left"], step["right"])), "")
    checked = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
