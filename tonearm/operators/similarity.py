"""Vectors: look-up, top-k search, lists of neighbours, clusters, affect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonearm import vocab
from tonearm.functions import arrays, numbers, text


def check_vectors(vectors: DataFrame, vector: str = "vector", key: str = "song_id") -> DataFrame:
    """Vectors with a key and at least one element; an empty set or mixed sizes is an error."""
    usable = vectors.where(~text.is_blank(key) & (F.size(vector) > 0))
    sizes = usable.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if sizes["low"] is None:
        raise ValueError("no usable vectors")
    if sizes["low"] != sizes["high"]:
        raise ValueError(f"vectors have different sizes: {sizes['low']} to {sizes['high']}")
    return usable


def vector_lookup(vectors: DataFrame, song_id: str, vector: str = "vector", key: str = "song_id") -> DataFrame:
    """The vector of one id; a blank id is an error."""
    if not str(song_id).strip():
        raise ValueError("a song id is needed")
    return vectors.where(F.col(key) == str(song_id).strip()).select(key, vector)


def known_vector(vectors: DataFrame, song_id: str, vector: str = "vector", key: str = "song_id") -> list[float]:
    """The vector of one id on the driver (a single row); an unknown id is an error."""
    row = vector_lookup(vectors, song_id, vector, key).first()
    if row is None:
        raise ValueError(f"no vector for id {song_id}")
    return list(row[vector])


def restrict_candidates(candidates: DataFrame, vectors: DataFrame, key: str = "song_id") -> DataFrame:
    """Distinct non-blank candidate ids that have a vector."""
    ids = candidates.select(text.safe_text(key).alias(key)).where(F.col(key) != "").distinct()
    return ids.join(vectors.select(key), key, "left_semi")


def search_similar(
    vectors: DataFrame,
    query: Sequence[float] | DataFrame,
    candidates: DataFrame | None = None,
    top_k: int = vocab.SIMILARITY_TOP_K,
    vector: str = "vector",
    key: str = "song_id",
) -> DataFrame:
    """(rank, song_id, score): most similar vectors, cosine x 100; the query itself may be among them.

    ``query`` is a vector, or a one-row DataFrame used as a scalar subquery. Only the k best rows of
    each partition leave it.
    """
    if isinstance(query, DataFrame):
        target = query.select(arrays.l2_normalize(vector).alias("query")).limit(1).scalar()
    else:
        target = arrays.l2_normalize(F.array(*[F.lit(float(item)) for item in query]))
    pool = vectors
    if candidates is not None:
        pool = vectors.join(restrict_candidates(candidates, vectors, key), key, "left_semi")
    scored = pool.withColumn("_query", target).select(
        key, (arrays.dot(arrays.l2_normalize(vector), "_query") * 100.0).alias("score")
    )
    best = scored.orderBy(F.desc("score"), key).limit(max(1, int(top_k)))
    return rank_results(best, key)


def rank_results(best: DataFrame, key: str = "song_id") -> DataFrame:
    """1-based rank of an already cut top-k result."""
    order = Window.orderBy(F.desc("score"), key)
    return best.select(F.row_number().over(order).alias("rank"), key, "score")


def attach_similarity(df: DataFrame, results: DataFrame, key: str = "song_id") -> DataFrame:
    """Keep the catalogue rows among the results, with their similarity."""
    scored = results.select(key, F.col("score").alias("audio_similarity_score"))
    return df.join(scored, key, "inner")


def neighbor_lists(neighbors: DataFrame, key: str = "song_id") -> DataFrame:
    """Joined ids and four-decimal scores per row, nearest first (at most k items each)."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", F.bround("similarity", 4).alias("s"))))
    return neighbors.groupBy(key).agg(listed.alias("near")).select(
        key,
        F.array_join(F.transform("near", lambda item: item["neighbor_id"]), " | ").alias("mert_neighbor_song_ids"),
        F.array_join(F.transform("near", lambda item: item["s"].cast("string")), " | ").alias("mert_neighbor_scores"),
    )


def kmeans(vectors: DataFrame, k: int = 12, seed: int = 42, vector: str = "vector", key: str = "song_id") -> DataFrame:
    """(song_id, mert_cluster) on unit vectors, k = min(k, rows); fewer than two rows give no clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.select(key, array_to_vector(arrays.l2_normalize(vector)).alias("features"))
    rows = unit.limit(max(k, 2)).count()
    if rows < 2:
        return vectors.sparkSession.createDataFrame([], f"{key} string, mert_cluster int")
    model = KMeans(k=min(k, rows), seed=seed, featuresCol="features", predictionCol="mert_cluster").fit(unit)
    return model.transform(unit).select(key, "mert_cluster")


# --- affect and linear heads -----------------------------------------------------------------------


def affect_proxy(rms: str, zcr: str, centroid: str, flux: str) -> tuple[Column, Column]:
    """(valence, arousal) from loudness, zero crossings, brightness and flux."""
    # Coefficients.
    level = F.log10(F.col(rms) + 1e-5) * 2.4 + F.col(centroid) * 0.0010 + F.col(zcr) * 10.0 + 0.8
    arousal = numbers.clip(numbers.sigmoid(level) + F.least(F.col(flux), F.lit(1.0)) * 0.05, 0, 1)
    brightness = numbers.sigmoid((F.col(centroid) - 1800.0) / 900.0)
    roughness = numbers.sigmoid((F.col(zcr) - 0.08) * 18.0)
    valence = numbers.clip(brightness * 0.62 + (F.lit(1.0) - roughness) * 0.38, 0, 1)
    return valence, arousal


def emotion_scores(valence: str, arousal: str, top_k: int = 3) -> Column:
    """Top (label, score) structs: softmax of -5 x distance to the prototypes."""
    gaps = F.array(
        *[
            F.sqrt(F.pow(F.col(valence) - v, F.lit(2.0)) + F.pow(F.col(arousal) - a, F.lit(2.0))) * -5.0
            for _label, v, a, _tag in vocab.EMOTION_PROTOTYPES
        ]
    )
    labels = F.array(*[F.lit(label) for label, _v, _a, _tag in vocab.EMOTION_PROTOTYPES])
    return arrays.top_labels(numbers.softmax(gaps), labels, top_k)


def emotion_tags(scores: Column | str, threshold: float = 0.16) -> Column:
    """Display tags of the labels at or above the threshold, else of the best one."""
    display = F.create_map(
        *[F.lit(item) for label, _v, _a, tag in vocab.EMOTION_PROTOTYPES for item in (label, tag)]
    )
    ranked = text.col(scores)
    strong = F.filter(ranked, lambda item: item["score"] >= threshold)
    chosen = F.when(F.size(strong) > 0, strong).otherwise(F.slice(ranked, 1, 1))
    return F.array_distinct(
        F.transform(chosen, lambda item: F.coalesce(F.try_element_at(display, item["label"]), item["label"]))
    )


def linear_head(vector: str, weights: Column | Sequence[Sequence[float]], bias: Column | Sequence[float]) -> Column:
    """Class probabilities softmax(Wx + b); the small weight matrix is one literal, or a column."""
    table = weights if isinstance(weights, Column) else arrays.constant_matrix(weights)
    offsets = bias if isinstance(bias, Column) else arrays.constant_matrix([bias])[0]
    logits = F.zip_with(table, offsets, lambda row, offset: arrays.dot(row, vector) + offset)
    return numbers.softmax(logits)
