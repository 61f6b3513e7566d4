"""Labelling texts by similarity to label descriptions, with a keyword fallback."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import arrays, text, udfs

Rules = Sequence[tuple[str, Sequence[str]]]


@dataclass(frozen=True)
class LabelSet:
    """Labels with their keywords, and the limits for accepting a label. Fixed values below."""

    prefix: str
    rules: Rules
    margin: float
    description: str
    threshold: float = 0.48
    max_tags: int = 3


LYRICS = LabelSet("lyric_semantic", tuple(vocab.LYRIC_SEMANTIC_RULES), 0.04, "歌词语义标签：{tag}。相关歌词表达：{needles}。")
COMMENTS = LabelSet("comment_semantic", tuple(vocab.COMMENT_RULES), 0.03, "评论语义标签：{tag}。相关表达：{needles}。")


def label_descriptions(labels: LabelSet) -> list[str]:
    """One describing sentence per label, the text a label vector is made from."""
    return [labels.description.format(tag=tag, needles="、".join(needles)) for tag, needles in labels.rules]


def label_scores(vector: str, label_vectors: Column | Sequence[Sequence[float]]) -> Column:
    """Similarity of a unit vector to each label vector: one literal, or a column (``arrays.matrix_of``)."""
    table = label_vectors if isinstance(label_vectors, Column) else arrays.constant_matrix(label_vectors)
    return F.transform(table, lambda row: arrays.dot(row, vector))


def accepted(scores: Column | str, labels: LabelSet) -> Column:
    """(label, score) structs of the best labels above the threshold and near the best one."""
    names = F.array(*[F.lit(tag) for tag, _needles in labels.rules])
    ranked = arrays.top_labels(scores, names, labels.max_tags)
    best = F.array_max(text.col(scores))
    return F.filter(
        ranked, lambda item: (item["score"] >= labels.threshold) & (best - item["score"] <= labels.margin)
    )


def label_texts(
    df: DataFrame, labels: LabelSet, scores: str, content: str, model: str = "hashing-trigrams",
    keyword_fallback: bool = True, key: str = "song_id",
) -> DataFrame:
    """(song_id, X_tags, X_scores, X_model, X_error) from a column of label scores per text."""
    staged = df.withColumns(
        {
            "_accepted": F.when(~text.is_blank(content), accepted(scores, labels)),
            "_fallback": text.matching_tags(F.lower(text.safe_raw(content)), labels.rules),
        }
    )
    by_model = F.coalesce(F.transform("_accepted", lambda item: item["label"]), F.array().cast("array<string>"))
    shown = F.transform("_accepted", lambda item: text.score_text(item["label"], item["score"]))
    fell_back = F.lit(keyword_fallback) & (F.size(by_model) == 0) & (F.size("_fallback") > 0) & ~text.is_blank(content)
    tags = F.when(fell_back, F.col("_fallback")).otherwise(by_model)
    return staged.select(
        key,
        F.array_join(arrays.unique_items(tags), " | ").alias(f"{labels.prefix}_tags"),
        F.coalesce(F.array_join(shown, " | "), F.lit("")).alias(f"{labels.prefix}_scores"),
        F.lit(model).alias(f"{labels.prefix}_model"),
        F.when(fell_back, "model_low_confidence_keyword_fallback").otherwise("").alias(f"{labels.prefix}_error"),
    )


def label_by_similarity(
    df: DataFrame, labels: LabelSet, content: str,
    make_encoder: Callable[[], Callable] = udfs.hashing_encoder, model: str = "hashing-trigrams",
    keyword_fallback: bool = True, key: str = "song_id",
) -> DataFrame:
    """Encode the texts in Arrow batches, compare with the label vectors there, keep accepted labels."""
    # A handful of label sentences are encoded once, where the job is defined.
    vectors = make_encoder()(label_descriptions(labels))
    scored = df.withColumn("_scores", udfs.encoded_scores(content, vectors, make_encoder))
    return label_texts(scored, labels, "_scores", content, model, keyword_fallback, key)
