"""Weighted, explainable scores over the long feature table."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import text
from tonearm.operators import features

SCALES = {feature: scale for feature, _column, _label, scale in vocab.SCORED_FEATURES}
LABELS = {feature: label for feature, _column, label, _scale in vocab.SCORED_FEATURES}


def base_score(count: Column | str) -> Column:
    return F.log1p(text.col(count)) * 10.0


def weight_rows(weights: Mapping[str, Mapping[str, float]]) -> list[tuple[str, str, float]]:
    """User weights by feature as (feature, item, weight) rows.

    The key ``tags`` stands for the one map shared by the seven tag features. Weights are typed by
    a user, so the list is small by nature and is given to Spark as a constant.
    """
    rows = []
    for feature in SCALES:
        shared = weights.get("tags", {}) if feature in vocab.TAG_WEIGHT_FEATURES else {}
        rows += [(feature, item, float(w)) for item, w in {**shared, **weights.get(feature, {})}.items()]
    return rows


def item_weight(weights: Mapping[str, Mapping[str, float]], default: float = 1.0) -> Column:
    """Weight of (feature, item): one constant map look-up per row, no join."""
    rows = weight_rows(weights)
    if not rows:
        return F.lit(default)
    entries = chain.from_iterable(
        (F.lit(f"{feature}\n{item}"), F.lit(weight)) for feature, item, weight in rows
    )
    key = F.concat_ws("\n", "feature", "item")
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def multi_feature_scores(
    rows: DataFrame,
    counts: DataFrame,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    key: str = "song_id",
) -> DataFrame:
    """(key, feature, score): sum of base x weight over the list, over the root of its length."""
    counted = features.attach_counts(rows, counts, key)
    points = base_score(F.coalesce("cnt", F.lit(0))) * item_weight(weights or {})
    return counted.groupBy(key, "feature").agg(
        (F.sum(points) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("score")
    )


def single_feature_score(
    rows: DataFrame,
    counts: DataFrame,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    key: str = "song_id",
) -> DataFrame:
    """Base x weight of a scalar feature (one row per key and feature)."""
    counted = features.attach_counts(rows, counts, key)
    points = base_score(F.coalesce("cnt", F.lit(0))) * item_weight(weights or {})
    return counted.select(key, "feature", "item", points.alias("score"))


def numeric_parts(df: DataFrame) -> dict[str, Column]:
    """The six non-list parts of the score, before dimension weights; maxima are taken over ``df``."""
    scale = dict(vocab.NUMERIC_PARTS)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    def present(name: str) -> Column:
        return flag(F.length(text.safe_raw(name)) > 0) if name in df.columns else F.lit(0.0)

    parts = [
        features.max_scale("popularity", df),
        features.max_scale("lyric_line_count", df),
        flag(F.col("quality").isin(vocab.HIGH_QUALITY)),
        flag(F.col("playable")),
        present("local_audio_path"),
        present("mert_embedding_path"),
    ]
    return {label: part * scale[label] for (label, _scale), part in zip(vocab.NUMERIC_PARTS, parts)}


def feature_part_columns(
    rows: DataFrame,
    counts: DataFrame,
    weights: Mapping[str, Mapping[str, float]],
    dimension_weights: Mapping[str, float],
    bonus: DataFrame | None = None,
    key: str = "song_id",
) -> DataFrame:
    """One row per key with a column per list feature, and the history sum if a bonus is given.

    One counter look-up and one aggregation by key serve all twelve features.
    """
    lookup = counts
    if bonus is not None:
        lookup = counts.join(bonus.select("feature", "item", "bonus"), ["feature", "item"], "left")
    based = features.attach_counts(rows, lookup, key)
    points = base_score(F.coalesce("cnt", F.lit(0))) * item_weight(weights)
    sums = []
    for feature in SCALES:
        mine = F.col("feature") == feature
        length = F.sqrt(F.count(F.when(mine, 1)).cast("double"))
        scale = float(dimension_weights.get(LABELS[feature], 1.0))
        scored = F.sum(F.when(mine, points)) / length * scale * SCALES[feature]
        sums.append(F.coalesce(scored, F.lit(0.0)).alias(f"points_{feature}"))
        if bonus is not None:
            liked = F.sum(F.when(mine, F.coalesce("bonus", F.lit(0.0)))) / length * SCALES[feature]
            sums.append(F.coalesce(liked, F.lit(0.0)).alias(f"history_{feature}"))
    scored = based.groupBy(key).agg(*sums)
    if bonus is None:
        return scored
    history = sum((F.col(f"history_{feature}") for feature in SCALES), F.lit(0.0))
    return scored.withColumn("history", history).drop(*[f"history_{feature}" for feature in SCALES])


def breakdown(parts: list[tuple[str, Column]]) -> Column:
    """The five largest parts as ``label:0.0`` text; parts below 0.1 are dropped afterwards."""
    ranked = F.sort_array(
        F.array(
            *[
                F.struct((-value).alias("minus"), F.lit(order).alias("order"), F.lit(label).alias("label"))
                for order, (label, value) in enumerate(parts)
            ]
        )
    )
    top = F.filter(F.slice(ranked, 1, 5), lambda part: F.abs(part["minus"]) >= 0.1)
    return F.array_join(
        F.transform(top, lambda part: text.score_text(part["label"], -part["minus"], "0.0")), " | "
    )


def dynamic_score(
    df: DataFrame,
    rows: DataFrame,
    counts: DataFrame,
    dimension_weights: Mapping[str, float] = vocab.DEFAULT_DIMENSION_WEIGHTS,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    bonus: DataFrame | None = None,
    history_weight: float = 0.0,
    key: str = "song_id",
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Add ``dynamic_score_raw``, ``dynamic_score`` and ``score_breakdown`` to catalogue rows.

    ``counts`` comes from the whole catalogue, and so do the maxima: ``catalog`` is the whole one if
    ``df`` is filtered. ``bonus`` is the history preference, left out when its weight is zero.
    """
    use_history = bonus is not None and float(history_weight) != 0.0
    lists = feature_part_columns(
        rows, counts, weights or {}, dimension_weights, bonus if use_history else None, key
    )
    scored = df.join(lists, key, "left")
    parts = [(LABELS[feature], F.coalesce(F.col(f"points_{feature}"), F.lit(0.0))) for feature in SCALES]
    for label, value in numeric_parts(catalog if catalog is not None else df).items():
        parts.append((label, value * float(dimension_weights.get(label, 1.0))))
    if use_history:
        parts.append((vocab.HISTORY_PART, F.coalesce(F.col("history"), F.lit(0.0)) * float(history_weight)))
    named = [(label, f"_part{order}", value) for order, (label, value) in enumerate(parts)]
    scored = scored.withColumns({name: value for _label, name, value in named})
    total = sum((F.col(name) for _label, name, _value in named), F.lit(0.0))
    result = scored.withColumns(
        {
            "dynamic_score_raw": total,
            "dynamic_score": F.rint(total).cast("long"),
            "score_breakdown": breakdown([(label, F.col(name)) for label, name, _value in named]),
        }
    )
    return result.drop(*[f"points_{feature}" for feature in SCALES], "history", *[name for _label, name, _value in named])
