"""The recommendation query: score, filter, optional similarity search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm import session, vocab
from tonearm.operators import features, filters, history, scoring, similarity
from tonearm.plans import feature_store


@dataclass(frozen=True)
class Request:
    """What a user sets: filters, weights, history. Defaults are the starting state."""

    keywords: str = ""
    lyric_keywords: str = ""
    artists: Sequence[str] = ()
    languages: Sequence[str] = ()
    tags: Sequence[str] = ()
    qualities: Sequence[str] = ()
    blocked_tags: Sequence[str] = ()
    playable_only: bool = True
    with_lyric_only: bool = False
    with_translation_only: bool = False
    min_popularity: float | None = None
    min_comments: float | None = None
    years: tuple[int, int] | None = None
    min_score: float | None = None
    dimension_weights: Mapping[str, float] = field(default_factory=lambda: dict(vocab.DEFAULT_DIMENSION_WEIGHTS))
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: {"tags": dict(vocab.INITIAL_TAG_WEIGHTS)})
    history_weight: float = 1.0
    top_k: int = vocab.SIMILARITY_TOP_K


SCORED_COLUMNS = """
song_id name artist_names album_name popularity comment_total lyric_line_count publish_year quality
playable has_lyric has_translation artist_list language_tags generated_tag_list local_audio_path
mert_embedding_path
""".split()


def passes(request: Request) -> Column:
    """The request's row filters as one condition over a preprocessed catalogue row."""
    return (
        filters.contains_all("search_text", request.keywords)
        & filters.contains_all(F.lower("full_lyric"), request.lyric_keywords)
        & filters.has_any("artist_list", request.artists)
        & filters.has_any("language_tags", request.languages)
        & filters.has_any("generated_tag_list", request.tags)
        & filters.is_in("quality", request.qualities)
        & filters.flags(request.playable_only, request.with_lyric_only, request.with_translation_only)
        & filters.ranges(request.min_popularity, request.min_comments, request.years)
    )


def recommend(
    wide: DataFrame,
    rows: DataFrame,
    counts: DataFrame,
    request: Request = Request(),
    liked: DataFrame | None = None,
    vectors: DataFrame | None = None,
    similar_to: DataFrame | Sequence[float] | None = None,
) -> DataFrame:
    """Scored rows that pass the request's filters, unsorted.

    ``wide``, ``rows`` and ``counts`` are the stored catalogue, long feature table and counters.
    Filters are evaluated next to the scan, so texts never reach a shuffle. With an explicit score
    threshold they also restrict what is scored; the default threshold depends on the scores of all
    rows that are not blocked, so then every such row is scored first.
    """
    kept = [name for name in SCORED_COLUMNS if name in wide.columns]
    flagged = passes(request) if "_passes" not in wide.columns else F.col("_passes")
    allowed = wide.where(filters.without_blocked("generated_tag_list", request.blocked_tags))
    candidates = allowed.select(*kept, flagged.alias("_passes"))
    if request.min_score is not None:
        candidates = candidates.where("_passes")
        rows = rows.join(candidates.select("song_id"), "song_id", "left_semi")
    bonus = None
    if liked is not None and request.history_weight > 0:
        bonus = history.rarity_bonus(liked, counts, request.dimension_weights)
    scored = scoring.dynamic_score(
        candidates, rows, counts, request.dimension_weights, request.weights, bonus, request.history_weight,
        catalog=wide,
    )
    result = filters.min_score(scored, request.min_score).where("_passes").drop("_passes")
    if similar_to is not None and vectors is not None:
        found = similarity.search_similar(vectors, similar_to, result.select("song_id"), request.top_k)
        result = similarity.attach_similarity(result, found)
    return result


def recommend_stored(spark: SparkSession, path: str, request: Request = Request(), **options) -> DataFrame:
    """As ``recommend`` on the tables that ``feature_store.refresh`` keeps at ``path``: no text is tagged or tokenised for a request."""
    return recommend(*feature_store.read(spark, path), request, **options)


def recommend_from(wide: DataFrame, request: Request = Request(), **options) -> DataFrame:
    """As ``recommend`` for a catalogue that is not stored yet.

    One pass over the texts evaluates the filters and the list features; that slim result is stored
    and serves the counters, the scores and the threshold.
    """
    lists = [name for name in features.FEATURE_COLUMNS.values() if name in wide.columns]
    kept = list(dict.fromkeys(name for name in (*SCORED_COLUMNS, *lists) if name in wide.columns))
    slim = session.materialize(wide.select(*kept, passes(request).alias("_passes")))
    rows = features.feature_rows(slim)
    return recommend(slim, rows, features.frequency_counts(rows), request, **options)
