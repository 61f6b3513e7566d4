"""Matching audio files to catalogue rows by fuzzy title / artist similarity, without a cross join.

A pair can only be accepted if its text score reaches a bound that follows from the threshold. The
score is a maximum and a weighted sum of three string ratios, so at least one ratio must reach a
bound of its own. For each such ratio candidates come from equi-joins on character-pair tokens
(prefix filter, rarest token first) and on anchors for the containment rule. Only candidates that
no simple rule decides reach the sequence-matching UDF.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import session
from tonearm.functions import numbers, text
from tonearm.functions.udfs import matching_blocks_ratio, ratio_at_least

# Score rules.
DEFAULT_THRESHOLD = 0.84
CONTAINED_RATIO, CONTAINED_LENGTH, LENGTH_SHARE = 0.92, 5, 0.42
COMBO_WEIGHT, TITLE_WEIGHT, ARTIST_WEIGHT = 0.95, 0.68, 0.32
ARTIST_FLOOR, COMBO_FLOOR, ARTIST_PENALTY = 0.45, 0.86, 0.82
TEXT_SHARE, DURATION_SHARE, DURATION_GATE, DURATION_PENALTY = 0.82, 0.18, 0.80, 0.88
DURATION_STEPS = ((3, 1.0), (8, 0.86), (20, 0.55))
LONG_GAP, SURE_SCORE = 20, 0.96

KEY = ["title_norm", "artist_norm", "combo_norm"]


# --- identities ------------------------------------------------------------------------------------


def catalog_variants(catalog: DataFrame, order: str = "row_order") -> DataFrame:
    """One row per (title or alias) x artist of a song, with comparison keys and its position."""
    artists = text.split_pipe("artist_names")
    artists = F.when(F.size(artists) > 0, artists).otherwise(F.array(text.safe_text("artist_names")))
    titles = F.concat(F.array(text.safe_text("name")), text.split_pipe("aliases"))
    titled = catalog.select(
        "song_id", text.safe_text("name").alias("name"), text.safe_text("artist_names").alias("artist_names"),
        "duration_seconds", F.col(order).alias("row_order"), artists.alias("_artists"),
        F.posexplode(titles).alias("title_pos", "_title"),
    ).where(F.col("_title") != "")
    paired = titled.select("*", F.posexplode("_artists").alias("artist_pos", "_artist")).drop("_artists")
    return paired.select(
        "song_id", "name", "artist_names", "duration_seconds", "row_order", "title_pos", "artist_pos",
        text.match_key("_title").alias("title_norm"),
        text.match_key("_artist").alias("artist_norm"),
        text.match_key(F.concat_ws(" ", "_artist", "_title")).alias("combo_norm"),
    )


def identity_variants(files: DataFrame) -> DataFrame:
    """Identities of a file: its metadata if titled, and its file name if that differs.

    ``files`` has file_path, stem, meta_title, meta_artist. One output row per identity with its
    position; the metadata identity comes first.
    """
    by_name = text.file_name_identity("stem")
    meta_title, meta_artist = text.safe_text("meta_title"), text.safe_text("meta_artist")

    def identity(source: str, artist: Column, title: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), artist.alias("artist"), title.alias("title"))

    named = files.withColumn("_name", by_name)
    name_identity = identity("filename", F.col("_name.artist"), F.col("_name.title"))
    meta_identity = identity("metadata", meta_artist, meta_title)
    same = (text.match_key(meta_artist) == text.match_key("_name.artist")) & (
        text.match_key(meta_title) == text.match_key("_name.title")
    )
    variants = (
        F.when(meta_title == "", F.array(name_identity))
        .when(same, F.array(meta_identity))
        .otherwise(F.array(meta_identity, name_identity))
    )
    return named.select("file_path", F.posexplode(variants).alias("identity_pos", "_v")).select(
        "file_path", "identity_pos",
        F.col("_v.source").alias("match_source"), F.col("_v.artist").alias("audio_artist"),
        F.col("_v.title").alias("audio_title"),
        text.match_key("_v.title").alias("title_norm"),
        text.match_key("_v.artist").alias("artist_norm"),
        text.match_key(F.concat_ws(" ", "_v.artist", "_v.title")).alias("combo_norm"),
    )


# --- scores ----------------------------------------------------------------------------------------


def _pairs_of_chars(value: Column) -> Column:
    return F.when(
        F.length(value) > 1,
        F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda at: F.substr(value, at, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))


def ratio_shortcut(left: str | Column, right: str | Column) -> Column:
    """Similarity where a simple rule decides it, else null."""
    a, b = text.col(left), text.col(right)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    contained = F.contains(a, b) | F.contains(b, a)
    ends_differ = (F.substring(a, 1, 1) != F.substring(b, 1, 1)) & (F.substring(a, -1, 1) != F.substring(b, -1, 1))
    a_pairs, b_pairs = _pairs_of_chars(a), _pairs_of_chars(b)
    unrelated = ends_differ & (shorter > 1) & ~F.arrays_overlap(a_pairs, b_pairs)
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when((shorter >= CONTAINED_LENGTH) & contained, CONTAINED_RATIO)
        .when(shorter / longer < LENGTH_SHARE, 0.0)
        .when(unrelated, 0.0)
    )


def with_ratio(df: DataFrame, left: str, right: str, name: str, bound: float | None = None) -> DataFrame:
    """Add the similarity of two text columns; decided pairs pass the UDF as nulls at no cost.

    With a ``bound`` similarities below it may come out as 0.
    """
    measure = matching_blocks_ratio if bound is None else ratio_at_least(bound)
    ruled = df.withColumn("_ruled", ratio_shortcut(left, right))
    open_left = F.when(F.col("_ruled").isNull(), F.col(left))
    open_right = F.when(F.col("_ruled").isNull(), F.col(right))
    return ruled.withColumn(name, F.coalesce("_ruled", measure(open_left, open_right))).drop("_ruled")


def match_score(title: str, artist: str, combo: str, artist_known: Column) -> Column:
    score = F.greatest(
        F.col(combo) * COMBO_WEIGHT, F.col(title) * TITLE_WEIGHT + F.col(artist) * ARTIST_WEIGHT
    )
    doubtful = artist_known & (F.col(artist) < ARTIST_FLOOR) & (F.col(combo) < COMBO_FLOOR)
    return F.when(doubtful, score * ARTIST_PENALTY).otherwise(score)


def duration_diff(local: str, catalog: str) -> Column:
    length = numbers.to_number(catalog, None)
    return F.when(F.col(local).isNotNull() & (length > 0), F.abs(F.col(local) - length))


def duration_score(diff: str | Column) -> Column:
    gap = text.col(diff)
    (near, best), (close, good), (far, fair) = DURATION_STEPS
    return F.when(gap <= near, best).when(gap <= close, good).when(gap <= far, fair).otherwise(0.0)


def text_gate(threshold: float) -> float:
    """Text score from which the duration is looked at."""
    return max(DURATION_GATE, (threshold - DURATION_SHARE) / TEXT_SHARE)


def adjusted_score(score: str, diff: str, threshold: float) -> Column:
    points = duration_score(diff)
    checked = (
        F.when(points > 0, F.col(score) * TEXT_SHARE + points * DURATION_SHARE)
        .when((F.col(diff) > LONG_GAP) & (F.col(score) < SURE_SCORE), F.col(score) * DURATION_PENALTY)
        .otherwise(F.col(score))
    )
    return F.when(F.col(score) >= text_gate(threshold), checked).otherwise(F.col(score))


# --- candidates ------------------------------------------------------------------------------------


def _pair_overlap(total: int, bound: float) -> int:
    """Fewest shared character pairs of two strings of ``total`` length with a ratio >= bound.

    With M matched characters at most total - 2M are unmatched and each gap between matching blocks
    costs one, so there are at most total - 2M + 1 blocks, and a block of length n has n - 1 pairs.
    """
    matched = math.ceil(bound * total / 2 - 1e-9)
    return total if 2 * matched > total else matched - (total - 2 * matched + 1)


def pairs_suffice(bound: float, longest: int = 400) -> bool:
    """Whether any two strings with a ratio >= bound must share a character pair."""
    # Two single characters only match if equal; they stand for themselves as tokens.
    return all(_pair_overlap(total, bound) >= 1 for total in range(3, longest)) and bound > 2 / 3


def _tokens(value: Column, by_pairs: bool) -> Column:
    """Characters or character pairs with their occurrence number, as one array."""
    units = _pairs_of_chars(value) if by_pairs else F.filter(F.split(value, ""), lambda unit: unit != "")
    ranked = F.array_sort(F.transform(units, lambda unit, at: F.struct(unit.alias("u"), at.alias("at"))))
    numbered = numbers.bind(
        ranked,
        lambda items: F.transform(
            items,
            lambda item, at: F.concat(
                item["u"], F.lit("\n"),
                (at - F.array_position(F.transform(items, lambda other: other["u"]), item["u"]) + 1).cast("string"),
            ),
        ),
    )
    # A single character has no pair: the string stands for itself.
    return F.when(F.lit(by_pairs) & (F.length(value) == 1), F.array(value)).otherwise(numbered)


def _prefix_length(size: Column, length: Column, bound: float, by_pairs: bool) -> Column:
    """How many of a string's tokens, rarest first, must be indexed so that no partner is missed."""
    if by_pairs:
        overlap = F.ceil(length * 2 / (2 - bound) * (1.5 * bound - 1) - 1 - 1e-9)
    else:
        overlap = F.ceil(length * bound / (2 - bound) - 1e-9)
    return size - F.greatest(overlap, F.lit(1)) + 1


def token_index(values: DataFrame, by_pairs: bool) -> DataFrame:
    """(token, df, value, size, place): every token of every string with its place among the string's tokens, rarest first.

    ``df`` is the number of strings that have the token. The index holds for any bound; it is stored, and both
    the search and the ranking of other strings' tokens read it.
    """
    rows = values.where(F.col("value") != "").select("value", _tokens(F.col("value"), by_pairs).alias("tokens"))
    rows = rows.select("value", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    weight = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return session.materialize(_placed(rows.join(weight, "token")))


def _placed(rows: DataFrame) -> DataFrame:
    ranked = rows.groupBy("value", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    return ranked.select("value", "size", F.posexplode("ranked").alias("at", "t")).select(
        F.col("t.token").alias("token"), F.col("t.df").alias("df"), "value", "size", (F.col("at") + 1).alias("place"))


def probe_tokens(values: DataFrame, index: DataFrame, by_pairs: bool) -> DataFrame:
    """Tokens of other strings in the order of the index, as it has them; tokens that it lacks are the rarest."""
    rows = values.where(F.col("value") != "").select("value", _tokens(F.col("value"), by_pairs).alias("tokens"))
    rows = rows.select("value", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    weight = index.groupBy("token").agg(F.first("df").alias("df"))
    ranked = rows.join(weight, "token", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    return session.materialize(_placed(ranked))


def prefix(index: DataFrame, bound: float, by_pairs: bool) -> DataFrame:
    """Rows of an index by which a string must be found so that no partner with a ratio >= ``bound`` is missed."""
    return index.where(F.col("place") <= _prefix_length(F.col("size"), F.length("value"), bound, by_pairs))


def _enough(l_len: Column, r_len: Column, bound: float, by_pairs: bool) -> Column:
    """Fewest shared tokens of two strings of these lengths with a ratio >= bound, 1 at least."""
    total = l_len + r_len
    matched = F.ceil(bound * total / 2 - 1e-9)
    return F.greatest(matched - (total - 2 * matched + 1) if by_pairs else matched, F.lit(1))


def _containment(short_side: DataFrame, long_side: DataFrame) -> DataFrame:
    """(short, long) strings where the first is part of the second, at least five characters long.

    The short string is looked up by its rarest five-character part among the parts of long strings.
    """
    n = CONTAINED_LENGTH

    def parts(df: DataFrame) -> DataFrame:
        grams = F.transform(
            F.sequence(F.lit(1), F.length("value") - (n - 1)), lambda at: F.substr("value", at, F.lit(n))
        )
        return df.where(F.length("value") >= n).select("value", F.explode(F.array_distinct(grams)).alias("gram"))

    long_parts = parts(long_side)
    weight = long_parts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    anchors = parts(short_side).join(weight, "gram").groupBy("value").agg(
        F.min_by("gram", F.struct("df", "gram")).alias("gram")
    )
    pairs = anchors.select(F.col("value").alias("short"), "gram").join(
        long_parts.withColumnRenamed("value", "long"), "gram"
    )
    return pairs.where(F.contains("long", F.col("short"))).select("short", "long")


def similar_strings(left: DataFrame, right: DataFrame, probes: DataFrame, index: DataFrame, bound: float, by_pairs: bool) -> DataFrame:
    """(l, r) candidate pairs of distinct strings: a superset of those with similarity >= bound.

    Strings meet on a token of both prefixes if their lengths allow the bound and if enough tokens are left: of the first token
    that they share, at most it and the tokens behind it on either side can be shared.
    """
    share = bound / (2 - bound)
    l_len, r_len = F.length("l"), F.length("r")
    l_rows = prefix(probes, bound, by_pairs).select("token", F.col("value").alias("l"), (F.col("size") - F.col("place")).alias("l_rest"))
    r_rows = prefix(index, bound, by_pairs).select("token", F.col("value").alias("r"), (F.col("size") - F.col("place")).alias("r_rest"))
    found = (
        l_rows.join(r_rows, "token")
        .where(F.least(l_len, r_len) >= F.greatest(l_len, r_len) * (share - 1e-9))
        .where(1 + F.least("l_rest", "r_rest") >= F.when((l_len == 1) | (r_len == 1), 1).otherwise(_enough(l_len, r_len, bound, by_pairs)))
        .select("l", "r")
    )
    if CONTAINED_RATIO >= bound:
        inner = _containment(left, right).select(F.col("short").alias("l"), F.col("long").alias("r"))
        outer = _containment(right, left).select(F.col("long").alias("l"), F.col("short").alias("r"))
        found = found.unionByName(inner).unionByName(outer)
    return _distinct_pairs(found, "l", "r")


def _distinct_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs of strings, in a fixed number of tasks.

    The measure that follows is heavy for the size of its input: adaptive coalescing by bytes would leave it to a few tasks.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select(left, right).repartition(tasks, left, right).distinct()


def rate_strings(pairs: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Add the similarity of two columns, computed once per distinct pair of strings.

    Titles and artists repeat over many pairs; the distinct step reduces them before any shuffle.
    """
    rated = with_ratio(_distinct_pairs(pairs, left, right), left, right, name)
    return pairs.join(rated, [left, right])


def candidate_pairs(file_keys: DataFrame, catalog_keys: DataFrame, threshold: float) -> DataFrame:
    """(file key, catalogue key, title_score, artist_score) that may reach the threshold, each once."""
    bound = min(threshold, text_gate(threshold))
    title_bound = (bound - ARTIST_WEIGHT) / TITLE_WEIGHT
    if title_bound <= 0:
        raise ValueError("the threshold is too low for candidate search")
    f_keys = file_keys.select(*[F.col(name).alias(f"f_{name}") for name in KEY])
    c_keys = catalog_keys.select(*[F.col(name).alias(f"c_{name}") for name in KEY])
    columns = [*f_keys.columns, *c_keys.columns, "title_score", "artist_score"]

    def values(keys: DataFrame, name: str) -> DataFrame:
        return session.materialize(keys.select(F.col(name).alias("value")).where(F.col("value") != "").distinct())

    f_values, c_values = ({name: values(keys, f"{side}_{name}") for name in KEY} for side, keys in (("f", f_keys), ("c", c_keys)))

    def related(field: str, at_least: float, score: str) -> DataFrame:
        """Distinct strings of a field on both sides whose similarity reaches a bound, stored."""
        by_pairs = pairs_suffice(at_least)
        index = token_index(c_values[field], by_pairs)
        probes = probe_tokens(f_values[field], index, by_pairs)
        found = similar_strings(f_values[field], c_values[field], probes, index, at_least, by_pairs)
        rated = with_ratio(found, "l", "r", score, at_least - 1e-9).where(F.col(score) >= at_least - 1e-9)
        return session.materialize(rated.withColumnsRenamed({"l": f"f_{field}", "r": f"c_{field}"}))

    def reaching(pairs: DataFrame) -> DataFrame:
        weighted = F.col("title_score") * TITLE_WEIGHT + F.col("artist_score") * ARTIST_WEIGHT
        return pairs.where(weighted >= bound - 1e-9).select(*columns)

    # The combined text is similar enough by itself.
    combos = related("combo_norm", bound / COMBO_WEIGHT, "combo_score").drop("combo_score")
    by_combo = f_keys.join(combos, "f_combo_norm").join(c_keys, "c_combo_norm")
    by_combo = rate_strings(by_combo, "f_title_norm", "c_title_norm", "title_score")
    by_combo = rate_strings(by_combo, "f_artist_norm", "c_artist_norm", "artist_score").select(*columns)

    # In the weighted sum the larger of title and artist reaches the bound itself. First the title:
    titles = related("title_norm", bound, "title_score")
    by_title = f_keys.join(titles, "f_title_norm").join(c_keys, "c_title_norm")
    if bound > TITLE_WEIGHT:  # a title alone cannot reach the bound
        by_title = by_title.where((F.col("f_artist_norm") != "") & (F.col("c_artist_norm") != ""))
    by_title = reaching(rate_strings(by_title, "f_artist_norm", "c_artist_norm", "artist_score"))

    # Then the artist: titles must still be related, so the pair meets on a title token as well.
    artists = related("artist_norm", bound, "artist_score")
    by_pairs = pairs_suffice(title_bound)
    index = token_index(c_values["title_norm"], by_pairs)
    probes = probe_tokens(f_values["title_norm"], index, by_pairs)
    f_tokens, c_tokens = (prefix(rows, title_bound, by_pairs).select("value", "token") for rows in (probes, index))
    # Title strings meet within related artists, and each pair of them is measured once.
    of_artist = f_keys.join(artists, "f_artist_norm")
    f_side = of_artist.select("f_title_norm", "c_artist_norm").distinct().join(f_tokens.withColumnRenamed("value", "f_title_norm"), "f_title_norm")
    c_side = c_keys.select("c_title_norm", "c_artist_norm").distinct().join(c_tokens.withColumnRenamed("value", "c_title_norm"), "c_title_norm")
    met = _distinct_pairs(f_side.join(c_side, ["c_artist_norm", "token"]), "f_title_norm", "c_title_norm")
    rated = with_ratio(met, "f_title_norm", "c_title_norm", "title_score", title_bound - 1e-9)
    alike = session.materialize(rated.where(F.col("title_score") >= title_bound - 1e-9))
    by_artist = reaching(of_artist.join(alike, "f_title_norm").join(c_keys, ["c_artist_norm", "c_title_norm"]))
    return by_combo.unionByName(by_title).unionByName(by_artist).distinct()


def fuzzy_match(
    files: DataFrame, catalog: DataFrame, threshold: float = DEFAULT_THRESHOLD, order: str = "row_order"
) -> DataFrame:
    """Best catalogue row per file at or above the threshold.

    ``files``: file_path, stem, meta_title, meta_artist, meta_album, duration (null if unknown) and
    duration_error. Equal scores go to the earliest catalogue row, title, artist and identity.
    """
    # The keys are made row by row with many regular expressions; a table of few splits is dealt out for that.
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Copies on either side are folded first: only distinct keys are compared.
    place = F.struct("row_order", "title_pos", "artist_pos")
    details = F.struct("song_id", "name", "artist_names", "duration_seconds", "row_order", "title_pos", "artist_pos")
    # Both key tables are read by every candidate path, so they are stored once.
    songs = session.materialize(
        catalog_variants(catalog.repartition(tasks, "song_id"), order).groupBy(*KEY).agg(F.min_by(details, place).alias("song"))
    )
    identities = session.materialize(identity_variants(files.repartition(tasks, "file_path")))
    keys = identities.select(*KEY).distinct()

    # An equal title and artist scores 1.0, which nothing can beat: the earliest such row is the
    # only candidate, and those keys take no part in the search.
    both = ["title_norm", "artist_norm"]
    song_place = F.struct(*[F.col("song")[name] for name in ("row_order", "title_pos", "artist_pos")])
    equal = songs.where((F.col("title_norm") != "") & (F.col("artist_norm") != "")).groupBy(*both).agg(
        F.min_by("combo_norm", song_place).alias("c_combo_norm")
    )
    exact = keys.join(equal, both).select(
        *[F.col(name).alias(f"f_{name}") for name in KEY],
        F.col("title_norm").alias("c_title_norm"), F.col("artist_norm").alias("c_artist_norm"), "c_combo_norm",
        F.lit(1.0).alias("title_score"), F.lit(1.0).alias("artist_score"),
    )
    searched = session.materialize(keys.join(equal.select(*both), both, "left_anti"))
    pairs = session.materialize(exact.unionByName(candidate_pairs(searched, songs, threshold)))

    scored = scored_pairs(pairs).where(F.col("score") >= min(threshold, text_gate(threshold)) - 1e-9)
    named = songs.withColumnsRenamed({name: f"c_{name}" for name in KEY})
    ranked = scored.join(named, [f"c_{name}" for name in KEY])
    best_by_key = _best(ranked, [f"f_{name}" for name in KEY], [])
    best_by_file = _best(
        identities.join(best_by_key.withColumnsRenamed({f"f_{name}": name for name in KEY}), KEY),
        ["file_path"], ["identity_pos", "match_source", "audio_title", "audio_artist"],
    )
    return _with_duration(best_by_file.join(files, "file_path"), threshold)


SCORES = ["score", "title_score", "artist_score", "combo_score"]


def _best(rows: DataFrame, by: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Highest score per group, then the earliest catalogue place, then the earliest identity."""
    earlier = [-F.col("song")[name] for name in ("row_order", "title_pos", "artist_pos")]
    earlier += [-F.col(name) for name in carried if name == "identity_pos"]
    best = F.max_by(F.struct("song", *SCORES, *carried), F.struct("score", *earlier))
    return rows.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Add the combined similarity and the text score to pairs with title and artist similarity."""
    rated = rate_strings(pairs, "f_combo_norm", "c_combo_norm", "combo_score")
    return rated.withColumn(
        "score", match_score("title_score", "artist_score", "combo_score", F.col("f_artist_norm") != "")
    )


MATCH_COLUMNS = """
file_path song_id name artist_names match_score match_reason match_source audio_title audio_artist
audio_album local_duration_seconds duration_diff_seconds duration_error
""".split()


def _with_duration(best: DataFrame, threshold: float) -> DataFrame:
    looked_at = F.col("score") >= text_gate(threshold)
    best = best.withColumn("local", F.when(looked_at, F.col("duration"))).withColumn(
        "catalog", F.col("song.duration_seconds")
    )
    best = best.withColumn("diff", duration_diff("local", "catalog"))
    parts = [("title", F.col("title_score")), ("artist", F.col("artist_score")), ("combo", F.col("combo_score"))]
    shown = [F.concat(F.lit(f"{name}="), text.decimals(value, "0.00")) for name, value in parts]
    timed = F.concat(F.lit("duration="), text.decimals(duration_score("diff"), "0.00"))
    matched = best.withColumn("final", adjusted_score("score", "diff", threshold)).where(F.col("final") >= threshold)
    return matched.select(
        "file_path", "song.song_id", "song.name", "song.artist_names",
        F.bround("final", 4).alias("match_score"),
        F.concat_ws(";", *shown, F.when(looked_at, timed)).alias("match_reason"),
        "match_source", "audio_title", "audio_artist",
        text.safe_text("meta_album").alias("audio_album"),
        F.bround("local", 3).alias("local_duration_seconds"),
        F.bround("diff", 3).alias("duration_diff_seconds"),
        F.when(looked_at, text.safe_raw("duration_error")).otherwise("").alias("duration_error"),
    )


def best_file_per_song(matches: DataFrame) -> DataFrame:
    """The file with the highest score per song, the smaller path on a tie."""
    rest = [name for name in matches.columns if name != "song_id"]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("match_score"), F.col("file_path")))
    return matches.groupBy("song_id").agg(best.alias("best")).select("song_id", "best.*").select(*matches.columns)
