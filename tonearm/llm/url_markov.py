"""URL filter: variable-order Markov models of accepted and rejected URLs, and host and path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import materialize

ORDER = 4
# A gram is common if it makes up at least one in so many places of the URLs; so no more than this many
# are, whatever the input. Common ones are broadcast to the places, all others are joined by a shuffle.
KEPT = 50_000
PRIOR = 4.0  # places that the next shorter context counts for
ALPHABET = 256
BINS = 400  # of the calibration, over score differences of -4 to 4 a character
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
_START, _END = "\u0002", "\u0003"


def _capitals(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null and where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return _capitals(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a domain above it) and the path's start, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _places(urls: DataFrame, *columns: str) -> DataFrame:
    """A row for every place of a URL with the ORDER characters before it and its own; digits are alike."""
    text = F.concat(F.lit(_START * ORDER), F.translate("url", "0123456789", "0" * 10), F.lit(_END))
    spelt = urls.select(*columns, text.alias("spelt"))
    return spelt.select(*columns, "spelt", F.explode(F.sequence(F.lit(1), F.length("spelt") - ORDER)).alias("at")).select(
        *columns, F.substring("spelt", F.col("at"), F.lit(ORDER + 1)).alias("gram"))


def gains(grams: DataFrame) -> DataFrame:
    """gram and gain, log p(rejected) - log p(accepted) of its last character, for each row of grams (gram, good, bad).

    A model's probability of a character mixes the contexts of 0 to ORDER characters: each counts
    with its places, and the next shorter one with PRIOR. A context that is not known adds nothing.
    Every string is counted. The joins go from a string to the one without its first character, and from
    one to all with another last character, so a key has at most as many rows as there are characters.
    """
    levels = [grams.select(F.col("gram").alias("string"), "good", "bad")]
    for n in range(ORDER, 0, -1):
        levels.insert(0, levels[0].groupBy(F.substring("string", 2, n).alias("string")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    whole = levels[0].agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()

    def share(side: str, shorter: Column | float, before: Column) -> Column:
        return (F.col(side) + PRIOR * shorter) / (before + PRIOR)

    even = F.lit(1.0 / ALPHABET)
    known = levels[0].select("string", *[share(side, even, F.lit(whole[side] or 0)).alias(f"p_{side}") for side in ("good", "bad")])
    for n in range(1, ORDER + 1):
        same = Window.partitionBy(F.substring("string", 1, n))
        rows = levels[n].select("string", "good", "bad", F.sum("good").over(same).alias("before_good"), F.sum("bad").over(same).alias("before_bad"))
        shorter = known.select(F.col("string").alias("shorter"), "p_good", "p_bad")
        known = rows.join(shorter, F.substring("string", 2, n) == F.col("shorter")).select(
            "string", *[share(side, F.col(f"p_{side}"), F.col(f"before_{side}")).alias(f"p_{side}") for side in ("good", "bad")])
    return known.select(F.col("string").alias("gram"), (F.log("p_bad") - F.log("p_good")).alias("gain"))


def scores(urls: DataFrame) -> DataFrame:
    """id and score of urls (id, url, good, bad): the mean gain over the places of a URL."""
    grams = materialize(_places(urls, "good", "bad").groupBy("gram").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    known = materialize(gains(grams).join(grams.select("gram", "n"), "gram"))
    least = (grams.agg(F.sum("n")).first()[0] or 0) / KEPT
    common, rare = known.where(F.col("n") >= least).select("gram", "gain"), known.where(F.col("n") < least).select("gram", F.col("gain").alias("rare_gain"))
    # At most KEPT rows are common; each of the others has less than a KEPT-th of all places.
    rows = _places(urls, "id").join(F.broadcast(common), "gram", "left")
    parts = rows.where("gain is not null").select("id", "gain")
    if not rare.isEmpty():
        parts = parts.unionByName(rows.where("gain is null").select("id", "gram").join(rare.hint("shuffle_merge"), "gram").select("id", F.col("rare_gain").alias("gain")))
    return parts.groupBy("id").agg(F.avg("gain").alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """The score that best parts (score, good, bad) rows: the highest mean of both classes' shares on their side.

    None if either class is missing.
    """
    width = 8.0 / BINS
    place = F.least(F.greatest(F.floor((F.col("score") + 4) / width), F.lit(0)), F.lit(BINS - 1))
    bins = scored.groupBy(place.alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    edges = bins.select("good", "bad", "bin", F.explode(F.sequence(F.lit(0), F.lit(BINS))).alias("edge"))
    below = F.col("bin") < F.col("edge")
    sides = edges.groupBy("edge").agg(
        F.sum(F.when(below, F.col("good")).otherwise(0)).alias("good_below"), F.sum(F.when(below, 0).otherwise(F.col("bad"))).alias("bad_above"),
        F.sum("good").alias("good"), F.sum("bad").alias("bad")).where("good > 0 and bad > 0")
    value = F.round(F.col("good_below") / F.col("good") + F.col("bad_above") / F.col("bad"), 12)
    # The middle of the best edges.
    best = sides.groupBy(value.alias("value")).agg(((F.min("edge") + F.max("edge")) / 2).alias("edge")).orderBy(F.desc("value")).first()
    return None if best is None else best.edge * width - 4


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url).

    The longest rule that fits decides. Where none does, ``verdict`` is ``block`` if the URL's score
    is above the calibrated threshold. The models learn from the URLs that rules decide: allowed ones are
    the accepted, blocked ones the rejected; the threshold is the one that parts these best.

    A null URL has empty host and path, no rule, score null and is allowed. So is all that no rule decides if rules
    allow none or block none. Empty and very long URLs are scored whole. Repeated rows stay, and count
    each in learning; a null page_id stays null. Other columns are not looked at, and an empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, word = matching(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": word})
    urls = rows.where("url is not null").groupBy("url").agg(
        F.count_if(F.col("decided") == "allow").alias("good"), F.count_if(F.col("decided") == "block").alias("bad"))
    urls = materialize(urls.withColumn("id", F.monotonically_increasing_id()))
    scored = materialize(scores(urls).join(urls, "id").select("url", "score", "good", "bad"))
    bound = threshold(scored.where("good + bad > 0"))
    method = F.when(F.col("score") > F.lit(bound), "block").otherwise("allow") if bound is not None else F.lit("allow")
    return rows.join(scored.select("url", "score"), "url", "left").select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "score")


def judge_sql(pages: str = "pages") -> str:
    """The same as SQL, with the score to six digits."""
    capitals = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{s}')" for _, d, s in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r[1] + r[2]}'" for f, r in zip(fits, ordered)) + " END"
    decided = "CASE " + " ".join(f"WHEN {f} THEN '{r[0]}'" for f, r in zip(fits, ordered)) + " END"
    span, width = ORDER + 1, 8.0 / BINS
    strings = " UNION ALL ".join(
        f"SELECT right(gram, {n + 1}) AS string, 0 AS ahead, good, bad FROM grams UNION ALL SELECT right(left(gram, {ORDER}), {n}), 1, good, bad FROM grams"
        for n in range(span))
    joins = " ".join(
        f"LEFT JOIN model o{n} ON o{n}.ahead = 0 AND o{n}.string = right(p.gram, {n + 1}) LEFT JOIN model b{n} ON b{n}.ahead = 1 AND b{n}.string = right(left(p.gram, {ORDER}), {n})"
        for n in range(span))
    chance = {}
    for side in ("good", "bad"):
        chance[side] = f"(1.0::DOUBLE / {ALPHABET})"
        for n in range(span):
            chance[side] = f"((coalesce(o{n}.{side}, 0) + {PRIOR} * {chance[side]}) / (coalesce(b{n}.{side}, 0) + {PRIOR}))"
    spelt = f"repeat(chr(2), {ORDER}) || translate(url, '0123456789', '0000000000') || chr(3)"
    return f"""
    WITH rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}),
    parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {capitals}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    ruled AS MATERIALIZED (SELECT *, {rule} AS rule, {decided} AS decided FROM parts),
    urls AS MATERIALIZED (SELECT url, {spelt} AS spelt, count(*) FILTER (WHERE decided = 'allow') AS good, count(*) FILTER (WHERE decided = 'block') AS bad FROM ruled WHERE url IS NOT NULL GROUP BY url),
    places AS MATERIALIZED (SELECT url, good, bad, substr(spelt, place, {span}) AS gram FROM (SELECT *, unnest(range(1, length(spelt) - {ORDER} + 1)) AS place FROM urls)),
    grams AS (SELECT gram, sum(good) AS good, sum(bad) AS bad FROM places GROUP BY gram HAVING sum(good + bad) > 0),
    model AS MATERIALIZED (SELECT string, ahead, CAST(sum(good) AS DOUBLE) AS good, CAST(sum(bad) AS DOUBLE) AS bad FROM ({strings}) GROUP BY ALL),
    scored AS MATERIALIZED (SELECT url, avg(ln({chance['bad']}) - ln({chance['good']})) AS score FROM places p {joins} GROUP BY url),
    bins AS (SELECT least(greatest(floor((score + 4) / {width}), 0), {BINS - 1}) AS bin, sum(good) AS good, sum(bad) AS bad FROM scored JOIN urls USING (url) WHERE good + bad > 0 GROUP BY ALL),
    sides AS (SELECT edge, coalesce(sum(good) FILTER (WHERE bin < edge), 0) / sum(good) + coalesce(sum(bad) FILTER (WHERE bin >= edge), 0) / sum(bad) AS value
        FROM bins, range(0, {BINS + 1}) e(edge) GROUP BY edge HAVING sum(good) > 0 AND sum(bad) > 0),
    best AS (SELECT (min(edge) + max(edge)) / 2 * {width} - 4 AS bound FROM sides WHERE round(value, 12) = (SELECT max(round(value, 12)) FROM sides))
    SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score > (SELECT bound FROM best) THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score
    FROM ruled LEFT JOIN scored USING (url)"""
