"""File-to-song matching on part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators import matching
from tonearm.queries.registry import query, table


def catalog(spark, folder):
    """Songs: part names with brand and type as artists."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("song_id"), F.col("p_name").alias("name"),
        F.concat_ws(" | ", "p_brand", "p_type").alias("artist_names"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("The "), "p_name", F.lit(" (live)"))).otherwise("").alias("aliases"),
        (F.col("p_retailprice") / 10).alias("duration_seconds"), F.col("p_partkey").alias("row_order"))


def files(spark, folder):
    """Files: the same names with fixed perturbations, some with metadata."""
    part = table(spark, folder, "part")
    typo = F.regexp_replace(F.regexp_replace("p_name", "g", "gg"), "l", "I")
    kind = F.pmod(F.col("p_partkey"), F.lit(4))
    title = F.when(kind == 0, F.col("p_name")).when(kind == 1, typo).when(kind == 2, F.concat("p_name", F.lit(" remix"))).otherwise(F.reverse("p_name"))
    return part.select(
        F.concat(F.lit("/music/"), "p_partkey", F.lit(".flac")).alias("file_path"),
        F.concat("p_brand", F.lit(" - "), title).alias("stem"),
        F.when(F.col("p_size") % 3 == 0, typo).otherwise("").alias("meta_title"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("meta_artist"),
        F.lit("album").alias("meta_album"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") / 10 + F.col("p_size") - 20).alias("duration"),
        F.lit("").alias("duration_error"))


@query("catalog_variants", """
WITH titles AS (SELECT p_partkey, 0 AS title_pos, p_name AS title FROM part UNION ALL SELECT p_partkey, 1, 'The ' || p_name || ' (live)' FROM part WHERE p_size > 25),
artists AS (SELECT p_partkey, 0 AS artist_pos, p_brand AS artist FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS song_id, CAST(title_pos AS INTEGER) AS title_pos, CAST(artist_pos AS INTEGER) AS artist_pos,
  replace(replace(lower(title), '(live)', ''), ' ', '') AS title_norm, replace(lower(artist), '#', '') AS artist_norm,
  replace(replace(replace(lower(artist || ' ' || title), '(live)', ''), '#', ''), ' ', '') AS combo_norm
FROM titles JOIN artists USING (p_partkey)""")
def catalog_variants(spark, folder):
    return matching.catalog_variants(catalog(spark, folder)).select("song_id", "title_pos", "artist_pos", *matching.KEY)


@query("identity_variants", """
WITH f AS (SELECT p_partkey, p_brand AS file_artist, replace(replace(p_name, 'g', 'gg'), 'l', 'I') AS typo, p_size, p_type,
    CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(replace(p_name, 'g', 'gg'), 'l', 'I') WHEN 2 THEN p_name || ' remix' ELSE reverse(p_name) END AS file_title FROM part),
v AS (SELECT p_partkey, 'metadata' AS match_source, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS audio_artist, typo AS audio_title FROM f WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, 'filename', file_artist, file_title FROM f)
SELECT '/music/' || p_partkey || '.flac' AS file_path, match_source, audio_artist, audio_title, replace(lower(audio_title), ' ', '') AS title_norm,
  replace(lower(audio_artist), '#', '') AS artist_norm FROM v""")
def identity_variants(spark, folder):
    return matching.identity_variants(files(spark, folder)).select(
        "file_path", "match_source", "audio_artist", "audio_title", "title_norm", "artist_norm")


def _name_pairs(spark, folder):
    """Distinct pairs of part names within a brand."""
    part = table(spark, folder, "part")
    left = part.select(F.col("p_name").alias("l"), "p_brand")
    right = part.select(F.concat("p_name", F.when(F.col("p_size") > 25, " deluxe").otherwise("")).alias("r"), "p_brand")
    return left.distinct().join(right.distinct(), "p_brand").select("l", "r").distinct()


@query("match_shortcuts", """
WITH pairs AS (SELECT DISTINCT a.p_name AS l, b.p_name || CASE WHEN b.p_size > 25 THEN ' deluxe' ELSE '' END AS r FROM part a JOIN part b ON a.p_brand = b.p_brand),
tested AS (SELECT l, r, length(l) AS n, length(r) AS m,
  list_distinct(list_transform(range(1, length(l)), lambda i: substr(l, i, 2))) AS lb, list_distinct(list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) AS rb FROM pairs)
SELECT l, r, CASE WHEN l = r THEN 1.0 WHEN least(n, m) >= 5 AND (contains(l, r) OR contains(r, l)) THEN 0.92 WHEN least(n, m) / greatest(n, m) < 0.42 THEN 0.0
  WHEN l[1] <> r[1] AND l[-1] <> r[-1] AND NOT list_has_any(lb, rb) THEN 0.0 END AS ratio FROM tested""")
def match_shortcuts(spark, folder):
    return _name_pairs(spark, folder).withColumn("ratio", matching.ratio_shortcut("l", "r"))


@query("match_score", """
SELECT l_orderkey, round(CASE WHEN l_returnflag <> 'N' AND a < 0.45 AND c < 0.86 THEN s * 0.82 ELSE s END, 6) AS score FROM (
  SELECT *, greatest(0.95 * c, 0.68 * t + 0.32 * a) AS s FROM (SELECT l_orderkey, l_returnflag, l_quantity / 50 AS t, l_discount * 10 AS a, l_tax * 12 AS c FROM lineitem))""")
def match_score(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_returnflag", (F.col("l_quantity") / 50).alias("t"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 12).alias("c"))
    return items.select("l_orderkey", F.round(matching.match_score("t", "a", "c", F.col("l_returnflag") != "N"), 6).alias("score"))


@query("duration_score", """
SELECT l_orderkey, d, CASE WHEN d <= 3 THEN 1.0 WHEN d <= 8 THEN 0.86 WHEN d <= 20 THEN 0.55 ELSE 0.0 END AS points,
  round(CASE WHEN s < greatest(0.8, (0.84 - 0.18) / 0.82) THEN s WHEN d <= 20 THEN s * 0.82 + CASE WHEN d <= 3 THEN 1.0 WHEN d <= 8 THEN 0.86 ELSE 0.55 END * 0.18
    WHEN d > 20 AND s < 0.96 THEN s * 0.88 ELSE s END, 6) AS adjusted
FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE abs(l_quantity - 20.5) END AS d, 0.7 + l_discount * 3 AS s FROM lineitem)""")
def duration_score(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("local"), F.lit("20.5").alias("catalog"),
        (F.col("l_discount") * 3 + 0.7).alias("s"))
    timed = items.withColumn("d", matching.duration_diff("local", "catalog"))
    return timed.select("l_orderkey", "d", matching.duration_score("d").alias("points"),
                        F.round(matching.adjusted_score("s", "d", 0.84), 6).alias("adjusted"))


def ratio_sql(name: str, pairs: str) -> str:
    """Tables that end in ``{name}(l, r, ratio)``: the similarity of the pairs of strings in ``pairs`` (l, r).

    What no rule decides is matched by longest common blocks: the runs of equal characters of every pair, the earliest longest
    one within a segment, and the segments left and right of it, recursively.
    """
    return f"""{name}_ruled AS (
  SELECT l, r, CASE WHEN l = '' OR r = '' THEN 0.0 WHEN l = r THEN 1.0 WHEN least(n, m) >= 5 AND (contains(l, r) OR contains(r, l)) THEN 0.92 WHEN least(n, m) / greatest(n, m) < 0.42 THEN 0.0
    WHEN l[1] <> r[1] AND l[-1] <> r[-1] AND least(n, m) > 1 AND NOT list_has_any(lb, rb) THEN 0.0 END AS ruled FROM (
    SELECT l, r, length(l) AS n, length(r) AS m, list_transform(range(1, length(l)), lambda i: substr(l, i, 2)) AS lb, list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) AS rb
    FROM (SELECT DISTINCT l, r FROM {pairs}))),
{name}_equal AS (
  SELECT l, r, i, j, i - row_number() OVER (PARTITION BY l, r, i - j ORDER BY i) AS island FROM (
    SELECT l, r, i, unnest(range(1, length(r) + 1)) AS j FROM (SELECT l, r, unnest(range(1, length(l) + 1)) AS i FROM {name}_ruled WHERE ruled IS NULL))
  WHERE l[i] = r[j]),
{name}_runs AS (SELECT l, r, i, j, max(i) OVER (PARTITION BY l, r, i - j, island) - i + 1 AS len FROM {name}_equal),
{name}_segments(l, r, a, b, c, d) AS (
  SELECT l, r, 1::BIGINT, length(l) + 1, 1::BIGINT, length(r) + 1 FROM {name}_ruled WHERE ruled IS NULL
  UNION ALL
  SELECT l, r, (s[1])::BIGINT, s[2], s[3], s[4] FROM (
    SELECT l, r, unnest([[a, best.i, c, best.j], [best.i + best.k, b, best.j + best.k, d]]) AS s FROM (
      SELECT l, r, a, b, c, d, arg_max({{'i': i, 'j': j, 'k': k}}, k * 1000000 - i * 1000 - j) AS best FROM (
        SELECT s.*, i, j, least(len, b - i, d - j) AS k FROM {name}_segments s JOIN {name}_runs u ON s.l = u.l AND s.r = u.r AND i >= a AND i < b AND j >= c AND j < d)
      GROUP BY ALL))
  WHERE s[1] < s[2] AND s[3] < s[4]),
{name}_blocks AS (
  SELECT l, r, sum(k) AS matched FROM (
    SELECT s.l, s.r, a, b, c, d, max(least(len, b - i, d - j)) AS k FROM {name}_segments s JOIN {name}_runs u ON s.l = u.l AND s.r = u.r AND i >= a AND i < b AND j >= c AND j < d GROUP BY ALL) GROUP BY l, r),
{name} AS (SELECT l, r, coalesce(ruled, 2.0 * coalesce(matched, 0) / (length(l) + length(r))) AS ratio FROM {name}_ruled LEFT JOIN {name}_blocks USING (l, r))"""


CATALOG_KEYS_SQL = """titles AS (SELECT p_partkey, 0 AS title_pos, p_name AS title FROM part UNION ALL SELECT p_partkey, 1, 'The ' || p_name || ' (live)' FROM part WHERE p_size > 25),
artists AS (SELECT p_partkey, 0 AS artist_pos, p_brand AS artist FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part),
variants AS (SELECT p_partkey, title_pos, artist_pos, replace(replace(lower(title), '(live)', ''), ' ', '') AS ct, replace(lower(artist), '#', '') AS ca,
  replace(replace(replace(lower(artist || ' ' || title), '(live)', ''), '#', ''), ' ', '') AS cc FROM titles JOIN artists USING (p_partkey)),
songs AS (SELECT ct, ca, cc, min([p_partkey, title_pos, artist_pos]) AS place FROM variants GROUP BY ALL)"""

FILE_KEYS_SQL = """f AS (SELECT p_partkey, p_brand AS file_artist, replace(replace(p_name, 'g', 'gg'), 'l', 'I') AS typo, p_size, p_type,
    CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(replace(p_name, 'g', 'gg'), 'l', 'I') WHEN 2 THEN p_name || ' remix' ELSE reverse(p_name) END AS file_title FROM part),
identities AS (SELECT *, replace(lower(audio_title), ' ', '') AS ft, replace(lower(audio_artist), '#', '') AS fa, replace(replace(lower(audio_artist || audio_title), '#', ''), ' ', '') AS fc FROM (
  SELECT p_partkey, 0 AS pos, 'metadata' AS match_source, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS audio_artist, typo AS audio_title FROM f WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END, 'filename', file_artist, file_title FROM f)),
keys AS (SELECT DISTINCT ft, fa, fc FROM identities)"""

# Characters that two strings have in common bound their matched blocks; pairs below the bound are no candidates.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _counts(value: str) -> str:
    return "[" + ", ".join(f"length({value}) - length(replace({value}, '{letter}', ''))" for letter in LETTERS) + "]"


FUZZY_SQL = "WITH RECURSIVE " + CATALOG_KEYS_SQL + ", " + FILE_KEYS_SQL + ", " + f"""
title_pairs AS (SELECT DISTINCT ft AS l, ct AS r FROM (SELECT DISTINCT ft FROM keys), (SELECT DISTINCT ct FROM songs)),
artist_pairs AS (SELECT DISTINCT fa AS l, ca AS r FROM (SELECT DISTINCT fa FROM keys), (SELECT DISTINCT ca FROM songs)),
{ratio_sql("title_ratio", "title_pairs")},
{ratio_sql("artist_ratio", "artist_pairs")},
fcount AS (SELECT fc, {_counts("fc")} AS fn FROM (SELECT DISTINCT fc FROM keys)), ccount AS (SELECT cc, {_counts("cc")} AS cn FROM (SELECT DISTINCT cc FROM songs)),
hopeful AS (SELECT fc, cc FROM fcount, ccount WHERE contains(fc, cc) OR contains(cc, fc)
  OR 2 * list_sum(list_transform(list_zip(fn, cn), lambda p: least(p[1], p[2]))) >= 0.847 * (length(fc) + length(cc))),
rated AS (SELECT ft, fa, fc, ct, ca, cc, place, t.ratio AS title_score, a.ratio AS artist_score FROM keys JOIN title_ratio t ON t.l = ft JOIN songs ON ct = t.r JOIN artist_ratio a ON a.l = fa AND a.r = ca
  WHERE 0.68 * t.ratio + 0.32 * a.ratio >= 0.8 OR (fc, cc) IN (SELECT (fc, cc) FROM hopeful)),
combo_pairs AS (SELECT DISTINCT fc AS l, cc AS r FROM rated),
{ratio_sql("combo_ratio", "combo_pairs")},
scored AS (SELECT *, CASE WHEN fa <> '' AND artist_score < 0.45 AND combo_score < 0.86 THEN s * 0.82 ELSE s END AS score FROM (
  SELECT rated.*, ratio AS combo_score, greatest(0.95 * ratio, 0.68 * title_score + 0.32 * artist_score) AS s FROM rated JOIN combo_ratio ON l = fc AND r = cc)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, place, pos) AS rn FROM identities JOIN scored USING (ft, fa, fc) WHERE score >= 0.84 - 0.04),
best AS (SELECT i.*, s.p_name AS name, s.p_brand || ' | ' || s.p_type AS artist_names, s.p_partkey AS song, score >= 0.66 / 0.82 AS timed,
    CASE WHEN score >= 0.66 / 0.82 AND q.p_size % 5 <> 0 THEN q.p_retailprice / 10 + q.p_size - 20 END AS local, s.p_retailprice / 10 AS length
  FROM ranked i JOIN part s ON s.p_partkey = place[1] JOIN part q ON q.p_partkey = i.p_partkey WHERE rn = 1),
measured AS (SELECT *, CASE WHEN length > 0 THEN abs(local - length) END AS diff FROM best),
pointed AS (SELECT *, CASE WHEN diff <= 3 THEN 1.0 WHEN diff <= 8 THEN 0.86 WHEN diff <= 20 THEN 0.55 ELSE 0.0 END AS points FROM measured),
adjusted AS (SELECT *, CASE WHEN NOT timed THEN score WHEN points > 0 THEN score * 0.82 + points * 0.18 WHEN diff > 20 AND score < 0.96 THEN score * 0.88 ELSE score END AS final FROM pointed)
SELECT '/music/' || p_partkey || '.flac' AS file_path, CAST(song AS VARCHAR) AS song_id, name, artist_names, round(final, 4) AS match_score,
  printf('title=%.2f;artist=%.2f;combo=%.2f', title_score::DOUBLE, artist_score::DOUBLE, combo_score::DOUBLE) || CASE WHEN timed THEN printf(';duration=%.2f', points::DOUBLE) ELSE '' END AS match_reason,
  match_source, audio_title, audio_artist, 'album' AS audio_album, round(local, 3) AS local_duration_seconds, round(diff, 3) AS duration_diff_seconds, '' AS duration_error
FROM adjusted WHERE final >= 0.84"""



@query("match_ratio", "WITH RECURSIVE pairs AS (SELECT DISTINCT a.p_name AS l, b.p_name || CASE WHEN b.p_size > 25 THEN ' deluxe' ELSE '' END AS r FROM part a JOIN part b ON a.p_brand = b.p_brand), "
       + ratio_sql("found", "pairs") + " SELECT l, r, round(ratio, 9) AS ratio FROM found")
def match_ratio(spark, folder):
    rated = matching.with_ratio(_name_pairs(spark, folder), "l", "r", "ratio")
    return rated.withColumn("ratio", F.round("ratio", 9))


@query("fuzzy_match", FUZZY_SQL)
def fuzzy_match(spark, folder):
    return matching.fuzzy_match(files(spark, folder), catalog(spark, folder))


@query("best_file_per_song", """
SELECT song_id, file_path, match_score FROM (
  SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY match_score DESC, file_path) AS rn FROM (
    SELECT CAST(l_partkey AS VARCHAR) AS song_id, '/music/' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS file_path, l_discount AS match_score FROM lineitem)) WHERE rn = 1""")
def best_file_per_song(spark, folder):
    matches = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("song_id"),
        F.concat(F.lit("/music/"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey")).alias("file_path"),
        F.col("l_discount").alias("match_score"))
    return matching.best_file_per_song(matches)


@query("match_key", "SELECT DISTINCT p_brand, replace(lower(p_brand), '#', ' ') AS compact, replace(lower(p_brand), '#', '') AS match_key FROM part")
def match_key(spark, folder):
    brands = table(spark, folder, "part").select("p_brand").distinct()
    return brands.select("p_brand", text.compact_text("p_brand").alias("compact"), text.match_key("p_brand").alias("match_key"))
