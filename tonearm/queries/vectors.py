"""Vector look-up, similarity search, neighbours, clusters, affect and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import arrays, text, udfs
from tonearm.operators import audio, neighbors, semantics, similarity
from tonearm.queries.registry import query, table


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("song_id"), F.col("embedding").alias("vector"), "label")


COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


@query("vector_lookup", "SELECT CAST(vec_id AS VARCHAR) AS song_id, CAST(len(embedding) AS INTEGER) AS size, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id = 42")
def vector_lookup(spark, folder):
    found = similarity.vector_lookup(similarity.check_vectors(vectors(spark, folder)), " 42 ")
    return found.select("song_id", F.size("vector").alias("size"), F.round(F.get("vector", 0).cast("double"), 6).alias("first"))


@query("search_similar", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 42),
scored AS (SELECT CAST(vec_id AS VARCHAR) AS song_id, {COSINE.format('embedding', 'qv')} * 100 AS score FROM embeddings, q)
SELECT CAST(row_number() OVER (ORDER BY score DESC, song_id) AS INTEGER) AS rank, song_id, round(score, 4) AS score FROM scored ORDER BY score DESC, song_id LIMIT 50""")
def search_similar(spark, folder):
    items = vectors(spark, folder)
    found = similarity.search_similar(items, similarity.vector_lookup(items, "42"), top_k=50)
    return found.withColumn("score", F.round("score", 4))


@query("rank_results", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7),
scored AS (SELECT CAST(vec_id AS VARCHAR) AS song_id, {COSINE.format('embedding', 'qv')} * 100 AS score FROM embeddings, q WHERE label < 5)
SELECT CAST(row_number() OVER (ORDER BY score DESC, song_id) AS INTEGER) AS rank, song_id, round(score, 4) AS score FROM scored QUALIFY rank <= 5000""")
def rank_results(spark, folder):
    items = vectors(spark, folder)
    query_vector = similarity.known_vector(items, "7")
    candidates = items.where("label < 5").select("song_id").unionByName(items.where("label = 1").select("song_id"))
    found = similarity.search_similar(items, query_vector, candidates)
    return found.withColumn("score", F.round("score", 4))


@query("candidate_restrict", "SELECT CAST(d.doc_id AS VARCHAR) AS song_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.lang = 'fr'")
def candidate_restrict(spark, folder):
    ids = table(spark, folder, "documents").where("lang = 'fr'").select(F.concat(F.lit(" "), "doc_id").alias("song_id"))
    return similarity.restrict_candidates(ids.unionByName(ids).unionByName(ids.select(F.lit(" ").alias("song_id"))), vectors(spark, folder))


@query("semi_join_ids", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 3),
scored AS (SELECT vec_id, {COSINE.format('embedding', 'qv')} * 100 AS score FROM embeddings, q ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 40)
SELECT CAST(doc_id AS VARCHAR) AS song_id, lang, round(score, 4) AS audio_similarity_score FROM documents JOIN scored ON vec_id = doc_id""")
def semi_join_ids(spark, folder):
    items = vectors(spark, folder)
    found = similarity.search_similar(items, similarity.vector_lookup(items, "3"), top_k=40)
    songs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"), "lang")
    return similarity.attach_similarity(songs, found).withColumn("audio_similarity_score", F.round("audio_similarity_score", 4))


NEIGHBORS_SQL = f"""neighbors AS (
  SELECT CAST(a.vec_id AS VARCHAR) AS song_id, CAST(b.vec_id AS VARCHAR) AS neighbor_id, {COSINE.format('a.embedding', 'b.embedding')} AS similarity,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE.format('a.embedding', 'b.embedding')}, 10) DESC, CAST(b.vec_id AS VARCHAR)) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 5)"""


@query("nearest_neighbors", "WITH " + NEIGHBORS_SQL + " SELECT song_id, neighbor_id, round(similarity, 4) AS similarity, CAST(rank AS INTEGER) AS rank FROM neighbors")
def nearest_neighbors(spark, folder):
    return neighbors.nearest_neighbors(vectors(spark, folder)).withColumn("similarity", F.round("similarity", 4))


@query("neighbor_lists", "WITH " + NEIGHBORS_SQL + " SELECT song_id, string_agg(neighbor_id, ' | ' ORDER BY rank) AS mert_neighbor_song_ids FROM neighbors GROUP BY song_id")
def neighbor_lists(spark, folder):
    near = neighbors.nearest_neighbors(vectors(spark, folder), pivots=4, block_rows=64)
    return similarity.neighbor_lists(near).select("song_id", "mert_neighbor_song_ids")


@query("kmeans")
def kmeans(spark, folder):
    return similarity.kmeans(vectors(spark, folder))


@query("mean_pool", """
SELECT CAST(label AS VARCHAR) AS song_id, pos, round(avg(x), 5) AS x FROM (
  SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings) GROUP BY ALL""")
def mean_pool(spark, folder):
    chunks = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("song_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return audio.mean_pool(chunks).select("song_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 5))


AFFECT_SQL = "points AS (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS v, (CAST(embedding[2] AS DOUBLE) * 2 + 1) / 2 AS a FROM embeddings)"


def _emotion_sql() -> str:
    prototypes = ", ".join(f"({i}, '{label}', {v}, {a}, '{tag}')" for i, (label, v, a, tag) in enumerate(vocab.EMOTION_PROTOTYPES))
    return f"""WITH {AFFECT_SQL}, prototypes(ord, label, pv, pa, tag) AS (VALUES {prototypes}),
raw AS (SELECT vec_id, ord, label, tag, exp(-5 * sqrt(pow(v - pv, 2) + pow(a - pa, 2))) AS e FROM points, prototypes),
scores AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS score FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) AS rank FROM scores)
SELECT vec_id, string_agg(label || ':' || printf('%.4f', score), ' | ' ORDER BY rank) FILTER (WHERE rank <= 3) AS scores,
  string_agg(tag, ' | ' ORDER BY rank) FILTER (WHERE rank = 1 OR (rank <= 3 AND score >= 0.16)) AS tags FROM ranked GROUP BY vec_id"""


@query("emotion_from_affect", _emotion_sql())
def emotion_from_affect(spark, folder):
    points = table(spark, folder, "embeddings").select(
        "vec_id", ((F.get("embedding", 0).cast("double") + 1) / 2).alias("v"), ((F.get("embedding", 1).cast("double") * 2 + 1) / 2).alias("a"))
    scored = points.withColumn("s", similarity.emotion_scores("v", "a"))
    shown = F.transform("s", lambda item: text.score_text(item["label"], item["score"]))
    return scored.select("vec_id", F.array_join(shown, " | ").alias("scores"), F.array_join(similarity.emotion_tags("s"), " | ").alias("tags"))


@query("affect_proxy", """
SELECT l_orderkey, round(greatest(0, least(1, 0.62 * (1 / (1 + exp(-(c - 1800) / 900))) + 0.38 * (1 - 1 / (1 + exp(-(z - 0.08) * 18))))), 6) AS valence,
  round(greatest(0, least(1, 1 / (1 + exp(-(2.4 * log10(r + 1e-5) + 0.0010 * c + 10 * z + 0.8))) + least(f, 1) * 0.05)), 6) AS arousal
FROM (SELECT l_orderkey, l_discount AS r, l_tax AS z, l_extendedprice / 10 AS c, l_quantity / 40 AS f FROM lineitem)""")
def affect_proxy(spark, folder):
    measures = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_discount").alias("r"), F.col("l_tax").alias("z"), (F.col("l_extendedprice") / 10).alias("c"), (F.col("l_quantity") / 40).alias("f"))
    valence, arousal = similarity.affect_proxy("r", "z", "c", "f")
    return measures.select("l_orderkey", F.round(valence, 6).alias("valence"), F.round(arousal, 6).alias("arousal"))


def _with_label_vectors(spark, folder, df):
    """Add ``label_vectors``, one vector per label in the order of the labels: of each label the one with the smallest id."""
    first = table(spark, folder, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    unit = first.select("label", arrays.l2_normalize("v").alias("v"))
    return df.withColumn("label_vectors", arrays.matrix_of(unit, "v", "label"))


LABEL_VECTORS_SQL = "label_vectors AS (SELECT label, arg_min(embedding, vec_id) AS lv FROM embeddings GROUP BY label)"


@query("linear_head", f"""WITH {LABEL_VECTORS_SQL},
logits AS (SELECT vec_id, l.label, {COSINE.format('embedding', 'lv')} * sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) + l.label * 0.1 AS z FROM embeddings, label_vectors l)
SELECT vec_id, label, round(exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id), 5) AS p FROM logits""")
def linear_head(spark, folder):
    weights = F.col("label_vectors")
    probabilities = similarity.linear_head("v", weights, F.transform(weights, lambda _row, i: i * 0.1))
    dense = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return _with_label_vectors(spark, folder, dense).select("vec_id", F.posexplode(probabilities).alias("label", "p")).select("vec_id", "label", F.round("p", 5).alias("p"))


LABELS = semantics.LabelSet(
    "lyric_semantic",
    tuple((f"L{i}", needles) for i, needles in enumerate(
        (("hand",), ("tion", "eau"), ("und",), ("lyly",), ("ouou",), ("erer",), ("thth",), ("inin",), ("anan",), ("stst",)))),
    0.04, "{tag}: {needles}", threshold=0.2)
LABEL_RANK_SQL = f"""{LABEL_VECTORS_SQL}, scores AS (SELECT vec_id, l.label, {COSINE.format('embedding', 'lv')} AS score FROM embeddings, label_vectors l),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank, max(score) OVER (PARTITION BY vec_id) AS best FROM scores)"""


def _label_rules_sql() -> str:
    rows = ", ".join(f"({i}, '{tag}', '{needle}')" for i, (tag, needles) in enumerate(LABELS.rules) for needle in needles)
    return f"label_rules(rule, tag, needle) AS (VALUES {rows})"


@query("label_similarity", f"""WITH {LABEL_RANK_SQL}, {_label_rules_sql()},
accepted AS (SELECT vec_id, string_agg('L' || label, ' | ' ORDER BY rank) AS tags, string_agg('L' || label || ':' || printf('%.4f', score), ' | ' ORDER BY rank) AS scores
  FROM ranked WHERE rank <= 3 AND score >= 0.2 AND best - score <= 0.04 GROUP BY vec_id),
fallback AS (SELECT doc_id, string_agg(tag, ' | ' ORDER BY rule) AS tags FROM (SELECT DISTINCT doc_id, rule, tag FROM documents, label_rules WHERE contains(lower(text), needle)) GROUP BY doc_id)
SELECT CAST(e.vec_id AS VARCHAR) AS song_id, coalesce(a.tags, f.tags, '') AS lyric_semantic_tags, coalesce(a.scores, '') AS lyric_semantic_scores, 'given' AS lyric_semantic_model,
  CASE WHEN a.tags IS NULL AND f.tags IS NOT NULL THEN 'model_low_confidence_keyword_fallback' ELSE '' END AS lyric_semantic_error
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN accepted a USING (vec_id) LEFT JOIN fallback f ON f.doc_id = e.vec_id""")
def label_similarity(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"), "text")
    unit = vectors(spark, folder).join(texts, "song_id").withColumn("v", arrays.l2_normalize("vector"))
    scored = _with_label_vectors(spark, folder, unit).withColumn("scores", semantics.label_scores("v", F.col("label_vectors")))
    return semantics.label_texts(scored, LABELS, "scores", "text", "given")


@query("topk_labels", f"WITH {LABEL_RANK_SQL} SELECT vec_id, string_agg('L' || label, ',' ORDER BY rank) AS labels FROM ranked WHERE rank <= 3 GROUP BY vec_id")
def topk_labels(spark, folder):
    unit = table(spark, folder, "embeddings").select("vec_id", arrays.l2_normalize("embedding").alias("v"))
    scored = _with_label_vectors(spark, folder, unit).withColumn("s", semantics.label_scores("v", F.col("label_vectors")))
    names = text.constant_array([tag for tag, _needles in LABELS.rules])
    return scored.select("vec_id", F.array_join(F.transform(arrays.top_labels("s", names, 3), lambda item: item["label"]), ",").alias("labels"))


def _encoded_sql() -> str:
    """Trigram counts of texts and label sentences by place, their cosines, and the accepted labels."""
    sentences = ", ".join(f"({i}, '{sentence}')" for i, sentence in enumerate(semantics.label_descriptions(LABELS)))
    place = f"((p[i] * {udfs.TRIGRAM_FACTOR} + p[i + 1]) * {udfs.TRIGRAM_FACTOR} + p[i + 2]) % {udfs.TRIGRAM_PRIME} % 256"
    return f"""WITH sentences(id, txt) AS (VALUES {sentences}), {_label_rules_sql()},
said AS (SELECT 0 AS kind, doc_id AS id, coalesce(text, '') AS txt FROM documents UNION ALL SELECT 1, id, txt FROM sentences),
points AS (SELECT kind, id, list_transform(string_split(' ' || lower(txt) || ' ', ''), lambda c: CAST(unicode(c) AS BIGINT)) AS p FROM said),
grams AS (SELECT kind, id, unnest(list_transform(range(1, len(p) - 1), lambda i: {place})) AS place FROM points),
counts AS (SELECT kind, id, place, count(*) AS n FROM grams GROUP BY ALL),
norms AS (SELECT kind, id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY ALL),
products AS (SELECT d.id, l.id AS label, sum(d.n * l.n) AS product FROM counts d JOIN counts l USING (place) WHERE d.kind = 0 AND l.kind = 1 GROUP BY ALL),
scores AS (SELECT p.id, label, round(product / d.norm / l.norm, 12) AS score FROM products p JOIN norms d ON d.kind = 0 AND d.id = p.id JOIN norms l ON l.kind = 1 AND l.id = label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank, max(score) OVER (PARTITION BY id) AS best FROM scores),
accepted AS (SELECT id, string_agg('L' || label, ' | ' ORDER BY rank) AS tags, string_agg('L' || label || ':' || printf('%.4f', score), ' | ' ORDER BY rank) AS scores
  FROM ranked WHERE rank <= 3 AND score >= 0.2 AND best - score <= 0.04 GROUP BY id),
fallback AS (SELECT doc_id, string_agg(tag, ' | ' ORDER BY rule) AS tags FROM (SELECT DISTINCT doc_id, rule, tag FROM documents, label_rules WHERE contains(lower(text), needle)) GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS song_id, coalesce(a.tags, f.tags, '') AS lyric_semantic_tags, coalesce(a.scores, '') AS lyric_semantic_scores, 'hashing-trigrams' AS lyric_semantic_model,
  CASE WHEN a.tags IS NULL AND f.tags IS NOT NULL THEN 'model_low_confidence_keyword_fallback' ELSE '' END AS lyric_semantic_error
FROM documents d LEFT JOIN accepted a ON a.id = d.doc_id AND trim(text) <> '' LEFT JOIN fallback f ON f.doc_id = d.doc_id"""


@query("label_encoded_texts", _encoded_sql())
def label_encoded_texts(spark, folder):
    """Encoder path: hashed trigram vectors of whole texts against label sentences."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("song_id"), "text")
    return semantics.label_by_similarity(texts, LABELS, "text")


@query("recommend_similar", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 42),
candidates AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')),
scored AS (SELECT vec_id, {COSINE.format('embedding', 'qv')} * 100 AS score FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM candidates)),
top AS (SELECT * FROM scored ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 30)
SELECT CAST(vec_id AS VARCHAR) AS song_id, round(score, 4) AS audio_similarity_score FROM top ORDER BY score DESC LIMIT 20""")
def recommend_similar(spark, folder):
    items = vectors(spark, folder)
    songs = table(spark, folder, "documents").where("lang IN ('en', 'de')").select(
        F.col("doc_id").cast("string").alias("song_id"), F.lit(0).alias("dynamic_score"))
    found = similarity.search_similar(items, similarity.vector_lookup(items, "42"), songs, 30)
    from tonearm.operators import joins

    best = joins.top_candidates(similarity.attach_similarity(songs, found))
    return best.select("song_id", F.round("audio_similarity_score", 4).alias("audio_similarity_score"))
