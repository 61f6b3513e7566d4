"""Golden rows, naive twins and properties of the table operators."""

import difflib
import io
import json
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.operators import audio, features, filters, history, matching, merge, neighbors, scoring, similarity, snapshots, tags


def test_dedup_prefers_complete_then_later(spark):
    rows = [("1", "a", "", 0, 0), ("1", "b", "x", 0, 1), ("1", "c", "y", 1, 0), (" ", "z", "z", 1, 1), ("2 ", "d", None, 1, 2)]
    df = spark.createDataFrame(rows, "song_id string, name string, more string, file_order int, row_order int")
    got = {(r["song_id"], r["name"]) for r in merge.dedup_most_complete(df).collect()}
    assert got == {("1", "c"), ("2", "d")}


def test_latest_nonblank_is_per_column_and_idempotent(spark):
    rows = [("1", "a", "x", 0, 0), ("1", " b ", " ", 1, 0), ("2", "", None, 0, 1)]
    df = spark.createDataFrame(rows, "song_id string, p string, q string, file_order int, row_order int")
    once = merge.latest_nonblank(df)
    assert {(r["song_id"], r["p"], r["q"]) for r in once.collect()} == {("1", "b", "x"), ("2", "", "")}
    again = merge.latest_nonblank(once.select("song_id", "p", "q", "last_order.*"))
    assert sorted(once.collect()) == sorted(again.collect())
    untrimmed = merge.latest_nonblank(df, trim_values=False)
    assert {r["p"] for r in untrimmed.collect()} == {" b ", ""}


def test_blank_columns_are_dropped_on_request(spark):
    df = spark.createDataFrame([("1", "a", " ", 0, 0)], "song_id string, p string, q string, file_order int, row_order int")
    assert "q" not in merge.latest_nonblank(df, keep_blank_columns=False).columns


def test_rule_tags_of_a_song(spark):
    df = spark.createDataFrame(
        [("1", "夜的钢琴曲", "石进", "1987-05-01", "纯音乐 | 治愈 | 思念 | BPM | 70", "false", "")],
        "song_id string, name string, artist_names string, publish_date string, wiki_summary_excerpt string, has_lyric string, full_lyric string",
    )
    row = tags.song_tags(df).first()
    assert row["language_tags"] == "纯音乐"
    assert row["style_tags"] == "纯音乐 | 钢琴"
    # The later category decides a tag's overall score: style 0.96 replaces language 0.98.
    assert row["tag_confidence"] == 0.96
    assert row["emotion_tags"] == "治愈 | 宁静"
    assert row["theme_tags"] == "思念"
    assert row["scene_tags"] == "放松 | 1980年代"
    assert row["audio_tags"] == "慢节奏"
    assert row["bpm"] == 70
    sources = json.loads(row["tag_sources"])
    assert sources["纯音乐"] == ["csv.wiki_summary_excerpt", "csv.text", "lyrics"]
    assert row["all_tags"].split(" | ")[0] == "纯音乐"


WEIGHTS = {"tags": {"x": -2.0, "y": 0.5}, "artists": {"a": 3.0}}


def catalogue(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pick = lambda words, most: [rng.choice(words) for _ in range(rng.randint(0, most))]
        rows.append((str(i), pick("xyzw", 4), pick("xy", 2), pick("abc", 3), float(rng.randint(0, 100)), float(rng.randint(0, 30)),
                     rng.choice(["Hi-Res", "未知"]), rng.random() < 0.5, rng.choice(["", "/p"]), ""))
    schema = """song_id string, generated_tag_list array<string>, style_tag_list array<string>, artist_list array<string>, popularity double,
    lyric_line_count double, quality string, playable boolean, local_audio_path string, mert_embedding_path string"""
    return rows, spark.createDataFrame(rows, schema)


def naive_scores(rows, dims):
    columns = {"all_tags": 1, "style": 2, "artists": 3}
    scale = {f: s for f, _c, _l, s in vocab.SCORED_FEATURES}
    label = {f: l for f, _c, l, _s in vocab.SCORED_FEATURES}
    counts = {f: {} for f in columns}
    for row in rows:
        for f, c in columns.items():
            for item in row[c]:
                counts[f][item] = counts[f].get(item, 0) + 1
    top_pop, top_lines = max(r[4] for r in rows), max(r[5] for r in rows)
    out = {}
    for row in rows:
        total = 0.0
        for f, c in columns.items():
            user = WEIGHTS["artists"] if f == "artists" else WEIGHTS["tags"]
            if row[c]:
                points = sum(10 * math.log1p(counts[f][i]) * user.get(i, 1.0) for i in row[c]) / math.sqrt(len(row[c]))
                total += points * dims.get(label[f], 1.0) * scale[f]
        numeric = [row[4] / top_pop * 35, row[5] / top_lines * 24, 18 * (row[6] == "Hi-Res"), 12 * row[7], 18 * (row[8] != ""), 0]
        total += sum(v * dims.get(l, 1.0) for v, (l, _s) in zip(numeric, vocab.NUMERIC_PARTS))
        out[row[0]] = total
    return out


def test_dynamic_score_equals_naive_twin(spark):
    rows, df = catalogue(spark)
    long = features.feature_rows(df)
    scored = scoring.dynamic_score(df, long, features.frequency_counts(long), weights=WEIGHTS)
    want = naive_scores(rows, vocab.DEFAULT_DIMENSION_WEIGHTS)
    got = {r["song_id"]: r["dynamic_score_raw"] for r in scored.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_zero_weights_score_zero(spark):
    _rows, df = catalogue(spark)
    long = features.feature_rows(df)
    zero = dict.fromkeys(vocab.DEFAULT_DIMENSION_WEIGHTS, 0.0)
    scored = scoring.dynamic_score(df, long, features.frequency_counts(long), zero).collect()
    assert {r["dynamic_score"] for r in scored} == {0} and {r["score_breakdown"] for r in scored} == {""}


def test_hot_and_cold_items_get_the_same_counts(spark, monkeypatch):
    _rows, df = catalogue(spark)
    long = features.feature_rows(df)
    counts = features.frequency_counts(long)
    plain = sorted((r["song_id"], r["item"], r["cnt"]) for r in long.join(counts, ["feature", "item"]).collect())
    for shares in (0, 2, 10**6):  # none hot, some hot, all hot
        monkeypatch.setattr(features, "HOT_SHARES", shares)
        got = sorted((r["song_id"], r["item"], r["cnt"]) for r in features.attach_counts(long, counts).collect())
        assert got == plain


def test_breakdown_takes_five_before_dropping_small(spark):
    parts = [("a", F.lit(0.05)), ("b", F.lit(3.0)), ("c", F.lit(-9.0)), ("d", F.lit(3.0)), ("e", F.lit(0.01))]
    assert spark.range(1).select(scoring.breakdown(parts).alias("b")).first()["b"] == "b:3.0 | d:3.0 | c:-9.0"


def test_min_score_default_threshold(spark):
    df = spark.createDataFrame([(5,), (9,)], "dynamic_score int")
    assert filters.min_score(df).count() == 2
    mixed = spark.createDataFrame([(-5,), (9,)], "dynamic_score int")
    assert [r[0] for r in filters.min_score(mixed).collect()] == [9]


def test_positions_are_dense_with_hot_values(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("v"))
    rows = filters.with_positions(df, "v", ["id"], groups=8).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 501))
    assert [r["id"] for r in rows] == [r["id"] for r in sorted(rows, key=lambda r: (r["v"], r["id"]))]


def test_history_bonus(spark):
    liked = spark.createDataFrame([("artists", "a", 2), ("artists", "new", 1), ("style", "s", 1)], "feature string, item string, cnt long")
    counts = spark.createDataFrame([("artists", "a", 9), ("artists", "b", 1)], "feature string, item string, cnt long")
    got = {(r["feature"], r["item"]): r["bonus"] for r in history.rarity_bonus(liked, counts, {"风格": 0.0, "歌手": 2.0}).collect()}
    assert got.keys() == {("artists", "a"), ("artists", "new")}
    assert abs(got["artists", "a"] - 2 * math.log1p(11 / 10) * 2.0) < 1e-12
    assert abs(got["artists", "new"] - math.log1p(11 / 1) * 2.0) < 1e-12


def brute_force_neighbors(vectors, k):
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], dtype=float)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    sims = np.round(unit @ unit.T, 9)
    out = {}
    for a, song in enumerate(ids):
        others = sorted((-sims[a, b], other) for b, other in enumerate(ids) if b != a)[:k]
        out[song] = [(other, round(-s, 6)) for s, other in others]
    return out


def test_nearest_neighbors_equal_brute_force_with_many_copies(spark):
    rng = np.random.default_rng(3)
    vectors = {f"v{i:03d}": [float(x) for x in rng.normal(size=6)] for i in range(150)}
    vectors |= {f"c{i:03d}": [1.0, 2.0, 0.0, 0.0, -1.0, 0.5] for i in range(80)}  # a third are copies
    vectors["zero"] = [0.0] * 6
    df = spark.createDataFrame(list(vectors.items()), "song_id string, vector array<double>")
    got = {}
    for r in neighbors.nearest_neighbors(df, 4, pivots=7, block_rows=16).orderBy("song_id", "rank").collect():
        got.setdefault(r["song_id"], []).append((r["neighbor_id"], round(r["similarity"], 6)))
    want = brute_force_neighbors(vectors, 4)
    assert got.keys() == want.keys()
    for song in want:
        assert [s for _o, s in got[song]] == pytest.approx([s for _o, s in want[song]], abs=1e-6)
        if song.startswith("c"):
            assert [o for o, _s in got[song]] == [o for o, _s in want[song]]


@pytest.mark.parametrize("pivots, block_rows, size", [(3, 2, 200), (4, 1, 300), (64, 16, 250), (2, 1000, 90)])
def test_nearest_neighbors_through_trees_of_one_and_two_levels(spark, pivots, block_rows, size):
    rng = np.random.default_rng(size)
    centers = rng.normal(size=(9, 5))
    points = centers[rng.integers(0, 9, size)] + 0.05 * rng.normal(size=(size, 5))
    vectors = {f"v{i:04d}": [float(x) for x in point] for i, point in enumerate(points)}
    df = spark.createDataFrame(list(vectors.items()), "song_id string, vector array<double>")
    got = {}
    for r in neighbors.nearest_neighbors(df, 3, pivots=pivots, block_rows=block_rows).orderBy("song_id", "rank").collect():
        got.setdefault(r["song_id"], []).append((r["neighbor_id"], round(r["similarity"], 6)))
    want = brute_force_neighbors(vectors, 3)
    assert got.keys() == want.keys()
    for song in want:
        assert [s for _o, s in got[song]] == pytest.approx([s for _o, s in want[song]], abs=1e-6)


def test_visits_grow_clearly_below_quadratic_on_clustered_vectors(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(400, 8))
    counts = []
    for size in (2000, 4000, 8000):
        points = centers[rng.integers(0, size // 20, size)] + 0.02 * rng.normal(size=(size, 8))
        df = spark.createDataFrame([(f"v{i:05d}", [float(x) for x in p]) for i, p in enumerate(points)], "vid string, v array<double>")
        blocked, seen = neighbors.visits(df, size, neighbors._unit(points[:4]), 5, 4, 32)
        assert blocked.groupBy("home").count().agg({"count": "max"}).first()[0] <= 32
        counts.append(seen.count())
    # Quadratic growth would be a factor of 4 each time.
    assert counts[1] < 2.9 * counts[0] and counts[2] < 2.9 * counts[1], counts


def test_vector_checks(spark):
    mixed = spark.createDataFrame([("1", [1.0]), ("2", [1.0, 2.0])], "song_id string, vector array<double>")
    with pytest.raises(ValueError):
        similarity.check_vectors(mixed)
    with pytest.raises(ValueError):
        similarity.check_vectors(mixed.limit(0))
    with pytest.raises(ValueError):
        similarity.known_vector(mixed, "9")


# --- fuzzy matching --------------------------------------------------------------------------------


def similar(a, b):
    """Similarity of two keys, straight from the stated rule."""
    if "" in (a, b):
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 5 and short in long:
        return 0.92
    grams = [set(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b)]
    unlike = a[0] != b[0] and a[-1] != b[-1] and all(grams) and not grams[0] & grams[1]
    if len(short) / len(long) < 0.42 or unlike:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def best_text_score(identities, candidates):
    best = (0.0, None)
    for row, (title, artist) in enumerate(candidates):
        for f_title, f_artist in identities:
            t, c = similar(f_title, title), similar(f_artist + f_title, artist + title)
            a = similar(f_artist, artist) if f_artist else 0.0
            score = max(0.95 * c, 0.68 * t + 0.32 * a)
            if f_artist and a < 0.45 and c < 0.86:
                score *= 0.82
            if score > best[0]:
                best = (score, row)
    return best


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["moon", "river", "night", "love", "summer", "rain", "blue", "song", "home", "star", "dream", "fire"]

    def phrase(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def damaged(value):
        letters = list(value)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], [rng.choice("abcdefgh")], [letters[at], letters[at]]])
        return "".join(letters) or value

    songs = [(str(i), phrase(rng.randint(1, 3)), phrase(rng.randint(1, 2)), i) for i in range(70)]
    songs += [(str(100 + i), "intro", phrase(2), 100 + i) for i in range(30)]  # one title on many rows
    catalog = spark.createDataFrame(songs, "song_id string, name string, artist_names string, row_order int").withColumns(
        {"aliases": F.lit(""), "duration_seconds": F.lit(100.0)})
    picks = [rng.choice(songs) for _ in range(60)]
    named = [(f"f{i}", f"{damaged(s[2])} - {damaged(s[1])}") for i, s in enumerate(picks)]
    files = spark.createDataFrame(named, "file_path string, stem string").withColumns(
        {"meta_title": F.lit(""), "meta_artist": F.lit(""), "meta_album": F.lit(""), "duration": F.lit(None).cast("double"), "duration_error": F.lit("")})
    got = {r["file_path"]: (r["song_id"], r["match_score"]) for r in matching.fuzzy_match(files, catalog).collect()}
    keys = [(s[1].replace(" ", ""), s[2].replace(" ", "")) for s in songs]
    want = {}
    for path, stem in named:
        artist, title = stem.split(" - ", 1)
        score, row = best_text_score([(title.replace(" ", ""), artist.replace(" ", ""))], keys)
        if score >= 0.84:
            want[path] = (songs[row][0], round(score, 4))
    assert len(want) > 20
    assert got == want


def test_prefix_bound_guarantees_a_shared_pair():
    assert matching.pairs_suffice(0.8049) and not matching.pairs_suffice(0.713)


# --- documents -------------------------------------------------------------------------------------


def flat(spark, document, name="5.json"):
    df = spark.createDataFrame([(name, json.dumps(document, ensure_ascii=False))], "file_name string, value string")
    return snapshots.flatten_snapshots(df).first()


def test_flatten_sparse_document(spark):
    row = flat(spark, {"song_id": 0, "api_results": {"song_detail": [{"error": "x", "response": {"songs": [{"id": 1}]}}, {"response": {"songs": [{"id": 9, "name": "n", "dt": 61500}]}}]}})
    assert row["song_id"] == "9" and row["name"] == "n" and row["duration_text"] == "1:02"
    assert row["playable"] == "" and row["has_lyric"] == "false" and row["hot_comment_count"] == "0"
    assert len(row) == 95


def test_flatten_falls_back_to_file_name(spark):
    assert flat(spark, {}, "77.json")["song_id"] == "77"


def test_harvest_keeps_document_order(spark):
    data = {"zeta": {"text": "one"}, "alpha": [{"title": "two"}, {"name": 3}], "desc": ["four", ""], "name": True}
    row = flat(spark, {"song_id": 1, "api_results": {"song_wiki_summary": [{"response": {"data": data}}]}})
    assert row["wiki_summary_excerpt"] == "one | two | 3 | four | true"


def test_unlicensed_marker_only_in_message_leaves(spark):
    marker = vocab.UNLICENSED_MARKER
    documents = [{"api_results": {"e": [{"deep": [{"msg": f"x{marker}"}]}]}}, {"api_results": {"e": [{"text": marker}]}}, {"message": marker}]
    df = spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in documents], "value string")
    assert [r["unlicensed"] for r in snapshots.with_unlicensed_flag(df).collect()] == [True, False, False]


def test_sine_wave_measures(spark):
    import io
    import wave

    rate = 8000
    tone = (np.sin(2 * np.pi * 1000 * np.arange(rate * 2) / rate) * 16000).astype("<i2")
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(tone.tobytes())
    df = spark.createDataFrame([("a", bytearray(buffer.getvalue())), ("b", bytearray(b"no"))], "path string, content binary")
    rows = {r["path"]: r for r in audio.audio_features(audio.wave_measures(df)).collect()}
    good, bad = rows["a"], rows["b"]
    assert good["audio_duration_seconds"] == 2.0 and abs(good["audio_centroid_hz"] - 1000) < 40
    assert abs(good["audio_rms"] - 16000 / 32768 / math.sqrt(2)) < 1e-3 and good["audio_vocal_band_ratio"] > 0.9
    assert "高能量" in good["audio_feature_tags"] and good["audio_error"] == ""
    assert bad["audio_error"] and bad["audio_rms"] is None and bad["audio_feature_tags"] == ""


def wav(samples, rate=8000):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(np.rint(np.clip(samples, -1, 1) * 32000).astype("<i2").tobytes())
    return buffer.getvalue()


def test_tempo_of_clicks_and_spectrum_of_short_tones(spark):
    rate = 16000
    seconds = np.arange(rate * 8) / rate
    clicks = 0.8 * np.sin(2 * np.pi * 700 * seconds) * ((seconds % 0.5) < 0.04)
    high, silent = 0.5 * np.sin(2 * np.pi * 6000 * seconds[: rate // 2]), np.zeros(rate)
    rows = [("clicks", wav(clicks, rate)), ("high", wav(high, rate)), ("silent", wav(silent, rate)), ("tiny", wav(clicks[:50], rate)), ("none", wav(clicks[:0], rate))]
    got = {r["path"]: r for r in audio.wave_measures(spark.createDataFrame(rows, "path string, content binary")).collect()}
    beats = got["clicks"]["audio_tempo_raw_bpm"]
    assert min(abs(beats - 120), abs(beats - 60)) < 4
    assert got["high"]["audio_vocal_band_ratio"] < 0.05 and abs(got["high"]["audio_centroid_hz"] - 6000) < 100
    assert got["silent"]["audio_tempo_raw_bpm"] is None and got["silent"]["audio_centroid_hz"] == 0
    assert got["tiny"]["audio_error"] == "" and got["none"]["audio_error"] == "empty audio"


def test_measures_do_not_depend_on_the_block(spark, monkeypatch):
    samples = np.random.default_rng(3).uniform(-1, 1, 60000)
    whole = audio._measure("x", wav(samples), 0)
    monkeypatch.setattr(audio, "FRAMES_AT_ONCE", 7)
    assert audio._measure("x", wav(samples), 0) == pytest.approx(whole)


def summary(*results):
    return json.dumps({"song_id": 1, "api_results": {"song_wiki_summary": list(results)}})


@pytest.mark.parametrize("first", [None, {"error": "failed", "response": {"data": {"title": "no"}}}, {"error": "", "response": None}, {"response": [1]}, {"error": 0}])
def test_summary_comes_from_the_first_good_result_in_document_order(spark, first):
    good = {"error": "", "response": {"data": {"title": "Z", "text": "A"}}}
    document = summary(*([first] if first else []), good, {"response": {"data": {"title": "later"}}})
    df = spark.createDataFrame([("1.json", document)], "file_name string, value string")
    assert snapshots.flatten_snapshots(df).first()["wiki_summary_excerpt"] == "Z | A"


def test_only_numbers_booleans_and_blank_texts_fall_through(spark):
    values = ['""', "0", "0.0", "false", "null", '"0"', '"0.0"', '"false"', "7", "true", '"x"']
    df = spark.createDataFrame([(i, f'{{"v": {v}}}') for i, v in enumerate(values)], "i int, j string")
    got = [r["t"] for r in df.select("i", snapshots.truthy(F.parse_json("j"), "$.v").alias("t")).orderBy("i").collect()]
    assert got == [None] * 5 + ["0", "0.0", "false", "7", "true", "x"]


def test_assembly_keeps_raw_json(spark):
    songs = spark.createDataFrame([("1", "n", None, "a", 5, "2024", '[{"z":1,"b":null}]', "no json")], "song_id string, name string, album_id string, album_name string, duration_ms int, collected_at string, artists_json string, raw_detail_json string")
    results = spark.createDataFrame(
        [(2, "1", "wiki", 200, 200, None, "t", '{"z":1,"a":2}', '{"data":{"title":"Z","text":"A"}}'), (1, "1", "wiki", 500, None, "failed", "t", "{}", None)],
        "id int, song_id string, endpoint string, status int, code int, error string, collected_at string, params_json string, response_json string")
    text_ = snapshots.assemble_snapshots(songs, results).first()["document"]
    document = json.loads(text_)
    assert document["album_id"] is None and document["raw_detail"] is None and list(document["artists"][0]) == ["z", "b"]
    failed, good = document["api_results"]["wiki"]
    assert failed["response"] is None and failed["code"] is None and failed["error"] == "failed"
    assert list(good["params"]) == ["z", "a"] and '{"data":{"title":"Z","text":"A"}}' in text_


def test_a_needed_name_that_is_unknown_is_an_error(spark):
    df = spark.createDataFrame([(i, f"Song {i}") for i in range(30)], "id int, name string")
    assert filters.find_by_name(df, " song 7", "id", needed=True).first()["id"] == 7
    with pytest.raises(ValueError, match="Song 0.*Song 19$"):
        filters.find_by_name(df, "nothing", "id", needed=True)


def test_segmenter_replaces_the_tokenizers(spark):
    df = spark.createDataFrame([("1", "ab|cd|ab|7|x|the", "", "")], "song_id string, full_lyric string, lyric_excerpt string, language_tags string")
    df = df.withColumn("language_tags", F.array())
    row = features.lyric_terms(df, make_segmenter=lambda: lambda t: t.split("|")).first()
    assert row["lyric_terms"][:2] == ["ab", "cd"] and "7" not in row["lyric_terms"] and "x" not in row["lyric_terms"]


def test_publish_year_of_usual_date_forms(spark):
    from tonearm.functions import numbers

    values = ["1999-05-01", "1999", "1999-05", "1999/5/1", "1999.05.01", "19990501", "5/1/1999", "May 1, 1999", "1 May 1999", "May 1999", "2001-02-03T04:05:06", "soon", "", None, "13/40/1999"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["y"] for r in df.select("i", numbers.publish_year("v").alias("y")).orderBy("i").collect()]
    assert got == [1999] * 10 + [2001] + [None] * 4


def test_history_entries_of_a_hot_song_are_dealt_over_tasks(spark):
    events = spark.range(4000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("song_id"))
    rows = [("hot", "Hot", "x | x | y"), ("s1", "One", None), ("s2", "Two", "z"), ("s2", "Two again", "z"), ("unheard", "U", "")]
    songs = spark.createDataFrame(rows, "song_id string, name string, artist_names string").withColumn("artist_list", F.split("artist_names", r" \| "))

    def entries(**options):
        found = history.history_entry(events, songs, **options)
        return sorted((r["event_id"], r["song_id"], r["name"], r["artists"]) for r in found.collect())

    plain = events.join(songs, "song_id", "left").where("song_id is not null or name is not null")
    want = sorted((r["event_id"], r["song_id"], (r["name"] or "").strip() if r["name"] else None) for r in plain.collect())
    got = entries()
    assert [row[:3] for row in got] == want
    assert got[0] == (0, "hot", "Hot", ["x", "y"])
    # Outdated or foreign counts only change how rows are dealt.
    for heat in ([("s2", 900), ("gone", 100)], []):
        assert entries(clicks=spark.createDataFrame(heat, "song_id string, cnt long")) == got
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = {r["song_id"]: r["salts"] for r in history.hot_songs(history.song_clicks(events)).collect()}
    assert hot["hot"] == math.ceil(1334 * features.HOT_SHARES * parts / 2667) and sum(hot.values()) <= 2 * features.HOT_SHARES * parts
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = history.history_entry(events, songs).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts = sorted(r["count"] for r in dealt)
    assert len(counts) == parts and counts[-1] <= 2 * counts[len(counts) // 2]


def test_text_encoder_counts_the_trigrams_of_each_text():
    from tonearm.functions import udfs

    texts = ["", "a", "Ab", "歌词 日", "x" * 50, "\ud800", "ab" * 3]
    want = np.zeros((len(texts), 16))
    for row, value in enumerate(texts):
        points = [32, *map(ord, value.lower()), 32]
        for a, b, c in zip(points, points[1:], points[2:]):
            want[row, ((a * udfs.TRIGRAM_FACTOR + b) * udfs.TRIGRAM_FACTOR + c) % udfs.TRIGRAM_PRIME % 16] += 1
    want /= np.clip(np.linalg.norm(want, axis=1, keepdims=True), 1e-12, None)
    encode = udfs.hashing_encoder(16)
    assert np.allclose(encode(texts), want) and encode([]).shape == (0, 16) and encode(["", ""]).sum() == 0
    together, udfs.TOGETHER = udfs.TOGETHER, 3
    try:
        assert np.allclose(encode(texts), want)
    finally:
        udfs.TOGETHER = together


def test_constant_matrix_scores_as_its_rows_do(spark):
    from tonearm.operators import semantics

    rows = [[1.0, -0.1, 1e-9], [0.3333333333333333, 2.5e20, 0.0]]
    df = spark.createDataFrame([([0.5, 0.25, 4.0],)], "v array<double>")
    scored = df.select(semantics.label_scores("v", rows).alias("s"), similarity.linear_head("v", [[1.0, 0, 0], [0, 1.0, 0]], [0.25, 0.5]).alias("p"))
    found = scored.first()
    assert found["s"] == [sum(a * b for a, b in zip(row, (0.5, 0.25, 4.0))) for row in rows]
    assert found["p"] == [0.5, 0.5]
    assert "from_json" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_neighbors_without_clusters_are_found_in_tiles(spark, monkeypatch):
    """Unstructured vectors visit nearly all blocks; a row for each visit would grow with the square of the vectors."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", 700)
    monkeypatch.setattr(neighbors, "_visits", None)  # not asked for
    draw = np.random.default_rng(5)
    points = draw.normal(size=(1500, 24))
    points[700:720] = points[3]
    rows = [(f"{i}", point.tolist()) for i, point in enumerate(points)]
    df = spark.createDataFrame(rows, "song_id string, vector array<double>")
    got = {}
    for r in neighbors.nearest_neighbors(df, 5, pivots=4, block_rows=16).orderBy("song_id", "rank").collect():
        got.setdefault(r["song_id"], []).append((r["neighbor_id"], round(r["similarity"], 9)))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    for i in range(0, len(points), 7):
        best = sorted((j for j in range(len(points)) if j != i), key=lambda j: (-scores[i, j], str(j)))[:5]
        assert got[str(i)] == [(str(j), scores[i, j]) for j in best]
    assert len(got) == len(points)
