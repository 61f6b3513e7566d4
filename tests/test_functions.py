import pytest
from pyspark.sql import functions as F

from tonearm import vocab
from tonearm.functions import arrays, numbers, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


WIDE_BLANK = "　"


@pytest.mark.parametrize(
    "build, expected",
    [
        (lambda: text.strip(F.lit(f"{WIDE_BLANK}\t x y \n")), "x y"),
        (lambda: text.safe_text(F.lit(None).cast("string")), ""),
        (lambda: text.split_pipe(F.lit(f"a | |b{WIDE_BLANK}| a")), ["a", "b", "a"]),
        (lambda: text.normalize_for_search(F.lit(f" A{WIDE_BLANK}\n B ")), "a b"),
        (lambda: text.excerpt(F.lit("ab\r\ncd"), 300), "ab  / cd"),
        (lambda: text.excerpt(F.lit("abcd   efgh"), 9), "abcd..."),
        (lambda: text.line_count(F.lit("a\r\nb\n")), 2),
        (lambda: text.line_count(F.lit("")), 0),
        (lambda: text.line_count(F.lit("a\n\nb")), 3),
        (lambda: text.compact_text(F.lit("Hello（Live）[x] World!? (y)")), "hello world"),
        (lambda: text.match_key(F.lit("A · B")), "ab"),
        (lambda: text.clean_lyric(F.lit("[00:01]词\n 作曲 : 某\nop:x\n纯音乐，请欣赏\n尾")), "词 尾"),
        (lambda: text.normalize_token(F.lit("「Ab's」")), "ab's"),
        (lambda: text.contains_any(F.lit("New AGE"), ["age"]), True),
        (lambda: text.matching_tags(F.lit("a 钢琴 piano"), vocab.STYLE_RULES), ["钢琴"]),
        (lambda: text.lyric_json_lines(F.lit('{"c":[{"tx":"作: "},{"tx":"x"}]}\n[0:1]line')), "作: x\n[0:1]line"),
        (lambda: text.lyric_json_lines(F.lit("{bad\nrest")), "rest"),
        (lambda: text.lyric_file_text(F.lit('{"a":1}\n[00:1] x \n[00:2]\n y')), "x\ny"),
        (lambda: text.language_tags(F.lit("华语 | 国语"), F.lit("英语 | 国语")), ["国语", "华语", "英语"]),
        (lambda: text.language_tags(F.lit(""), F.lit("")), ["未知"]),
        (lambda: text.has_web_scheme(F.lit(" HTTPS://x")), True),
        (lambda: text.sorted_json({"b": F.lit('q"'), "a": F.lit("é")}), '{"a": "é", "b": "q\\""}'),
        (lambda: text.score_text(F.lit("x"), F.lit(0.25), "0.0"), "x:0.2"),
        (lambda: numbers.parse_bool(F.lit(" Yes ")), True),
        (lambda: numbers.to_number(F.lit("nan")), 0.0),
        (lambda: numbers.duration_text(F.lit(3599500)), "1:00:00"),
        (lambda: numbers.duration_text(F.lit(61500)), "1:02"),
        (lambda: numbers.duration_text(F.lit(62500)), "1:02"),
        (lambda: numbers.duration_text(F.lit("x")), ""),
        (lambda: numbers.epoch_ms_to_date(F.lit(1700000000000)), "2023-11-14"),
        (lambda: numbers.epoch_ms_to_date(F.lit(0)), ""),
        (lambda: numbers.epoch_ms_to_date(F.lit(10**18)), ""),
        (lambda: numbers.publish_year(F.lit("2020-02-30")), None),
        (lambda: numbers.decade_tag(F.lit("1987-01-01")), "1980年代"),
        (lambda: numbers.decade_tag(F.lit("1969")), None),
        (lambda: numbers.summary_bpm(F.lit("x | bpm | 96")), 96),
        (lambda: numbers.summary_bpm(F.lit("BPM：120")), 120),
        (lambda: numbers.row_bpm([F.lit("300"), F.lit("80.5")], F.lit("")), 80),
        (lambda: numbers.fold_tempo(F.lit(200.0)), 100.0),
        (lambda: numbers.fold_tempo(F.lit(60.0)), 120.0),
        (lambda: numbers.fold_tempo(F.lit(5.0)), 80.0),
        (lambda: numbers.fold_tempo(F.lit(1000.0)), 125.0),
        (lambda: numbers.round_half_even(F.lit(2.5)), 2.0),
        (lambda: arrays.most_common(F.split(F.lit("b a c a b d"), " "), 3), ["b", "a", "c"]),
        (lambda: arrays.most_common(F.array().cast("array<string>"), 3), []),
        (lambda: arrays.union_tags(F.lit("b | a"), F.lit("a | c")), ["b", "a", "c"]),
        (lambda: arrays.finite(F.array(F.lit(float("nan")), F.lit(float("-inf")), F.lit(2.0))), [0.0, 0.0, 2.0]),
        (lambda: F.size(arrays.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))), 2),
    ],
)
def test_expression(spark, build, expected):
    assert value(spark, build()) == expected


def test_fold_tempo_prefers_the_octave_nearest_to_100(spark):
    tempos = [30.0, 55.0, 71.9, 72.0, 99.0, 145.0, 146.0, 190.0, 380.0, 760.0]
    rows = spark.createDataFrame([(t,) for t in tempos], "t double").select("t", numbers.fold_tempo("t").alias("f")).collect()
    for row in rows:
        octaves = [row["t"] * f for f in (0.25, 0.5, 1.0, 2.0, 4.0) if 55 <= row["t"] * f <= 190]
        pool = [o for o in octaves if 72 <= o <= 145] or octaves
        assert row["f"] == sorted(pool, key=lambda o: (abs(o - 100), o))[0]


def test_file_name_separator_kind_decides(spark):
    names = {"A-B - C": ("A-B", "C"), "A – B": ("A", "B"), "A-B-C": ("A", "B-C"), " X ": ("", "X")}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.file_name_identity("n").alias("i")).collect()
    assert {row["n"]: (row["i"]["artist"], row["i"]["title"]) for row in rows} == names


def test_title_terms_drop_whole_titles_and_long_cjk(spark):
    terms = value(
        spark,
        text.title_terms(F.lit("红色 Piano Song"), F.lit(""), F.lit(""), F.lit("一二三四五六七"), F.array(F.lit("未知"))),
    )
    assert terms == ["红色", "piano", "song"]


def test_emoji_counts_as_one_character(spark):
    assert value(spark, text.excerpt(F.lit("😀" * 5), 5)) == "😀" * 5


def test_most_common_agrees_with_a_counter(spark, monkeypatch):
    import random
    from collections import Counter

    import pyarrow as pa

    monkeypatch.setattr(arrays, "COUNTED", 50)
    draw = random.Random(1)
    lists = [None if draw.random() < 0.1 else [draw.choice("abcdefghijklé") for _ in range(draw.randrange(200))] for _ in range(300)]
    for start in (0, 7, 300):
        found = arrays.top_words(pa.array(lists, pa.list_(pa.string())).slice(start), 4).to_pylist()
        assert found == [[word for word, _n in Counter(words or []).most_common(4)] for words in lists[start:]]


def test_blank_and_line_patterns_keep_every_character(spark):
    """The guarded patterns match what the plain classes match, character by character."""
    chars = [chr(code) for code in range(0x3100)]
    rows = spark.createDataFrame([(c,) for c in chars], "c string")
    plain = f"[{text._BLANK_CLASS}]+"
    ends = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
    assert rows.where(F.col("c").rlike(plain) != F.col("c").rlike(text._BLANKS)).count() == 0
    assert rows.where(F.col("c").rlike(ends) != F.col("c").rlike(text._LINE_END)).count() == 0
    pieces = [a + b + d for a in ("", "x", "\r", "\n") for b in ("\r\n", "\n\r", "\n\n", "\r", " ") for d in ("", "y", "\n", "\r\n")]
    found = spark.createDataFrame([(p,) for p in pieces], "c string").select("c", F.split("c", ends).alias("a"), text.lines("c").alias("b"), text.line_count("c").alias("n")).collect()
    for row in found:
        assert row["a"] == row["b"]
        assert row["n"] == len(row["c"].splitlines())


def test_line_counts_need_no_pattern_over_the_text(spark):
    from tonearm.functions import text

    ends = ["\n", "\x0b", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r\n"]
    values = ["", "a", "\r\n", "\n\r", "\r\r\n\n", "钢\u2028琴𝄞\x85", "a\r\nb\rc\n", "\x1fa\x00"] + ends + [f"a{x}b{y}" for x in ends for y in ends]
    df = spark.createDataFrame([(value,) for value in values], "value string").select("value", text.line_count("value").alias("n"))
    assert [(r.value, r.n) for r in df.collect()] == [(value, len(value.splitlines())) for value in values]
    assert dict(df.dtypes)["n"] == "int" and "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
