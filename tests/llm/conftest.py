import pytest

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; an input may have them too.
CLASHING = ("id", "row", "score", "class", "bucket", "held_out", "chunk", "train", "digest", "label", "a", "b", "url", "gram")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, very long, repeated and equal texts, and columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"Wort{i % 977} und" for i in range(60_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "   \n\t ", None, "a", 6), (4, "the cat sat on the mat", "en", "a", 22),
        (4, "the cat sat on the mat", "en", "a", 22), (5, "the cat sat on the mat", None, None, None), (6, long_text, "de", "b", len(long_text)),
        (None, "no id here at all", "en", "b", 17), (None, None, None, None, None), (7, "x" * 200_000, "en", "b", 200_000),
        (8, "12 34 -- !!", "en", "b", 11), (9, "日本語のテキスト é  ü", "xx", "b", 12), (10, "one", "en", "b", 3), (11, "two words", "en", "b", 9),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.select("*", *[F.lit("other").alias(x) for x in CLASHING])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
