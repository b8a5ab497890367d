import pytest

ROWS = [
    (1, "a b c d e f g h i j k l", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", "fr", None),
    (4, "a b  c d e\tf g h i j k l", "en", "s2"),
    (5, " \n ", None, "s2"),
    (6, "x " * 30_000, "de", "s2"),
    (7, "one two", "en", "s1"),
    (7, "one two", "en", "s1"),
    (8, "ünï😀 cödé \\ ### Assistant: </turn> & <b>", "de", "s3"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with outputs."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", "'x' as kept", "1 as votes", "2 as size", "3 as n_words", "4 as target", "5 as name")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
