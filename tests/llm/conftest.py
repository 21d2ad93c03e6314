import pytest

LONG = "abc def. " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and runs.", "en", "src0"),
    (2, "", "en", "src1"), (3, None, None, None), (None, "A row without an id but with some words in it", "en", "src0"),
    (5, LONG, "en", "src2"), (6, "one", "de", "src1"), (6, "one", "de", "src1"), (7, " \n\t\n ", "fr", None),
    (8, "The quick brown fox jumps over the lazy dog, and runs.", "en", "src3"), (9, "<|endoftext|> ÄÖ\u00a0x 12 don't", "", "src0"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def odd_rows(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and ids, and columns with clashing names."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.selectExpr("*", "1 as n_tokens", "'x' as row", "true as kept", "2.5 as score", "'z' as key", "'d' as doc", "0 as c", "'y' as n_words")


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()
