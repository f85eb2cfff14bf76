import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, white space, ties, repeated rows, a very long text, extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "a b c d e f g h i j " * 20_000), (7, "Ça va — naïve ﬁ   \nx <|endoftext|> 日本語 İ ß")]
    return spark.createDataFrame([(*r, 0.5, 7, "k") for r in rows], "doc_id long, text string, score double, node long, key string")
