import duckdb
import pytest

SF = "/root/testdata/sf0.001"

EDGE = [
    (1, None, "s", "en"),
    (2, "", "s", "en"),
    (3, " \n\t ", None, "en"),
    (4, "one", "s", None),
    (5, "the same words " * 40, "s", "en"),
    (6, "the same words " * 40, "s", "en"),
    (6, "the same words " * 40, "s", "en"),
    (7, " ".join(f"w{i}" for i in range(60_000)), "s", "de"),
    (None, "a text without an id that is long enough to count for something here", "s", "en"),
    (8, "naïve café \U0001f600 größe <|endoftext|> x", "t", "fr"),
]


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, blanks, ties, repeated rows, a long text, and columns whose names clash with the operators' own."""
    rows = [(*r, i, i, i) for i, r in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int, score int, tokens int")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
