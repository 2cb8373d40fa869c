
import duckdb
import pytest

SF_SMALL, SF_MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "The cat", "one two three four", "one two three four five", "é ß 漢字 😀",
    "ab" * 30_000, "w " * 5_000, "same text here for you and me", "same text here for you and me", "\x00 ctl \x0b x",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeated rows and extra columns."""
    rows = [(None if i == 3 else i // 2, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", i, [1.5], "x")
            for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, taken array<double>, host string"
    )


@pytest.fixture(scope="session")
def small():
    return SF_SMALL


@pytest.fixture(scope="session")
def middle():
    return SF_MIDDLE


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the documents, by id."""
    return duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet' order by 1").fetchall()
