import pytest

public = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score0 double, word string, ids0 array<int>"


@pytest.fixture(scope="session")
def vocabulary():
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


@pytest.fixture(scope="session")
def file_vocabulary():
    return public.path("byte_bpe_50k.json"), public.PATTERN


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of texts, with columns besides the usual ones."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", len(t or ""), 0.5, "w", [1]) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest test table."""
    import duckdb

    return duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
