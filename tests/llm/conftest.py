import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, with ids in order, or from (id, text) pairs."""

    def make(texts):
        rows = [(k, t, "en", f"s{k % 3}", len(t or "")) if not isinstance(t, tuple) else (t[0], t[1], "en", "s0", len(t[1] or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, repeated rows, ids of several texts."""
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (None, "null id here"), (None, None), (5, "same row twice " * 30), (5, "same row twice " * 30), (5, "another text " * 30), (6, "long word " * 30000), (7, "é😀 <|endoftext|> Ünï " * 10)])
