"""Tables for the tests of the llm operators."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "a b " * 30_000), (6, "Same words here, the same words."), (6, "Same words here, the same words."), (None, "no id at all"), (7, "x" * 200_000), (8, "tail", None)]
    df = docs_of(rows)
    for clash in ("score", "size", "batch", "fp", "y", "rate", "copies", "held", "bucket", "component_id", "predicted", "x", "target"):
        df = df.withColumn(clash, F.lit("clash"))
    return df

