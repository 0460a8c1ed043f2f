import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


#: Names that operators use inside; inputs may have them as columns of their own.
CLASHING = ("n_words", "fp", "key", "hash", "score", "kept", "host", "m", "h", "th", "c", "size", "class", "salt", "spans", "component_id", "base_failed", "copies", "_measures", "_candidates", "_key", "_bitmap", "_page", "_place", "_target", "_kept_key", "__kept_key", "__kept_id", "copy", "source_size", "target", "taken", "_row", "_row_key")
LONG = "lorem Ipsum " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls everywhere, empty and long texts, ties, repeats and clashing columns."""
    rows = [(1, "alpha beta Gamma delta epsilon zeta eta theta iota kappa", "a"), (1, "alpha beta Gamma delta epsilon zeta eta theta iota kappa", "a"), (2, "", "a"), (3, None, None), (None, "alpha beta", None), (None, None, "b"), (4, " \n\t ", "b"), (5, LONG, "b"), (6, "é😀 ñ\nmail a@b.co", "c"), (7, "one", "c")]
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return d.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
