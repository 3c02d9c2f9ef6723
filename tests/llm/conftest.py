import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts or (id, text) pairs, with the columns of the table."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and blank texts, repeated rows, a very long text."""
    long_ = " ".join(f"word{i % 977}x" for i in range(30000))
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "no id here at all, really"), (None, None)]
    return frame([*rows, (2, None), (3, ""), (4, " \t\n\r "), (5, long_), (6, long_ + " end"), (7, "a"), (8, "é ü\n日本 😀")])


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns that bear the names of results."""
    from pyspark.sql import functions as F

    names = ["n", "id", "kept", "score", "component_id", "digest", "gid", "root", "length", "_seq", "spans", "line", "doc", "node", "v", "toxic"]
    return odd.select("*", *[F.lit("x").alias(c) for c in names])


def key(row):
    return repr(row)
