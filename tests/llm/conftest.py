import pytest
from pyspark.sql import types as T

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a documents table of (doc_id, text) pairs."""

    def make(pairs, parts=3):
        rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOC).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd(frame, spark):
    """Documents with nulls, empty and long texts, repeats, and extra columns whose names clash with common ones."""
    words = [f"w{k % 97}x{k}" for k in range(3000)]
    long = " ".join(words)
    base = " ".join(words[:120])
    pairs = [(1, base), (1, base), (2, base), (None, base), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, "a"), (8, "two words"), (9, base.replace("w5x5", "changed")), (None, None), (10, long + " end")]
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("key", "label", "pos", "n", "length", "bucket", "text_crc32", "shard", "item_id", "_file", "a", "b")}
    return frame(pairs).withColumns(extra)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOC))
