"""Fixtures of the corpus tests."""

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use themselves; a table may have them too.
CLASHES = ["id", "key", "n", "size", "u", "digest", "row", "component", "host", "path", "rate", "label", "hash", "evidence", "bad", "_key", "value"]


@pytest.fixture(scope="session")
def documents(spark):
    """A table from (doc_id, text[, lang, source]) rows, on request with columns of clashing names."""
    def make(rows, clashes=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashes:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit(f"x-{c}") for c in CLASHES})
        return df
    return make


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
