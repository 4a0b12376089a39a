import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions beneath a crooked silver moon near the old stone bridge"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with those the operators use."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("size", "keep_id", "score", "piece", "run", "rep", "digest", "grp", "_label", "x"):
            df = df.withColumn(name, df["lang"])
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one long text, unusual characters."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, PROSE), (5, PROSE), (5, PROSE), (None, PROSE), (None, None), (6, "word " * 60_000), (7, "x" * 300_000), (8, "É ü \x1c   ß 'll don't"), (9, PROSE.replace(" ", "\n  "))]
