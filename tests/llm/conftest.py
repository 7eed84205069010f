import pytest
from pyspark.sql import Row

#: Extra columns whose names clash with ones the operators make.
CLASH = {"n": 1, "queue": "x", "key": 2, "part": 3, "hash": 4, "score": 5.0, "words": "w", "count": 7}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts, or from (doc_id, text) pairs, in several partitions."""

    def make(texts, clash=False, source=lambda i: f"s{i % 3}"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [Row(doc_id=i, text=t, lang="en", source=source(n), n_chars=len(t or "")) for n, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in CLASH.items()})
        return df

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """Whole documents of the smallest test tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
