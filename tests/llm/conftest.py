import os

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` rows, with columns whose names operators use inside."""

    def make(rows):
        docs = spark.createDataFrame([(d, t, "xx", len(t or "")) for d, t in rows], SCHEMA)
        for name in ("doc", "row", "score", "keep", "n_lines", "ids", "start", "node", "component", "spans", "kept", "bucket"):
            docs = docs.withColumn(name, F.lit("own"))
        return docs

    return make


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    return lambda name: spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@pytest.fixture(scope="session")
def texts(given):
    """All documents of the small table, as ``(doc_id, text)``, in order."""
    return sorted((r["doc_id"], r["text"] or "") for r in given("documents").select("doc_id", "text").collect())
