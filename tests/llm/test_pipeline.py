import importlib

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = pipeline.STAGES[0][1](spark, docs, DATA)
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    out = pipeline.run(spark, DATA)
    assert out.where(~F.col("round_trip")).count() == 0 and out.select("doc_id").distinct().count() == out.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_registry():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
