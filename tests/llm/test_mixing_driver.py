"""What the mix leaves to the driver."""

import pytest
from pyspark.sql import functions as F

from terravane.llm import mixing as mx


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "Join " in x and "src" in x and "block" in x]


@pytest.mark.parametrize("of", ["pieces", "documents"])
def test_slots_are_not_broadcast(spark, of):
    """Many slots from a plan of a few rows, which looks small enough to be broadcast."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"), F.lit("s").alias("source"))
    df = mx.Mix(docs).pieces() if of == "pieces" else mx.mixed_documents(docs)
    df.collect()
    assert joins(df) and all("SortMergeJoin" in x for x in joins(df))


def test_plan_is_drawn_by_an_executor(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 500).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    m = mx.Mix(docs)
    plan = m.plan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan
    rows = sorted((r.shard, r.src, r.first, r.n) for r in m.plan.collect())
    slots = [sum(r[3] for r in rows if r[1] == s) for s in range(3)]
    assert rows == sorted(mx.plan_shards(slots)[1]) and all(slots)
