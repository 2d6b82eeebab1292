"""An extension of ours: rescans as a stream. Listings (path, hash, seen) arrive as files; each micro-batch is compared with
the table of known hashes, changes are appended, and the table is replaced. A batch that is replayed after a failure
finds its own changes written under its number and overwrites them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import changes


def known(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The hashes after a batch; before the first there are none."""
    if batch < 0:
        return spark.createDataFrame([], "path string, hash string")
    return spark.read.parquet(f"{folder}/known/batch={batch}")


def follow(listings: DataFrame, folder: str, checkpoint: str):
    """Start the stream. The latest listing of a path in a batch counts; paths not listed stay as they are."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy("path").agg(F.max_by("hash", "seen").alias("hash"))
        before = known(spark, folder, n - 1)
        delta = changes(before, now).where("change IN ('added', 'changed')")
        delta.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")
        rest = before.join(now.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti")
        rest.unionByName(now).write.mode("overwrite").parquet(f"{folder}/known/batch={n}")

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
