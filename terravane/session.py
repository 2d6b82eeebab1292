"""Session helpers shared by the whole library: a local session for tests, code shipping and durable cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terravane")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that Python stages can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        target = os.path.join(tempfile.mkdtemp(prefix="terravane-"), "terravane.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        # texts are long rows: smaller batches keep the Python workers small. A setting of the cluster's own stays.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset on a local master (tests) a temp
    folder. On a cluster executors cannot see the driver's temp folders, so there it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="terravane-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. A lost executor costs nothing before this cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terravane-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._terravane_path = path
    return back


def release(df: DataFrame) -> None:
    """Remove what durable() wrote, once nothing reads it any more."""
    path = getattr(df, "_terravane_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver notice which shuffles no plan needs any more, so that their files go before the next phase."""
    gc.collect()
    spark._jvm.System.gc()
