"""The snapshot store: a Parquet folder for each scan and a pointer file that is renamed into place, so readers see a
whole snapshot or the one before it. Paths go through Hadoop's file system; the store may be local or remote."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "3"
TABLES = ("entities", "relationships", "diagnostics", "files")


class StoreError(Exception):
    pass


class Store:
    """Read and write. open_reader() gives one without writing methods."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        jvm = spark._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._read("META")
        if found is None and read_only:
            raise StoreError(f"no index at {path}")
        if found is not None and found["schema"] != SCHEMA_VERSION:
            if read_only:
                raise StoreError(f"index has schema {found['schema']}, {SCHEMA_VERSION} is needed; scan again")
            self._fs.delete(self._p(self.path), True)
            found = None
        if found is None:
            self._put("META", {"schema": SCHEMA_VERSION})

    # -- small files

    def _read(self, name: str):
        p = self._p(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _put(self, name: str, value) -> None:
        """Write beside, then rename over."""
        tmp = self._p(f"{self.path}/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        final = self._p(f"{self.path}/{name}")
        if not self._fs.rename(tmp, final):
            self._fs.delete(final, False)
            if not self._fs.rename(tmp, final):
                raise StoreError(f"could not place {name}")

    def _writable(self) -> None:
        if self.read_only:
            raise StoreError("the index is open read-only")

    # -- scans

    def history(self) -> list[dict]:
        """All scans, latest first."""
        if not self._fs.exists(self._p(f"{self.path}/scans")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/scans")) if not s.getPath().getName().startswith(".")]
        return sorted((self._read(f"scans/{n}") for n in names), key=lambda s: -s["row"])

    def latest(self) -> dict | None:
        return next((s for s in self.history() if s["status"] == "COMPLETED"), None)

    def begin(self, scan_id: str, root: str, files: int) -> dict:
        self._writable()
        row = {"row": 1 + max((s["row"] for s in self.history()), default=0), "scan_id": scan_id, "root": root, "files": files, "status": "IN_PROGRESS", "started": time.time(), "completed": None}
        self._put(f"scans/{row['row']:09d}", row)
        return row

    def _end(self, row: dict, status: str) -> None:
        row.update(status=status, completed=time.time())
        self._put(f"scans/{row['row']:09d}", row)

    def fail(self, row: dict) -> None:
        self._end(row, "FAILED")

    def complete(self, row: dict, model, parsed: DataFrame) -> None:
        """Write the tables and the cache of live files, then move the pointer, then mark the scan."""
        self._writable()
        at = f"{self.path}/snapshots/{row['row']:09d}"
        e, r = model.entities, model.relationships
        # kinds and ends are what lookups filter on: sorted files keep their ranges narrow
        e.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.mode("overwrite").parquet(f"{at}/entities")
        r.repartitionByRange("from_id", "kind").sortWithinPartitions("from_id", "kind", "to_id").write.mode("overwrite").parquet(f"{at}/relationships")
        model.diagnostics.write.mode("overwrite").parquet(f"{at}/diagnostics")
        model.files.write.mode("overwrite").parquet(f"{at}/files")
        parsed.write.mode("overwrite").parquet(f"{at}/cache")
        before = self._read("CURRENT")
        self._put("CURRENT", {"row": row["row"], "scan_id": row["scan_id"], "stats": model.stats, "root": model.root})
        self._end(row, "COMPLETED")
        if before and before["row"] != row["row"]:
            self._fs.delete(self._p(f"{self.path}/snapshots/{before['row']:09d}"), True)

    # -- reading

    def current(self) -> dict | None:
        return self._read("CURRENT")

    def table(self, name: str) -> DataFrame:
        now = self.current()
        if now is None:
            raise StoreError("no completed scan")
        return self.spark.read.parquet(f"{self.path}/snapshots/{now['row']:09d}/{name}")

    def cache(self) -> DataFrame | None:
        return self.table("cache") if self.current() else None

    def changes(self, files: DataFrame) -> DataFrame:
        """path and change of a new listing against the snapshot."""
        from ..operators.analysis import changes

        old = self.table("files").select("path", "hash") if self.current() else files.select("path", "hash").where(F.lit(False))
        return changes(old, files)
