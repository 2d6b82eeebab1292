"""The repository scan as a Spark data source, and the distributed extraction of facts from what it lists.

Listing a tree is one task's work (directory names, sizes); reading, hashing and parsing files is spread over tasks, by
size. The built-in binary source is not used: it hides names that begin with a dot or underscore.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import time
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import count_lines
from ..functions.text import category as category_of
from ..functions.text import language as language_of
from ..session import ship
from .facts import Facts, registry

#: Directories that are not scanned, and the limits of a scan.
EXCLUDED = (".git", ".svn", ".hg", "target", "build", "out", "dist", "node_modules", "bin", "obj", ".idea", ".vscode", ".gradle", ".mvn")
MIB, GIB = 1 << 20, 1 << 30
PART_BYTES = 128 * MIB


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 8 * MIB
    files: int = 250_000
    total_bytes: int = 20 * GIB
    seconds: int = 30 * 60
    threads: int = 32
    excluded: tuple[str, ...] = EXCLUDED
    follow_links: bool = False


HARDENED = Limits(4 * MIB, 100_000, 2 * GIB, 15 * 60, 8)


class ScanError(Exception):
    pass


def walk(root: str, limits: Limits = Limits()) -> list[tuple[str, str, int]]:
    """(relative path, absolute path, size) in order of path. Oversize files and excluded directories are passed over;
    too many files, bytes or seconds fail the scan."""
    out, total, began = [], 0, time.monotonic()
    for at, dirs, names in os.walk(root, followlinks=limits.follow_links):
        dirs[:] = sorted(d for d in dirs if d not in limits.excluded and (limits.follow_links or not os.path.islink(os.path.join(at, d))))
        for n in sorted(names):
            p = os.path.join(at, n)
            if not os.path.isfile(p) or (os.path.islink(p) and not limits.follow_links):
                continue
            size = os.path.getsize(p)
            if size > limits.file_bytes:
                continue
            out.append((os.path.relpath(p, root).replace(os.sep, "/"), os.path.abspath(p), size))
            total += size
            if len(out) > limits.files:
                raise ScanError(f"more than {limits.files} files")
            if total > limits.total_bytes:
                raise ScanError(f"more than {limits.total_bytes} bytes")
            if time.monotonic() - began > limits.seconds:
                raise ScanError(f"more than {limits.seconds} seconds")
    return sorted(out)


class TreePartition(InputPartition):
    def __init__(self, files):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.limits = HARDENED if str(options.get("hardened", "false")).lower() == "true" else Limits()
        self.parts = int(options.get("partitions", "8"))

    def partitions(self):
        """Files dealt so that parts hold about the same number of bytes: `partitions` parts, more where those would be above PART_BYTES."""
        files = sorted(walk(self.root, self.limits), key=lambda f: -f[2])
        parts: list[list] = [[] for _ in range(max(self.parts, -(-sum(f[2] + 4096 for f in files) // PART_BYTES)))]
        load = [(0, i) for i in range(len(parts))]  # a heap: the lightest part comes first
        for f in files:
            n, i = load[0]
            parts[i].append(f)
            heapq.heapreplace(load, (n + f[2] + 4096, i))
        return [TreePartition(sorted(p)) for p in parts if p] or [TreePartition([])]

    def read(self, partition):
        for path, full, size in partition.files:
            with open(full, "rb") as f:
                content = f.read()
            if len(content) != size:
                raise ScanError(f"{path} changed while it was read")
            yield path, full, size, content


class TreeSource(DataSource):
    """spark.read.format("source_tree").load(root): path, abs_path, size, content."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, abs_path string, size long, content binary"

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, hardened: bool = False, partitions: int | None = None) -> DataFrame:
    """At least as many parts as the cluster runs tasks at once, unless told otherwise."""
    ship(spark)
    partitions = partitions or spark.sparkContext.defaultParallelism
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("hardened", str(hardened).lower()).option("partitions", str(partitions)).load(root)


def describe(tree: DataFrame) -> DataFrame:
    """The files table: path, abs_path, language, category, size, hash."""
    return tree.select("path", "abs_path", language_of(F.col("path")).alias("language"), category_of(F.col("path")).alias("category"), "size", F.sha2("content", 256).alias("hash"))


def rollups(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    by = lambda c: files.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(c)
    return by("language"), by("category")


LOC_TYPE = "struct<file:string,s_line:int,e_line:int,s_col:int,e_col:int>"
ENTITY_TYPE = f"struct<id:string,kind:string,name:string,qualified_name:string,language:string,loc:{LOC_TYPE},attrs:map<string,string>>"
EDGE_TYPE = f"struct<from_id:string,to_id:string,kind:string,resolved:boolean,status:string,loc:{LOC_TYPE},attrs:map<string,string>>"
PARSED = f"path string, hash string, language string, size long, parser_id string, parser_version string, status string, total int, comment int, blank int, issues array<string>, entities array<{ENTITY_TYPE}>, relationships array<{EDGE_TYPE}>"

_LOC = pa.struct([("file", pa.string()), *((c, pa.int32()) for c in ("s_line", "e_line", "s_col", "e_col"))])
_BAG = pa.map_(pa.string(), pa.string())
_ENTITY = pa.struct([*((c, pa.string()) for c in ("id", "kind", "name", "qualified_name", "language")), ("loc", _LOC), ("attrs", _BAG)])
_EDGE = pa.struct([("from_id", pa.string()), ("to_id", pa.string()), ("kind", pa.string()), ("resolved", pa.bool_()), ("status", pa.string()), ("loc", _LOC), ("attrs", _BAG)])


@dataclass
class Parsed:
    status: str
    parser: str | None = None
    version: str | None = None
    lines: tuple[int, int, int] = (0, 0, 0)
    facts: Facts | None = field(default=None)


def parse(path: str, content: bytes, content_hash: str, language: str, extractors=None) -> Parsed:
    """ANALYZED, FAILED (an error or nothing but issues), UNREADABLE (a NUL byte early on) or SKIPPED (no extractor)."""
    if b"\0" in content[:8000]:
        return Parsed("UNREADABLE")
    text = content.decode("utf-8", "replace")
    lines = count_lines(text, language)
    own = next((e for e in (extractors or registry()) if e.supports(path)), None)
    if own is None:
        return Parsed("SKIPPED", lines=lines)
    try:
        facts = own.extract(path, text, content_hash)
    except Exception as e:  # an extractor's fault costs its file, not the scan
        facts = Facts(path, own.id)
        facts.error(f"{type(e).__name__}: {e}")
    bad = any(k == "ERROR" for k, _, _ in facts.issues)
    return Parsed("FAILED" if bad else "ANALYZED", own.id, own.version, lines, facts)


def extract(tree: DataFrame) -> DataFrame:
    """One row a file with its facts; a file is parsed where it is read, and nothing is shuffled."""
    ship(tree.sparkSession)
    d = tree.select("path", F.sha2("content", 256).alias("hash"), language_of(F.col("path")).alias("language"), "size", "content")

    def run(batches):
        extractors = registry()
        bag = lambda x: {**x, "attrs": list(x["attrs"].items())}
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                path, hash_, lang, size, content = (part.column(i).to_pylist() for i in range(5))
                got = [parse(p, c, h, l, extractors) for p, c, h, l in zip(path, content, hash_, lang)]
                issues = [[f"{a}:{n}: {m}" for a, m, n in g.facts.issues] if g.facts else [] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(path, pa.string()), pa.array(hash_, pa.string()), pa.array(lang, pa.string()), pa.array(size, pa.int64()), pa.array([g.parser for g in got], pa.string()), pa.array([g.version for g in got], pa.string()),
                        pa.array([g.status for g in got], pa.string()), *(pa.array([g.lines[i] for g in got], pa.int32()) for i in range(3)), pa.array(issues, pa.list_(pa.string())),
                        pa.array([[bag(x) for x in g.facts.entities] if g.facts else [] for g in got], pa.list_(_ENTITY)), pa.array([[bag(x) for x in g.facts.relationships] if g.facts else [] for g in got], pa.list_(_EDGE)),
                    ],
                    names=["path", "hash", "language", "size", "parser_id", "parser_version", "status", "total", "comment", "blank", "issues", "entities", "relationships"],
                )

    return d.mapInArrow(run, PARSED)


def index_location(root: str) -> str:
    """<name>-<8 hex digits of the hash of the absolute path>."""
    full = os.path.abspath(root)
    return f"{os.path.basename(full)}-{hashlib.sha256(full.encode()).hexdigest()[:8]}"


