import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from terravane.llm import line_dedup as ld

LONG = "This line is long enough to be a key"


def brute(rows, min_chars=20, min_docs=3):
    strip = " \t\n\v\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for i, t in rows:
        for l in (t or "").split("\n"):
            k = l.strip(strip).translate(lower)
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda l: len(h := holders.get(l.strip(strip).translate(lower), ())) >= min_docs and i != max(h)
        kept = [l for l in lines if not gone(l)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


ROWS = [
    (1, f"a\n{LONG}\nb"), (2, f"  {LONG.upper()}\t\n{LONG}"), (3, LONG), (4, "short\nshort\n"), (5, None), (6, ""), (7, "short"), (8, "short\n\n\n"),
    (9, "é" * 20 + "\nx"), (10, "é" * 20), (11, "é" * 20), (12, "É" * 20), (13, "\n".join(f"{LONG} {i % 7}" for i in range(3000))), (14, f"{LONG} 1\n{LONG} 2"), (15, f"{LONG} 1"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = ld.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256))
    assert sorted(map(tuple, got.collect())) == brute(ROWS)


def test_keep_runs_rebuild_the_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    texts = dict(ROWS)
    for r in ld.dedup_lines(df).collect():
        lines = (texts[r.doc_id] or "").split("\n")
        assert "\n".join(l for first, n in r.keep for l in lines[first : first + n]) == r.text


def test_clashing_columns_repeated_and_null_ids(spark):
    rows = [(1, LONG, "x", 5), (1, LONG, "y", 6), (None, LONG, "z", 7), (2, LONG, "w", 8), (3, "other", "v", 9)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, key string, n_lines int"))
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped", "keep"]
    got = sorted((r.key, r.text, r.n_dropped) for r in out.collect())
    # ids 1 and 2 are two documents at most with the null one as a third or not counted: the largest id keeps its line
    assert ("v", "other", 0) in got and ("w", LONG, 0) in got
    assert len(got) == 5


def test_empty_table(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4])
def test_threshold(spark, n):
    df = spark.createDataFrame([(i, LONG) for i in range(n)], "doc_id long, text string")
    assert ld.dedup_lines(df).agg(F.sum("n_dropped")).first()[0] == (n - 1 if n >= 3 else 0)


def test_sql_twin(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(ld.ORACLE).fetchall())
    assert sorted(map(tuple, ld.op2_line_dedup(spark, str(tmp_path)).collect())) == want
