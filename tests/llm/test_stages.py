"""Every pipeline stage on rows with nulls, repeated rows, ties and clashing names, against what plain Python says."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, keep string, size string, component_id string"
COMMON = "this passage stands in several documents alike"
LONG = " ".join(f"word{i}" for i in range(400))
ROWS = [
    (1, f"{COMMON}\none own line", "en", "a"), (2, f"{COMMON}\ntwo own line", "en", "a"), (3, f"three own line\n{COMMON}", "en", None), (4, None, None, "b"), (5, "", "en", "b"),
    (6, LONG, "en", "b"), (7, LONG + " end", "en", "a"), (7, LONG + " end", "en", "a"), (None, "a row without an id and some words", None, None), (8, "a b c", "en", "c"), (9, "a b c", "en", "c"),
]


def table(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "w") for r in ROWS], SCHEMA)


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_line_dedup_stage(spark):
    docs = table(spark)
    got = sorted(pipeline.STAGES[1][1](spark, docs, DATA).collect(), key=key)
    want = {1: "one own line", 2: "two own line", 3: f"three own line\n{COMMON}"}
    assert [(r.doc_id, r.text) for r in got] == [(r[0], want.get(r[0], r[1] or "")) for r in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))]
    assert all((r.n_chars, r.n_lines, r.keep, r.size) == (len(r.text), "x", "y", "z") for r in got)
    assert pipeline.STAGES[1][1](spark, docs.drop("n_chars"), DATA).count() == len(ROWS)


def test_ngram_stage(spark):
    got = sorted(pipeline.STAGES[2][1](spark, table(spark), DATA).collect(), key=key)
    ids = [r.doc_id for r in got]
    assert {1, 2, 3, 4, 5, 6, 8, None} == set(ids) and all(r.component_id == "w" for r in got)


def test_toxicity_mixing_and_bpe_stages(spark):
    docs = table(spark)
    kept = pipeline.STAGES[0][1](spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    mixed = pipeline.STAGES[3][1](spark, docs, DATA)
    assert mixed.columns == docs.columns
    words = {r[0]: len((r[1] or "").split()) for r in ROWS}
    assert all(len((r.text or "").split()) <= 2 * words[r.doc_id] for r in mixed.collect())
    out = pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert len(out) == len(ROWS) and all(r.round_trip for r in out)
