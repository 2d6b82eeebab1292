import numpy as np
from pyspark.sql import functions as F

from terravane.llm import mixing as mx


def test_targets():
    assert mx.targets([100, 100, 100]) == [200.0, 83.33333333333333, 166.66666666666666]  # one at its cap, the rest reshared
    t = mx.targets([10, 1000, 50, 700, 3])
    assert abs(sum(t) - 1.5 * 1763) < 1e-6 and all(a <= 2 * b + 1e-9 for a, b in zip(t, [10, 1000, 50, 700, 3]))
    assert mx.targets([]) == [] and mx.targets([0, 0]) == [0.0, 0.0]


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        for key in (0, 7, 123456789):
            assert sorted(mx.permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert (mx.permute(np.arange(1000), 1000, 1) != mx.permute(np.arange(1000), 1000, 2)).any()


def test_plan_uses_every_slot_once():
    size, rows = mx.plan_shards([5000, 0, 12000, 3])
    assert size == mx.SHARD
    for s, n in enumerate([5000, 0, 12000, 3]):
        own = sorted(r for r in rows if r[1] == s)
        assert sum(r[3] for r in own) == n and all(a[2] + a[3] == b[2] for a, b in zip(own, own[1:]))


ROWS = [(i, " ".join(f"w{i}_{k}" for k in range(40 + i % 90)), f"s{i % 4}") for i in range(400)] + [(900, None, "s0"), (901, "", None), (902, "only one", None), (902, "only one", None), (None, "a b c", "s1"), (903, "x " * 20000, "s2")]


def test_mix(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mx.mix(df).collect()
    again = mx.mix(df.repartition(3)).collect()
    key = lambda r: (str(r.id), r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(ROWS)
    assert all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        assert r.size == len((next(t for i, t, s in ROWS if i == r.id and s == r.source) or "").split())
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= mx.BLOCK for t, n in by.values())


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mx.mix(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mx.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()] == [0, 0]


def test_documents_hold_what_was_taken(spark):
    schema = "doc_id long, text string, source string, n_chars long, extra string"
    rows = [(*r, len(r[1] or ""), "e") for r in ROWS if r[0] != 902]
    df = spark.createDataFrame(rows, schema)
    taken = {(r.id, r.source): r.taken for r in mx.mix(df).collect()}
    out = mx.mixed_documents(df).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "n_chars", "extra"}
    for r in out:
        assert len((r.text or "").split()) == taken[r.doc_id, r.source] and r.n_chars == len(r.text or "")
    whole = {i: set((t or "").split()) for i, t, _ in ROWS}
    assert all(set((r.text or "").split()) <= whole[r.doc_id] for r in out)
