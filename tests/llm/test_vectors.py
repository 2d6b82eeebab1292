import numpy as np
import pytest

from terravane.llm import vector_dedup as vd
from terravane.llm import vector_search as vs
from terravane.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    par = {r[0]: r[0] for r in rows}

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    links = {r[0]: 0 for r in rows}
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for a in range(len(ok)):
        for b in range(a):
            x, y = np.array(ok[a][1], np.float32).astype(float), np.array(ok[b][1], np.float32).astype(float)
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= vd.THRESHOLD:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                p, q = sorted((find(ok[a][0]), find(ok[b][0])))
                par[q] = p
    return {i: (links[i], find(i)) for i in par}


def sample(n=300, group=60):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 3)) for i in range(n)]
    centre = rng.standard_normal(16)
    rows += [(n + i, (centre + rng.standard_normal(16) * 0.15).tolist(), 1) for i in range(group)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(2000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    return rows + [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [float("inf")] + [1.0] * 15, 1), (3004, rows[0][1], None), (3005, [None] * 16, 1), (3006, [], 1), (3007, [1e30] * 16, 2), (3008, [1e-30] * 16, 2)]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vd, "TILE", 16)  # hot buckets become many tiles
    rows = sample()
    got = vd.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "label")).collect()
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_empty_and_extra_columns(spark):
    assert vd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 0, 7, "x")], "vec_id long, embedding array<float>, label int, rep long, sig string")
    assert vd.near_duplicates(df).count() == 1


def test_tables_grow_with_the_table():
    for n in (10, 10_000, 10_000_000):
        bits, tables = vd.tables_for(n)
        meet = (1 - np.arccos(vd.THRESHOLD) / np.pi) ** bits
        assert 1 - (1 - meet) ** tables >= vd.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 80)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, **{500 + i: 500 for i in range(80)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("scale", [False, True])
def test_search_recall(spark, scale):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.5, 3.0, (3000, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(6000, None), (6020, [0.0] * 24), (6040, [float("nan")] * 24), (6060, [None] * 24)]
    got = vs.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits, d = 0, x.astype(float)
    assert set(by) == set(range(0, 3000, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        s = d @ d[q]
        s[q] = -np.inf
        assert [r.rank for r in found] == list(range(1, 21)) and all(r.vec_id != q for r in found)
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in found) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9


def test_search_small_tables(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    assert vs.search(spark.createDataFrame([], schema)).count() == 0
    rows = [(20 * i, [float(i), 1.0], 0) for i in range(5)]
    got = vs.search(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 * 4 and {r.query_id for r in got} == {0, 20, 40, 60, 80}
    ties = [(i, [1.0, 0.0], 0) for i in range(30)]
    assert [r.vec_id for r in sorted(vs.search(spark.createDataFrame(ties, schema)).where("query_id = 20").collect(), key=lambda r: r.rank)] == list(range(20))


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0, 0.0], 1 << 40), (5, [0.0, 1.0, 0.0], 1 << 40), (6, [1.0, 0.05, 0.0], 1 << 40), (7, [0.05, 1.0, 0.0], 1 << 40)]
    schema = "vec_id long, embedding array<double>, label long"
    got = vd.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]
    named = spark.createDataFrame([(i, v, f"k{l % 7}") for i, v, l in rows], schema.replace("label long", "label string"))
    assert sorted(r.n_links for r in vd.near_duplicates(named).collect()) == [1, 1, 1, 1]


def test_queries_that_share_an_id(spark):
    rng = np.random.default_rng(3)
    rows = [(20, rng.standard_normal(8).tolist()), (20, rng.standard_normal(8).tolist())] + [(i, rng.standard_normal(8).tolist()) for i in range(21, 60) if i % 20]
    got = vs.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = []
    for n in (0, 1):
        s = [(-float(np.dot(rows[n][1], x)), i) for k, (i, x) in enumerate(rows) if k != n]
        want += [(20, r + 1, i) for r, (_, i) in enumerate(sorted(s)[:20])]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)


def test_short_lists_are_extended(spark, monkeypatch):
    """One probe of lists of a few rows: every query still gets 20 rows."""
    monkeypatch.setattr(vs, "PER_LIST", 4)
    monkeypatch.setattr(vs, "probes_for", lambda *a, **k: 1)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    got = vs.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 * 20
