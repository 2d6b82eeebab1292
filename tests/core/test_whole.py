"""Queries whose registered SQL keeps only a part of the tables, against the same SQL without that cut."""

import duckdb
import pytest

from terravane import workflows
from terravane.api import Api
from terravane.operators import analysis as an
from terravane.operators import graph as gr
from terravane.operators import neighbors as nb
from terravane.plans import estate as es
from terravane.queries import ORACLES, QUERIES

from .fixtures import edges, entities
from .test_queries import DATA, TABLES, plain

FIRST_ORDERS = "FROM lineitem WHERE l_orderkey < 20"
ONLY_CALLS = " AND r.from_id LIKE 'data:method%' AND r.kind = 'CALLS'"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def whole(name):
    return ORACLES[name].replace(FIRST_ORDERS, "FROM lineitem").replace(ONLY_CALLS, "")


def same(spark, con, name, sql):
    df = QUERIES[name](spark, DATA)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    rows = lambda x: sorted(str(tuple(plain(r[i]) for i in x)) for r in got)
    got = cur.fetchall()
    want = rows([cols.index(c) for c in sorted(cols)])
    got = df.collect()
    assert rows(sorted(cols)) == want


READS_CALLS = "package_coupling package_cycles_scc callers fan_in_top fan_out_top impact_indirect central_score callees dependencies reference_counts resolution_rate dead_code dead_code_percent graph_call graph_architecture confidence_bands".split()


@pytest.mark.parametrize("name", READS_CALLS)
def test_calls_of_all_orders(spark, con, name):
    same(spark, con, name, whole(name))


def test_coupling_and_cycles_are_not_saturated(spark):
    """The tables couple every nation with every other; bands and a cycle of some packages are seen here."""
    n = 8
    e = entities(spark, [(f"p{i}", "PACKAGE", f"p{i}", f"p{i}", {}) for i in range(n)] + [(f"c{i}", "CLASS", f"c{i}", f"c{i}", {}) for i in range(n)] + [(f"m{i}", "METHOD", f"m{i}", f"m{i}", {}) for i in range(n)])
    inside = [(f"p{i}", f"c{i}", "CONTAINS", "DISCOVERED", {}) for i in range(n)] + [(f"c{i}", f"m{i}", "CONTAINS", "DISCOVERED", {}) for i in range(n)]
    r = edges(spark, inside + [("m0", "c1", "CALLS", "RESOLVED", {}), ("c1", "p2", "CALLS", "RESOLVED", {}), ("m2", "m0", "INVOKES", "RESOLVED", {}), ("m2", "c3", "USES", "RESOLVED", {})] + [(f"m{i}", "c3", "CALLS", "RESOLVED", {}) for i in range(4, n)])
    assert {x.package: x.risk for x in an.package_coupling(e, r).collect()} == {f"p{i}": "MEDIUM" if i == 3 else "LOW" for i in range(n)}
    p = an.package_edges(e, r).selectExpr("from_package AS a", "to_package AS b")
    assert {x.member: (x.scc, x.size) for x in gr.cycles(p).collect()} == {f"p{i}": ("p0", 3) for i in range(3)}


def test_names_of_all_suppliers(spark, tmp_path):
    """Nation 0 has nine suppliers, nation 1 has eight, nation 2 one, all but two with keys of 100 and up."""
    suppliers = [(1, 0), (2, 1), *((100 + i, 0) for i in range(8)), *((200 + i, 1) for i in range(7)), (300, 2)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long").selectExpr("*", "'s' AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    events = [(i, "error", '{"k": %d}' % k) for i, k in enumerate([0, 1, 2, 3, 2])] + [(9, "view", '{"k": 1}')]
    spark.createDataFrame(events, "user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    assert QUERIES["candidate_cap"](spark, d).first().asDict() == {"resolved": 3, "unresolved": 1, "ambiguous": 1}
    eight = ["data:method:T2", *(f"data:method:T{200 + i}" for i in range(7))]
    two = [("data:type:C2", "data:method:T300"), ("data:type:C4", "data:method:T300")]
    links = lambda q: sorted((r.from_id, r.to_id) for r in QUERIES[q](spark, d).collect())
    assert links("name_resolution") == sorted([("data:type:C1", x) for x in eight] + two)
    # two arguments: of nation 0 four suppliers have odd keys and are under the cap, of nation 1 three; 300 is all there is
    odd = lambda n: [f"data:method:T{k}" for k, of in suppliers if of == n and k % 2]
    assert links("arity_resolution") == sorted([("data:type:C0", x) for x in odd(0)] + [("data:type:C1", x) for x in odd(1)] + two)


def best_by_brute_force(out, starts, store, depth=8):
    """Best simple path of each start, by depth-first search. out: node to {neighbour: surest confidence}."""
    best = {}
    for s in starts:
        stack = [([s], 1.0)]
        while stack:
            path, c = stack.pop()
            more = [(t, x) for t, x in out.get(path[-1], {}).items() if t not in path] if len(path) <= depth else []
            stack += [([*path, t], min(c, x)) for t, x in more]
            if not more and len(path) > 1:
                own = (not store(path[-1]), -len(path), -c, path[-1], "|".join(path))
                best[s] = min(best.get(s, own), own)
    return {s: (p, round(-c, 2), not k) for s, (k, _, c, _, p) in best.items()}


def surest(rows):
    out = {}
    for a, b, c in rows:
        out.setdefault(a, {})[b] = max(c, out.get(a, {}).get(b, 0.0))
    return out


def test_best_path_of_every_order(spark):
    from terravane.model import confidence

    e = es.invocations(spark, DATA).unionByName(es.touches(spark, DATA).where("kind <> 'USES'")).where("status <> 'UNRESOLVED'")
    out = surest((r.from_id, r.to_id, r.c) for r in e.select("from_id", "to_id", confidence().alias("c")).collect())
    starts = [f"data:method:O{r[0]}" for r in es.table(spark, DATA, "orders").select("o_orderkey").collect()]
    want = best_by_brute_force(out, starts, lambda n: n.startswith("sql:"))
    got = {r.start: (r.path, r.confidence, r.store) for r in QUERIES["best_path_per_start"](spark, DATA).collect()}
    assert got == want and max(p.count("|") for p, _, _ in got.values()) == 8


def test_expand_on_cycles_and_parallel_edges(spark):
    rows = [("a", "b", 0.5), ("a", "b", 0.9), ("b", "a", 0.8), ("b", "c", 0.7), ("c", "b", 1.0), ("d", "d", 1.0), ("c", "t", 0.6)]
    e = spark.createDataFrame(rows, "from_id string, to_id string, confidence double")
    starts = spark.createDataFrame([(x,) for x in "abdt"], "id string")
    got = sorted(("".join(r.nodes), r.confidence) for r in gr.expand(e, starts, 8).collect())
    assert got == [("abct", 0.6), ("ba", 0.8), ("bct", 0.6)]


def test_dependents_of_everything(spark, con):
    same(spark, con, "dependents_antijoin", whole("dependents_antijoin").replace(" WHERE to_id LIKE 'data:type:S%'", ""))


def test_dependents_hide_calls_that_are_invoked(spark):
    e = entities(spark, [(i, "METHOD", i, i, {}) for i in "abc"])
    r = edges(spark, [("a", "b", "CALLS", "RESOLVED", {}), ("a", "b", "INVOKES", "RESOLVED", {}), ("c", "b", "CALLS", "RESOLVED", {}), ("b", "c", "INVOKES", "RESOLVED", {}), ("b", "gone", "CALLS", "RESOLVED", {}), ("gone", "a", "CALLS", "RESOLVED", {})])
    got = sorted((x.entity_id, x.other_id, x.edge_kind) for x in nb.neighbors(e, r, None).collect())
    assert got == [("b", "a", "INVOKES"), ("b", "c", "CALLS"), ("c", "b", "INVOKES"), ("gone", "b", "CALLS")]


def estate(spark, e, r):
    none = spark.createDataFrame([], "status string")
    return Api(spark, entities(spark, e), edges(spark, r), none, none, "s")


def test_coverage_and_samples_follow_eight_edges(spark):
    """An endpoint whose table is 8 edges away, one 9 away, and one without a table."""
    def chain(name, n):
        ids = [f"java:endpoint:{name}", *(f"java:method:{name}{i}" for i in range(1, n)), f"sql:table:{name}"]
        kinds = ["ENDPOINT", *["METHOD"] * (n - 1), "DATABASE_OBJECT"]
        return [(i, k, i, i, {}) for i, k in zip(ids, kinds)], [(a, b, "INVOKES", "RESOLVED", {}) for a, b in zip(ids, ids[1:])]

    (e8, r8), (e9, r9) = chain("A", 8), chain("B", 9)
    api = estate(spark, [*e8, *e9, ("java:endpoint:C", "ENDPOINT", "C", "C", {})], [*r8, *r9, ("java:endpoint:C", "java:method:B8", "INVOKES", "UNRESOLVED", {})])
    c = workflows.lineage_coverage(api)
    assert (c["endpoints"], c["endpointsWithStore"], c["completePaths"], c["partialPaths"]) == (3, 1, 1, 1)
    got = {r["start"]: (r["store"], r["path"].count("|")) for r in workflows.lineage_samples(api)}
    assert got == {"java:endpoint:A": (True, 8), "java:endpoint:B": (False, 8)}


def test_samples_see_every_start(spark):
    tasks = [(f"ada:task:t{i:03d}", "TASK", "t", f"t{i}", {}) for i in range(201)]
    api = estate(spark, [*tasks, ("java:endpoint:z", "ENDPOINT", "z", "z", {}), ("sql:table:x", "DATABASE_OBJECT", "x", "x", {})], [(t[0], "v", "INVOKES", "RESOLVED", {}) for t in tasks] + [("java:endpoint:z", "sql:table:x", "READS_FROM", "RESOLVED", {})])
    got = workflows.lineage_samples(api)
    assert [r["start"] for r in got] == ["java:endpoint:z", *(f"ada:task:t{i:03d}" for i in range(4))]


def test_trace_all_equals_single_traces(spark):
    import random

    rnd = random.Random(5)
    rows = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", rnd.choice(["INVOKES", "MAPS_TO"]), "RESOLVED", {"confidence": rnd.choice(["0.95", "0.50"])}) for _ in range(34)]
    e, r = entities(spark, [(f"n{i}", "METHOD", f"n{i}", f"n{i}", {}) for i in range(14)]), edges(spark, rows)
    starts = ["n0", "n3"]
    got = gr.trace_all(gr.lineage_edges(r), spark.createDataFrame([(s,) for s in starts], "id string"), 5, 6).collect()
    for s in starts:
        want = sorted((list(p.nodes), p.confidence) for p in gr.trace(e, r, s, depth=5, most=6).paths.collect())
        assert sorted((list(p.nodes), p.confidence) for p in got if p.start == s) == want and want


def test_package_of_deeply_nested_entities(spark):
    n = 15
    e = entities(spark, [("p", "PACKAGE", "p", "p", {}), ("q", "PACKAGE", "q", "q", {}), ("r", "CLASS", "r", "r", {})] + [(f"c{i:02d}", "CLASS", "c", f"c{i}", {}) for i in range(n)])
    inside = [("p", "c00"), *((f"c{i:02d}", f"c{i + 1:02d}") for i in range(n - 1)), (f"c{n - 1:02d}", "c03"), ("c05", "q"), ("q", "r")]
    r = edges(spark, [(a, b, "CONTAINS", "DISCOVERED", {}) for a, b in inside] + [(f"c{n - 1:02d}", "r", "CALLS", "RESOLVED", {})])
    got = {x.id: x.package for x in an.entity_to_package(e, r).collect()}
    assert got == {"p": "p", "q": "q", "r": "q", **{f"c{i:02d}": "p" for i in range(n)}}
    assert [tuple(x) for x in an.package_edges(e, r).collect()] == [("p", "q")]
