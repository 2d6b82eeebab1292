from pyspark.sql import functions as F

from terravane.model import stable_id, stable_id_column
from terravane.operators import analysis as an
from terravane.operators import graph as gr
from terravane.operators import neighbors as nb
from terravane.operators import resolution as rs

from .fixtures import edges, entities


def ents(spark, ids, **attrs):
    return entities(spark, [(i, "METHOD", i, i, attrs) for i in ids])


def paths(t):
    return [r.nodes for r in t.paths.orderBy("no").collect()]


def test_cycle_is_cut(spark):
    e = edges(spark, [("A", "B", "INVOKES", "RESOLVED", {"confidence": "0.95"}), ("B", "A", "INVOKES", "RESOLVED", {"confidence": "0.95"})])
    t = gr.trace(ents(spark, "AB"), e, "A")
    assert paths(t) == [["A", "B"]] and t.cycles and not t.truncated


def test_depth_is_cut(spark):
    e = edges(spark, [(f"C{i}", f"C{i + 1}", "INVOKES", "RESOLVED", {}) for i in range(5)])
    t = gr.trace(ents(spark, [f"C{i}" for i in range(6)]), e, "C0", depth=2)
    assert paths(t) == [["C0", "C1", "C2"]] and t.truncated


def test_filters(spark):
    e = edges(spark, [("A", "B", "INVOKES", "RESOLVED", {"confidence": "0.95"}), ("A", "C", "INVOKES", "RESOLVED", {"confidence": "0.30"}), ("A", "D", "INVOKES", "INFERRED", {"confidence": "0.60"})])
    assert paths(gr.trace(ents(spark, "ABCD"), e, "A", inferred=False)) == [["A", "B"]]
    t = gr.trace(ents(spark, "ABCD"), e, "A")
    assert paths(t) == [["A", "B"], ["A", "D"]] and [r.confidence for r in t.paths.orderBy("no").collect()] == [0.95, 0.60]


def test_unresolved_is_a_gap_and_unknown_start(spark):
    e = edges(spark, [("A", "External#gone()", "INVOKES", "UNRESOLVED", {})])
    t = gr.trace(ents(spark, "A"), e, "A")
    assert paths(t) == [] and [r.reason for r in t.gaps.collect()] == ["UNRESOLVED_TARGET"]
    assert [r.reason for r in gr.trace(ents(spark, "A"), e, "nowhere").gaps.collect()] == ["UNKNOWN_START"]


def test_order_and_cap(spark):
    e = edges(spark, [("A", x, "INVOKES", "RESOLVED", {}) for x in "ZMB"])
    assert paths(gr.trace(ents(spark, "AZMB"), e, "A")) == [["A", "B"], ["A", "M"], ["A", "Z"]]
    wide = edges(spark, [("A", f"x{i:03d}", "INVOKES", "RESOLVED", {}) for i in range(150)])
    t = gr.trace(ents(spark, "A"), wide, "A")
    assert len(paths(t)) == 100 and t.truncated and paths(t)[-1] == ["A", "x099"]
    up = gr.trace(ents(spark, "A"), wide, "x007", "up")
    assert paths(up) == [["x007", "A"]]


def test_dependents_and_layers(spark):
    e = edges(spark, [(f"n{i + 1}", f"n{i}", "CALLS", "RESOLVED", {}) for i in range(8)])
    direct = spark.createDataFrame([("n1",)], "id string")
    assert {r.id: r.hop for r in gr.dependents(e, "n0", direct, 3).collect()} == {"n2": 1, "n3": 2, "n4": 3}
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], "a string, b string")
    assert {r.id: r.layer for r in gr.layers(pairs).collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    assert gr.layers_small([("a", "b"), ("b", "a"), ("b", "c")])["c"] >= 1


def test_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x")], "a string, b string")
    assert {r.member: (r.scc, r.size) for r in gr.cycles(pairs).collect()} == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "x": ("x", 2), "y": ("x", 2)}


def test_dead_code(spark):
    e = entities(spark, [("used", "METHOD", "used", "C#used", {"visibility": "private"}), ("lone", "METHOD", "lone", "C#lone", {"visibility": "private"}), ("open", "METHOD", "open", "C#open", {"externallyExposed": "true"}), ("maybe", "METHOD", "process", "C#process", {"visibility": "private"}), ("field", "FIELD", "f", "C#f", {})])
    r = edges(spark, [("open", "used", "CALLS", "RESOLVED", {}), ("open", "x", "CALLS", "UNRESOLVED", {"callName": "process"})])
    assert {x.id: x.confidence for x in an.dead_code(e, r).collect()} == {"lone": 94, "maybe": 64, "field": 78}


def test_invokes_hides_calls_and_twins(spark):
    e = ents(spark, "AB")
    r = edges(spark, [("A", "B", "CALLS", "RESOLVED", {"callName": "b"}), ("A", "B", "INVOKES", "RESOLVED", {}), ("A", "b", "CALLS", "UNRESOLVED", {"callName": "b"}), ("A", "q", "CALLS", "UNRESOLVED", {"callName": "q"}), ("A", "t", "USES", "INFERRED", {})])
    assert [x.edge_kind for x in nb.neighbors(e, r, "B").collect()] == ["INVOKES"]
    assert nb.reference_counts(r).first().asDict() == {"resolved": 2, "unresolved": 2, "ambiguous": 0}
    assert sorted(x.target for x in nb.unresolved_references(r).collect()) == ["q", "t"]


def test_resolution_cascades(spark):
    many = [(f"m{i}", "METHOD", "many", f"X{i}#many", {}) for i in range(9)]
    e = entities(spark, [("a1", "METHOD", "go", "A#go(int)", {"signature": "go(int)"}), ("a2", "METHOD", "Go", "A#go(int,int)", {"signature": "go(int,int)"}), ("w", "PROCEDURE", "go", "P.go", {}), ("t", "CLASS", "Thing", "p.Thing", {}), ("t2", "CLASS", "Thing", "q.Thing", {}), ("tab", "DATABASE_OBJECT", "orders", "orders", {}), ("mod", "MODULE", "core", "g:core", {}), *many])
    r = edges(spark, [("x", "go", "CALLS", "UNRESOLVED", {"callName": "go", "argCount": "2"}), ("x", "go", "CALLS", "UNRESOLVED", {"callName": "go", "argCount": "7"}), ("y", "p.Thing", "REFERENCES", "UNRESOLVED", {"typeName": "p.Thing"}), ("z", "Thing", "REFERENCES", "UNRESOLVED", {}), ("sql:table:l", "Orders", "REFERENCES", "DISCOVERED", {"resolved": False}), ("b", "other:core", "DEPENDS_ON", "DISCOVERED", {"resolved": False}), ("v", "many", "CALLS", "UNRESOLVED", {}), ("v", "none", "CALLS", "UNRESOLVED", {}), ("t", "p.Thing", "INHERITS", "UNRESOLVED", {})])
    found = rs.resolve(e, r)
    got = sorted((x.from_id, x.kind, x.to_id) for x in rs.link(found).collect())
    # seven arguments fit only the routine of unknown arity
    assert got == sorted([("x", "CALLS", "a2"), ("x", "CALLS", "w"), ("x", "CALLS", "w"), ("y", "REFERENCES", "t"), ("z", "REFERENCES", "t"), ("z", "REFERENCES", "t2"), ("sql:table:l", "REFERENCES", "tab"), ("b", "DEPENDS_ON", "mod")])
    assert rs.link_stats(found).first().asDict() == {"resolved": 7, "unresolved": 1, "ambiguous": 1}


def test_arity_and_ids(spark):
    sigs = ["f()", "f(int)", "f(Map<String,X>,int)", None, "f", "f(  )"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sigs], "s string").select(rs.arity(F.col("s"))).collect()]
    assert got == [0, 1, 3, -1, -1, 0]
    cases = [("java", "CLASS", "p.A"), (None, "FILE", "a/b"), ("x", "PROJECT", "p"), ("config", "CONFIGURATION", "c.xml"), ("", "METHOD", "m"), ("sql", "DATABASE_OBJECT", "t"), ("ada", "DATA_SINK", "s"), ("Java", "ENDPOINT", "GET:/x")]
    df = spark.createDataFrame(cases, "l string, k string, q string").select(stable_id_column(F.col("l"), F.col("k"), F.col("q")))
    assert [r[0] for r in df.collect()] == [stable_id(*c) for c in cases]
    assert stable_id("java", "CLASS", "p.A") == "java:type:p.A" and stable_id("n/a", "METHOD", "m") == "code:method:m"


def test_membership_merge_and_changes(spark):
    m = spark.createDataFrame([("root", ""), ("app", "app"), ("deep", "app/x")], "id string, dir string")
    f = spark.createDataFrame([("1", "a.txt"), ("2", "app/b"), ("3", "app/x/c"), ("4", "apple/d")], "id string, path string")
    assert {r.file_id: r.module_id for r in an.build_membership(m, f).collect()} == {"1": "root", "2": "app", "3": "deep", "4": "root"}
    old, new = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {r.path: r.change for r in an.changes(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    assert an.scan_id(new).first()[0] == an.scan_id(new.orderBy(F.desc("path"))).first()[0]


def test_coupling_bands(spark):
    e = entities(spark, [(f"p{i}", "PACKAGE", f"p{i}", f"p{i}", {}) for i in range(12)] + [(f"c{i}", "CLASS", f"c{i}", f"c{i}", {}) for i in range(12)])
    r = edges(spark, [(f"p{i}", f"c{i}", "CONTAINS", "DISCOVERED", {}) for i in range(12)] + [(f"c{i}", "c0", "CALLS", "RESOLVED", {}) for i in range(1, 12)] + [(f"c{i}", "c1", "CALLS", "RESOLVED", {}) for i in range(2, 6)])
    risk = {x.package: x.risk for x in an.package_coupling(e, r).collect()}
    assert risk["p0"] == "HIGH" and risk["p1"] == "MEDIUM" and risk["p9"] == "LOW"
