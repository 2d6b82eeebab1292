"""The registered queries of the estate operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .model import CALL_KINDS, DB_KINDS, DEAD_CANDIDATES, DEAD_USAGE, GRAPH_USAGE, LINEAGE_KINDS, TOOL_USAGE
from .operators import analysis as an
from .operators import graph as gr
from .operators import neighbors as nb
from .operators import resolution as rs
from .plans import estate as es

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
START, STORE = "data:method:O7", "sql:table:p1"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ent(spark, d):
    return es.entities(spark, d)


def rel(spark, d):
    return es.relationships(spark, d)


VISIBLE = f"""{es.SQL}, vis AS (
  SELECT * FROM rel r WHERE resolved AND kind IN {_in(TOOL_USAGE)}
  AND NOT (kind = 'CALLS' AND EXISTS (SELECT 1 FROM rel i WHERE i.resolved AND i.kind = 'INVOKES' AND i.from_id = r.from_id AND i.to_id = r.to_id))
)"""


@query(f"{VISIBLE} SELECT to_id AS id, count(*) AS fan_in FROM vis WHERE from_id IN (SELECT id FROM ent) AND to_id IN (SELECT id FROM ent) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def fan_in_top(spark, d):
    n = nb.fan(ent(spark, d), rel(spark, d), True)
    return n.orderBy(F.desc("n"), "id").limit(5).select("id", F.col("n").alias("fan_in"))


@query(f"{VISIBLE} SELECT from_id AS id, count(*) AS fan_out FROM vis WHERE from_id IN (SELECT id FROM ent) AND to_id IN (SELECT id FROM ent) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def fan_out_top(spark, d):
    n = nb.fan(ent(spark, d), rel(spark, d), False)
    return n.orderBy(F.desc("n"), "id").limit(5).select("id", F.col("n").alias("fan_out"))


@query(f"{VISIBLE} SELECT from_id AS other_id, e.kind AS other_kind, v.kind AS edge_kind, status FROM vis v JOIN ent e ON e.id = from_id WHERE to_id = 'data:type:S1' AND v.kind IN {_in(CALL_KINDS)}")
def callers(spark, d):
    return nb.neighbors(ent(spark, d), rel(spark, d), "data:type:S1", CALL_KINDS).select("other_id", "other_kind", "edge_kind", "status")


@query(f"{VISIBLE} SELECT to_id AS other_id, e.kind AS other_kind, v.kind AS edge_kind, status FROM vis v JOIN ent e ON e.id = to_id WHERE from_id = '{START}' AND v.kind IN {_in(CALL_KINDS)}")
def callees(spark, d):
    return nb.neighbors(ent(spark, d), rel(spark, d), START, CALL_KINDS, incoming=False).select("other_id", "other_kind", "edge_kind", "status")


@query(f"{VISIBLE} SELECT to_id AS entity_id, from_id AS other_id, v.kind AS edge_kind FROM vis v JOIN ent e ON e.id = from_id WHERE to_id LIKE 'data:type:S%'")
def dependents_antijoin(spark, d):
    return nb.neighbors(ent(spark, d), rel(spark, d), None).select("entity_id", "other_id", "edge_kind")


@query(f"{VISIBLE} SELECT to_id AS other_id, v.kind AS edge_kind, e.kind AS other_kind, round(conf, 2) AS confidence FROM vis v JOIN ent e ON e.id = to_id WHERE from_id = '{START}'")
def dependencies(spark, d):
    return nb.neighbors(ent(spark, d), rel(spark, d), START, incoming=False).select("other_id", "edge_kind", "other_kind", "confidence")


@query(f"{es.SQL} SELECT from_id AS id, count(*) AS members FROM rel JOIN ent e ON e.id = from_id AND e.kind IN ('MODULE', 'PACKAGE') WHERE rel.kind = 'CONTAINS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def members_topk(spark, d):
    owners = ent(spark, d).where("kind IN ('MODULE', 'PACKAGE')").select("id")
    n = es.containment(spark, d).groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    return n.join(owners, "id", "left_semi").orderBy(F.desc("members"), "id").limit(10)


@query(f"{es.SQL} SELECT id, name FROM ent WHERE kind = 'DATABASE_OBJECT' AND (contains(lower(name), 'e') OR contains(lower(qn), 'e')) ORDER BY id LIMIT 50")
def search_entities(spark, d):
    return nb.search(ent(spark, d), "E", "database_object").orderBy("id").limit(50).select("id", "name")


@query(f"{es.SQL} SELECT id, kind FROM ent WHERE qn = 'O7' OR ends_with(qn, '.O7') OR ends_with(qn, '#O7') OR name = 'O7'")
def find_entity(spark, d):
    return nb.find(ent(spark, d), "O7").select("id", "kind")


@query(f"{es.SQL} SELECT from_id, to_id, r.kind, coalesce(t.id, f.id) AS table_id FROM rel r LEFT JOIN ent t ON t.id = to_id AND t.kind = 'DATABASE_OBJECT' LEFT JOIN ent f ON f.id = from_id AND f.kind = 'DATABASE_OBJECT' WHERE resolved AND r.kind IN {_in(DB_KINDS)} AND (from_id = '{STORE}' OR to_id = '{STORE}') AND (t.id IS NOT NULL OR f.id IS NOT NULL)")
def db_references(spark, d):
    return nb.database_references(ent(spark, d), rel(spark, d), STORE).drop("table_name")


@query(f"{es.SQL} SELECT to_id AS id, count(DISTINCT CASE WHEN kind = 'READS_FROM' THEN from_id END) AS readers, count(DISTINCT CASE WHEN kind = 'WRITES_TO' THEN from_id END) AS writers FROM rel WHERE resolved AND kind IN ('READS_FROM', 'WRITES_TO') GROUP BY 1")
def store_readers_writers(spark, d):
    return nb.touch_counts(es.touches(spark, d)).withColumnRenamed("to_id", "id")


TWINS = f"""{es.SQL}, lost AS (
  SELECT * FROM rel u WHERE NOT resolved AND NOT EXISTS (SELECT 1 FROM rel t WHERE t.resolved AND t.call IS NOT NULL AND t.from_id = u.from_id AND t.kind = u.kind AND t.call = u.call)
)"""


@query(f"{TWINS} SELECT from_id, coalesce(call, to_id) AS target, kind, count(*) AS n FROM lost GROUP BY 1, 2, 3")
def unresolved_refs(spark, d):
    return nb.unresolved_references(rel(spark, d)).groupBy("from_id", "target", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{TWINS} SELECT (SELECT count(*) FROM rel WHERE resolved AND kind <> 'CONTAINS') AS resolved, (SELECT count(*) FROM lost WHERE kind <> 'CONTAINS') AS unresolved, 0::BIGINT AS ambiguous")
def reference_counts(spark, d):
    return nb.reference_counts(rel(spark, d))


@query(f"{es.SQL} SELECT count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE NOT resolved) AS unresolved, round(100.0 * count(*) FILTER (WHERE resolved) / count(*), 2)::DOUBLE AS rate, count(*) FILTER (WHERE NOT resolved) > 0 AS is_partial FROM rel WHERE kind <> 'CONTAINS'")
def resolution_rate(spark, d):
    return an.resolution_coverage(rel(spark, d))


@query(f"{es.SQL} SELECT id, cx AS complexity, CASE WHEN cx >= 30 THEN 'VERY_HIGH' WHEN cx >= 15 THEN 'HIGH' ELSE 'MODERATE' END AS band FROM ent WHERE kind = 'METHOD' AND cx >= 6")
def complexity_hotspots(spark, d):
    return an.complexity_hotspots(ent(spark, d), 6).select("id", "complexity", "band")


DEAD = f"""{es.SQL}, used AS (SELECT DISTINCT to_id FROM rel WHERE resolved AND kind IN {_in(DEAD_USAGE)}), shown AS (SELECT DISTINCT qn FROM ent WHERE exposed),
said AS (SELECT DISTINCT lower(call) AS word FROM rel WHERE NOT resolved AND kind IN {_in(DEAD_USAGE)} AND call IS NOT NULL), dead AS (
  SELECT id, kind, CASE WHEN kind = 'CLASS' THEN 88 WHEN visibility = 'private' THEN 94 WHEN visibility = 'package' THEN 86 ELSE 82 END - CASE WHEN said.word IS NULL THEN 0 ELSE 30 END AS confidence
  FROM ent e LEFT JOIN said ON said.word = lower(e.name) LEFT JOIN shown ON shown.qn = e.qn LEFT JOIN used ON used.to_id = e.id
  WHERE kind IN {_in(DEAD_CANDIDATES)} AND NOT exposed AND shown.qn IS NULL AND used.to_id IS NULL
)"""


@query(f"{DEAD} SELECT id, kind, confidence::INT AS confidence FROM dead WHERE confidence >= 60")
def dead_code(spark, d):
    return an.dead_code(ent(spark, d), rel(spark, d)).select("id", "kind", "confidence")


@query(f"{DEAD} SELECT (SELECT count(*) FROM ent WHERE kind IN ('METHOD', 'CLASS')) AS total, count(*) AS dead, round(100.0 * count(*) / (SELECT count(*) FROM ent WHERE kind IN ('METHOD', 'CLASS')), 2)::DOUBLE AS percent FROM dead WHERE confidence >= 60")
def dead_code_percent(spark, d):
    e = ent(spark, d)
    return an.dead_share(e, an.dead_code(e, rel(spark, d)))


PACKAGES = f"""{es.SQL}, own AS (
  SELECT id, id AS pid, qn AS package FROM ent WHERE kind = 'PACKAGE'
  UNION ALL SELECT c.to_id, c.from_id, e.qn FROM rel c JOIN ent e ON e.id = c.from_id AND e.kind = 'PACKAGE' WHERE c.kind = 'CONTAINS'
  UNION ALL SELECT m.to_id, c.from_id, e.qn FROM rel m JOIN rel c ON c.to_id = m.from_id AND c.kind = 'CONTAINS' JOIN ent e ON e.id = c.from_id AND e.kind = 'PACKAGE' WHERE m.kind = 'CONTAINS'
), pe AS (
  SELECT DISTINCT a.package AS fp, b.package AS tp FROM rel r JOIN own a ON a.id = r.from_id JOIN own b ON b.id = r.to_id
  WHERE r.resolved AND r.kind IN ('CALLS', 'REFERENCES', 'INHERITS', 'IMPLEMENTS', 'INSTANTIATES', 'USES', 'DEPENDS_ON', 'INVOKES') AND a.package <> b.package AND r.from_id LIKE 'data:method%' AND r.kind = 'CALLS'
)"""


@query(f"""{PACKAGES}, o AS (SELECT fp, count(*) AS n, string_agg(tp, '|' ORDER BY tp) AS deps FROM pe GROUP BY 1), i AS (SELECT tp, count(*) AS n FROM pe GROUP BY 1)
SELECT e.qn AS package, coalesce(o.n, 0) AS dependencies, coalesce(i.n, 0) AS dependents, coalesce(deps, '') AS depends_on,
 CASE WHEN coalesce(i.n, 0) >= 10 OR coalesce(o.n, 0) + coalesce(i.n, 0) >= 20 THEN 'HIGH' WHEN coalesce(i.n, 0) >= 4 OR coalesce(o.n, 0) + coalesce(i.n, 0) >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM ent e LEFT JOIN o ON o.fp = e.qn LEFT JOIN i ON i.tp = e.qn WHERE e.kind = 'PACKAGE'""")
def package_coupling(spark, d):
    return an.package_coupling(ent(spark, d), rel(spark, d))


@query(f"""{PACKAGES.replace('WITH ent', 'WITH RECURSIVE ent')}, reach AS (SELECT fp, tp FROM pe UNION SELECT r.fp, p.tp FROM reach r JOIN pe p ON p.fp = r.tp),
both_ways AS (SELECT a.fp, a.tp FROM reach a JOIN reach b ON a.fp = b.tp AND a.tp = b.fp WHERE a.fp <> a.tp)
SELECT fp AS member, least(min(tp), fp) AS scc, count(*) + 1 AS size FROM both_ways GROUP BY fp""")
def package_cycles_scc(spark, d):
    p = an.package_edges(ent(spark, d), rel(spark, d))
    return gr.cycles(p.select(F.col("from_package").alias("a"), F.col("to_package").alias("b")))


@query(f"{PACKAGES} SELECT package, count(*) AS members FROM own GROUP BY 1")
def entity_to_package(spark, d):
    return an.entity_to_package(ent(spark, d), es.containment(spark, d)).groupBy("package").agg(F.count(F.lit(1)).alias("members"))


def _flow(spark, d):
    return es.invocations(spark, d).unionByName(es.touches(spark, d)).unionByName(es.mappings(spark, d))


def _trace_sql(up: bool, depth: int, start: str) -> str:
    here, there = ("to_id", "from_id") if up else ("from_id", "to_id")
    return f"""{es.SQL.replace('WITH ent', 'WITH RECURSIVE ent')}, le AS (
  SELECT from_id, to_id, kind, conf FROM rel WHERE kind IN {_in(LINEAGE_KINDS)} AND status <> 'UNRESOLVED' AND conf >= 0.4
), w AS (
  SELECT ['{start}'] AS nodes, 1.0::DOUBLE AS conf, '' AS rank, '{start}' AS last, 0 AS hops
  UNION ALL SELECT list_append(nodes, {there}), least(w.conf, le.conf), rank || chr(1) || kind || chr(1) || {there}, {there}, hops + 1
  FROM w JOIN le ON le.{here} = w.last WHERE hops < {depth} AND NOT list_contains(nodes, {there})
), leaf AS (
  SELECT * FROM w WHERE hops > 0 AND (hops = {depth} OR NOT EXISTS (SELECT 1 FROM le WHERE le.{here} = w.last AND NOT list_contains(w.nodes, le.{there})))
), kept AS (SELECT * FROM leaf ORDER BY rank LIMIT 100)
SELECT array_to_string(nodes, '|') AS path, round(conf, 2) AS confidence FROM kept"""


def _trace(spark, d, start, direction, depth):
    t = gr.trace(ent(spark, d), _flow(spark, d), start, direction, depth)
    return t.paths.select(F.array_join("nodes", "|").alias("path"), F.round("confidence", 2).alias("confidence"))


@query(_trace_sql(False, 4, START))
def lineage_trace_down(spark, d):
    return _trace(spark, d, START, "down", 4)


@query(_trace_sql(True, 2, "data:type:S1"))
def lineage_trace_up(spark, d):
    return _trace(spark, d, "data:type:S1", "up", 2)


@query(f"{es.SQL}, c AS (SELECT min(from_id) AS id FROM unres) SELECT DISTINCT 'READS_FROM' AS kind, from_id, to_id, 'UNRESOLVED_TARGET' AS reason FROM unres, c WHERE from_id = c.id")
def lineage_gaps(spark, d):
    """Unresolved reads at the start of a trace are its gaps."""
    lost = es.unresolved_calls(spark, d).withColumn("kind", F.lit("READS_FROM"))
    first = lost.agg(F.min("from_id")).first()[0] or START
    return gr.trace(ent(spark, d), lost, first, "down", 2).gaps


@query(_trace_sql(False, 3, START).replace("SELECT array_to_string(nodes, '|') AS path, round(conf, 2) AS confidence FROM kept", "SELECT kept.last AS end_id, count(*) AS paths, round(max(conf), 2) AS best FROM kept GROUP BY 1"))
def path_min_confidence(spark, d):
    t = gr.trace(ent(spark, d), _flow(spark, d), START, "down", 3)
    return t.paths.groupBy(F.element_at("nodes", -1).alias("end_id")).agg(F.count(F.lit(1)).alias("paths"), F.round(F.max("confidence"), 2).alias("best"))


@query(f"""{es.SQL.replace('WITH ent', 'WITH RECURSIVE ent')}, us AS (SELECT DISTINCT from_id, to_id FROM rel WHERE resolved AND kind IN {_in(TOOL_USAGE)}),
seeds AS (SELECT '{STORE}' AS id UNION SELECT from_id FROM us WHERE to_id = '{STORE}'),
w AS (SELECT id, 0 AS hop FROM seeds UNION SELECT from_id, hop + 1 FROM w JOIN us ON us.to_id = w.id WHERE hop < 5)
SELECT id, min(hop)::INT AS hop FROM w GROUP BY id HAVING min(hop) > 0""")
def impact_indirect(spark, d):
    own = es.invocations(spark, d).unionByName(es.touches(spark, d)).unionByName(es.mappings(spark, d)).unionByName(es.supplier_calls(spark, d))
    direct = nb.visible(own.where(F.col("to_id") == STORE)).select(F.col("from_id").alias("id")).distinct()
    return gr.dependents(own, STORE, direct)


@query(f"{es.SQL} SELECT from_id, to_id, kind, count(*) AS n FROM rel WHERE resolved AND kind IN {_in(DB_KINDS)} AND from_id <> '{START}' AND to_id IN (SELECT to_id FROM rel WHERE resolved AND kind IN {_in(DB_KINDS)} AND from_id = '{START}') GROUP BY 1, 2, 3")
def co_touch(spark, d):
    return nb.co_touch(rel(spark, d), START).groupBy("from_id", "to_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{es.SQL}, l AS (
  SELECT id, 0 AS layer FROM ent WHERE kind = 'MODULE' UNION ALL SELECT id, 1 FROM ent WHERE kind = 'PACKAGE' UNION ALL SELECT id, 2 FROM ent WHERE id LIKE 'data:type:C%'
  UNION ALL SELECT id, 3 FROM ent WHERE kind = 'METHOD' UNION ALL SELECT DISTINCT to_id, 4 FROM rel WHERE kind IN ('READS_FROM', 'WRITES_TO', 'USES')
  UNION ALL SELECT id, CASE WHEN id IN (SELECT to_id FROM rel WHERE kind = 'MAPS_TO') THEN 5 ELSE 2 END FROM ent WHERE id LIKE 'data:type:S%')
SELECT layer::INT AS layer, count(*) AS n FROM l GROUP BY 1""")
def layering(spark, d):
    e = es.containment(spark, d).unionByName(es.touches(spark, d)).unionByName(es.mappings(spark, d))
    return gr.layers(e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def _files(spark, d):
    docs = es.table(spark, d, "documents").select(F.concat(F.lit("r"), F.col("doc_id") % 5, F.lit("/n"), F.col("doc_id") % 25, F.lit("/src/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id"), F.lit("."), F.coalesce("lang", F.lit("txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return docs.withColumn("id", F.concat(F.lit("file:"), F.col("path")))


FILES = "fl AS (SELECT 'r' || doc_id % 5 || '/n' || doc_id % 25 || '/src/' || coalesce(source, 'none') || '/' || doc_id || '.' || coalesce(lang, 'txt') AS path, coalesce(text, '') AS content FROM documents)"


@query(f"""WITH {FILES}, m AS (SELECT 'build:module:R' || r_regionkey AS id, 'r' || r_regionkey AS dir FROM region UNION ALL SELECT 'data:package:N' || n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey FROM nation)
SELECT 'file:' || path AS file_id, arg_min(m.id, (-length(dir), m.id)) AS module_id FROM fl JOIN m ON starts_with(path, dir || '/') GROUP BY 1""")
def build_membership(spark, d):
    r = es.table(spark, d, "region").select(F.concat(F.lit("build:module:R"), "r_regionkey").alias("id"), F.concat(F.lit("r"), "r_regionkey").alias("dir"))
    n = es.table(spark, d, "nation").select(F.concat(F.lit("data:package:N"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("dir"))
    return an.build_membership(r.unionByName(n), _files(spark, d))


def _named(spark, d):
    """Callables with the simple name n<nation> and one or two parameters."""
    s = es.table(spark, d, "supplier")
    sig = F.when(F.col("s_suppkey") % 2 == 0, "m(int a)").otherwise("m(int a, int b)")
    return es._entity(s, es._id("data:method:T", "s_suppkey"), "METHOD", es._id("n", "s_nationkey"), es._id("T#", "s_suppkey"), "data", attrs={"signature": sig})


def _asks(spark, d, args: bool):
    u = es.unresolved_calls(spark, d)
    return u.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("argCount"), F.lit("2")))) if args else u


NAMES = f"{es.SQL}, t AS (SELECT 'data:method:T' || s_suppkey AS id, 'n' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS arity FROM supplier WHERE s_suppkey < 100), c AS (SELECT name, count(*) AS n FROM t GROUP BY 1)"


@query(f"{NAMES} SELECT from_id, t.id AS to_id, count(*) AS n FROM unres u JOIN c ON c.name = u.to_id AND c.n <= 8 JOIN t ON t.name = u.to_id GROUP BY 1, 2")
def name_resolution(spark, d):
    return rs.link(rs.resolve(_named(spark, d), _asks(spark, d, False))).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{NAMES}, a AS (SELECT name, count(*) AS n FROM t WHERE arity = 2 GROUP BY 1), p AS (SELECT u.from_id, u.to_id, CASE WHEN a.n > 0 THEN a.n ELSE c.n END AS n, a.n > 0 AS fit FROM unres u JOIN c ON c.name = u.to_id LEFT JOIN a ON a.name = u.to_id)
SELECT from_id, t.id AS to_id, count(*) AS n FROM p JOIN t ON t.name = p.to_id AND (t.arity = 2 OR NOT coalesce(fit, false)) WHERE p.n <= 8 GROUP BY 1, 2""")
def arity_resolution(spark, d):
    return rs.link(rs.resolve(_named(spark, d), _asks(spark, d, True))).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{NAMES} SELECT count(*) FILTER (WHERE c.n <= 8) AS resolved, count(*) FILTER (WHERE c.n IS NULL) AS unresolved, count(*) FILTER (WHERE c.n > 8) AS ambiguous FROM unres u LEFT JOIN c ON c.name = u.to_id")
def candidate_cap(spark, d):
    return rs.link_stats(rs.resolve(_named(spark, d), _asks(spark, d, False)))


@query(f"{es.SQL} SELECT kind, from_id, to_id, round(max(conf), 2) AS confidence FROM rel WHERE from_id LIKE 'data:method:%' AND to_id LIKE 'sql:%' GROUP BY 1, 2, 3")
def first_wins_dedup(spark, d):
    """The surest of equal edges comes first here."""
    from .model import confidence

    t = es.touches(spark, d).withColumn("_c", confidence())
    return an.first_wins(t, [F.desc("_c")]).select("kind", "from_id", "to_id", F.round("_c", 2).alias("confidence"))


@query("SELECT 'sql:table:p' || l_partkey AS id, bool_or(l_returnflag = 'R') AS exposed, max(l_quantity::INT)::BIGINT AS loc, arg_min(l_suppkey, l_orderkey * 100 + l_linenumber)::VARCHAR AS first FROM lineitem GROUP BY l_partkey")
def entity_merge(spark, d):
    l = es.table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    bag = F.create_map(F.lit("externallyExposed"), (F.col("l_returnflag") == "R").cast("string"), F.lit("loc"), F.col("l_quantity").cast("int").cast("string"), F.lit("first"), F.col("l_suppkey").cast("string"))
    rows = l.select(es._id("sql:table:p", "l_partkey").alias("id"), F.lit("DATABASE_OBJECT").alias("kind"), es._id("p", "l_partkey").alias("name"), es._id("p", "l_partkey").alias("qualified_name"), F.lit("sql").alias("language"), F.lit(None).cast(es.LOC).alias("loc"), bag.alias("attrs"), "seq")
    m, _ = an.merge_entities(rows)
    return m.select("id", (F.element_at("attrs", "externallyExposed") == "true").alias("exposed"), F.element_at("attrs", "loc").cast("long").alias("loc"), F.element_at("attrs", "first").alias("first"))


@query("WITH e AS (SELECT event_id AS seq, 'data:event:' || user_id AS id, upper(event_type) AS kind FROM events), f AS (SELECT id, arg_min(kind, seq) AS kind FROM e GROUP BY 1) SELECT e.id, count(*) AS collisions FROM e JOIN f USING (id) WHERE e.kind <> f.kind GROUP BY 1")
def merge_collisions(spark, d):
    e = es.table(spark, d, "events")
    rows = e.select(F.concat(F.lit("data:event:"), "user_id").alias("id"), F.upper("event_type").alias("kind"), F.lit("e").alias("name"), F.lit("e").alias("qualified_name"), F.lit("data").alias("language"), F.struct(F.lit("f").alias("file"), F.lit(1).alias("s_line"), F.lit(1).alias("e_line"), F.lit(0).alias("s_col"), F.lit(0).alias("e_col")).cast(es.LOC).alias("loc"), F.create_map().cast("map<string,string>").alias("attrs"), F.col("event_id").alias("seq"))
    _, bad = an.merge_entities(rows)
    return bad.groupBy("id").agg(F.count(F.lit(1)).alias("collisions"))


@query(f"""{VISIBLE}, fi AS (SELECT to_id AS id, count(*) AS n FROM vis WHERE from_id IN (SELECT id FROM ent) GROUP BY 1), fo AS (SELECT from_id AS id, count(*) AS n FROM vis WHERE to_id IN (SELECT id FROM ent) GROUP BY 1),
dt AS (SELECT DISTINCT from_id AS id FROM rel WHERE resolved AND kind IN ('READS_FROM', 'WRITES_TO', 'PERSISTS_TO', 'MAPS_TO')), un AS (SELECT from_id AS id, count(*) AS n FROM rel WHERE NOT resolved GROUP BY 1)
SELECT ent.id, (5 * coalesce(fi.n, 0) + 2 * coalesce(fo.n, 0) + CASE WHEN dt.id IS NULL THEN 0 ELSE 6 END + least(coalesce(cx, 0), 20) + least(coalesce(un.n, 0), 5))::BIGINT AS score
FROM ent LEFT JOIN fi ON fi.id = ent.id LEFT JOIN fo ON fo.id = ent.id LEFT JOIN dt ON dt.id = ent.id LEFT JOIN un ON un.id = ent.id ORDER BY score DESC, ent.id LIMIT 10""")
def central_score(spark, d):
    return an.central_score(ent(spark, d), rel(spark, d)).orderBy(F.desc("score"), "id").limit(10)


@query(f"""{es.SQL}, le AS (SELECT from_id, to_id, conf FROM rel WHERE kind IN ('INVOKES', 'READS_FROM', 'WRITES_TO') AND status <> 'UNRESOLVED'),
p1 AS (SELECT from_id AS s, [from_id, to_id] AS n, least(1.0::DOUBLE, conf) AS c, to_id AS e FROM le WHERE from_id IN (SELECT 'data:method:O' || o_orderkey FROM orders WHERE o_custkey < 20)),
p2 AS (SELECT s, list_append(n, to_id) AS n, least(c, conf) AS c, to_id AS e FROM p1 JOIN le ON from_id = e WHERE NOT list_contains(n, to_id)),
ps AS (SELECT * FROM p1 WHERE e NOT IN (SELECT from_id FROM le) UNION ALL SELECT * FROM p2),
r AS (SELECT *, e LIKE 'sql:%' AS store, row_number() OVER (PARTITION BY s ORDER BY (e LIKE 'sql:%') DESC, len(n) DESC, c DESC, e, array_to_string(n, '|')) AS k FROM ps)
SELECT s AS start, array_to_string(n, '|') AS path, round(c, 2) AS confidence, store FROM r WHERE k = 1""")
def best_path_per_start(spark, d):
    e = es.invocations(spark, d).unionByName(es.touches(spark, d).where("kind <> 'USES'"))
    starts = es.table(spark, d, "orders").select(es._id("data:method:O", "o_orderkey").alias("id"))
    paths = gr.expand(gr.lineage_edges(e, floor=0.0), starts)
    return gr.best_path_per_start(paths, ent(spark, d)).withColumn("confidence", F.round("confidence", 2))


GROUPS = {"modules": ("MODULE",), "packages": ("PACKAGE",), "types": ("CLASS", "INTERFACE", "ENUM", "RECORD", "TYPE"), "behaviours": ("METHOD", "FUNCTION", "PROCEDURE", "CONSTRUCTOR", "TASK"), "stores": ("DATABASE_OBJECT",)}


@query(f"""{es.SQL}, g AS (SELECT CASE WHEN kind = 'MODULE' THEN 'modules' WHEN kind = 'PACKAGE' THEN 'packages' WHEN kind = 'CLASS' THEN 'types' WHEN kind = 'METHOD' THEN 'behaviours' ELSE 'stores' END AS category, name FROM ent),
k AS (SELECT category, name, row_number() OVER (PARTITION BY category ORDER BY name) AS r FROM (SELECT DISTINCT * FROM g))
SELECT g.category, count(*) AS n, (SELECT string_agg(name, '|' ORDER BY name) FROM k WHERE k.category = g.category AND r <= 5) AS examples FROM g GROUP BY 1""")
def inventory(spark, d):
    return an.inventory(ent(spark, d), GROUPS)


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, max(p) AS n FROM l GROUP BY 1), u AS (SELECT l.* FROM l JOIN k USING (doc_id) WHERE NOT (p = n AND line = '')),
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE trim(line, ' ' || chr(9) || chr(13)) = '') AS blank, count(*) FILTER (WHERE starts_with(trim(line, ' ' || chr(9) || chr(13)), '#')) AS comment FROM u)
SELECT (SELECT count(*) FROM documents) AS files, total AS total_lines, comment AS comment_lines, blank AS blank_lines, greatest(0, total - comment - blank) AS code_lines,
CASE WHEN total - blank > 0 THEN round(100.0 * comment / (greatest(0, total - comment - blank) + comment), 0) ELSE 0 END::BIGINT AS comment_percent FROM s""")
def repo_metrics(spark, d):
    docs = es.table(spark, d, "documents").select(tx.line_stats(F.col("text"), F.lit("python")).alias("s"))
    return an.file_metrics(docs.select("s.*"))


@query("SELECT doc_id, length(text) AS chars, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark, d):
    t = es.table(spark, d, "documents")
    return t.select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("hash"))


@query(f"WITH {FILES}, h AS (SELECT path, sha256(content) AS hash FROM fl) SELECT 'scan-' || substr(sha256(string_agg(path || chr(0) || hash || chr(10), '' ORDER BY path)), 1, 12) AS scan_id FROM h")
def scan_id(spark, d):
    return an.scan_id(_files(spark, d).select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash")))


SPLIT = "(SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 FROM events)"


def _halves(spark, d):
    e = es.table(spark, d, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    b = e.agg(F.min("_us"), F.max("_us")).first()
    mid = (b[0] or 0) + ((b[1] or 0) - (b[0] or 0)) // 2
    of = lambda x: x.groupBy(F.concat(F.lit("u"), "user_id").alias("path")).agg(F.max("event_type").alias("hash"))
    return of(e.where(F.col("_us") < mid)), of(e.where(F.col("_us") >= mid))


@query(f"WITH a AS (SELECT 'u' || user_id AS path, max(event_type) AS hash FROM events WHERE epoch_us(ts) < {SPLIT} GROUP BY 1), b AS (SELECT 'u' || user_id AS path, max(event_type) AS hash FROM events WHERE epoch_us(ts) >= {SPLIT} GROUP BY 1) SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path")
def change_set(spark, d):
    return an.changes(*_halves(spark, d))


@query(f"WITH a AS (SELECT 'u' || user_id AS path, max(event_type) AS hash FROM events WHERE epoch_us(ts) < {SPLIT} GROUP BY 1), b AS (SELECT 'u' || user_id AS path, max(event_type) AS hash FROM events WHERE epoch_us(ts) >= {SPLIT} GROUP BY 1) SELECT b.path, b.hash FROM b JOIN a ON a.path = b.path AND a.hash = b.hash")
def cache_reuse(spark, d):
    old, new = _halves(spark, d)
    tag = lambda x: x.withColumns({"parser_id": F.lit("p"), "parser_version": F.lit(None).cast("string")})
    return an.reusable(tag(new), tag(old)).select("path", "hash")


@query("""WITH l AS (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) AS p, unnest(string_split(html, chr(10))) AS line FROM pages),
k AS (SELECT page_id, max(p) AS n FROM l GROUP BY 1), u AS (SELECT l.* FROM l JOIN k USING (page_id) WHERE NOT (p = n AND line = ''))
SELECT page_id, count(*)::INT AS total, count(*) FILTER (WHERE starts_with(trim(line, ' ' || chr(9) || chr(13)), '--'))::INT AS comment, count(*) FILTER (WHERE trim(line, ' ' || chr(9) || chr(13)) = '')::INT AS blank FROM u GROUP BY 1""")
def line_stats(spark, d):
    s = es.table(spark, d, "pages").select("page_id", tx.line_stats(F.col("html"), F.lit("ada")).alias("s"))
    return s.select("page_id", "s.total", "s.comment", "s.blank").where("total > 0")


@query("SELECT CASE WHEN s.ext = 'f' THEN 'fortran' WHEN s.ext = 'c' THEN 'c' WHEN s.ext = 'java' THEN 'java' WHEN s.ext = 'sql' THEN 'sql' ELSE 'unknown' END AS language, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'java' WHEN 1 THEN 'sql' WHEN 2 THEN 'f' WHEN 3 THEN 'c' ELSE 'zzz' END AS ext FROM documents) s GROUP BY 1")
def language_detect(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("java", "sql", "f", "C", "zzz"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/a.b/F"), F.col("doc_id"), F.lit("."), ext)
    return es.table(spark, d, "documents").select(tx.language(path).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'orders|part' WHEN 1 THEN 'stage' ELSE '' END AS reads, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'audit' ELSE 'old_' || o_custkey % 7 END AS writes FROM orders")
def sql_literal_tables(spark, d):
    lit = F.when(F.col("o_orderkey") % 3 == 0, F.lit('SELECT * FROM app."Orders" o JOIN `part` p ON true')).when(F.col("o_orderkey") % 3 == 1, F.lit("insert into audit select * from stage, x join audit a")).otherwise(F.concat(F.lit("DELETE FROM old_"), F.col("o_custkey") % 7))
    r, w = tx.sql_tables(F.col("sql"))
    return es.table(spark, d, "orders").withColumn("sql", lit).select("o_orderkey", F.array_join(r, "|").alias("reads"), F.array_join(w, "|").alias("writes"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'com.acme.Mapper' || c_nationkey END AS class FROM customer")
def class_refs(spark, d):
    t = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("use a.b then com.acme.Mapper"), F.col("c_nationkey"), F.lit(" and x.Y"))).otherwise(F.lit("plain.lower text No.Class"))
    return es.table(spark, d, "customer").select("c_custkey", tx.class_name(t).alias("class"))


@query("SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey % 3 = 0) AS masked FROM customer GROUP BY 1")
def secret_keys(spark, d):
    key = F.when(F.col("c_custkey") % 3 == 0, "db.Password").otherwise(F.lit("datasource.url"))
    return es.table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(tx.is_secret(key)).alias("masked"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/api/v' || c_nationkey || '/{id}' ELSE '/api/v' || c_nationkey END AS path FROM customer")
def endpoint_paths(spark, d):
    own = F.when(F.col("c_custkey") % 2 == 0, "/{id}/").otherwise(F.lit(""))
    return es.table(spark, d, "customer").select("c_custkey", tx.compose_path(F.concat(F.lit("//api/v"), "c_nationkey", F.lit("/")), own).alias("path"))


@query(f"""{es.SQL}, n AS (SELECT id, CASE WHEN kind = 'DATABASE_OBJECT' THEN 5 ELSE 2 END AS layer FROM ent WHERE kind = 'DATABASE_OBJECT' OR role = 'supplier' ORDER BY id LIMIT 200)
SELECT a.id AS from_id, b.id AS to_id, a.layer AS from_layer, b.layer AS to_layer FROM (SELECT DISTINCT from_id, to_id FROM rel WHERE resolved AND kind IN {_in(GRAPH_USAGE)}) r JOIN n a ON a.id = r.from_id JOIN n b ON b.id = r.to_id""")
def graph_architecture(spark, d):
    from .operators.views import capped_graph

    e = ent(spark, d).where((F.col("kind") == "DATABASE_OBJECT") | (F.element_at("attrs", "role") == "supplier")).select("id", F.when(F.col("kind") == "DATABASE_OBJECT", 5).otherwise(2).alias("layer"))
    return capped_graph(e, rel(spark, d).where(F.col("resolved") & F.col("kind").isin(*GRAPH_USAGE)))


@query(f"""{es.SQL}, r AS (SELECT DISTINCT from_id, to_id FROM rel WHERE resolved AND kind IN {_in(CALL_KINDS)} AND from_id LIKE 'data:method:%' AND to_id LIKE 'data:method:%'),
n AS (SELECT id FROM (SELECT from_id AS id FROM r UNION SELECT to_id FROM r) ORDER BY id LIMIT 200) SELECT from_id, to_id FROM r WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)""")
def graph_call(spark, d):
    from .operators.views import capped_graph

    c = ent(spark, d).where("kind = 'METHOD'").select("id")
    e = rel(spark, d).where(F.col("resolved") & F.col("kind").isin(*CALL_KINDS)).select("from_id", "to_id").distinct()
    e = e.join(c, F.col("from_id") == F.col("id"), "left_semi").join(c, F.col("to_id") == F.col("id"), "left_semi")
    n = e.select(F.col("from_id").alias("id")).unionByName(e.select(F.col("to_id").alias("id"))).distinct().withColumn("layer", F.lit(0))
    return capped_graph(n, e).select("from_id", "to_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '''=' || c_name WHEN c_custkey % 4 = 1 THEN '''-1' ELSE c_name END AS cell FROM customer")
def csv_escape(spark, d):
    cell = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("="), "c_name")).when(F.col("c_custkey") % 4 == 1, F.lit("-1")).otherwise(F.col("c_name"))
    return es.table(spark, d, "customer").select("c_custkey", tx.csv_safe(cell).alias("cell"))


@query(f"""{es.SQL} SELECT count(*) FILTER (WHERE kind = 'METHOD') AS methods, (SELECT count(DISTINCT from_id) FROM rel WHERE status <> 'UNRESOLVED' AND to_id LIKE 'sql:%') AS with_store,
(SELECT count(*) FROM rel WHERE kind IN {_in(LINEAGE_KINDS)} AND status = 'RESOLVED') AS resolved, (SELECT count(*) FROM rel WHERE kind IN {_in(LINEAGE_KINDS)} AND status = 'INFERRED') AS inferred FROM ent""")
def coverage(spark, d):
    m = ent(spark, d).agg(F.count_if(F.col("kind") == "METHOD").alias("methods"))
    r = rel(spark, d)
    s = r.where((F.col("status") != "UNRESOLVED") & F.col("to_id").startswith("sql:")).agg(F.countDistinct("from_id").alias("with_store"))
    c = r.where(F.col("kind").isin(*LINEAGE_KINDS)).agg(F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count_if(F.col("status") == "INFERRED").alias("inferred"))
    # three tables of one row each
    return m.join(F.broadcast(s), F.lit(True)).join(F.broadcast(c), F.lit(True))


@query(f"{es.SQL} SELECT kind, status, CASE WHEN conf >= 0.85 THEN 'High' WHEN conf >= 0.60 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS n FROM rel GROUP BY 1, 2, 3")
def confidence_bands(spark, d):
    from .model import confidence

    return rel(spark, d).groupBy("kind", "status", tx.confidence_band(confidence()).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{es.SQL} SELECT from_id AS id, max(coalesce(cx, 0)) AS max_complexity FROM rel JOIN ent ON ent.id = to_id WHERE rel.kind = 'CONTAINS' AND resolved GROUP BY 1")
def max_member_complexity(spark, d):
    return an.max_member_complexity(ent(spark, d), rel(spark, d))
