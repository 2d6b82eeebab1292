"""An estate of entities and relationships projected from business tables, so that every graph operator can be checked
at any scale. Orders are methods of customers, parts are stores, suppliers are classes, nations packages, regions
modules; lines of orders are reads, writes and uses; error events are unresolved calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entity(df: DataFrame, id_, kind: str, name, qualified, language: str, file=None, attrs: dict | None = None) -> DataFrame:
    loc = F.lit(None).cast(LOC) if file is None else F.struct(file.alias("file"), F.lit(1).alias("s_line"), F.lit(0).alias("e_line"), F.lit(0).alias("s_col"), F.lit(0).alias("e_col")).cast(LOC)
    pairs = [x for k, v in (attrs or {}).items() for x in (F.lit(k), v.cast("string"))]
    bag = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), F.lit(language).alias("language"), loc.alias("loc"), bag.alias("attrs"))


def _edge(df: DataFrame, from_, to, kind, resolved=None, status=None, attrs: dict | None = None) -> DataFrame:
    resolved = F.lit(True) if resolved is None else resolved
    kind = F.lit(kind) if isinstance(kind, str) else kind
    pairs = [x for k, v in (attrs or {}).items() for x in (F.lit(k), v.cast("string"))]
    bag = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(0).cast("long").alias("ord"), from_.alias("from_id"), to.alias("to_id"), kind.alias("kind"), resolved.alias("resolved"), (F.lit("RESOLVED") if status is None else status).alias("status"), F.lit(None).cast(LOC).alias("loc"), bag.alias("attrs"))


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    region = _entity(t("region"), _id("build:module:R", "r_regionkey"), "MODULE", F.col("r_name"), _id("R", "r_regionkey"), "build", attrs={"moduleDir": _id("r", "r_regionkey")})
    nation = _entity(t("nation"), _id("data:package:N", "n_nationkey"), "PACKAGE", F.col("n_name"), _id("N", "n_nationkey"), "data", F.concat(_id("r", "n_regionkey"), _id("/n", "n_nationkey")))
    customer = _entity(t("customer"), _id("data:type:C", "c_custkey"), "CLASS", F.col("c_name"), F.concat(_id("N", "c_nationkey"), _id(".C", "c_custkey")), "data", attrs={"role": F.lower("c_mktsegment"), "externallyExposed": F.col("c_acctbal") >= 0})
    supplier = _entity(t("supplier"), _id("data:type:S", "s_suppkey"), "CLASS", F.col("s_name"), F.concat(_id("N", "s_nationkey"), _id(".S", "s_suppkey")), "data", attrs={"role": F.lit("supplier"), "externallyExposed": F.lit(False)})
    lines = t("lineitem").groupBy(F.col("l_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    visibility = F.when(F.col("o_orderstatus") == "F", "private").when(F.col("o_orderstatus") == "O", "package").otherwise("public")
    order = _entity(orders, _id("data:method:O", "o_orderkey"), "METHOD", _id("O", "o_orderkey"), F.concat(_id("C", "o_custkey"), _id("#O", "o_orderkey")), "data", attrs={"cyclomaticComplexity": F.greatest(F.lit(1), F.coalesce("lines", F.lit(0))), "visibility": visibility, "externallyExposed": F.col("o_orderpriority") == "1-URGENT"})
    part = _entity(t("part"), _id("sql:table:p", "p_partkey"), "DATABASE_OBJECT", F.col("p_name"), _id("p", "p_partkey"), "sql", attrs={"externallyExposed": F.lit(True)})
    out = region
    for more in (nation, customer, supplier, order, part):
        out = out.unionByName(more)
    return out


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as reads (returned), writes (accepted) and uses of stores."""
    kind = F.when(F.col("l_returnflag") == "R", "READS_FROM").when(F.col("l_returnflag") == "A", "WRITES_TO").otherwise("USES")
    status = F.when(F.col("l_linestatus") == "F", "RESOLVED").otherwise("INFERRED")
    sure = F.format_string("%.2f", F.round(1 - 5 * F.abs(F.col("l_discount")), 2))
    return _edge(table(spark, sf_dir, "lineitem"), _id("data:method:O", "l_orderkey"), _id("sql:table:p", "l_partkey"), kind, F.col("l_linestatus") == "F", status, {"confidence": sure})


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order invokes the next order of its customer."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next")).where("next IS NOT NULL")
    return _edge(o, _id("data:method:O", "o_orderkey"), _id("data:method:O", "next"), "INVOKES", attrs={"confidence": F.lit("0.95")})


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    found = F.lit("DISCOVERED")
    out = _edge(t("nation"), _id("build:module:R", "n_regionkey"), _id("data:package:N", "n_nationkey"), "CONTAINS", status=found)
    out = out.unionByName(_edge(t("customer"), _id("data:package:N", "c_nationkey"), _id("data:type:C", "c_custkey"), "CONTAINS", status=found))
    out = out.unionByName(_edge(t("supplier"), _id("data:package:N", "s_nationkey"), _id("data:type:S", "s_suppkey"), "CONTAINS", status=found))
    return out.unionByName(_edge(t("orders"), _id("data:type:C", "o_custkey"), _id("data:method:O", "o_orderkey"), "CONTAINS", status=found))


def supplier_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call the suppliers of their lines."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return _edge(l, _id("data:method:O", "l_orderkey"), _id("data:type:S", "l_suppkey"), "CALLS")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return _edge(l, _id("sql:table:p", "l_partkey"), _id("data:type:S", "l_suppkey"), "MAPS_TO", attrs={"confidence": F.lit("1.00")})


def unresolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events call a name that stands for a nation's suppliers, if any."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("k", F.concat(F.lit("n"), F.get_json_object("props", "$.k")))
    return _edge(e, _id("data:type:C", "user_id"), F.col("k"), "CALLS", F.lit(False), F.lit("UNRESOLVED"), {"callName": F.col("k")})


def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved twins of some unresolved calls: names of the even nations."""
    e = unresolved_calls(spark, sf_dir).where("cast(substring(to_id, 2) AS int) % 2 = 0").select("from_id", "to_id").distinct()
    return _edge(e, F.col("from_id"), F.concat(F.lit("data:package:"), F.upper("to_id")), "CALLS", attrs={"callName": F.col("to_id")})


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = containment(spark, sf_dir)
    for part in (touches, invocations, supplier_calls, mappings, unresolved_calls, resolved_calls):
        out = out.unionByName(part(spark, sf_dir))
    return out


#: The same projection for the SQL check: CTEs ent and rel.
SQL = """
WITH ent AS (
  SELECT 'build:module:R' || r_regionkey AS id, 'MODULE' AS kind, r_name AS name, 'R' || r_regionkey AS qn, 'build' AS lang, NULL AS file, false AS exposed, NULL AS visibility, NULL::INT AS cx, NULL AS role FROM region
  UNION ALL SELECT 'data:package:N' || n_nationkey, 'PACKAGE', n_name, 'N' || n_nationkey, 'data', 'r' || n_regionkey || '/n' || n_nationkey, false, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'data:type:C' || c_custkey, 'CLASS', c_name, 'N' || c_nationkey || '.C' || c_custkey, 'data', NULL, c_acctbal >= 0, NULL, NULL, lower(c_mktsegment) FROM customer
  UNION ALL SELECT 'data:type:S' || s_suppkey, 'CLASS', s_name, 'N' || s_nationkey || '.S' || s_suppkey, 'data', NULL, false, NULL, NULL, 'supplier' FROM supplier
  UNION ALL SELECT 'data:method:O' || o_orderkey, 'METHOD', 'O' || o_orderkey, 'C' || o_custkey || '#O' || o_orderkey, 'data', NULL, o_orderpriority = '1-URGENT',
    CASE o_orderstatus WHEN 'F' THEN 'private' WHEN 'O' THEN 'package' ELSE 'public' END, greatest(1, coalesce(n, 0))::INT, NULL
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey
  UNION ALL SELECT 'sql:table:p' || p_partkey, 'DATABASE_OBJECT', p_name, 'p' || p_partkey, 'sql', NULL, true, NULL, NULL, NULL FROM part
), unres AS (
  SELECT 'data:type:C' || user_id AS from_id, 'n' || (props->>'$.k') AS to_id FROM events WHERE event_type = 'error'
), rel AS (
  SELECT 'build:module:R' || n_regionkey AS from_id, 'data:package:N' || n_nationkey AS to_id, 'CONTAINS' AS kind, true AS resolved, 'DISCOVERED' AS status, 1.0 AS conf, NULL AS call FROM nation
  UNION ALL SELECT 'data:package:N' || c_nationkey, 'data:type:C' || c_custkey, 'CONTAINS', true, 'DISCOVERED', 1.0, NULL FROM customer
  UNION ALL SELECT 'data:package:N' || s_nationkey, 'data:type:S' || s_suppkey, 'CONTAINS', true, 'DISCOVERED', 1.0, NULL FROM supplier
  UNION ALL SELECT 'data:type:C' || o_custkey, 'data:method:O' || o_orderkey, 'CONTAINS', true, 'DISCOVERED', 1.0, NULL FROM orders
  UNION ALL SELECT 'data:method:O' || l_orderkey, 'sql:table:p' || l_partkey, CASE l_returnflag WHEN 'R' THEN 'READS_FROM' WHEN 'A' THEN 'WRITES_TO' ELSE 'USES' END,
    l_linestatus = 'F', CASE l_linestatus WHEN 'F' THEN 'RESOLVED' ELSE 'INFERRED' END, round(1 - 5 * abs(l_discount), 2), NULL FROM lineitem
  UNION ALL SELECT 'data:method:O' || o_orderkey, 'data:method:O' || nxt, 'INVOKES', true, 'RESOLVED', 0.95, NULL
    FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL
  UNION ALL SELECT DISTINCT 'data:method:O' || l_orderkey, 'data:type:S' || l_suppkey, 'CALLS', true, 'RESOLVED', 1.0, NULL FROM lineitem WHERE l_orderkey < 20
  UNION ALL SELECT DISTINCT 'sql:table:p' || l_partkey, 'data:type:S' || l_suppkey, 'MAPS_TO', true, 'RESOLVED', 1.0, NULL FROM lineitem
  UNION ALL SELECT from_id, to_id, 'CALLS', false, 'UNRESOLVED', 1.0, to_id FROM unres
  UNION ALL SELECT DISTINCT from_id, 'data:package:' || upper(to_id), 'CALLS', true, 'RESOLVED', 1.0, to_id FROM unres WHERE substr(to_id, 2)::INT % 2 = 0
)
"""
