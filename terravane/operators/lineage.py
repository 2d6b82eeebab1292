"""Lineage rules: each derives edges by joins, with a fixed confidence and its rule's id.

A rule yields candidates with the place it takes in the order of rules (seq) and a sort key within it; of equal edges
(kind, from, to) the first wins, so evidence is the same on every run. All lookups are equi-joins on keys prepared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import LOC, PROJECT_TYPES, attr, bool_attr, last_segment, render, stable_id
from .resolution import unique

#: Rule ids and name prefixes.
RULES = {
    "JPA1": "JPA-TABLE-001", "JPA2": "JPA-TABLE-002", "REPO1": "REPOSITORY-001", "REPO2": "REPOSITORY-002", "REPO3": "REPOSITORY-003", "IO": "ENDPOINT-002", "CALL": "CALL-001",
    "LOST": "UNRESOLVED-001", "READ": "READ-001", "WRITE": "WRITE-001", "DI1": "DI-001", "DI2": "DI-002", "SQL1": "SQL-001", "SQL2": "SQL-002",
    "MAP1": "MAP-001", "MAP2": "MAP-002", "VALID": "VALIDATION-001", "AWRITE": "ADA-WRITE-001", "AREAD": "ADA-READ-001", "ACALL1": "ADA-CALL-001",
    "ACALL2": "ADA-CALL-002", "AIO1": "ADA-IO-001", "AIO2": "ADA-IO-002", "AEXT": "ADA-EXTERNAL-001", "AMAP1": "ADA-MAP-001", "AMAP2": "ADA-MAP-002",
}
WRITES, READS = ("save", "insert", "update", "delete", "remove", "persist", "merge"), ("find", "get", "read", "query", "count", "exists", "search", "stream")
MAPPERS, ADA_MAPPERS = ("to", "map", "convert", "from", "build"), ("to_", "convert", "from_", "make_", "build_", "transform")
CONSOLE_IN, CONSOLE_OUT, TEXT_IO = ("get", "get_line", "get_immediate"), ("put", "put_line"), "ada.text_io"

EDGE = ("seq", "skey", "kind", "from_id", "to_id", "rule", "confidence", "status", "resolved", "inferred", "ambiguous", "loc")


def starts(c: Column, prefixes) -> Column:
    return F.lower(c).rlike("^(" + "|".join(prefixes) + ")")


def simple_type(c: Column) -> Column:
    return last_segment(F.trim(F.substring_index(c, "<", 1)))


def type_arity(params: Column) -> Column:
    """Parameters of a type list; commas inside <> do not count."""
    flat = params
    for _ in range(4):
        flat = F.regexp_replace(flat, "<[^<>]*>", "")
    return F.when(F.coalesce(params, F.lit("")) == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(","), F.lit(""))) + 1)


def single(params: Column) -> Column:
    return params.isNotNull() & ~params.contains(",")


def made(df: DataFrame, seq: int, skey, kind, from_, to, rule, confidence, status="RESOLVED", inferred=False, ambiguous=False, resolved=None, loc=None) -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    st = c(status)
    res = st.isin("RESOLVED", "DISCOVERED") if resolved is None else c(resolved)
    return df.select(F.lit(seq).alias("seq"), c(skey).alias("skey"), c(kind).alias("kind"), c(from_).alias("from_id"), c(to).alias("to_id"), c(rule).alias("rule"), c(confidence).cast("double").alias("confidence"), st.alias("status"), res.alias("resolved"), c(inferred).alias("inferred"), c(ambiguous).alias("ambiguous"), (F.lit(None).cast(LOC) if loc is None else loc).alias("loc"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_edges(candidates: DataFrame) -> DataFrame:
    w = Window.partitionBy("kind", "from_id", "to_id").orderBy("seq", "skey", F.coalesce(render(F.col("loc")), F.lit("")), "rule")
    return candidates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_relationships(edges: DataFrame, analyzer: str) -> DataFrame:
    """Rule edges in the form of the relationships table."""
    keys = F.array(F.lit("ruleId"), F.lit("ruleVersion"), F.lit("analyzerId"), F.lit("confidence"))
    vals = F.array(F.col("rule"), F.lit("1"), F.lit(analyzer), F.format_string("%.2f", "confidence"))
    for c in ("inferred", "ambiguous"):
        keys, vals = F.when(F.col(c), F.concat(keys, F.array(F.lit(c)))).otherwise(keys), F.when(F.col(c), F.concat(vals, F.array(F.lit("true")))).otherwise(vals)
    return edges.select(F.lit(0).cast("long").alias("ord"), "from_id", "to_id", "kind", "resolved", "status", "loc", F.map_from_arrays(keys, vals).alias("attrs"))


def method_in(refs: DataFrame, methods: DataFrame, owner: str, out: str) -> DataFrame:
    """refs: eid, call, args and an owner column. Adds the method of that owner and name: of that arity, else the first."""
    m = methods.select(F.col("owner").alias("_o"), F.col("name").alias("_m"), F.col("id").alias("_id"), F.col("arity").alias("_a"))
    j = refs.select("eid", owner, "call", "args").join(m, (F.col(owner) == F.col("_o")) & (F.col("call") == F.col("_m")))
    pick = j.groupBy(F.col("eid").alias("_e"), F.col(owner).alias("_ow")).agg(F.min(F.struct(((F.col("args") < 0) | (F.col("args") != F.col("_a"))).alias("miss"), F.col("_id").alias("id"))).alias("_p"))
    return refs.join(pick.select("_e", "_ow", F.col("_p.id").alias(out)), (F.col("eid") == F.col("_e")) & (F.col(owner) == F.col("_ow")), "left").drop("_e", "_ow")


def java_rules(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, tables: name, tags: id, key, value, seq)."""
    types = entities.where(F.col("kind").isin(*PROJECT_TYPES))
    one = unique(types.select("name", "id"), "name").select(F.col("name").alias("u_name"), F.col("id").alias("u_id"))
    info = types.select(F.col("id").alias("t_id"), F.col("qualified_name").alias("t_qn"), F.col("kind").alias("t_kind"), F.col("name").alias("t_name"))
    known = one.join(info, F.col("u_id") == F.col("t_id")).drop("u_id")
    named = lambda df, c: df.join(known, c == F.col("u_name")).drop("u_name")
    table_id = lambda c: F.concat(F.lit("sql:table:"), c)
    parts: list[DataFrame] = []
    # 1. JPA tables
    explicit = attr("jpaTableName")
    jpa = types.where(bool_attr("jpaEntity")).select("id", "qualified_name", "loc", F.coalesce(explicit, F.lower("name")).alias("table"), explicit.isNull().alias("guess"))
    sure = F.when(F.col("guess"), 0.60).otherwise(1.00)
    status = F.when(F.col("guess"), "INFERRED").otherwise("RESOLVED")
    parts.append(made(jpa, 1, F.col("id"), "MAPS_TO", F.col("id"), table_id(F.col("table")), F.when(F.col("guess"), RULES["JPA2"]).otherwise(RULES["JPA1"]), sure, status, F.col("guess"), loc=F.col("loc")))
    # 2. repositories
    repo = types.where(bool_attr("springDataRepository")).select("id", "qualified_name", "loc", simple_type(attr("managedEntityType")).alias("managed"))
    repo = named(repo, F.col("managed"))
    parts.append(made(repo, 2, F.col("id"), "MANAGES", F.col("id"), F.col("t_id"), RULES["REPO1"], 1.00, loc=F.col("loc")))
    stores = repo.join(jpa.select(F.col("id").alias("_j"), "table", "guess"), F.col("t_id") == F.col("_j"))
    parts.append(made(stores, 2, F.col("id"), "PERSISTS_TO", F.col("id"), table_id(F.col("table")), RULES["REPO2"], F.least(F.lit(0.95), sure), status, F.col("guess"), loc=F.col("loc")))
    stores = stores.select(F.col("id").alias("s_id"), F.col("table").alias("s_table"), F.col("guess"))
    # 3. endpoints
    ends = entities.where("kind = 'ENDPOINT'")
    takes = named(ends.select("id", "loc", simple_type(attr("requestBodyType")).alias("dto")), F.col("dto"))
    gives = named(ends.select("id", "loc", simple_type(attr("returnTypeNormalized")).alias("dto")), F.col("dto"))
    parts += [made(d, 3, F.col("id"), k, F.col("id"), F.col("t_id"), RULES["IO"], 0.95, loc=F.col("loc")) for d, k in ((takes, "CONSUMES"), (gives, "PRODUCES"))]
    tags = union([d.select(F.col("t_id").alias("id"), F.lit("role").alias("key"), F.lit(v).alias("value"), F.concat(F.col("id"), F.lit(f"|{n}")).alias("seq")) for n, (d, v) in enumerate(((takes, "dto-request"), (gives, "dto-response")))])
    # 4. calls
    hash_ = F.instr("qualified_name", "#")
    owner = F.when(hash_ > 1, F.substring_index("qualified_name", "#", 1)).otherwise(F.col("qualified_name"))
    methods = entities.where("kind = 'METHOD'").where(hash_ > 1).select("id", "name", owner.alias("owner"), type_arity(attr("paramTypes")).alias("arity"))
    fields = entities.where("kind = 'FIELD'").where(hash_ > 1).where(attr("fieldType").isNotNull()).groupBy(owner.alias("f_owner"), F.col("name").alias("f_name")).agg(F.min(simple_type(attr("fieldType"))).alias("f_type"))
    callers = entities.where("kind <> 'FILE'").select(F.col("id").alias("c_id"), owner.alias("c_owner"))
    calls = edges.where("kind = 'CALLS' AND NOT resolved").select("from_id", "loc", F.coalesce(attr("callName"), "to_id").alias("call"), F.coalesce(attr("argCount").try_cast("int"), F.lit(-1)).alias("args"), attr("receiverName").alias("receiver"))
    calls = calls.withColumn("eid", F.xxhash64("from_id", "call", "args", F.coalesce("receiver", F.lit("\0")), render(F.col("loc")), F.col("loc.s_col"))).join(callers, F.col("from_id") == F.col("c_id"))
    key = F.concat_ws("\x01", "from_id", "call", F.coalesce(render(F.col("loc")), F.lit("")))
    own = method_in(calls.where("receiver IS NULL"), methods, "c_owner", "target").where("target IS NOT NULL")
    parts.append(made(own, 4, key, "INVOKES", F.col("from_id"), F.col("target"), RULES["CALL"], 0.95, loc=F.col("loc")))
    on = calls.where("receiver IS NOT NULL").join(fields, (F.col("c_owner") == F.col("f_owner")) & (F.col("receiver") == F.col("f_name")), "left")
    on = on.withColumn("rtype", F.coalesce("f_type", F.when(F.col("receiver").rlike("^\\p{Lu}"), F.col("receiver")))).where("rtype IS NOT NULL")
    on = on.join(known, F.col("rtype") == F.col("u_name"), "left")
    lost = on.where("u_name IS NULL AND f_type IS NOT NULL")
    parts.append(made(lost, 4, key, "INVOKES", F.col("from_id"), F.concat("rtype", F.lit("#"), "call"), RULES["LOST"], 0.40, "UNRESOLVED", loc=F.col("loc")))
    on = method_in(on.where("u_name IS NOT NULL"), methods, "t_qn", "declared").join(stores, F.col("t_id") == F.col("s_id"), "left")
    repo_calls = on.where("s_id IS NOT NULL")
    op = F.when(starts(F.col("call"), WRITES), "WRITES_TO").when(starts(F.col("call"), READS), "READS_FROM").otherwise("USES")
    rule = F.when(op == "READS_FROM", RULES["READ"]).when(op == "WRITES_TO", RULES["WRITE"]).otherwise(RULES["REPO3"])
    weight = F.round(F.when(op == "USES", 0.70).otherwise(0.90) * F.when(F.col("guess"), 0.60).otherwise(1.00), 2)
    parts.append(made(repo_calls, 4, key, op, F.col("from_id"), table_id(F.col("s_table")), rule, weight, status, F.col("guess"), loc=F.col("loc")))
    impl = edges.where("kind = 'IMPLEMENTS' AND resolved").select(F.col("to_id").alias("i_of"), F.col("from_id").alias("i_id")).distinct()
    impl = impl.join(entities.select(F.col("id").alias("_i"), F.col("qualified_name").alias("i_qn")), F.col("i_id") == F.col("_i")).drop("_i")
    n_impl = impl.groupBy(F.col("i_of").alias("n_of")).agg(F.count(F.lit(1)).alias("n_impl"))
    iface = on.where("s_id IS NULL AND t_kind = 'INTERFACE'").join(n_impl, F.col("t_id") == F.col("n_of"), "left")
    through = iface.where("n_impl >= 1").drop("n_of").join(impl, F.col("t_id") == F.col("i_of"))
    through = method_in(through, methods, "i_qn", "target").where("target IS NOT NULL")
    parts.append(made(through.where("n_impl = 1"), 4, key, "INVOKES", F.col("from_id"), F.col("target"), RULES["DI1"], 0.90, loc=F.col("loc")))
    parts.append(made(through.where("n_impl > 1"), 4, key, "INVOKES", F.col("from_id"), F.col("target"), RULES["DI2"], 0.50, "INFERRED", True, True, True, F.col("loc")))
    met = through.where("n_impl = 1").select(F.col("eid").alias("_met")).distinct()
    plain = iface.where("n_impl IS NULL OR n_impl = 1").join(met, F.col("eid") == F.col("_met"), "left_anti")
    declared = union([x.select("from_id", "call", "loc", "declared") for x in (repo_calls, plain, on.where("s_id IS NULL AND t_kind <> 'INTERFACE'"))]).where("declared IS NOT NULL")
    parts.append(made(declared, 4, key, "INVOKES", F.col("from_id"), F.col("declared"), RULES["CALL"], 0.95, loc=F.col("loc")))
    # 5. SQL literals
    sql = entities.where(attr("sqlReads").isNotNull() | attr("sqlWrites").isNotNull()).withColumn("dyn", bool_attr("sqlDynamic"))
    for k, a in (("READS_FROM", "sqlReads"), ("WRITES_TO", "sqlWrites")):
        s = sql.select("id", "loc", "dyn", F.explode(F.split(attr(a), ",")).alias("t")).withColumn("t", F.trim("t")).where("t <> ''")
        parts.append(made(s, 5, F.col("id"), k, F.col("id"), table_id(F.col("t")), F.when(F.col("dyn"), RULES["SQL2"]).otherwise(RULES["SQL1"]), F.when(F.col("dyn"), 0.60).otherwise(0.95), F.when(F.col("dyn"), "INFERRED").otherwise("RESOLVED"), F.col("dyn"), loc=F.col("loc")))
    # 6. transformations
    made_types = edges.where("kind = 'INSTANTIATES'").select(F.col("from_id").alias("n_from"), F.coalesce(attr("typeName"), F.when(F.col("resolved"), F.lit("")).otherwise(F.col("to_id"))).alias("n_type")).distinct().withColumn("news", F.lit(True))
    m = entities.where("kind = 'METHOD'").where(single(attr("paramTypes")) & attr("returnTypeNormalized").isNotNull())
    m = m.select("id", "name", "loc", simple_type(attr("paramTypes")).alias("pin"), simple_type(attr("returnTypeNormalized")).alias("pout"))
    m = named(m, F.col("pin")).select("id", "name", "loc", "pout", F.col("t_id").alias("in_id"))
    m = named(m, F.col("pout")).where("t_id <> in_id").join(made_types, (F.col("id") == F.col("n_from")) & (F.col("t_name") == F.col("n_type")), "left")
    m = m.withColumn("news", F.coalesce("news", F.lit(False))).where(F.col("news") | starts(F.col("name"), MAPPERS))
    flow = (F.when(F.col("news"), RULES["MAP1"]).otherwise(RULES["MAP2"]), F.when(F.col("news"), 0.90).otherwise(0.60), F.when(F.col("news"), "RESOLVED").otherwise("INFERRED"), ~F.col("news"))
    parts += [made(m, 6, F.col("id"), k, F.col("id"), F.col(t), *flow, loc=F.col("loc")) for k, t in (("CONSUMES", "in_id"), ("PRODUCES", "t_id"))]
    tags = tags.unionByName(m.select("id", F.lit("transformation").alias("key"), F.lit("true").alias("value"), F.col("id").alias("seq")))
    base = first_edges(union(parts))
    # 7. validation looks at the invocations derived above
    v = entities.where("kind = 'METHOD'").where(starts(F.col("name"), ("validate",)) & single(attr("paramTypes"))).select(F.col("id").alias("v_id"), simple_type(attr("paramTypes")).alias("dto"))
    inv = base.where("kind = 'INVOKES' AND resolved").select("from_id", "to_id", F.col("loc").alias("v_loc")).join(v, F.col("to_id") == F.col("v_id"))
    inv = named(inv, F.col("dto"))
    check = first_edges(made(inv, 7, F.concat_ws("\x01", "to_id", "from_id"), "VALIDATED_BY", F.col("t_id"), F.col("v_id"), RULES["VALID"], 0.90, loc=F.col("v_loc")))
    out = base.unionByName(check)
    tables = out.where("kind IN ('MAPS_TO', 'PERSISTS_TO', 'READS_FROM', 'WRITES_TO', 'USES')").where(F.col("to_id").startswith("sql:table:")).select(F.substring("to_id", len("sql:table:") + 1, 1 << 20).alias("name")).distinct()
    return out, tables, tags


def ada_rules(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, consoles: kind, name, tags)."""
    ada = entities.where("language = 'ada'")
    free = edges.where(~F.col("resolved") & attr("ruleId").isNull())
    callers = ada.select(F.col("id").alias("a_id"))
    parts: list[DataFrame] = []
    # state: the longest dotted prefix that names a variable, or names one in the enclosing package
    variables = ada.where("kind = 'VARIABLE'").groupBy(F.lower("qualified_name").alias("v_qn")).agg(F.min("id").alias("v_id"))
    st = free.where(F.col("kind").isin("WRITES_TO", "READS_FROM") & attr("stateName").isNotNull()).select("kind", "from_id", "to_id", "loc", F.lower(attr("stateName")).alias("state"), F.lower(F.coalesce(attr("enclosingPackage"), F.lit(""))).alias("pkg"))
    st = st.join(callers, F.col("from_id") == F.col("a_id"), "left_semi").withColumn("_p", F.split("state", "\\."))
    st = st.withColumn("take", F.explode(F.sequence(F.lit(1), F.size("_p")))).withColumn("prefix", F.array_join(F.slice("_p", 1, F.col("take")), "."))
    local = F.when(F.col("pkg") != "", F.concat("pkg", F.lit("."), "prefix"))
    both = F.explode(F.array(F.struct(F.col("prefix").alias("name"), F.lit(0).alias("loc_")), F.struct(local.alias("name"), F.lit(1).alias("loc_"))))
    st = st.select("kind", "from_id", "to_id", "loc", "take", both.alias("c")).join(variables, F.col("c.name") == F.col("v_qn"))
    st = st.groupBy("kind", "from_id", "to_id", "loc").agg(F.min(F.struct((-F.col("take")).alias("t"), F.col("c.loc_").alias("l"), F.col("v_id").alias("v"))).alias("b"))
    qualified = (F.col("b.l") == 0) & (F.col("b.t") < -1)
    key = F.concat_ws("\x01", "from_id", "to_id")
    parts.append(made(st, 1, key, F.col("kind"), F.col("from_id"), F.col("b.v"), F.when(F.col("kind") == "WRITES_TO", RULES["AWRITE"]).otherwise(RULES["AREAD"]), F.when(qualified, 0.90).otherwise(0.85), loc=F.col("loc")))
    # calls
    routines = ada.where("kind IN ('PROCEDURE', 'FUNCTION')").select("id", F.lower("name").alias("simple"), F.lower(F.substring_index("qualified_name", "(", 1)).alias("qn"))
    withs = edges.where("kind = 'IMPORTS'").where(F.col("from_id").startswith("file:") & attr("typeName").isNotNull()).select(F.substring("from_id", 6, 1 << 20).alias("w_file"), F.lower(attr("typeName")).alias("unit")).distinct()
    packages = ada.where("kind = 'PACKAGE'").select(F.lower("qualified_name").alias("p_qn")).distinct()
    c = free.where("kind = 'CALLS'").select("from_id", "to_id", "loc", F.lower(F.coalesce(attr("callName"), "to_id")).alias("simple"), attr("qualifiedCallName").alias("qual")).distinct()
    c = c.join(callers, F.col("from_id") == F.col("a_id"), "left_semi")
    text_io = withs.where(F.col("unit") == TEXT_IO).select(F.col("w_file").alias("io_file")).distinct().withColumn("io", F.lit(True))
    c = c.join(text_io, F.col("loc.file") == F.col("io_file"), "left").drop("io_file").withColumn("io", F.coalesce("io", F.lit(False)))
    n_qn = routines.groupBy(F.col("qn").alias("k")).agg(F.collect_set("id").alias("ids"))
    n_simple = routines.groupBy(F.col("simple").alias("k")).agg(F.collect_set("id").alias("ids"))
    q = c.where("qual IS NOT NULL").join(n_qn, F.lower("qual") == F.col("k"), "left")
    s = c.where("qual IS NULL").join(n_simple, F.col("simple") == F.col("k"), "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    n = F.when(F.col("ids").isNull(), 0).otherwise(n)
    each = lambda d: d.withColumn("t", F.explode("ids"))
    parts.append(made(each(q.where(n == 1)), 2, key, "INVOKES", F.col("from_id"), F.col("t"), RULES["ACALL1"], 0.95, loc=F.col("loc")))
    parts.append(made(each(s.where(n == 1)).where("t <> from_id"), 2, key, "INVOKES", F.col("from_id"), F.col("t"), RULES["ACALL1"], 0.85, loc=F.col("loc")))
    parts.append(made(each(q.where(n > 1).unionByName(s.where(n > 1))), 2, key, "INVOKES", F.col("from_id"), F.col("t"), RULES["ACALL2"], 0.50, "INFERRED", True, True, True, F.col("loc")))
    is_io = F.col("simple").isin(*CONSOLE_IN, *CONSOLE_OUT)
    none_q, none_s = q.where(n == 0), s.where(n == 0)
    at_text = F.lower("qual").startswith(TEXT_IO + ".")
    io = none_q.where(F.col("io") & at_text & is_io).unionByName(none_s.where(F.col("io") & is_io))
    reading = F.col("simple").isin(*CONSOLE_IN)
    console = F.when(reading, F.lit(stable_id("ada", "DATA_SOURCE", "console_input"))).otherwise(F.lit(stable_id("ada", "DATA_SINK", "console_output")))
    parts.append(made(io, 2, key, F.when(reading, "READS_FROM").otherwise("WRITES_TO"), F.col("from_id"), console, F.when(reading, RULES["AIO1"]).otherwise(RULES["AIO2"]), 0.85, loc=F.col("loc")))
    ext = none_q.where(~(F.col("io") & at_text & is_io)).select("from_id", "to_id", "loc", "qual")
    ext = ext.join(withs, (F.col("loc.file") == F.col("w_file")) & F.lower("qual").startswith(F.concat("unit", F.lit("."))))
    ext = ext.groupBy("from_id", "to_id", "loc", "qual").agg(F.max_by("unit", F.length("unit")).alias("unit")).join(packages, F.col("unit") == F.col("p_qn"), "left_anti")
    parts.append(made(ext, 2, key, "INVOKES", F.col("from_id"), F.col("qual"), RULES["AEXT"], 0.40, "UNRESOLVED", loc=F.col("loc")))
    # transformations
    types = unique(ada.where("kind = 'TYPE'").select(F.lower("name").alias("k"), "id"), "k")
    f = ada.where("kind = 'FUNCTION'").where(single(attr("paramTypes")) & attr("returnType").isNotNull()).select("id", "name", "loc", F.lower(last_segment(attr("paramTypes"))).alias("pin"), F.lower(last_segment(attr("returnType"))).alias("pout"))
    f = f.join(types.select(F.col("k").alias("_a"), F.col("id").alias("in_id")), F.col("pin") == F.col("_a")).join(types.select(F.col("k").alias("_b"), F.col("id").alias("out_id")), F.col("pout") == F.col("_b")).where("in_id <> out_id")
    f = f.withColumn("named", starts(F.col("name"), ADA_MAPPERS))
    flow = (F.when(F.col("named"), RULES["AMAP1"]).otherwise(RULES["AMAP2"]), F.when(F.col("named"), 0.85).otherwise(0.60), F.when(F.col("named"), "RESOLVED").otherwise("INFERRED"), ~F.col("named"))
    parts += [made(f, 3, F.col("id"), k, F.col("id"), F.col(t), *flow, loc=F.col("loc")) for k, t in (("CONSUMES", "in_id"), ("PRODUCES", "out_id"))]
    out = first_edges(union(parts))
    consoles = out.where(F.col("to_id").rlike("^ada:(source|sink):console_")).select(F.when(F.col("to_id").contains(":source:"), "DATA_SOURCE").otherwise("DATA_SINK").alias("kind"), F.substring_index("to_id", ":", -1).alias("name")).distinct()
    return out, consoles, f.select("id", F.lit("transformation").alias("key"), F.lit("true").alias("value"), F.col("id").alias("seq"))


def leftover_state(edges: DataFrame) -> Column:
    """Ada state candidates that no rule took up; they go."""
    return F.col("kind").isin("WRITES_TO", "READS_FROM") & ~F.col("resolved") & attr("stateName").isNotNull() & attr("ruleId").isNull()


def tagged(entities: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds attributes that entities lack; the first of several tags of a key stays."""
    own = tags.groupBy("id", "key").agg(F.min_by("value", "seq").alias("value")).groupBy(F.col("id").alias("_t")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_tags"))
    j = entities.join(own, F.col("id") == F.col("_t"), "left").drop("_t")
    fresh = F.map_filter(F.col("_tags"), lambda k, v: ~F.array_contains(F.map_keys("attrs"), k))
    return j.withColumn("attrs", F.when(F.col("_tags").isNull(), F.col("attrs")).otherwise(F.map_concat("attrs", fresh))).drop("_tags")


def new_entities(spark, tables: DataFrame, consoles: DataFrame, entities: DataFrame) -> DataFrame:
    """Stores and consoles that rules name and no file declares."""
    no_loc = F.lit(None).cast(LOC).alias("loc")
    t = tables.select(F.concat(F.lit("sql:table:"), "name").alias("id"), F.lit("DATABASE_OBJECT").alias("kind"), "name", F.col("name").alias("qualified_name"), F.lit("sql").alias("language"), no_loc, F.create_map(F.lit("dbObjectType"), F.lit("table"), F.lit("externallyExposed"), F.lit("true")).alias("attrs"))
    token = F.when(F.col("kind") == "DATA_SOURCE", "source").otherwise("sink")
    c = consoles.select(F.concat(F.lit("ada:"), token, F.lit(":"), "name").alias("id"), "kind", "name", F.col("name").alias("qualified_name"), F.lit("ada").alias("language"), no_loc, F.create_map(F.lit("description"), F.concat(F.lit("Ada.Text_IO standard "), F.substring_index("name", "_", -1)), F.lit("externallyExposed"), F.lit("true")).alias("attrs"))
    return t.unionByName(c).join(entities.select(F.col("id").alias("_e")), F.col("id") == F.col("_e"), "left_anti")
