"""Linking symbolic references to entities: cascades of keyed lookups with a cap on candidates.

A name with a million bearers is not joined a million times: each key of an index has its exact number of candidates
and at most CAP + 1 of their ids, found with a rank filter that Spark applies before the shuffle too. A lookup is one
equi-join against that index, whatever the skew of the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CALLABLES, LINK_TYPES, attr, last_segment

CAP = 8
TYPE_REFERENCES = ("REFERENCES", "INHERITS", "IMPLEMENTS", "INSTANTIATES", "IMPORTS", "RENAMES", "CONFIGURES")


def arity(signature: Column) -> Column:
    """Parameters by counting commas between the first ( and the last ); -1 without a signature: matches any."""
    open_, close = F.instr(signature, "("), F.length(signature) - F.instr(F.reverse(signature), ")") + 1
    inner = F.trim(F.substring(signature, open_ + 1, close - open_ - 1))
    n = F.when(inner == "", 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(","), F.lit(""))) + 1)
    ok = signature.isNotNull() & (open_ > 0) & (F.instr(signature, ")") > 0) & (close > open_)
    return F.coalesce(F.when(ok, n), F.lit(-1)).cast("int")


def index(rows: DataFrame, *keys: str) -> DataFrame:
    """rows: keys and id. For each key: n, the number of distinct ids, and ids, the first CAP + 1 of them."""
    d = rows.select(*keys, "id").distinct()
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_rn") <= CAP + 1)
    ids = top.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return n.join(ids, list(keys))


def _lookup(refs: DataFrame, idx: DataFrame, on: dict[str, Column], name: str) -> DataFrame:
    """Left join of one index; adds <name>_n and <name>_ids."""
    own = idx.select(*(F.col(k).alias(f"_{name}_{k}") for k in on), F.col("n").alias(f"{name}_n"), F.col("ids").alias(f"{name}_ids"))
    cond = None
    for k, c in on.items():
        one = c == F.col(f"_{name}_{k}")
        cond = one if cond is None else cond & one
    return refs.join(own, cond, "left").drop(*(f"_{name}_{k}" for k in on))


def _first(*names: str) -> tuple[Column, Column]:
    """n and ids of the first lookup that found something."""
    n, ids = F.lit(0).cast("long"), F.array().cast("array<string>")
    for x in reversed(names):
        n, ids = F.when(F.col(f"{x}_n") > 0, F.col(f"{x}_n")).otherwise(n), F.when(F.col(f"{x}_n") > 0, F.col(f"{x}_ids")).otherwise(ids)
    return n, ids


def resolve(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved edges of linkable kinds with n (candidates) and ids (CAP + 1 at most)."""
    own = edges.where(~F.col("resolved"))
    e = entities.select("id", "kind", F.lower("name").alias("lname"), F.lower("qualified_name").alias("lqn"), arity(attr("signature")).alias("arity"))
    outs = []
    # Calls and declared mains: callables by name, of the same arity (or unknown) where there are any.
    c = e.where(F.col("kind").isin(*CALLABLES))
    calls = own.where(F.col("kind").isin("CALLS", "DECLARES_MAIN")).withColumn("_key", F.lower(F.coalesce(attr("callName"), "to_id"))).withColumn("_args", attr("argCount").try_cast("int"))
    by_arity, by_name = index(c, "lname", "arity"), index(c, "lname")
    calls = _lookup(calls, by_arity, {"lname": F.col("_key"), "arity": F.col("_args")}, "same")
    calls = _lookup(calls, by_arity.where("arity = -1").drop("arity"), {"lname": F.col("_key")}, "any")
    calls = _lookup(calls, by_name, {"lname": F.col("_key")}, "all")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    empty = F.array().cast("array<string>")
    fit_n = F.when(F.col("_args").isNull(), F.lit(0)).otherwise(z("same_n") + F.when(F.col("_args") == -1, 0).otherwise(z("any_n")))
    fit_ids = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("same_ids", empty), F.coalesce("any_ids", empty)))), 1, CAP + 1)
    calls = calls.withColumns({"fit_n": fit_n, "fit_ids": fit_ids})
    n, ids = _first("fit", "all")
    outs.append(calls.select(*edges.columns, n.alias("n"), ids.alias("ids")))
    # Modules by key or name, else by what follows the last colon. A module with equal key and name counts once.
    m = e.where("kind = 'MODULE'")
    m = index(m.select(F.col("lqn").alias("key"), "id").unionByName(m.select(F.col("lname").alias("key"), "id")), "key")
    deps = own.where("kind = 'DEPENDS_ON'").withColumn("_key", F.lower(F.coalesce(attr("typeName"), "to_id")))
    deps = _lookup(_lookup(deps, m, {"key": F.col("_key")}, "key"), m, {"key": F.substring_index("_key", ":", -1)}, "tail")
    n, ids = _first("key", "tail")
    outs.append(deps.select(*edges.columns, n.alias("n"), ids.alias("ids")))
    # Foreign keys of tables by name.
    is_table = (F.col("kind") == "REFERENCES") & F.col("from_id").startswith("sql:")
    t = index(e.where("kind = 'DATABASE_OBJECT'"), "lname")
    fks = _lookup(own.where(is_table).withColumn("_key", F.lower(F.coalesce(attr("typeName"), "to_id"))), t, {"lname": F.col("_key")}, "t")
    n, ids = _first("t")
    outs.append(fks.select(*edges.columns, n.alias("n"), ids.alias("ids")))
    # Types by qualified name, else by simple name.
    y = e.where(F.col("kind").isin(*LINK_TYPES))
    refs = own.where(F.col("kind").isin(*TYPE_REFERENCES) & ~is_table).withColumn("_key", F.lower(F.coalesce(attr("typeName"), "to_id")))
    refs = _lookup(_lookup(refs, index(y, "lqn"), {"lqn": F.col("_key")}, "qn"), index(y, "lname"), {"lname": last_segment(F.col("_key"))}, "sn")
    n, ids = _first("qn", "sn")
    outs.append(refs.select(*edges.columns, n.alias("n"), ids.alias("ids")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def link(resolved: DataFrame) -> DataFrame:
    """Resolved edges to add: every candidate but the source itself, where there are 1 to CAP."""
    cols = [c for c in resolved.columns if c not in ("n", "ids")]
    r = resolved.where((F.col("n") > 0) & (F.col("n") <= CAP)).withColumn("_t", F.explode("ids")).where("_t <> from_id")
    return r.select(*(F.col("_t").alias("to_id") if c == "to_id" else F.lit(True).alias("resolved") if c == "resolved" else F.lit("RESOLVED").alias("status") if c == "status" else F.col(c) for c in cols))


def link_stats(resolved: DataFrame) -> DataFrame:
    """Per reference, not per edge."""
    n = F.col("n")
    return resolved.agg(F.count_if((n > 0) & (n <= CAP)).alias("resolved"), F.count_if(n == 0).alias("unresolved"), F.count_if(n > CAP).alias("ambiguous"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    """rows: key and id; the keys with one candidate, and it."""
    return rows.groupBy(key).agg(F.min("id").alias("id"), F.count_distinct("id").alias("_n")).where("_n = 1").drop("_n")
