"""Neighbour joins, usage counts, searches and reference counts over an estate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DB_KINDS, TOOL_USAGE, attr, confidence, last_segment, render


def visible(edges: DataFrame, kinds=TOOL_USAGE) -> DataFrame:
    """Resolved edges of these kinds, without CALLS that an INVOKES of the same pair covers."""
    own = edges.where(F.col("resolved") & F.col("kind").isin(*kinds))
    if "CALLS" not in kinds or "INVOKES" not in kinds:
        return own
    covered = own.where("kind = 'INVOKES'").select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t")).distinct()
    calls = own.where("kind = 'CALLS'").join(covered, (F.col("from_id") == F.col("_f")) & (F.col("to_id") == F.col("_t")), "left_anti")
    return own.where("kind <> 'CALLS'").unionByName(calls)


def view(entities: DataFrame) -> DataFrame:
    """What the query API shows of an entity."""
    return entities.select("id", "kind", "name", "qualified_name", "language", render(F.col("loc")).alias("location"))


def neighbors(entities: DataFrame, edges: DataFrame, of: str | None, kinds=TOOL_USAGE, incoming: bool = True) -> DataFrame:
    """Edges at one entity (or at all) with the entity at the other end; edges whose other end is unknown go."""
    here, there = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    # The id filter comes first, so both sides of the anti-join read that entity's edges alone.
    own = visible(edges if of is None else edges.where(F.col(here) == of), kinds)
    other = view(entities).select(F.col("id").alias("other_id"), F.col("kind").alias("other_kind"), "name", "qualified_name", "language", "location")
    out = own.join(other, own[there] == other["other_id"])
    return out.select(F.col(here).alias("entity_id"), "other_id", "other_kind", "name", F.col("kind").alias("edge_kind"), "status", confidence().alias("confidence"), attr("ruleId").alias("rule_id"))


def fan(entities: DataFrame, edges: DataFrame, incoming: bool, kinds=TOOL_USAGE) -> DataFrame:
    """id and n: how many neighbours an entity has. Counted before the names are joined."""
    here, there = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    known = entities.select(F.col("id").alias("_id"))
    own = visible(edges, kinds).select(here, there)
    counted = own.join(known, F.col(there) == F.col("_id"), "left_semi").groupBy(here).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(known, F.col(here) == F.col("_id"), "left_semi").select(F.col(here).alias("id"), "n")


def search(entities: DataFrame, text: str, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Case-insensitive contains on name or qualified name; equality filters come first and reach the scan."""
    e = entities
    if kind:
        e = e.where(F.upper("kind") == kind.upper())
    if language:
        e = e.where(F.lower("language") == language.lower())
    needle = F.lit(text.lower())
    return view(e.where(F.lower("name").contains(needle) | F.lower("qualified_name").contains(needle)))


def find(entities: DataFrame, shorthand: str) -> DataFrame:
    """Entities that a shorthand may mean: VERB /path, an id with a colon, or a name or suffix of a qualified name."""
    s = shorthand.strip()
    verb, _, path = s.partition(" ")
    if verb.isupper() and path.strip().startswith("/"):
        return view(entities.where((F.col("kind") == "ENDPOINT") & (F.col("name") == f"{verb} {path.strip()}")))
    q = F.col("qualified_name")
    loose = (q == s) | q.endswith("." + s) | q.endswith("#" + s) | (F.col("name") == s)
    return view(entities.where((F.col("id") == s) if ":" in s else loose))


def database_references(entities: DataFrame, edges: DataFrame, of: str | None = None) -> DataFrame:
    """Resolved touches of tables, the table on either end."""
    e = edges.where(F.col("resolved") & F.col("kind").isin(*DB_KINDS))
    if of is not None:
        e = e.where((F.col("from_id") == of) | (F.col("to_id") == of))
    t = entities.where("kind = 'DATABASE_OBJECT'")
    to = t.select(F.col("id").alias("_t"), F.col("name").alias("_tn"))
    from_ = t.select(F.col("id").alias("_f"), F.col("name").alias("_fn"))
    j = e.join(to, F.col("to_id") == F.col("_t"), "left").join(from_, F.col("from_id") == F.col("_f"), "left").where("_t IS NOT NULL OR _f IS NOT NULL")
    return j.select("from_id", "to_id", "kind", F.coalesce("_t", "_f").alias("table_id"), F.coalesce("_tn", "_fn").alias("table_name"))


def touch_counts(edges: DataFrame) -> DataFrame:
    """Distinct readers and writers of each store."""
    own = edges.where(F.col("resolved") & F.col("kind").isin("READS_FROM", "WRITES_TO"))
    return own.groupBy("to_id").agg(F.countDistinct(F.when(F.col("kind") == "READS_FROM", F.col("from_id"))).alias("readers"), F.countDistinct(F.when(F.col("kind") == "WRITES_TO", F.col("from_id"))).alias("writers"))


def twin_name() -> Column:
    return F.coalesce(attr("callName"), attr("typeName"))


def without_twins(edges: DataFrame) -> DataFrame:
    """Unresolved edges that have no resolved twin (same source, kind and name). Without a name there is no twin."""
    twins = edges.where(F.col("resolved")).select(F.col("from_id").alias("_f"), F.col("kind").alias("_k"), twin_name().alias("_n")).where("_n IS NOT NULL").distinct()
    own = edges.where(~F.col("resolved")).withColumn("_name", twin_name())
    return own.join(twins, (F.col("from_id") == F.col("_f")) & (F.col("kind") == F.col("_k")) & (F.col("_name") == F.col("_n")), "left_anti").drop("_name")


def unresolved_references(edges: DataFrame) -> DataFrame:
    return without_twins(edges).select("from_id", F.coalesce(twin_name(), "to_id").alias("target"), "kind", render(F.col("loc")).alias("location"))


def reference_counts(edges: DataFrame) -> DataFrame:
    """One row: resolved, unresolved and ambiguous references; containment does not count."""
    own = edges.where("kind <> 'CONTAINS'")
    ambiguous = F.coalesce(attr("ambiguous") == "true", F.lit(False))
    r = own.where(F.col("resolved")).select(F.lit("resolved").alias("what"))
    u = without_twins(own).select(F.when(ambiguous, "ambiguous").otherwise("unresolved").alias("what"))
    return r.unionByName(u).agg(*(F.count_if(F.col("what") == w).alias(w) for w in ("resolved", "unresolved", "ambiguous")))


def co_touch(edges: DataFrame, target: str) -> DataFrame:
    """Other entities that touch a store which the target touches."""
    own = edges.where(F.col("resolved") & F.col("kind").isin(*DB_KINDS))
    stores = own.where(F.col("from_id") == target).select(F.col("to_id").alias("_s")).distinct()
    return own.join(stores, F.col("to_id") == F.col("_s"), "left_semi").where(F.col("from_id") != target).select("from_id", "to_id", "kind")


def evidence(entities: DataFrame, of: str) -> DataFrame:
    """Where an entity stands and the hash of its file."""
    files = entities.where("kind = 'FILE'").select(F.col("id").alias("_f"), attr("fileHash").alias("file_hash"))
    e = entities.where(F.col("id") == of).withColumn("_file", F.concat(F.lit("file:"), F.col("loc.file")))
    return e.join(files, F.col("_file") == F.col("_f"), "left").select("id", render(F.col("loc")).alias("location"), attr("specLocation").alias("spec_location"), attr("bodyLocation").alias("body_location"), F.coalesce("file_hash", F.lit("")).alias("file_hash"))


def risk_references(edges: DataFrame, name: str) -> DataFrame:
    """Unresolved edges whose simple name is this one: references that may exist."""
    simple = F.lower(last_segment(F.coalesce(twin_name(), "to_id")))
    return edges.where(~F.col("resolved") & (simple == name.lower())).select("from_id", render(F.col("loc")).alias("location")).distinct()


