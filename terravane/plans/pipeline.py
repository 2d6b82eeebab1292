"""From a source tree to a snapshot: scan, reuse, extract, merge, link, attribute, derive, write."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOC, attr
from ..operators import analysis as an
from ..operators import lineage as ln
from ..operators import resolution as rs
from ..session import durable
from ..sources.facts import registry
from ..sources.scan import describe, extract, read_tree
from ..sources.store import Store


@dataclass
class Model:
    entities: DataFrame
    relationships: DataFrame
    diagnostics: DataFrame
    files: DataFrame  # path, hash, language, size, status, total, comment, blank
    stats: dict[str, int]
    scan_id: str
    root: str


def _rows(parsed: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Entity rows with their merge order, and edges, of all files, the FILE entities and the PROJECT."""
    e = parsed.select("path", F.posexplode("entities").alias("n", "e")).select("e.*", F.struct(F.lit(0).alias("a"), "path", "n").alias("seq"))
    attrs = F.create_map(F.lit("fileHash"), F.col("hash"), F.lit("loc"), F.greatest(F.col("total") - F.col("comment") - F.col("blank"), F.lit(0)).cast("string"), F.lit("sizeBytes"), F.col("size").cast("string"), F.lit("parseStatus"), F.col("status"))
    files = parsed.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("FILE").alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("qualified_name"), "language", F.struct(F.col("path").alias("file"), F.lit(0).alias("s_line"), F.lit(0).alias("e_line"), F.lit(0).alias("s_col"), F.lit(0).alias("e_col")).cast(LOC).alias("loc"), attrs.alias("attrs"), F.struct(F.lit(1).alias("a"), "path", F.lit(0).alias("n")).alias("seq"))
    spark = parsed.sparkSession
    p = spark.range(1).select(F.lit(f"project:{project}").alias("id"), F.lit("PROJECT").alias("kind"), F.lit(project).alias("name"), F.lit(project).alias("qualified_name"), F.lit("unknown").alias("language"), F.lit(None).cast(LOC).alias("loc"), F.create_map().cast("map<string,string>").alias("attrs"), F.struct(F.lit(2).alias("a"), F.lit("").alias("path"), F.lit(0).alias("n")).alias("seq"))
    r = parsed.select("path", F.posexplode("relationships").alias("n", "r")).select(F.col("n").cast("long").alias("ord"), "r.*")
    c = parsed.select(F.lit(0).cast("long").alias("ord"), F.lit(f"project:{project}").alias("from_id"), F.concat(F.lit("file:"), "path").alias("to_id"), F.lit("CONTAINS").alias("kind"), F.lit(True).alias("resolved"), F.lit("DISCOVERED").alias("status"), F.lit(None).cast(LOC).alias("loc"), F.create_map().cast("map<string,string>").alias("attrs"))
    return e.unionByName(files).unionByName(p), r.unionByName(c)


def ada_parts(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Ada entities declared in a spec and a body show both; the spec's place is theirs."""
    own = rows.where(F.col("language") == "ada").where(attr("adaPart").isNotNull()).groupBy(F.col("id").alias("_a")).agg(
        F.max(attr("specLocation")).alias("spec"), F.max(attr("bodyLocation")).alias("body"), F.max_by("loc", F.when(attr("adaPart") == "spec", 1).otherwise(0)).alias("_loc"))
    j = merged.join(own, F.col("id") == F.col("_a"), "left")
    more = F.map_from_arrays(F.array(F.lit("hasSpec"), F.lit("hasBody"), F.lit("specLocation"), F.lit("bodyLocation")), F.array(F.col("spec").isNotNull().cast("string"), F.col("body").isNotNull().cast("string"), F.coalesce("spec", F.lit("")), F.coalesce("body", F.lit(""))))
    rest = F.map_filter("attrs", lambda k, v: ~k.isin("hasSpec", "hasBody", "specLocation", "bodyLocation"))
    return j.withColumn("attrs", F.when(F.col("_a").isNull(), F.col("attrs")).otherwise(F.map_concat(rest, F.map_filter(more, lambda k, v: v != "")))).withColumn("loc", F.coalesce("_loc", "loc")).select(*merged.columns)


def build_model(parsed: DataFrame, root: str, scan_id: str) -> Model:
    spark = parsed.sparkSession
    project = os.path.basename(os.path.abspath(root))
    rows, edges = _rows(parsed, project)
    rows, edges = durable(rows), durable(edges)
    entities, bad = an.merge_entities(rows)
    entities = durable(ada_parts(rows, entities))
    diagnostics = durable(bad.select(F.lit("STABLE_ID_COLLISION").alias("code"), F.concat(F.lit("id '"), "id", F.lit("' is declared as "), "first_kind", F.lit(" and as "), "kind").alias("message")))
    found = durable(rs.resolve(entities, edges))
    stats = rs.link_stats(found).first().asDict()
    edges = durable(edges.unionByName(rs.link(found)))
    modules = entities.where("kind = 'MODULE'").select("id", F.coalesce(attr("moduleDir"), F.lit("")).alias("dir"))
    member = an.build_membership(modules, entities.where("kind = 'FILE'").select("id", F.col("qualified_name").alias("path")))
    owned = member.select(F.lit(0).cast("long").alias("ord"), F.col("module_id").alias("from_id"), F.col("file_id").alias("to_id"), F.lit("CONTAINS").alias("kind"), F.lit(True).alias("resolved"), F.lit("DISCOVERED").alias("status"), F.lit(None).cast(LOC).alias("loc"), F.create_map().cast("map<string,string>").alias("attrs"))
    edges = durable(edges.unionByName(owned))
    java, tables, java_tags = ln.java_rules(entities, edges)
    java = durable(java)
    entities = durable(ln.tagged(entities.unionByName(ln.new_entities(spark, tables, spark.createDataFrame([], "kind string, name string"), entities)), java_tags))
    edges = durable(edges.unionByName(ln.as_relationships(java, "lineage/1")))
    ada, consoles, ada_tags = ln.ada_rules(entities, edges)
    ada = durable(ada)
    entities = durable(ln.tagged(entities.unionByName(ln.new_entities(spark, spark.createDataFrame([], "name string"), consoles, entities)), ada_tags))
    edges = durable(edges.where(~ln.leftover_state(edges)).unionByName(ln.as_relationships(ada, "ada-lineage/1")))
    files = parsed.select("path", "hash", "language", "size", "status", "total", "comment", "blank")
    return Model(entities, edges, diagnostics, files, stats, scan_id, root)


def scan(spark: SparkSession, root: str, store: Store | None = None, hardened: bool = False) -> Model:
    """Scan a tree. With a store, unchanged files are taken from its cache, and the result becomes its snapshot; a failure
    marks the scan FAILED and leaves the snapshot before it in place."""
    tree = read_tree(spark, root, hardened)
    files = durable(describe(tree))
    scan_id = an.scan_id(files).first()[0]
    row = store.begin(scan_id, root, files.count()) if store else None
    try:
        cached = store.cache() if store else None
        if cached is not None:
            # an extractor is chosen by path, so its id and version are known before parsing
            known = {e.id: e.version for e in registry()}
            usable = cached.where(F.col("parser_id").isNull() | F.concat_ws("@", "parser_id", "parser_version").isin([f"{k}@{v}" for k, v in known.items()]))
            keep = usable.join(files.select(F.col("path").alias("_p"), F.col("hash").alias("_h")), (F.col("path") == F.col("_p")) & (F.col("hash") == F.col("_h")), "left_semi")
            fresh = tree.join(keep.select(F.col("path").alias("_k")), F.col("path") == F.col("_k"), "left_anti")
            parsed = durable(extract(fresh).unionByName(keep))
        else:
            parsed = durable(extract(tree))
        model = build_model(parsed, root, scan_id)
        if store:
            store.complete(row, model, parsed)
        return model
    except Exception:
        if store:
            store.fail(row)
        raise
