"""Metrics, rankings, dead code, coupling, membership and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AGGREGATING, CALLABLES, COUPLING_USAGE, DEAD_CANDIDATES, DEAD_USAGE, attr, bool_attr, int_attr, last_segment
from ..session import durable
from .neighbors import fan


def complexity_hotspots(entities: DataFrame, threshold: int = 10) -> DataFrame:
    cx = int_attr("cyclomaticComplexity", 1)
    band = F.when(F.col("complexity") >= 30, "VERY_HIGH").when(F.col("complexity") >= 15, "HIGH").otherwise("MODERATE")
    own = entities.where(F.col("kind").isin(*CALLABLES, "TASK")).select("id", "qualified_name", cx.alias("complexity"))
    return own.where(F.col("complexity") >= threshold).withColumn("band", band)


def dead_code(entities: DataFrame, edges: DataFrame, minimum: int = 60) -> DataFrame:
    """Probably dead entities with a confidence: not exposed, no exposed namesake, no resolved usage."""
    exposed = entities.where(bool_attr("externallyExposed")).select(F.col("qualified_name").alias("_q")).distinct()
    used = edges.where(F.col("resolved") & F.col("kind").isin(*DEAD_USAGE)).select(F.col("to_id").alias("_t")).distinct()
    asked = edges.where(~F.col("resolved") & F.col("kind").isin(*DEAD_USAGE))
    asked = asked.select(F.lower(last_segment(F.coalesce(attr("callName"), attr("typeName"), "to_id"))).alias("_n")).distinct().withColumn("_maybe", F.lit(True))
    visibility = F.coalesce(attr("visibility"), F.lit(""))
    base = (
        F.when(F.col("kind").isin("METHOD", "FUNCTION", "PROCEDURE"), F.when(visibility == "private", 94).when(visibility.isin("protected", "package"), 86).otherwise(82))
        .when(F.col("kind") == "FIELD", 78)
        .when(F.col("kind").isin("CLASS", "ENUM", "RECORD", "TYPE"), 88)
        .otherwise(70)
    )
    c = entities.where(F.col("kind").isin(*DEAD_CANDIDATES) & ~bool_attr("externallyExposed")).withColumn("_base", base).withColumn("_simple", F.lower("name"))
    c = c.join(exposed, F.col("qualified_name") == F.col("_q"), "left_anti").join(used, F.col("id") == F.col("_t"), "left_anti")
    c = c.join(asked, F.col("_simple") == F.col("_n"), "left")
    score = F.greatest(F.lit(0), F.least(F.lit(96), F.col("_base") - F.when(F.col("_maybe"), 30).otherwise(0)))
    return c.select("id", "qualified_name", "kind", score.alias("confidence"), F.coalesce("_maybe", F.lit(False)).alias("name_is_called")).where(F.col("confidence") >= minimum)


def entity_to_package(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Each contained entity with its package: containment is followed down, not into nested packages. Where several
    packages reach an entity, the smallest id is taken. Levels are joined until one adds nothing; each is written before
    the next."""
    kinds = entities.select("id", (F.col("kind") == "PACKAGE").alias("is_package"))
    packages = entities.where("kind = 'PACKAGE'").select("id", F.col("id").alias("package_id"), F.col("qualified_name").alias("package"))
    down = durable(edges.where("kind = 'CONTAINS'").select("from_id", "to_id").join(kinds, F.col("to_id") == F.col("id")).where("NOT is_package").select("from_id", "to_id"))
    level = out = durable(packages)
    while not level.isEmpty():
        nxt = level.join(down, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id"), "package_id", "package").distinct()
        seen = out.select(F.col("id").alias("_i"), F.col("package_id").alias("_p"))
        level = durable(nxt.join(seen, (F.col("id") == F.col("_i")) & (F.col("package_id") == F.col("_p")), "left_anti"))
        out = out.unionByName(level)
    return out.groupBy("id").agg(F.min(F.struct("package_id", "package")).alias("p")).select("id", "p.package_id", "p.package")


def package_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (from_package, to_package) of resolved usage between packages."""
    of = entity_to_package(entities, edges)
    a = of.select(F.col("id").alias("_a"), F.col("package").alias("from_package"))
    b = of.select(F.col("id").alias("_b"), F.col("package").alias("to_package"))
    own = edges.where(F.col("resolved") & F.col("kind").isin(*COUPLING_USAGE)).select("from_id", "to_id")
    j = own.join(a, F.col("from_id") == F.col("_a")).join(b, F.col("to_id") == F.col("_b"))
    return j.where("from_package <> to_package").select("from_package", "to_package").distinct()


def risk(out: Column, in_: Column) -> Column:
    return F.when((in_ >= 10) | (out + in_ >= 20), "HIGH").when((in_ >= 4) | (out + in_ >= 8), "MEDIUM").otherwise("LOW")


def package_coupling(entities: DataFrame, edges: DataFrame) -> DataFrame:
    pairs = package_edges(entities, edges)
    out = pairs.groupBy(F.col("from_package").alias("_o")).agg(F.count(F.lit(1)).alias("out"), F.array_join(F.array_sort(F.collect_set("to_package")), "|").alias("depends_on"))
    in_ = pairs.groupBy(F.col("to_package").alias("_i")).agg(F.count(F.lit(1)).alias("in"))
    p = entities.where("kind = 'PACKAGE'").select(F.col("qualified_name").alias("package")).distinct()
    j = p.join(out, F.col("package") == F.col("_o"), "left").join(in_, F.col("package") == F.col("_i"), "left")
    j = j.select("package", F.coalesce("out", F.lit(0)).alias("dependencies"), F.coalesce("in", F.lit(0)).alias("dependents"), F.coalesce("depends_on", F.lit("")).alias("depends_on"))
    return j.withColumn("risk", risk(F.col("dependencies"), F.col("dependents")))


def resolution_coverage(edges: DataFrame) -> DataFrame:
    """Counters of resolved and unresolved references and the rate; 100 where there are none."""
    own = edges.where("kind <> 'CONTAINS'").agg(F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))
    total = F.col("resolved") + F.col("unresolved")
    return own.withColumn("rate", F.when(total > 0, F.round(100.0 * F.col("resolved") / total, 2)).otherwise(F.lit(100.0))).withColumn("is_partial", F.col("unresolved") > 0)


def dead_share(entities: DataFrame, dead: DataFrame) -> DataFrame:
    """Share of probably dead entities among methods, functions, procedures and classes."""
    n = entities.where(F.col("kind").isin("METHOD", "FUNCTION", "PROCEDURE", "CLASS")).agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(dead.agg(F.count(F.lit(1)).alias("dead"))), F.lit(True)).withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("dead") / F.col("total"), 2)).otherwise(F.lit(0.0)))


def file_metrics(files: DataFrame) -> DataFrame:
    """files: language, total, comment, blank. One row of totals; code lines are never below 0."""
    t = files.agg(F.count(F.lit(1)).alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_lines") for c in ("total", "comment", "blank")))
    t = t.withColumn("code_lines", F.greatest(F.lit(0), F.col("total_lines") - F.col("comment_lines") - F.col("blank_lines")))
    both = F.col("code_lines") + F.col("comment_lines")
    return t.withColumn("comment_percent", F.when(both > 0, F.round(100.0 * F.col("comment_lines") / both, 0)).otherwise(F.lit(0.0)).cast("long"))


def inventory(entities: DataFrame, groups: dict[str, tuple[str, ...]], examples: int = 5) -> DataFrame:
    """Categories of kinds with a count and the smallest distinct names. Names are ranked within each category after a
    distinct step, so a category of any size sends a few names."""
    of = F.create_map(*(F.lit(x) for c, kinds in groups.items() for k in kinds for x in (k, c)))
    own = entities.select(F.element_at(of, F.col("kind")).alias("category"), "name").where("category IS NOT NULL")
    n = own.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    names = own.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy("name"))).where(F.col("_r") <= examples)
    names = names.groupBy(F.col("category").alias("_c")).agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("examples"))
    return n.join(names, F.col("category") == F.col("_c")).select("category", "n", "examples")


def build_membership(modules: DataFrame, files: DataFrame) -> DataFrame:
    """modules: id, dir; files: id, path. Each file with the deepest module whose directory is a prefix of its path.

    The theta join becomes an equi-join: each path is exploded into its ancestor directories."""
    parts = F.split("path", "/")
    # '' (the root) and every proper ancestor
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    f = files.select(F.col("id").alias("file_id"), F.explode(up).alias("_dir"))
    j = f.join(modules.select(F.col("id").alias("module_id"), F.col("dir").alias("_mdir")), F.col("_dir") == F.col("_mdir"))
    best = j.groupBy("file_id").agg(F.min(F.struct((-F.length("_mdir")).alias("d"), "module_id")).alias("b"))
    return best.select("file_id", "b.module_id")


def max_member_complexity(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """id and max_complexity: the largest complexity of what an entity directly contains; members without one count 0."""
    inside = edges.where("kind = 'CONTAINS' AND resolved").select(F.col("from_id").alias("id"), F.col("to_id").alias("_part"))
    parts = entities.select(F.col("id").alias("_p"), int_attr("cyclomaticComplexity", 0).alias("cx"))
    return inside.join(parts, F.col("_part") == F.col("_p")).groupBy("id").agg(F.max("cx").alias("max_complexity"))


def central_score(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """5 in + 2 out + 8 lineage + 10 entry + 6 data + 12 boundary + min(complexity, 20) + min(unresolved, 5), above 0."""
    in_, out = fan(entities, edges, True).select(F.col("id").alias("_i"), F.col("n").alias("fan_in")), fan(entities, edges, False).select(F.col("id").alias("_o"), F.col("n").alias("fan_out"))
    data = edges.where(F.col("resolved") & F.col("kind").isin("READS_FROM", "WRITES_TO", "PERSISTS_TO", "MAPS_TO")).select(F.col("from_id").alias("_d")).distinct().withColumn("data", F.lit(1))
    missing = edges.where(~F.col("resolved")).groupBy(F.col("from_id").alias("_u")).agg(F.count(F.lit(1)).alias("unresolved"))
    e = entities.select("id", "kind", F.least(int_attr("cyclomaticComplexity", 0), F.lit(20)).alias("cx"), (F.col("kind").isin("ENDPOINT", "TASK") | F.coalesce(attr("isMain") == "true", F.lit(False))).cast("int").alias("entry"), F.coalesce(attr("transformation") == "true", F.lit(False)).cast("int").alias("lineage"), F.coalesce(attr("nativeMethod") == "true", F.lit(False)).cast("int").alias("boundary"))
    j = e.join(in_, F.col("id") == F.col("_i"), "left").join(out, F.col("id") == F.col("_o"), "left").join(data, F.col("id") == F.col("_d"), "left").join(missing, F.col("id") == F.col("_u"), "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    score = 5 * z("fan_in") + 2 * z("fan_out") + 8 * F.col("lineage") + 10 * F.col("entry") + 6 * z("data") + 12 * F.col("boundary") + F.col("cx") + F.least(z("unresolved"), F.lit(5))
    return j.select("id", score.cast("long").alias("score")).where("score > 0")


def first_wins(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each (kind, from, to): the first in order."""
    w = Window.partitionBy("kind", "from_id", "to_id").orderBy(*order)
    return edges.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: the entity columns and seq, their order. Gives (entities, collisions).

    The first row of an id stays. Mergeable rows (same kind, and of an aggregating kind or at the same place) add their
    attributes: exposure is or-ed, complexity and loc take the maximum, any other key the first value. Other rows are
    collisions.
    """
    first = rows.groupBy("id").agg(F.min_by(F.struct("kind", "name", "qualified_name", "language", "loc"), "seq").alias("f"), F.min("seq").alias("_s"))
    j = rows.join(first, "id")
    same_place = (F.col("loc.file") == F.col("f.loc.file")) & (F.col("loc.s_line") == F.col("f.loc.s_line"))
    parts = (F.col("language") == "ada") & (attr("adaPart").isin("spec", "body"))
    fits = (F.col("seq") == F.col("_s")) | ((F.col("kind") == F.col("f.kind")) & (F.col("kind").isin(*AGGREGATING) | F.coalesce(same_place, F.lit(False)) | F.coalesce(parts, F.lit(False))))
    good = j.where(fits)
    kv = good.select("id", "seq", F.explode("attrs").alias("k", "v"))
    number = F.col("v").try_cast("long")
    value = (
        F.when(F.first("k") == "externallyExposed", F.bool_or(F.lower("v") == "true").cast("string"))
        .when(F.first("k").isin("cyclomaticComplexity", "loc"), F.max(number).cast("string"))
        .otherwise(F.min_by("v", "seq"))
    )
    bags = kv.groupBy("id", "k").agg(value.alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    merged = first.select("id", "f.*").join(bags.withColumnRenamed("id", "_b"), F.col("id") == F.col("_b"), "left").drop("_b")
    merged = merged.withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    return merged, j.where(~fits).select("id", "seq", F.col("f.kind").alias("first_kind"), "kind")


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, hash) tables to (path, change): added, changed, unchanged or removed."""
    p, c = previous.select(F.col("path").alias("_p"), F.col("hash").alias("_ph")), current.select(F.col("path").alias("_c"), F.col("hash").alias("_ch"))
    j = p.join(c, F.col("_p") == F.col("_c"), "full_outer")
    kind = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_ph") == F.col("_ch"), "unchanged").otherwise("changed")
    return j.select(F.coalesce("_c", "_p").alias("path"), kind.alias("change"))


def reusable(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files and cache: path, hash, parser_id, parser_version. The files whose cached facts can be used again."""
    k = cache.select(F.col("path").alias("_p"), F.col("hash").alias("_h"), F.col("parser_id").alias("_i"), F.col("parser_version").alias("_v"))
    return files.join(k, (F.col("path") == F.col("_p")) & (F.col("hash") == F.col("_h")) & F.col("parser_id").eqNullSafe(F.col("_i")) & F.col("parser_version").eqNullSafe(F.col("_v")), "left_semi")


def scan_id(files: DataFrame) -> DataFrame:
    """scan- and 12 hex digits of SHA-256 over the sorted lines path, NUL, hash. One row; the listing is one per file of
    a scan, which the scanner bounds (250,000 files)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda r: F.concat(r["path"], F.lit("\0"), r["hash"], F.lit("\n"))), "")
    return files.agg(F.concat(F.lit("scan-"), F.substring(F.sha2(F.encode(lines, "UTF-8"), 256), 1, 12)).alias("scan_id"))
