"""Traversals: lineage traces, transitive dependents, best paths, package cycles, layering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import LINEAGE_KINDS, TOOL_USAGE, attr, confidence, render
from ..session import durable, release

MAX_PATHS, DEPTH, FLOOR = 100, 8, 0.40


def lineage_edges(edges: DataFrame, floor: float = FLOOR, inferred: bool = True) -> DataFrame:
    """Edges a trace may follow: filtered before the traversal, so every level reads few columns and rows."""
    e = edges.where(F.col("kind").isin(*LINEAGE_KINDS) & (F.col("status") != "UNRESOLVED"))
    is_inferred = (F.col("status") == "INFERRED") | F.coalesce(attr("inferred") == "true", F.lit(False))
    if not inferred:
        e = e.where(~is_inferred)
    e = e.select("from_id", "to_id", "kind", "status", confidence().alias("confidence"), is_inferred.alias("inferred"), F.coalesce(attr("ambiguous") == "true", F.lit(False)).alias("ambiguous"), F.coalesce(attr("ruleId"), F.lit("")).alias("rule"), F.coalesce(render(F.col("loc")), F.lit("")).alias("location"))
    return e.where(F.col("confidence") >= floor)


@dataclass
class Trace:
    paths: DataFrame  # no, nodes array<string>, kinds array<string>, confidence
    gaps: DataFrame  # kind, from_id, to_id, reason
    nodes: list[str]
    cycles: bool
    truncated: bool


PATHS = "nodes array<string>, kinds array<string>, confidence double"


def _walk(edges: DataFrame, start: str, upstream: bool, depth: int, most: int):
    """Simple paths in depth-first order (kind, then neighbour). Of each level the first `most` + 1 paths in that order
    are kept: each gives one result at least, so later ones cannot be among the first `most`."""
    spark = edges.sparkSession
    here, there = ("to_id", "from_id") if upstream else ("from_id", "to_id")
    mark = "\x01"
    frontier, done, cycles, cut, seen = [("", [start], [], 1.0)], [], False, False, {start}
    for level in range(depth + 1):
        if not frontier:
            break
        # `most` + 1 rows at most
        f = spark.createDataFrame([(i, r, n, k, c, n[-1]) for i, (r, n, k, c) in enumerate(frontier)], "i int, rank string, path array<string>, kinds array<string>, c double, last string")
        own = edges.where(F.col(here).isin([n[-1] for _, n, _, _ in frontier]))
        j = own.join(F.broadcast(f), F.col(here) == F.col("last")).withColumn("cyclic", F.array_contains("path", F.col(there)))
        state = {r.i: (r.ext, r.cyc) for r in j.groupBy("i").agg(F.count_if(~F.col("cyclic")).alias("ext"), F.count_if("cyclic").alias("cyc")).collect()}
        if level == depth:
            cut |= any(e + c for e, c in state.values())
            done += [x for x in frontier if len(x[1]) > 1]
            break
        cycles |= any(c for _, c in state.values())
        done += [x for i, x in enumerate(frontier) if not state.get(i, (0, 0))[0] and len(x[1]) > 1]
        n = j.where("NOT cyclic").select(F.concat("rank", F.lit(mark), "kind", F.lit(mark), F.col(there)).alias("rank"), F.concat("path", F.array(F.col(there))).alias("nodes"), F.concat("kinds", F.array("kind")).alias("kinds"), F.least("c", "confidence").alias("c"))
        room = most + 1
        frontier = [(r.rank, list(r.nodes), list(r.kinds), r.c) for r in n.orderBy("rank").limit(room).collect()]
        ranked = sorted([(x[0], 0, x) for x in done] + [(x[0], 1, x) for x in frontier], key=lambda t: t[0])
        if len(ranked) > most:
            cut, ranked = True, ranked[:most]
        done, frontier = [x for _, k, x in ranked if k == 0], [x for _, k, x in ranked if k == 1]
        for x in frontier:
            seen.update(x[1])
    done.sort(key=lambda x: x[0])
    for x in done:
        seen.update(x[1])
    return [(n, k, c) for _, n, k, c in done[:most]], seen, cycles, cut


def trace(entities: DataFrame, edges: DataFrame, start: str, direction: str = "down", depth: int = DEPTH, floor: float = FLOOR, inferred: bool = True, most: int = MAX_PATHS) -> Trace:
    """Lineage of one entity, down, up or both (down first; the cap on paths is shared)."""
    spark = edges.sparkSession
    own = durable(lineage_edges(edges, floor, inferred))
    paths, seen, cycles, cut = [], {start}, False, False
    for upstream in {"down": (False,), "up": (True,), "both": (False, True)}[direction]:
        if len(paths) >= most:
            cut = True
            break
        p, s, c, t = _walk(own, start, upstream, depth, most - len(paths))
        paths, seen, cycles, cut = paths + p, seen | s, cycles | c, cut | t
    paths.sort(key=lambda p: "|".join(p[0]))
    at = sorted(seen)
    lineage = F.col("kind").isin(*LINEAGE_KINDS)
    touching = F.col("from_id").isin(at) if direction == "down" else F.col("from_id").isin(at) | F.col("to_id").isin(at)
    lost = edges.where(lineage & (F.col("status") == "UNRESOLVED") & touching).select("kind", "from_id", "to_id", F.lit("UNRESOLVED_TARGET").alias("reason"))
    several = own.where(F.col("ambiguous") & touching).select("kind", "from_id", "to_id", F.lit("AMBIGUOUS_IMPLEMENTATION").alias("reason"))
    ends = sorted({p[0][-1] for p in paths})
    consumer = entities.where(F.col("id").isin(ends) & (attr("role") == "dto-response")).select(F.lit("terminal").alias("kind"), F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("EXTERNAL_CONSUMER").alias("reason"))
    gaps = lost.unionByName(several)
    if direction != "up":
        gaps = gaps.unionByName(consumer)
    if not paths and entities.where(F.col("id") == start).isEmpty():
        gaps = spark.createDataFrame([("start", start, start, "UNKNOWN_START")], "kind string, from_id string, to_id string, reason string")
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(paths)], f"no int, {PATHS}")
    return Trace(df, gaps.distinct(), at, cycles, cut)


def dependents(edges: DataFrame, target: str, direct: DataFrame, depth: int = 5) -> DataFrame:
    """direct: id. Entities that reach the target or a direct dependent over resolved usage: id and hop. Seeds are not
    among them. Each level is written before the next, so the plan stays flat and a lost executor costs one level."""
    spark = edges.sparkSession
    usage = durable(edges.where(F.col("resolved") & F.col("kind").isin(*TOOL_USAGE)).select("from_id", "to_id").distinct())
    seeds = direct.select("id").unionByName(spark.createDataFrame([(target,)], "id string")).distinct().withColumn("hop", F.lit(0))
    seen = level = durable(seeds)
    for hop in range(1, depth + 1):
        nxt = usage.join(level.select(F.col("id").alias("_l")), F.col("to_id") == F.col("_l")).select(F.col("from_id").alias("id")).distinct()
        level = durable(nxt.join(seen.select(F.col("id").alias("_s")), F.col("id") == F.col("_s"), "left_anti").withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.where("hop > 0")


def expand(edges: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All simple paths of up to depth edges from many starts (id), those that no edge leads on to a new node, or that end
    at the depth: start, nodes, confidence, last. Distributed; for edges whose paths the caller knows to be bounded. Of
    parallel edges the surest is followed. Each level is written before the next."""
    e = durable(edges.groupBy("from_id", F.col("to_id").alias("to")).agg(F.max("confidence").alias("ec")))
    level = starts.select(F.col("id").alias("start"), F.array("id").alias("nodes"), F.lit(1.0).alias("confidence"), F.col("id").alias("last")).distinct()
    out = None
    for hop in range(1, depth + 1):
        j = level.join(e, (F.col("last") == F.col("from_id")) & ~F.array_contains("nodes", F.col("to")), "inner" if hop == 1 else "left")
        j = durable(j.select("start", "nodes", "confidence", "last", "to", "ec"))
        ended = j.where("to IS NULL").select("start", "nodes", "confidence", "last")
        out = ended if out is None else out.unionByName(ended)
        level = j.where("to IS NOT NULL").select("start", F.concat("nodes", F.array("to")).alias("nodes"), F.least("confidence", "ec").alias("confidence"), F.col("to").alias("last"))
        if level.isEmpty():
            break
    return out.unionByName(level)


def reachable(edges: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """start and id: what each start (id) reaches over up to depth edges, itself included. Pairs are joined level by level
    and met once, so the work is bounded by pairs, not by paths; each level is written before the next."""
    e = durable(edges.select("from_id", "to_id").distinct())
    seen = level = durable(starts.select(F.col("id").alias("start"), "id").distinct())
    for _ in range(depth):
        nxt = level.join(e, F.col("id") == F.col("from_id")).select("start", F.col("to_id").alias("id")).distinct()
        level = durable(nxt.join(seen.select(F.col("start").alias("_s"), F.col("id").alias("_i")), (F.col("start") == F.col("_s")) & (F.col("id") == F.col("_i")), "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def trace_all(edges: DataFrame, starts: DataFrame, depth: int = DEPTH, most: int = MAX_PATHS) -> DataFrame:
    """The paths that a trace down from each start (id) gives, `most` for a start: start, nodes, confidence, last."""
    return trace_ranked(edges, starts, depth, most).select("start", "nodes", "confidence", F.element_at("nodes", -1).alias("last"))


def trace_ranked(edges: DataFrame, starts: DataFrame, depth: int = DEPTH, most: int = MAX_PATHS) -> DataFrame:
    """The same with rank, which sorts a start's paths in depth-first order: start, rank, nodes, confidence. As in
    _walk, paths are in depth-first order and each level keeps the first `most`, which later ones cannot come before."""
    e = durable(edges.select("from_id", F.col("to_id").alias("to"), "kind", F.col("confidence").alias("ec")))
    mark = F.lit("\x01")
    level = durable(starts.select(F.col("id").alias("start"), F.lit("").alias("rank"), F.array("id").alias("nodes"), F.lit(1.0).alias("confidence"), F.lit(True).alias("open")).distinct())
    first = Window.partitionBy("start").orderBy("rank", "open")
    for _ in range(depth):
        j = level.where("open").withColumn("last", F.element_at("nodes", -1)).join(e, (F.col("last") == F.col("from_id")) & ~F.array_contains("nodes", F.col("to")), "left")
        on = F.col("to").isNotNull()
        new = j.select("start", F.when(on, F.concat("rank", mark, "kind", mark, "to")).otherwise(F.col("rank")).alias("rank"), F.when(on, F.concat("nodes", F.array("to"))).otherwise(F.col("nodes")).alias("nodes"), F.when(on, F.least("confidence", "ec")).otherwise(F.col("confidence")).alias("confidence"), on.alias("open"))
        both = new.where("open OR size(nodes) > 1").unionByName(level.where("NOT open"))
        level = durable(both.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= most).drop("_rn"))
        if level.where("open").isEmpty():
            break
    return level.select("start", "rank", "nodes", "confidence")


def best_path_per_start(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each start's paths: one that ends in a store, then the longest, the surest, the smallest end."""
    kinds = entities.select(F.col("id").alias("_e"), F.col("kind").isin("DATABASE_OBJECT", "DATA_SINK", "VARIABLE").alias("store"))
    p = paths.join(kinds, F.col("last") == F.col("_e"), "left").withColumn("store", F.coalesce("store", F.lit(False)))
    w = Window.partitionBy("start").orderBy(F.desc("store"), F.desc(F.size("nodes")), F.desc("confidence"), "last", F.array_join("nodes", "|"))
    return p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("start", F.array_join("nodes", "|").alias("path"), "confidence", "store")


def cycles(pairs: DataFrame) -> DataFrame:
    """(a, b) edges to strongly connected groups of two or more: member, group (least member), size. Reachability is
    doubled each round, so rounds grow with the logarithm of the longest path."""
    reach = durable(pairs.select("a", "b").distinct())
    before = reach.count()
    while True:
        two = reach.select("a", F.col("b").alias("_m")).join(reach.select(F.col("a").alias("_n"), "b"), F.col("_m") == F.col("_n")).select("a", "b")
        new = durable(reach.unionByName(two).distinct())
        release(reach)
        reach, now = new, new.count()
        if now == before:
            break
        before = now
    back = reach.select(F.col("a").alias("_b"), F.col("b").alias("_a"))
    both = reach.join(back, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("a", "b").where("a <> b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("scc"), (F.count(F.lit(1)) + 1).alias("size"))
    return least.select(F.col("a").alias("member"), "scc", "size")


def layers(pairs: DataFrame) -> DataFrame:
    """(a, b) edges of an acyclic graph: id and layer, the length of the longest path that ends there. Each round takes off
    the nodes that nothing left points to and raises what they point to, so there are as many rounds as layers and each
    edge is used once; a round that takes off nothing has met a cycle and raises."""
    e = durable(pairs.select("a", "b").distinct())
    left = durable(e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct())
    out, n = None, 0
    while not left.isEmpty():
        held = e.select(F.col("b").alias("_b")).distinct()
        free = durable(left.join(held, F.col("id") == F.col("_b"), "left_anti").withColumn("layer", F.lit(n)))
        if free.isEmpty():
            raise RuntimeError("layers need an acyclic graph")
        out = free if out is None else out.unionByName(free)
        gone = free.select(F.col("id").alias("_f"))
        rest, fewer = durable(left.join(gone, F.col("id") == F.col("_f"), "left_anti")), durable(e.join(gone, F.col("a") == F.col("_f"), "left_anti"))
        release(left)
        release(e)
        left, e, n = rest, fewer, n + 1
    return pairs.sparkSession.createDataFrame([], "id string, layer int") if out is None else out


def representative_paths(paths: DataFrame, entities: DataFrame, kinds=("DATABASE_OBJECT",)) -> DataFrame:
    """Of each start's paths the first, in the order of rank, that meets an entity of these kinds; else the first."""
    ends = entities.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("_e")).distinct()
    met = paths.select("start", "rank", F.explode("nodes").alias("n")).join(ends, F.col("n") == F.col("_e"), "left_semi").groupBy(F.col("start").alias("_s")).agg(F.min("rank").alias("_r"))
    pick = F.min(F.struct((~F.coalesce(F.col("rank") == F.col("_r"), F.lit(False))).alias("no"), "rank", "nodes", "confidence"))
    best = paths.join(met, F.col("start") == F.col("_s"), "left").groupBy("start").agg(pick.alias("b"))
    return best.select("start", "b.nodes", "b.confidence", (~F.col("b.no")).alias("reached"))


def layers_small(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Layers of a drawn graph (200 nodes at most), cycles allowed: an edge back to the path under way counts 0."""
    into: dict[str, set[str]] = {}
    for a, b in edges:
        into.setdefault(a, set())
        into.setdefault(b, set()).add(a)
    known: dict[str, int] = {}

    def depth(node: str, path: frozenset) -> int:
        if node in known:
            return known[node]
        if node in path:
            return 0
        known_now = max((1 + depth(p, path | {node}) for p in sorted(into[node])), default=0)
        known[node] = known_now
        return known_now

    for n in sorted(into):
        depth(n, frozenset())
    return known
