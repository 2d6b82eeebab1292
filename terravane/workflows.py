"""Fixed workflows over the query API: orientation, lineage investigation, entity summaries and onboarding."""

from __future__ import annotations

import html
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import onboarding as ob
from .api import Api, records
from .model import DB_KINDS, LINEAGE_KINDS, attr, bool_attr, confidence, render
from .operators import analysis as an
from .operators import graph as gr
from .operators import neighbors as nb
from .reports import page, table, to_json
from .session import durable

INVENTORY = {
    "modules": ("MODULE",), "packages": ("PACKAGE",), "types": ("CLASS", "INTERFACE", "ENUM", "RECORD", "TYPE", "PROTECTED_TYPE"), "behaviours": ("METHOD", "CONSTRUCTOR", "FUNCTION", "PROCEDURE"), "tasks": ("TASK",), "fields": ("FIELD",), "state": ("VARIABLE",),
    "endpoints": ("ENDPOINT",), "tables": ("DATABASE_OBJECT",), "sources": ("DATA_SOURCE",), "sinks": ("DATA_SINK",), "configurations": ("CONFIGURATION",),
}


# -- lineage summary


def lineage_coverage(api: Api) -> dict:
    """Endpoints, those with a path to a store, repositories and mapped ones, edges by status; of the endpoints' traces
    (100 paths each at most) those that meet a store are complete, the others partial."""
    e, r = api.entities, api.relationships
    own = gr.lineage_edges(r)
    ends = e.where("kind = 'ENDPOINT'").select("id")
    stores = e.where("kind IN ('DATABASE_OBJECT', 'DATA_SINK')").select(F.col("id").alias("_s"))
    reached = gr.reachable(own, ends).join(stores, F.col("id") == F.col("_s"), "left_semi").select("start").distinct()
    paths = gr.trace_all(own, ends).select("start", F.monotonically_increasing_id().alias("no"), "nodes")
    total = paths.count()
    complete = paths.select("no", F.explode("nodes").alias("n")).join(stores, F.col("n") == F.col("_s"), "left_semi").select("no").distinct().count()
    status = {x["status"]: x["count"] for x in r.where(F.col("kind").isin(*LINEAGE_KINDS)).groupBy("status").count().collect()}
    repos = e.where(bool_attr("springDataRepository"))
    mapped = r.where("kind = 'PERSISTS_TO'").select("from_id").distinct()
    return {"endpoints": ends.count(), "endpointsWithStore": reached.count(), "repositories": repos.count(), "mapped": mapped.count(), "status": dict(sorted(status.items())), "completePaths": complete, "partialPaths": total - complete}


def endpoint_views(api: Api) -> DataFrame:
    """Each endpoint with its handler: the smallest qualified name it surely invokes."""
    h = api.relationships.where("kind = 'INVOKES' AND resolved").select("from_id", "to_id").join(api.entities.select(F.col("id").alias("_h"), F.col("qualified_name").alias("handler")), F.col("to_id") == F.col("_h"))
    h = h.groupBy(F.col("from_id").alias("_f")).agg(F.min("handler").alias("handler"))
    return api.entities.where("kind = 'ENDPOINT'").join(h, F.col("id") == F.col("_f"), "left").select("id", "name", "handler", attr("validated").alias("validated"), render(F.col("loc")).alias("location"))


def store_views(api: Api) -> DataFrame:
    """Each table with what maps to it (smallest id), readers, writers and whether anything is inferred."""
    t = api.entities.where("kind = 'DATABASE_OBJECT'").select("id", "name")
    r = api.relationships.where(F.col("kind").isin(*DB_KINDS) & (F.col("status") != "UNRESOLVED"))
    own = r.groupBy(F.col("to_id").alias("_t")).agg(F.min(F.when(F.col("kind") == "MAPS_TO", F.col("from_id"))).alias("mapped_from"), F.countDistinct(F.when(F.col("kind") == "READS_FROM", F.col("from_id"))).alias("readers"), F.countDistinct(F.when(F.col("kind") == "WRITES_TO", F.col("from_id"))).alias("writers"), F.bool_or(F.col("status") == "INFERRED").alias("inferred"))
    return t.join(own, F.col("id") == F.col("_t"), "left").drop("_t")


def source_traces(api: Api) -> DataFrame:
    """One trace for each (source, reader), no surer than 0.85."""
    s = api.entities.where("kind = 'DATA_SOURCE'").select(F.col("id").alias("_s"))
    return api.relationships.where("kind = 'READS_FROM'").join(s, F.col("to_id") == F.col("_s"), "left_semi").select(F.col("to_id").alias("source"), F.col("from_id").alias("reader"), F.least(F.lit(0.85), confidence()).alias("confidence"))


# -- orientation


def orient(api: Api) -> list[tuple[str, object]]:
    """Eight fixed questions and their answers, each from the tables; lists say how much they leave out."""

    def some(df, *order):
        r = api.limited(df, 20, *order)
        return {"first": r.value, "total": r.total, "truncated": r.truncated}

    s = api.get_repository_summary().value
    members = nb.fan(api.entities, api.relationships, False, ("CONTAINS",))
    modules = members.join(api.entities.where("kind IN ('MODULE', 'PACKAGE')").select("id"), "id", "left_semi").orderBy(F.desc("n"), "id").limit(10)
    central = nb.fan(api.entities, api.relationships, True).orderBy(F.desc("n"), "id").limit(5)
    return [
        ("What is in the repository?", {k: s[k] for k in ("files", "total_lines", "code_lines", "languages")}),
        ("Which modules are largest?", records(modules)),
        ("Where does it start?", some(entry_points(api), "sort", "id")),
        ("What does it store?", some(store_views(api), "id")),
        ("What depends on what?", records(an.package_coupling(api.entities, api.relationships).orderBy(F.desc(F.col("dependencies") + F.col("dependents")), "package").limit(10))),
        ("What is most central?", records(central)),
        ("What is complex?", api.get_complexity(10).value),
        ("What is not known?", api.get_reference_counts().value),
    ]


# -- lineage investigation


def best_origin(paths: list[dict], kinds: dict[str, str]) -> dict | None:
    """The longest path up that ends in an endpoint or a source; else the first."""
    good = [p for p in paths if kinds.get(p["nodes"][-1]) in ("ENDPOINT", "DATA_SOURCE")]
    return max(good, key=lambda p: len(p["nodes"])) if good else (paths[0] if paths else None)


def investigate(api: Api, id_: str) -> dict:
    """Where an entity's data comes from and goes: its overview, the best origin, transformers, stores and consumers, each with
    its place, the edges of the shown paths with their rules, and a confidence, the lowest of the paths shown (None without)."""
    up, down = api.trace_data_lineage(id_, "up"), api.trace_data_lineage(id_, "down")
    paths = up.value["paths"] + down.value["paths"]
    ids = sorted({*up.value["nodes"], *down.value["nodes"]})  # at most 100 paths of nine nodes each way
    info = {r.id: r for r in api.entities.where(F.col("id").isin(ids)).select("id", "kind", attr("transformation").alias("t"), render(F.col("loc")).alias("location")).collect()}
    kinds = {k: v.kind for k, v in info.items()}
    steps = {(a, b) for p in paths for a, b in zip(p["nodes"], p["nodes"][1:])} | {(b, a) for p in up.value["paths"] for a, b in zip(p["nodes"], p["nodes"][1:])}
    pairs = api.spark.createDataFrame(sorted(steps), "_f string, _t string")
    edges = api.relationships.where(F.col("kind").isin(*LINEAGE_KINDS)).join(F.broadcast(pairs), (F.col("from_id") == F.col("_f")) & (F.col("to_id") == F.col("_t")), "left_semi")
    evidence = records(edges.select("from_id", "to_id", "kind", "status", attr("ruleId").alias("rule"), confidence().alias("confidence"), render(F.col("loc")).alias("location")).distinct().orderBy("from_id", "to_id", "kind", "rule"))
    return {
        "overview": api.get_entity(id_).value, "origin": best_origin(up.value["paths"], kinds), "transformers": [x for x in ids if x in info and info[x].t == "true"],
        "storage": [x for x in ids if kinds.get(x) in ("DATABASE_OBJECT", "VARIABLE", "DATA_SINK")], "consumers": sorted({p["nodes"][-1] for p in down.value["paths"]}), "unresolved": up.value["gaps"] + down.value["gaps"], "truncated": up.truncated or down.truncated,
        "places": {x: info[x].location for x in ids if x in info}, "evidence": evidence, "confidence": min((p["confidence"] for p in paths), default=None),
    }


def summarize(api: Api, id_: str) -> dict:
    e = api.get_entity(id_).value
    if e is None:
        return {"id": id_, "known": False}
    dead = api.dead().where(F.col("id") == id_).select("confidence").collect()
    parts = {"entity": e, "callers": api.get_callers(id_, 10).value, "callees": api.get_callees(id_, 10).value, "dead": dead[0][0] if dead else None}
    if e["kind"] not in ("METHOD", "FUNCTION", "PROCEDURE", "CONSTRUCTOR"):
        inside = nb.neighbors(api.entities, api.relationships, id_, ("CONTAINS",), incoming=False)
        worst = an.max_member_complexity(api.entities, api.relationships.where(F.col("from_id") == id_)).first()
        parts |= {"members": api.get_members(id_, 20).value, "dependents": api.get_dependents(id_, 10).value, "dependencies": api.get_dependencies(id_, 10).value}
        parts |= {"memberKinds": {r.other_kind: r["count"] for r in inside.groupBy("other_kind").count().orderBy("other_kind").collect()}, "maxComplexity": worst.max_complexity if worst else None}
        parts |= {"stores": records(nb.database_references(api.entities, api.relationships, id_).orderBy("table_id", "kind").limit(20)), "unresolved": api.limited(nb.unresolved_references(api.relationships.where(F.col("from_id") == id_)), 10, "target", "kind").value}
    return parts


# -- onboarding


def entry_points(api: Api) -> DataFrame:
    """Build mains, Java mains, endpoints, Ada procedures nobody calls (inferred) and tasks."""
    e, r = api.entities, api.relationships
    mains = r.where("kind = 'DECLARES_MAIN' AND resolved").select(F.col("to_id").alias("id")).distinct().withColumns({"sort": F.lit(1), "how": F.lit("declared main")})
    java = e.where("kind = 'METHOD' AND name = 'main' AND language = 'java'").where(bool_attr("externallyExposed")).select("id", F.lit(2).alias("sort"), F.lit("main method").alias("how"))
    ends = e.where("kind = 'ENDPOINT'").select("id", F.lit(3).alias("sort"), F.lit("endpoint").alias("how"))
    used = r.where("resolved AND kind IN ('CALLS', 'INVOKES')").select(F.col("to_id").alias("_u")).distinct()
    top = e.where("kind = 'PROCEDURE' AND language = 'ada' AND NOT contains(qualified_name, '.')").select("id").join(used, F.col("id") == F.col("_u"), "left_anti").withColumns({"sort": F.lit(4), "how": F.lit("library procedure, inferred")})
    tasks = e.where("kind = 'TASK'").select("id", F.lit(5).alias("sort"), F.lit("task").alias("how"))
    all_ = mains.unionByName(java).unionByName(ends).unionByName(top).unionByName(tasks)
    return all_.groupBy("id").agg(F.min(F.struct("sort", "how")).alias("m")).select("id", "m.sort", "m.how")


def scan_health(api: Api) -> dict:
    """FAILED without analysed files; POOR below 60 % resolved or above 25 % failed; PARTIAL with any gap; else HEALTHY."""
    s = {r["status"]: r["count"] for r in api.files.groupBy("status").count().collect()}
    tried = s.get("ANALYZED", 0) + s.get("FAILED", 0)
    c = an.resolution_coverage(api.relationships).first()
    failed = s.get("FAILED", 0) + s.get("UNREADABLE", 0)
    state = "FAILED" if not s.get("ANALYZED") else "POOR" if c["rate"] < 60 or failed > 0.25 * max(tried, 1) else "PARTIAL" if failed or c["is_partial"] else "HEALTHY"
    return {"state": state, "files": dict(sorted(s.items())), "resolutionRate": c["rate"], "unresolved": nb.without_twins(api.relationships).count()}


def responsibility(kind: str, role: str | None, language: str) -> str:
    if kind == "ENDPOINT" or role == "controller":
        return "receives requests"
    if kind in ("DATABASE_OBJECT", "VARIABLE") or role == "repository":
        return "keeps data"
    if kind in ("DATA_SOURCE", "DATA_SINK"):
        return "exchanges data"
    if role in ("dto-request", "dto-response"):
        return "carries data"
    if role == "mapper-interface":
        return "transforms data"
    return {"service": "coordinates work", "validator": "checks data"}.get(role or "", "supports")


def lineage_samples(api: Api, borders: DataFrame | None = None, most: int = 5) -> list[dict]:
    """The best paths of the traces of entry points and data sources."""
    starts = entry_points(api).select("id").unionByName(api.entities.where("kind = 'DATA_SOURCE'").select("id")).distinct()
    return ob.sampled_paths(api, starts, api.spark.createDataFrame([], "id string") if borders is None else borders, most)


def risks(api: Api) -> list[dict]:
    out = [{"risk": "repository problem", "what": d["message"]} for d in api.get_diagnostics().value]
    lost = nb.without_twins(api.relationships).where("kind = 'INVOKES'").select(F.substring_index("to_id", "#", 1).alias("t")).distinct()
    lost = api.limited(lost, 0, "t")
    out += [{"risk": "external dependency", "what": f"{r['t']} is not in the repository"} for r in lost.value]
    if lost.truncated:
        out.append({"risk": "external dependency", "what": f"and {lost.total - len(lost.value)} more that are not in the repository"})
    out += [{"risk": "architectural", "what": f"{r.package} is coupled with many packages"} for r in an.package_coupling(api.entities, api.relationships).where("risk = 'HIGH'").orderBy("package").collect()]
    return [*out, {"risk": "limitation", "what": "reflection and run-time wiring are not seen"}]


@dataclass
class Onboarding:
    stages: dict[str, object] = field(default_factory=dict)
    partial: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return to_json({"status": "PARTIAL" if self.partial else "COMPLETE", "failedStages": self.partial, "stages": self.stages})

    def to_text(self) -> str:
        return "\n".join(f"== {k}\n{to_json(v)}" for k, v in self.stages.items())

    def to_html(self) -> str:
        return page("Onboarding", [(k, table(v, list(v[0])) if isinstance(v, list) and v and isinstance(v[0], dict) else f"<pre>{html.escape(to_json(v))}</pre>") for k, v in self.stages.items()])

    def write(self, folder: str, scanned: str) -> None:
        """Refuses to write inside the scanned tree."""
        at, root = Path(folder).resolve(), Path(scanned).resolve()
        if at == root or root in at.parents:
            raise ValueError("the output folder lies inside the scanned tree")
        at.mkdir(parents=True, exist_ok=True)
        for name, text in (("onboarding.json", self.to_json()), ("onboarding.txt", self.to_text()), ("onboarding.html", self.to_html())):
            (at / name).write_text(text, encoding="utf-8")


def onboard(api: Api) -> Onboarding:
    """Twelve stages in order; one that fails is named and the rest go on. What later stages ask of earlier ones is written
    once; a stage whose basis failed fails for itself."""
    out, held = Onboarding(), {}

    def once(name, make):
        if name not in held:
            held[name] = make()
        return held[name]

    entries = lambda: once("entries", lambda: durable(entry_points(api)))
    borders = lambda: once("borders", lambda: durable(ob.boundaries(api, entries().where("sort IN (1, 4) AND startswith(id, 'ada:')").select("id"))))
    border_ids = lambda: borders().select(F.col("java_id").alias("id")).unionByName(borders().select(F.col("ada_id").alias("id"))).where("id <> ''").distinct()
    border_rows = lambda: once("border rows", lambda: records(borders().orderBy("boundary", "java_id", "ada_id", "artifact")))

    samples = lambda: once("samples", lambda: lineage_samples(api, border_ids()))

    def central():
        nodes = sorted({n for p in samples() for n in p["path"].split("|")})
        flows = api.spark.createDataFrame([(n,) for n in nodes], "id string")
        return once("central", lambda: records(ob.central_components(api, entries().select("id"), border_ids(), flows).orderBy(F.desc("score"), "id").limit(10)))

    def architecture():
        found = api.entities.select("id", "kind", attr("role").alias("role"), "language").where("role IS NOT NULL OR kind IN ('ENDPOINT', 'DATABASE_OBJECT', 'DATA_SOURCE', 'DATA_SINK', 'VARIABLE')")
        rows = found.orderBy("id").limit(100).collect()
        return {"layers": ob.layers(api), "responsibilities": [{"id": r.id, "responsibility": responsibility(r.kind, r.role, r.language)} for r in rows], "total": found.count()}

    def order():
        rows = ob.reading_order(api, entries(), border_ids()).orderBy("stage", "key", "id")
        shown = api.limited(rows, 200, "stage", "key", "id")
        return {"places": [{"place": n, "stage": r["stage"], "id": r["id"]} for n, r in enumerate(shown.value, 1)], "total": shown.total, "truncated": shown.truncated}

    def questions():
        ends = [r.id for r in entries().where("sort = 3").orderBy("id").limit(1).collect()]
        return ob.expert_questions(api, border_rows(), central(), samples(), ends)

    stages = {
        "intake": lambda: {"buildSystems": sorted(r[0] for r in api.entities.where("kind = 'MODULE'").select(attr("buildSystem")).distinct().collect()), "summary": api.get_repository_summary().value},
        "health": lambda: scan_health(api), "inventory": lambda: records(an.inventory(api.entities, INVENTORY).orderBy("category")), "entry points": lambda: records(entries().orderBy("sort", "id")),
        "architecture": architecture, "boundaries": border_rows, "central components": central, "lineage": lambda: {"coverage": lineage_coverage(api), "samples": samples()},
        "reading order": order, "risks": lambda: risks(api), "expert questions": questions,
        "summary": lambda: {**ob.final_summary(out.stages), "references": api.get_reference_counts().value, "dead": api.dead().count()},
    }
    for name, stage in stages.items():
        try:
            out.stages[name] = stage()
        except Exception as e:  # one stage's fault leaves the others
            out.stages[name] = {"unavailable": str(e).splitlines()[0][:200]}
            out.partial.append(name)
    return out
