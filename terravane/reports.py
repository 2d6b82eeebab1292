"""Report sinks: CSV, JSON, HTML, DOT, SVG and text. Reports are small by their limits and are written by the driver."""

from __future__ import annotations

import csv
import html
import io
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Api, records
from .model import CALL_KINDS, CALLABLES, GRAPH_USAGE
from .operators import analysis as an
from .operators.graph import layers_small
from .operators.views import MAX_NODES, architecture_nodes

#: Fill and border of a category.
PALETTE = {
    "default": ("#eef2f7", "#5b6b7f"), "high": ("#fde2e1", "#b3261e"), "medium": ("#fff3d6", "#8a6100"), "low": ("#e3f4e6", "#2e7d32"), "dead": ("#e6e6e6", "#6b6b6b"), "active": ("#e3f4e6", "#2e7d32"),
    "ENDPOINT": ("#dbeafe", "#1d4ed8"), "controller": ("#e0e7ff", "#4338ca"), "service": ("#ede9fe", "#6d28d9"), "repository": ("#fce7f3", "#be185d"), "TABLE": ("#fef3c7", "#b45309"), "STATE": ("#fef3c7", "#b45309"), "SOURCE": ("#cffafe", "#0e7490"), "SINK": ("#ffedd5", "#c2410c"),
}


def safe_cell(v) -> str:
    s = "" if v is None else str(v)
    return "'" + s if s[:1] in ("=", "+", "-", "@", "\t", "\r") else s


def to_csv(rows: list[dict], columns: list[str]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([safe_cell(r.get(c)) for c in columns] for r in rows)
    return out.getvalue()


def to_json(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, default=str) + "\n"


def table(rows: list[dict], columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def page(title: str, sections: list[tuple[str, str]]) -> str:
    """One file, no scripts, nothing loaded from elsewhere."""
    style = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .5em;text-align:left}"
    body = "".join(f"<h2>{html.escape(h)}</h2>{b}" for h, b in sections)
    return f"<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>\n"


DEAD, CX = ["id", "qualified_name", "kind", "confidence"], ["id", "qualified_name", "complexity", "band"]


def report_data(api: Api) -> dict:
    dead = records(api.dead().orderBy(F.desc("confidence"), "qualified_name"))
    cx = records(an.complexity_hotspots(api.entities).orderBy(F.desc("complexity"), "id"))
    coupling = records(an.package_coupling(api.entities, api.relationships).orderBy(F.desc(F.col("dependencies") + F.col("dependents")), "package"))
    return {"scanId": api.scan_id, "summary": api.get_repository_summary().value, "deadCode": dead, "complexity": cx, "coupling": coupling, "references": api.get_reference_counts().value}


def bundle(api: Api, folder: str) -> list[str]:
    """report.html, report.json, dead-code.csv and complexity.csv."""
    d = report_data(api)
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    summary = [{"measure": k, "value": v} for k, v in sorted(d["summary"].items()) if not isinstance(v, (dict, list))]
    files = {
        "report.html": page("Estate report", [("Summary", table(summary, ["measure", "value"])), ("Probably unused", table(d["deadCode"], DEAD)), ("Complexity", table(d["complexity"], CX)), ("Coupling", table(d["coupling"], ["package", "dependencies", "dependents", "risk"]))]),
        "report.json": to_json(d), "dead-code.csv": to_csv(d["deadCode"], DEAD), "complexity.csv": to_csv(d["complexity"], CX),
    }
    for name, text in files.items():
        (at / name).write_text(text, encoding="utf-8")
    return sorted(files)


def lineage_json(api: Api, result) -> str:
    v = result.value
    return to_json({"scanId": api.scan_id, "query": {"start": v["start"], "direction": v["direction"]}, "nodes": v["nodes"], "paths": v["paths"], "unresolvedGaps": v["gaps"], "cyclesDetected": v["cycles"], "truncated": result.truncated})


# -- graphs


def graph(api: Api, kind: str) -> dict:
    """nodes (id, label, category, layer), edges and a note; the MAX_NODES smallest ids are drawn."""
    e, r = api.entities, api.relationships.where("resolved")
    label = F.when(F.col("kind").isin("ENDPOINT", "DATABASE_OBJECT"), F.col("name")).otherwise(F.col("qualified_name"))
    if kind == "dependency":
        c = an.package_coupling(e, api.relationships)
        nodes = c.select(F.col("package").alias("id"), F.col("package").alias("label"), F.lower("risk").alias("category"))
        edges = an.package_edges(e, api.relationships).select(F.col("from_package").alias("a"), F.col("to_package").alias("b"))
    elif kind == "architecture":
        nodes = architecture_nodes(e)
        edges = r.where(F.col("kind").isin(*GRAPH_USAGE)).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    elif kind == "call":
        nodes = e.where(F.col("kind").isin(*CALLABLES)).select("id", label.alias("label"), F.lit("default").alias("category"))
        edges = r.where(F.col("kind").isin(*CALL_KINDS)).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
        ends = edges.join(nodes.select(F.col("id").alias("_x")), F.col("a") == F.col("_x"), "left_semi").join(nodes.select(F.col("id").alias("_y")), F.col("b") == F.col("_y"), "left_semi")
        ids = ends.select(F.col("a").alias("_i")).unionByName(ends.select(F.col("b").alias("_i"))).distinct()
        nodes = nodes.join(ids, F.col("id") == F.col("_i"), "left_semi")
    else:
        dead = api.dead().select(F.col("id").alias("_d"))
        shown = e.where(F.col("kind").isin("CLASS", "INTERFACE", "ENUM", "RECORD", "METHOD", "FUNCTION", "PROCEDURE"))
        nodes = shown.join(dead, F.col("id") == F.col("_d"), "left").select("id", label.alias("label"), F.when(F.col("_d").isNull(), "active").otherwise("dead").alias("category"))
        edges = r.where(F.col("kind").isin(*GRAPH_USAGE)).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    total = nodes.count()
    kept = [x.asDict() for x in nodes.orderBy("id").limit(MAX_NODES).collect()]
    ids = [n["id"] for n in kept]
    pairs = sorted((x.a, x.b) for x in edges.where(F.col("a").isin(ids) & F.col("b").isin(ids)).distinct().collect())
    if kind != "architecture":
        layer = layers_small(pairs)
        for n in kept:
            n["layer"] = layer.get(n["id"], 0)
    note = f"drawn {MAX_NODES} of {total} nodes" if total > MAX_NODES else ""
    return {"title": f"{kind} graph", "nodes": kept, "edges": pairs, "truncated": total > MAX_NODES, "note": note}


def dot(g: dict) -> str:
    q = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"digraph {q(g['title'])} {{", "  rankdir=LR;", "  node [shape=box, style=filled];"]
    for n in g["nodes"]:
        fill, border = PALETTE.get(n["category"], PALETTE["default"])
        lines.append(f"  {q(n['id'])} [label={q(n['label'])}, fillcolor={q(fill)}, color={q(border)}];")
    lines += [f"  {q(a)} -> {q(b)};" for a, b in g["edges"]]
    return "\n".join([*lines, "}"]) + "\n"


def svg(g: dict) -> str:
    """Boxes in columns by layer, straight edges."""
    columns: dict[int, list[dict]] = {}
    for n in g["nodes"]:
        columns.setdefault(n["layer"], []).append(n)
    w, h, gap_x, gap_y = 200, 28, 70, 14
    at = {n["id"]: (20 + i * (w + gap_x), 20 + j * (h + gap_y)) for i, l in enumerate(sorted(columns)) for j, n in enumerate(columns[l])}
    width = 40 + len(columns) * (w + gap_x)
    height = 40 + max((len(c) for c in columns.values()), default=0) * (h + gap_y)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">']
    parts += [f'<line x1="{at[a][0] + w}" y1="{at[a][1] + h // 2}" x2="{at[b][0]}" y2="{at[b][1] + h // 2}" stroke="#999"/>' for a, b in g["edges"]]
    for n in g["nodes"]:
        (x, y), (fill, border) = at[n["id"]], PALETTE.get(n["category"], PALETTE["default"])
        parts.append(f'<rect x="{x}" y="{y}" width="{w}" height="{h}" fill="{fill}" stroke="{border}"/><text x="{x + 6}" y="{y + 18}">{html.escape(str(n["label"])[-32:])}</text>')
    return "".join(parts) + "</svg>\n"


def write_csv(df: DataFrame, path: str) -> None:
    """The distributed form of the CSV sink, for tables that are not small."""
    from .functions.text import csv_safe

    df.select(*(csv_safe(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns)).write.option("header", "true").csv(path)
