"""A read-only explorer of an index for a browser on the same machine: pages over the query API, no scripts, nothing
loaded from elsewhere. Names come from scanned sources and are escaped wherever they are shown."""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass, field
from http.cookies import CookieError, SimpleCookie
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, quote, urlsplit

from . import reports
from .api import Api

THEMES = {"auto": "", "light": "body{background:#fff;color:#111}", "dark": "body{background:#161a20;color:#e6e6e6}a{color:#8ab4f8}"}
GRAPHS = ("architecture", "dependency", "call", "dead-code")
HEADERS = {
    "Content-Security-Policy": "default-src 'none'; style-src 'unsafe-inline'; img-src data:; form-action 'self'; base-uri 'none'; frame-ancestors 'none'",
    "X-Content-Type-Options": "nosniff", "Referrer-Policy": "no-referrer", "Cache-Control": "no-store",
}


@dataclass
class Answer:
    status: int
    body: str = ""
    type: str = "text/html; charset=utf-8"
    headers: dict[str, str] = field(default_factory=dict)


def local(host: str | None) -> bool:
    """Whether a Host header names this machine, so that another site's name for it cannot read the index."""
    try:
        parts = urlsplit("//" + (host or "").strip())
        return parts.hostname in ("localhost", "127.0.0.1", "::1") and (parts.port is None or parts.port > 0) and not parts.path and parts.username is None
    except ValueError:
        return False


def back(target: str | None) -> str:
    """A path of this server, else the first page."""
    t = target or "/"
    return t if t.startswith("/") and not t.startswith("//") and not set(t) & set("\\\r\n") else "/"


def link(id_: str) -> str:
    return f'<a href="/entity?id={quote(id_, safe="")}">{html.escape(id_)}</a>'


def rows(found: list[dict], columns: tuple[str, ...], ids: tuple[str, ...] = ("id",)) -> str:
    cell = lambda r, c: link(str(r[c])) if c in ids and r.get(c) else html.escape(str(r.get(c, "")))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r, c)}</td>" for c in columns) + "</tr>" for r in found) + "</table>"


def shown(result, columns, ids=("id",)) -> str:
    cut = f"<p>{len(result.value)} of {result.total} are shown.</p>" if result.truncated else ""
    return cut + rows(result.value, columns, ids) + (f"<p>{html.escape(result.note)}</p>" if result.note else "")


def start(api: Api, q: dict) -> list:
    s = api.get_repository_summary().value
    return [("Counts", rows([{"what": k, "n": v} for k, v in s.items() if isinstance(v, int | float)], ("what", "n"))), ("Languages", rows([{"language": k, "files": v} for k, v in s["languages"].items()], ("language", "files")))]


def search(api: Api, q: dict) -> list:
    return [(f"Entities with '{q.get('q', '')}'", shown(api.search_entities(q.get("q", ""), q.get("kind") or None, q.get("language") or None), ("id", "kind", "name", "location")))]


def entity(api: Api, q: dict) -> list | None:
    e = api.get_entity(q.get("id", "")).value
    if e is None:
        return None
    facts = rows([{"what": k, "value": v} for k, v in e.items()], ("what", "value"))
    ends = ("other_id", "other_kind", "edge_kind", "status")
    lists = [(h, shown(f(e["id"]), ends, ("other_id",))) for h, f in (("Used by", api.get_dependents), ("Uses", api.get_dependencies), ("Members", api.get_members))]
    return [("Entity", facts + f'<p><a href="/lineage?id={quote(e["id"], safe="")}">lineage</a></p>'), *lists]


def lineage(api: Api, q: dict) -> list | None:
    if not api.has(q.get("id", "")):
        return None
    way = {"upstream": "up", "up": "up", "both": "both"}.get(q.get("dir", ""), "down")
    t = api.trace_data_lineage(q["id"], way)
    paths = "".join(f"<li>{' &rarr; '.join(link(n) for n in p['nodes'])} ({p['confidence']:.2f})</li>" for p in t.value["paths"])
    gaps = rows(t.value["gaps"], tuple(t.value["gaps"][0])) if t.value["gaps"] else "<p>none</p>"
    return [(f"Lineage {way}", f"<ol>{paths}</ol>" + ("<p>There are more paths.</p>" if t.truncated else "")), ("Gaps", gaps)]


def graph(api: Api, q: dict) -> list | None:
    kind = q.get("type", "architecture")
    return [(f"Graph: {kind}", reports.svg(reports.graph(api, kind)))] if kind in GRAPHS else None


ROUTES: dict[str, Callable[[Api, dict], list | None]] = {
    "/": start, "/search": search, "/entity": entity, "/lineage": lineage, "/graph": graph,
    "/dead-code": lambda api, q: [("Probably unused", shown(api.find_dead_code_candidates(), tuple(reports.DEAD)))], "/complexity": lambda api, q: [("Complex", shown(api.get_complexity(), tuple(reports.CX)))],
    "/unresolved": lambda api, q: [("Unresolved", shown(api.get_unresolved_references(), ("from_id", "target", "kind", "location"), ("from_id",)))],
}


def respond(api: Api, method: str, target: str, host: str | None, cookie: str | None = None) -> Answer:
    """What the explorer says to a request. Only GET from this machine is answered; nothing is ever changed but the theme cookie."""
    plain = "text/plain; charset=utf-8"
    if not local(host):
        return Answer(400, "the Host header must name this machine\n", plain)
    if method != "GET":
        return Answer(405, "the explorer only reads; use GET\n", plain, {"Allow": "GET"})
    url = urlsplit(target)
    q = dict(parse_qsl(url.query, keep_blank_values=True))
    if url.path == "/theme":
        theme = q.get("set") if q.get("set") in THEMES else "auto"
        return Answer(302, "", plain, {"Set-Cookie": f"theme={theme}; Path=/; Max-Age=31536000; SameSite=Strict; HttpOnly", "Location": back(q.get("next"))})
    try:
        theme = SimpleCookie(cookie or "").get("theme")
    except CookieError:
        theme = None
    route = ROUTES.get(url.path)
    try:
        sections = route(api, q) if route else None
    except Exception as e:  # a page that fails leaves the server up
        return Answer(500, reports.page("Error", [("This page could not be made", f"<p>{html.escape(str(e).splitlines()[0] if str(e) else type(e).__name__)}</p>")]))
    if sections is None:
        return Answer(404, reports.page("Not found", [("Nothing here", f"<p>{html.escape(target)}</p>")]))
    nav = " ".join(f'<a href="{p}">{n}</a>' for p, n in (("/", "overview"), ("/dead-code", "dead code"), ("/complexity", "complexity"), ("/unresolved", "unresolved"), *((f"/graph?type={g}", f"{g} graph") for g in GRAPHS)))
    themes = " ".join(f'<a href="/theme?set={t}&amp;next={quote(target, safe="")}">{t}</a>' for t in THEMES)
    form = '<form action="/search"><input name="q" aria-label="search"><button>search</button></form>'
    body = reports.page("Explorer", [("Pages", f"<p>{nav}</p>{form}<p>theme: {themes}</p>"), *sections])
    return Answer(200, body.replace("</style>", THEMES.get(theme.value if theme else "auto", "") + "</style>", 1))


def serve(api: Api, port: int = 8765) -> ThreadingHTTPServer:
    """A server on the loopback address alone; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            a = respond(api, self.command, self.path, self.headers.get("Host"), self.headers.get("Cookie"))
            data = a.body.encode("utf-8", "replace")
            self.send_response(a.status)
            for k, v in {**HEADERS, "Content-Type": a.type, "Content-Length": str(len(data)), **a.headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data if self.command != "HEAD" else b"")

        do_GET = do_HEAD = do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
