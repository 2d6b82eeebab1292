"""terravane scan|lineage|tool|orient|summarize|investigate|graph|onboard|serve."""

from __future__ import annotations

import argparse
import inspect
import sys

from .session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="terravane")
    p.add_argument("command", choices=("scan", "lineage", "tool", "orient", "summarize", "investigate", "graph", "onboard", "serve"))
    p.add_argument("args", nargs="*", help="scan ROOT; lineage START; tool OPERATION [ARGUMENT]; summarize|investigate ID; graph dependency|call|dead-code|architecture")
    p.add_argument("--index", required=True, help="folder of the store")
    p.add_argument("--out", help="folder for reports")
    p.add_argument("--direction", choices=("down", "up", "both"), default="down")
    p.add_argument("--inferred", action="store_true")
    p.add_argument("--format", choices=("json", "dot", "svg"), default="json")
    p.add_argument("--hardened", action="store_true")
    p.add_argument("--port", type=int, default=8765, help="of serve, on 127.0.0.1")
    a = p.parse_args(argv)
    from . import reports, workflows
    from .api import OPERATIONS, Api
    from .plans.pipeline import scan
    from .sources.store import Store, StoreError

    spark = local_session()
    if a.command == "scan":
        m = scan(spark, a.args[0], Store(spark, a.index), a.hardened)
        print(f"{m.scan_id} {m.stats}")
        if a.out:
            print(*reports.bundle(Api.open(spark, a.index), a.out))
        return 0
    try:
        api = Api.open(spark, a.index)
    except StoreError as e:
        print(e, file=sys.stderr)
        return 4
    if a.command == "lineage":
        found = api.find_entity(a.args[0])
        if found.value is None:
            print(found.note, file=sys.stderr)
            return 3
        print(reports.lineage_json(api, api.trace_data_lineage(found.value["id"], a.direction, inferred=a.inferred)))
    elif a.command == "tool":
        if a.args[0] not in OPERATIONS:
            print(f"unknown operation; one of {', '.join(OPERATIONS)}", file=sys.stderr)
            return 2
        f = getattr(api, a.args[0])
        print(f(*a.args[1 : 1 + len(inspect.signature(f).parameters)]).to_json())
    elif a.command == "graph":
        g = reports.graph(api, a.args[0] if a.args else "dependency")
        print({"json": reports.to_json, "dot": reports.dot, "svg": reports.svg}[a.format](g))
    elif a.command == "serve":
        from .explorer import serve

        with serve(api, a.port) as server:
            print(f"http://127.0.0.1:{server.server_address[1]}/", flush=True)
            try:
                server.serve_forever()
            except KeyboardInterrupt:
                pass
    elif a.command == "onboard":
        o = workflows.onboard(api)
        if a.out:
            o.write(a.out, (Store(spark, a.index, read_only=True).current() or {}).get("root", "/nonexistent"))
        print(o.to_text())
    else:
        value = workflows.orient(api) if a.command == "orient" else getattr(workflows, a.command)(api, a.args[0])
        print(reports.to_json(value))
    return 0


if __name__ == "__main__":
    sys.exit(main())
