"""A tree from scan to snapshot, lineage, reports and workflows."""

import json
import os

import pytest

from terravane import reports, workflows
from terravane.api import OPERATIONS, Api
from terravane.plans.pipeline import scan
from terravane.sources.store import Store, StoreError

from .fixtures import JAVA, write_tree

P = "org.tidal.gauge."


@pytest.fixture(scope="module")
def estate(spark, tmp_path_factory):
    root, index = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("index")
    write_tree(str(root))
    store = Store(spark, f"file://{index}/s")
    m = scan(spark, str(root), store)
    return str(root), store, m, Api.open(spark, f"file://{index}/s")


def rules(m):
    rows = m.relationships.where("attrs['ruleId'] IS NOT NULL").collect()
    return {(r.kind, r.from_id.removeprefix("java:").replace(P, ""), r.to_id.removeprefix("java:").replace(P, "")): (r.status, r.attrs.get("confidence"), r.resolved) for r in rows}


def test_lineage_rules(estate):
    got = rules(estate[2])
    enter = "method:TideLedger#enter(Sounding)"
    assert got["MAPS_TO", "type:Reading", "sql:table:reading"] == ("RESOLVED", "1.00", True)
    assert got["MAPS_TO", "type:GaugeVisit", "sql:table:gaugevisit"] == ("INFERRED", "0.60", False)
    assert got["WRITES_TO", enter, "sql:table:reading"] == ("RESOLVED", "0.90", True)
    assert got["READS_FROM", "method:TideLedger#since(int)", "sql:table:reading"] == ("RESOLVED", "0.90", True)
    assert got["INVOKES", enter, "method:Chart#isLow(String,int)"] == ("RESOLVED", "0.95", True)
    assert got["INVOKES", enter, "method:TideLedger#fromSounding(Sounding)"] == ("RESOLVED", "0.95", True)
    assert got["INVOKES", enter, "PressureFeed#stormAhead"] == ("UNRESOLVED", "0.40", False)
    for impl in ("Siren", "Pager"):
        assert got["INVOKES", enter, f"method:{impl}#raise(Sounding)"] == ("INFERRED", "0.50", True)
    assert got["PRODUCES", "method:TideLedger#fromSounding(Sounding)", "type:Reading"] == ("RESOLVED", "0.90", True)
    assert got["VALIDATED_BY", "type:Sounding", "method:TideLedger#validateDepth(Sounding)"] == ("RESOLVED", "0.90", True)
    assert got["READS_FROM", "method:Archive#yearly()", "sql:table:reading"] == ("RESOLVED", "0.95", True)
    assert got["READS_FROM", "method:Archive#near(String)", "sql:table:reading"] == ("INFERRED", "0.60", False)
    assert got["WRITES_TO", "method:Archive#prune()", "sql:table:old_tide"] == ("RESOLVED", "0.95", True)
    turn = "ada:procedure:Valves.Turn(Opening)"
    assert got["WRITES_TO", turn, "ada:variable:Valves.Present"] == ("RESOLVED", "0.85", True)
    assert got["WRITES_TO", "ada:procedure:Watering", "ada:variable:Valves.Pressure"] == ("RESOLVED", "0.90", True)
    assert got["WRITES_TO", turn, "ada:sink:console_output"] == ("RESOLVED", "0.85", True)
    assert got["INVOKES", turn, "Pump_Link.Halt"] == ("UNRESOLVED", "0.40", False)
    assert got["INVOKES", "ada:procedure:Watering", turn] == ("RESOLVED", "0.95", True)
    assert got["PRODUCES", "ada:function:Valves.To_Opening(Sensors.Moisture)", "ada:type:Valves.Opening"] == ("RESOLVED", "0.85", True)
    assert got["REFERENCES", "sql:table:gauge", "sql:table:reading"][2] and not got["REFERENCES", "sql:table:gauge", "buoy"][2]


def test_entities(estate):
    e = {r.id: r for r in estate[2].entities.collect()}
    assert e["sql:table:reading"].attrs["declaredIn"] == "db/schema.sql:2" and e["sql:table:gaugevisit"].loc is None and "sql:table:buoy" not in e
    up = e["ada:procedure:Valves.Turn(Opening)"]
    assert up.attrs["hasSpec"] == up.attrs["hasBody"] == "true" and up.loc.file == "ada/valves.ads"
    assert e[f"java:type:{P}Receipt"].attrs["role"] == "dto-response" and e["file:data.bin"].attrs["parseStatus"] == "UNREADABLE"


def test_api(estate):
    api = estate[3]
    t = api.trace_data_lineage("java:endpoint:PUT:/readings/{gauge}").value
    assert any(p["nodes"][-1] == "sql:table:reading" for p in t["paths"]) and {"UNRESOLVED_TARGET", "AMBIGUOUS_IMPLEMENTATION", "EXTERNAL_CONSUMER"} <= {g["reason"] for g in t["gaps"]}
    up = api.trace_data_lineage("sql:table:reading", "up").value
    assert any("java:endpoint:PUT:/readings/{gauge}" in p["nodes"] for p in up["paths"])
    assert api.find_entity("PUT /readings/{gauge}").value["id"] == "java:endpoint:PUT:/readings/{gauge}"
    assert api.find_entity("TideLedger").total >= 1 and api.get_entity("x").value is None
    assert "springTide" in str(api.find_dead_code_candidates().value)
    impact = api.calculate_change_impact(f"java:method:{P}TideLedger#enter(Sounding)").value
    assert impact["direct"] and any(r["from_id"].endswith("Archive#yearly()") for r in impact["database"])
    owner = api.get_build_membership("file:web/src/Boot.java").value
    assert [o["from_id"] for o in owner] == ["build:module:org.tidal:tide-web"]
    assert api.get_configuration_references().value[0]["to_id"] == f"java:type:{P}Chart"
    assert api.get_repository_summary().value["tables"] == ["gauge", "gaugevisit", "old_tide", "reading", "visit_log"]
    assert len(OPERATIONS) == 21 and all(callable(getattr(api, o)) for o in OPERATIONS)
    assert api.get_callers("nope").note and json.loads(api.get_data_sinks().to_json())["totalMatches"] == 1


def test_reports_and_workflows(estate, tmp_path):
    root, _, _, api = estate
    assert reports.bundle(api, str(tmp_path)) == ["complexity.csv", "dead-code.csv", "report.html", "report.json"]
    assert "<script" not in (tmp_path / "report.html").read_text()
    g = reports.graph(api, "architecture")
    assert reports.dot(g) == reports.dot(reports.graph(api, "architecture")) and reports.svg(g).startswith("<svg")
    for kind in ("dependency", "call", "dead-code"):
        assert reports.graph(api, kind)["nodes"]
    assert reports.to_csv([{"a": "=1"}, {"a": "x"}], ["a"]) == "a\n'=1\nx\n"
    assert len(workflows.orient(api)) == 8 and workflows.investigate(api, "sql:table:reading")["origin"]
    o = workflows.onboard(api)
    assert len(o.stages) == 12 and not o.partial, o.partial
    with pytest.raises(ValueError):
        o.write(os.path.join(root, "out"), root)
    o.write(str(tmp_path / "o"), root)
    assert workflows.summarize(api, f"java:type:{P}TideLedger")["members"]


def test_rescan_reuses_and_failure_keeps_the_snapshot(spark, estate, monkeypatch):
    root, store, m, _ = estate
    before = sorted(map(str, m.relationships.select("from_id", "to_id", "kind", "status").collect()))
    with open(os.path.join(root, JAVA, "Sounding.java"), "a") as f:
        f.write("// more\n")
    again = scan(spark, root, store)
    assert sorted(map(str, again.relationships.select("from_id", "to_id", "kind", "status").collect())) == before and again.scan_id != m.scan_id
    assert [s["status"] for s in store.history()] == ["COMPLETED", "COMPLETED"] and store.latest()["scan_id"] == again.scan_id
    monkeypatch.setattr("terravane.plans.pipeline.build_model", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        scan(spark, root, store)
    assert store.history()[0]["status"] == "FAILED" and store.current()["scan_id"] == again.scan_id
    with pytest.raises(StoreError):
        Store(spark, store.path + "-none", read_only=True)


def test_stream_of_listings(spark, tmp_path):
    from terravane.streaming.changes import follow

    schema = "path string, hash string, seen long"
    for n, rows in enumerate(([("a", "1", 1), ("b", "1", 1)], [("a", "2", 2), ("c", "1", 2), ("b", "1", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert q.awaitTermination(60)
    got = {(r.batch, r.path, r.change) for r in spark.read.parquet(str(tmp_path / "out/changes")).collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "changed"), (1, "c", "added")}
