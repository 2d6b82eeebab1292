"""Onboarding answers, long chains and cycles."""

import pytest

from terravane import onboarding as ob
from terravane.operators import graph as gr


def test_layers_of_a_long_chain_and_of_a_cycle(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("n000", "n050"), ("a", "n070")], "a string, b string")
    got = {r.id: r.layer for r in gr.layers(chain).collect()}
    assert got == {**{f"n{i:03}": i for i in range(71)}, "a": 0}
    with pytest.raises(RuntimeError):
        gr.layers(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "a string, b string"))
    assert gr.layers(spark.createDataFrame([], "a string, b string")).count() == 0


def test_representative_path_is_the_first_that_meets_a_store(spark):
    edges = spark.createDataFrame([("s", "a", "CONSUMES"), ("s", "b", "INVOKES"), ("b", "t", "WRITES_TO"), ("b", "c", "INVOKES"), ("c", "t2", "READS_FROM"), ("lone", "x", "INVOKES")], "from_id string, to_id string, kind string").selectExpr("*", "0.9D AS confidence")
    ents = spark.createDataFrame([("t", "DATABASE_OBJECT"), ("t2", "DATABASE_OBJECT"), ("a", "CLASS")], "id string, kind string")
    paths = gr.trace_ranked(edges, spark.createDataFrame([("s",), ("lone",)], "id string"))
    got = {r.start: (r.nodes, r.reached) for r in gr.representative_paths(paths, ents).collect()}
    assert got == {"s": (["s", "b", "c", "t2"], True), "lone": (["lone", "x"], False)}


def test_summary_answers_ten_questions_and_survives_failed_stages():
    stages = {
        "intake": {"unavailable": "x"}, "health": {"state": "POOR", "unresolved": 3}, "inventory": [{"category": "tables", "n": 2, "examples": "t"}], "entry points": [{"id": "e", "sort": 3, "how": "endpoint"}, {"id": "p", "sort": 4, "how": "library procedure, inferred"}],
        "boundaries": [{"boundary": "NETWORK_BOUNDARY", "java_id": "j", "ada_id": "", "artifact": "Socket", "status": "UNRESOLVED"}, {"boundary": "SHARED_DATA_BOUNDARY", "java_id": "j", "ada_id": "a", "artifact": "store t", "status": "DISCOVERED"}],
        "central components": [{"id": "j", "language": "java", "qualified_name": "J", "score": 9}], "lineage": {"samples": [{"path": "e|m|x", "confidence": 0.9, "store": False}]}, "risks": [{"risk": "external dependency", "what": "Feed"}, {"risk": "limitation", "what": "no reflection"}], "architecture": {"layers": ["service (inferred)"]},
    }
    got = ob.final_summary(stages)
    answers = {a["question"]: a["answer"] for a in got["answers"]}
    assert len(answers) == 10 and answers["What is not resolved?"] == "3 references, 1 external dependencies" and answers["Which Ada components matter most?"] == "none found"
    f = got["facts"]
    assert f["confirmed"] == ["endpoint: e", "2 tables"] and f["unresolved"] == ["Feed", "e to x does not end in a store"] and f["limitations"] == ["no reflection"]
    assert f["inferred"] == ["service (inferred)", "NETWORK_BOUNDARY: j and unknown through Socket (UNRESOLVED)"] and f["resolved"] == ["SHARED_DATA_BOUNDARY: j and a through store t", "e to x (0.90)"]
    assert len(ob.final_summary({})["answers"]) == 10
