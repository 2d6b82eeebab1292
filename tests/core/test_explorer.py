"""The explorer: every page, escaping, and what it refuses."""

import threading
import urllib.request

import pytest

from terravane import explorer
from terravane.api import Api

HOST = "127.0.0.1:1"


@pytest.fixture(scope="module")
def api(spark):
    from terravane.model import ENTITIES, RELATIONSHIPS

    loc = ("a<b>.java", 1, 2, 0, 0)
    e = [("java:type:A", "CLASS", "A", "p.A", "java", loc, {"visibility": "public"}), ("java:method:A#x()", "METHOD", "<b>x", "p.A#x()", "java", loc, {"cyclomaticComplexity": "30"}), ("sql:table:t", "DATABASE_OBJECT", "t", "t", "sql", None, {})]
    r = [(0, "java:type:A", "java:method:A#x()", "CONTAINS", True, "DISCOVERED", None, {}), (0, "java:method:A#x()", "sql:table:t", "READS_FROM", True, "RESOLVED", None, {"confidence": "0.90"}), (0, "java:type:A", "Gone", "CALLS", False, "UNRESOLVED", None, {})]
    files = spark.createDataFrame([("a.java", "h", "java", 1, "ANALYZED", 2, 0, 0)], "path string, hash string, language string, size long, status string, total int, comment int, blank int")
    return Api(spark, spark.createDataFrame(e, ENTITIES), spark.createDataFrame(r, RELATIONSHIPS), files, spark.createDataFrame([], "code string, message string"), "s")


def test_pages(api):
    for target, part in (("/", "Languages"), ("/search?q=x", "&lt;b&gt;x"), ("/entity?id=java%3Atype%3AA", "p.A"), ("/lineage?id=java%3Amethod%3AA%23x()", "sql:table:t"), ("/lineage?id=sql%3Atable%3At&dir=upstream", "Lineage up"), ("/dead-code", "Probably"), ("/complexity", "30"), ("/unresolved", "Gone"), ("/graph?type=call", "<svg")):
        a = explorer.respond(api, "GET", target, HOST)
        assert a.status == 200 and part in a.body and "<b>x" not in a.body and "<script" not in a.body, target


def test_refusals(api):
    assert explorer.respond(api, "POST", "/", HOST).status == 405
    for host in (None, "", "example.org", "127.0.0.1.example.org", "localhost:x", "a@localhost", "localhost/x"):
        assert explorer.respond(api, "GET", "/", host).status == 400, host
    for target in ("/none", "/entity?id=none", "/lineage", "/graph?type=none", "/../x"):
        assert explorer.respond(api, "GET", target, HOST).status == 404, target
    a = explorer.respond(api, "GET", "/theme?set=dark&next=//example.org", HOST)
    assert (a.status, a.headers["Location"]) == (302, "/") and a.headers["Set-Cookie"].startswith("theme=dark;")
    assert "theme=auto" in explorer.respond(api, "GET", "/theme?set=%0d%0ax&next=/search", HOST).headers["Set-Cookie"]
    assert explorer.THEMES["dark"] in explorer.respond(api, "GET", "/unresolved", HOST, "theme=dark").body


def test_server_on_loopback(api):
    server = explorer.serve(api, 0)
    t = threading.Thread(target=server.serve_forever)
    t.start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/unresolved", timeout=120) as got:
            assert got.status == 200 and "default-src 'none'" in got.headers["Content-Security-Policy"] and b"Gone" in got.read()
    finally:
        server.shutdown()
        server.server_close()
        t.join()
