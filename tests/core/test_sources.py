import hypothesis.strategies as st
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from terravane.functions import text as tx
from terravane.sources import ada, build, config, ddl, java, scan

from .fixtures import TREE, write_tree

SEEDS = ["", "class Broken {", "package body Broken is", "SELECT * FROM", "<project><broken>", "\x00\xff\x00\x01\x02\x03", '<!DOCTYPE x [<!ENTITY a SYSTEM "file:///etc/passwd">]><x>&a;</x>']
NAMES = ["A.java", "a.ads", "a.adb", "a.sql", "a.xml", "a.yml", "a.properties", "pom.xml", "build.gradle", "x.gpr"]


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("name", NAMES)
def test_no_exception_escapes(name, seed):
    p = scan.parse(name, seed.encode("utf-8", "replace"), "h", "java")
    assert p.status in ("ANALYZED", "FAILED", "UNREADABLE", "SKIPPED")
    assert not p.facts or not any("passwd" in str(e) for e in p.facts.entities)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("class {}()<>;,.\"'\n@=+-*/ abX1:")), max_size=200))
def test_extractors_survive_anything(t):
    for m, n in ((java, "A.java"), (ada, "a.adb"), (ddl, "a.sql"), (config, "a.yml"), (build, "build.gradle"), (build, "x.gpr")):
        m.extract(n, t, "h")


def facts(path):
    f = scan.parse(path, TREE[path].encode(), "h", "java").facts
    return {e["id"]: e for e in f.entities}, f


def test_java_details():
    src = """package p;
public class A<T extends Comparable<T>> {
  int x = 1, y[] = {1, 2};
  /* } */ String s = "}" + '{' + \"\"\"
    text } block
  \"\"\";
  static { init(); }
  A(int a) { this.x = a; }
  int f(java.util.List<? extends T> l, String... r) throws Exception {
    for (int i = 0; i < 3 && l != null || x > 2; i++) { do { g(a -> a.h(1, 2), new B<C, D>(1)); } while (x > 0); }
    switch (x) { case 1: case 2, 3: return x > 1 ? 1 : 2; default: break; }
    try { this.svc.run().then(); Helper.go(); } catch (E e) { }
    new Thread() { public void run() { inner(); } }.start();
    return 0;
  }
  native int n();
  @interface Note { int v() default 1; }
}
"""
    f = java.extract("A.java", src, "h")
    assert not f.issues
    by = {e["id"]: e["attrs"] for e in f.entities}
    m = by["java:method:p.A#f(java.util.List<?extendsT>,String...)"]
    assert m["cyclomaticComplexity"] == str(1 + 1 + 2 + 1 + 1 + 2 + 1 + 1 + 1) and m["visibility"] == "package"
    assert by["java:method:p.A#n()"]["nativeMethod"] == "true" and "java:field:p.A#y" in by and "java:type:p.A.Note" in by
    calls = {(r["to_id"], r["attrs"]["argCount"], r["attrs"].get("receiverName")) for r in f.relationships if r["kind"] == "CALLS"}
    assert calls == {("g", "2", None), ("h", "2", "a"), ("run", "0", "svc"), ("then", "0", None), ("go", "0", "Helper"), ("inner", "0", None), ("start", "0", None)}
    assert {r["to_id"] for r in f.relationships if r["kind"] == "INSTANTIATES"} == {"B", "Thread"}


def test_endpoints_and_repository():
    by, f = facts("src/main/java/org/tidal/gauge/TideDesk.java")
    put = by["java:endpoint:PUT:/readings/{gauge}"]["attrs"]
    assert put["requestBodyType"] == "Sounding" and put["validated"] == "true" and "java:endpoint:GET:/readings" in by
    assert by["java:endpoint:GET:/readings"]["attrs"]["httpParams"] == "hours:query" and put["httpParams"] == "gauge:path"
    by, _ = facts("src/main/java/org/tidal/gauge/ReadingStore.java")
    assert by["java:type:org.tidal.gauge.ReadingStore"]["attrs"]["managedEntityType"] == "Reading"
    f = java.extract("E.java", 'class E { @GetMapping(PATH + "/x") Optional<List<Dto>> a() { } }', "h")
    e = next(e for e in f.entities if e["kind"] == "ENDPOINT")
    assert e["attrs"]["httpPathUnresolved"] == "true" and e["name"].startswith("GET {unresolved:") and e["attrs"]["returnTypeNormalized"] == "Dto"


def test_sql_in_java():
    by, _ = facts("src/main/java/org/tidal/gauge/Archive.java")
    a = {k.rsplit("#", 1)[-1]: e["attrs"] for k, e in by.items() if "#" in k}
    assert a["yearly()"]["sqlReads"] == "reading" and a["visited()"]["sqlWrites"] == "visit_log" and a["near(String)"]["sqlDynamic"] == "true" and a["prune()"]["sqlWrites"] == "old_tide"


def test_ddl_config_build():
    by, f = facts("db/schema.sql")
    assert by["sql:field:gauge.code"]["attrs"]["primaryKey"] == "true" and by["sql:field:reading.level"]["attrs"] == {"sqlType": "VARCHAR(8)", "primaryKey": "false", "notNull": "true", "externallyExposed": "true"}
    assert by["sql:table:gauge"]["attrs"]["declaredIn"] == "db/schema.sql:3"
    assert [(r["from_id"], r["to_id"]) for r in f.relationships if r["kind"] == "REFERENCES"] == [("sql:table:gauge", "reading"), ("sql:table:gauge", "buoy")]
    by, f = facts("src/main/resources/application.properties")
    assert by["config:src/main/resources/application.properties"]["attrs"] == {"format": "properties", "references": "1", "secretKeysMasked": "2"}
    y = config.extract("a.yml", "app:\n  mapper:\n    impl: 'com.acme.Mapper' # c\n  low: com.acme.mapper\n", "h")
    assert [(r["to_id"], r["attrs"]["configKey"]) for r in y.relationships if r["kind"] == "CONFIGURES"] == [("com.acme.Mapper", "app.mapper.impl")]
    x = config.extract("a.xml", '<beans><bean class="com.acme.Dao" password="com.acme.P"/><v>com.acme.Val</v></beans>', "h")
    assert [r["attrs"]["configKey"] for r in x.relationships if r["kind"] == "CONFIGURES"] == ["bean@class", "v"]
    assert config.extract("a.xml", SEEDS[-1], "h").issues
    by, f = facts("web/pom.xml")
    assert "build:module:org.tidal:tide-web" in by
    assert [(r["to_id"], r["attrs"]["scope"]) for r in f.relationships if r["kind"] == "DEPENDS_ON"] == [("org.tidal:tide-parent", "compile"), ("org.jdbi:jdbi3-core", "runtime")]
    by, f = facts("ada/irrigation.gpr")
    assert [(r["kind"], r["to_id"], r["loc"]["s_line"]) for r in f.relationships if not r["resolved"]] == [("DECLARES_MAIN", "watering", 3), ("DEPENDS_ON", "shared", 1)]
    g = build.extract("lib/build.gradle", "group = 'g'\nimplementation project(':core')\napi 'a:b:1' // x\ninclude ':x:y', 'z'\n", "h")
    assert g.entities[0]["qualified_name"] == "g:lib" and g.entities[0]["attrs"]["includes"] == "x/y,z" and {r["to_id"] for r in g.relationships if r["kind"] == "DEPENDS_ON"} == {"core", "a:b"}


def test_ada_details():
    src = """package P is
   type E is (A, B);
   type R is access Integer;
   Fault : exception;
   task type Worker;
   protected Gate;
   Limit : constant Integer := 3;
   function "+" (A, B : in out Integer := 1; C : access Float) return Boolean
     with Pre => A > 0, Post => True;
   package Inst is new Generic_Thing (Integer);
end P;
"""
    f = ada.extract("p.ads", src, "h")
    by = {e["id"]: e["attrs"] for e in f.entities}
    op = by['ada:function:P." "(Integer,Integer,access Float)'] if 'ada:function:P." "(Integer,Integer,access Float)' in by else next(v for k, v in by.items() if k.startswith("ada:function:"))
    assert op["sparkPrecondition"] == "A > 0" and op["returnType"] == "Boolean"
    assert by["ada:type:P.E"]["languageFeature"] == "enumeration" and by["ada:type:P.R"]["languageFeature"] == "access" and by["ada:variable:P.Limit"]["constant"] == "true"
    assert {"ada:exception:P.Fault", "ada:task:P.Worker", "ada:type:P.Gate", "ada:package:P.Inst"} <= by.keys()
    assert [r["to_id"] for r in f.relationships if r["kind"] == "INSTANTIATES"] == ["Generic_Thing"]


def test_scan_source(spark, tmp_path):
    write_tree(str(tmp_path))
    files = {r.path: r for r in scan.describe(scan.read_tree(spark, str(tmp_path))).collect()}
    assert ".hidden/_private.properties" in files and "target/Skipped.java" not in files
    assert files["pom.xml"].language == "xml" and files["ada/irrigation.gpr"].category == "BUILD" and files["data.bin"].category == "OTHER"
    with pytest.raises(scan.ScanError):
        scan.walk(str(tmp_path), scan.Limits(files=3))
    assert scan.index_location("/a/b").startswith("b-") and len(scan.index_location("/a/b")) == 10


def test_text_functions(spark):
    rows = [("java", "/* a\n\n b */ x\n// c\nint x;\n"), ("ada", "-- a\n  \t\nx"), ("sql", "/* one */\nselect 1\n"), ("text", "# a\n"), ("python", ""), ("java", "a\n\n")]
    got = spark.createDataFrame(rows, "l string, t string").select(tx.line_stats(F.col("t"), F.col("l")).alias("s")).collect()
    assert [(r.s.total, r.s.comment, r.s.blank) for r in got] == [tx.count_lines(t, l) for l, t in rows] == [(5, 3, 1), (3, 1, 1), (2, 1, 0), (1, 0, 0), (0, 0, 0), (2, 0, 1)]
    names = ["a/Makefile", "x.JAVA", ".env", "noext", "b.gpr", "q.f90", "d/Dockerfile"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(tx.language(F.col("p")), tx.category(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("make", "BUILD"), ("java", "SOURCE"), ("unknown", "OTHER"), ("unknown", "OTHER"), ("ada-project", "BUILD"), ("fortran", "SOURCE"), ("docker", "BUILD")]
    sql = ["INSERT INTO a.B SELECT * FROM c JOIN \"D\"", "update T set x = 1", "delete from old", "MERGE INTO t USING s", "with q as (select 1) select * from the x", "hello from a"]
    r, w = tx.sql_tables(F.col("s"))
    got = spark.createDataFrame([(s,) for s in sql], "s string").select(r, w).collect()
    assert [tuple(x) for x in got] == [(["c", "d"], ["b"]), ([], ["t"]), ([], ["old"]), (["s"], ["t"]), ([], []), ([], [])]
    got = spark.createDataFrame([("/a/", "/b//"), ("", ""), (None, "x")], "a string, b string").select(tx.compose_path(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in got] == ["/a/b", "/", "/x"]
    got = spark.createDataFrame([("ResponseEntity<Optional<Dto>>",), ("Map<A,B>",), ("List<Map<A,B>>",)], "t string").select(tx.unwrap_type(F.col("t"))).collect()
    assert [x[0] for x in got] == ["Dto", "Map<A,B>", "Map<A,B>"]
