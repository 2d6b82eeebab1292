"""Registered queries over source trees: each row of a business table becomes the files of one small program, whose text
carries the row's values; the extractors and the lineage rules read them as they read a scanned tree. The SQL says from
the same values what they must find."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import attr
from .plans import estate as es
from .queries import query
from .session import durable
from .sources.scan import extract

#: Names that templates use in double angle marks, by table: expressions that Spark and DuckDB read alike.
FIELDS = {
    "customer": {
        "k": "c_custkey", "n": "c_nationkey", "seg": "lower(c_mktsegment)",
        "vis": "CASE c_custkey % 3 WHEN 0 THEN 'public ' WHEN 1 THEN 'private ' ELSE '' END", "seen": "CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'package' END",
        "out": "CASE c_custkey % 3 WHEN 0 THEN 'true' ELSE 'false' END", "ifs": "repeat('if (id > 0 && ask != null) { probe(id, ask); } ', CAST(c_custkey % 4 AS INT))", "cc": "1 + 2 * (c_custkey % 4)",
        "plus": "CASE c_custkey % 2 WHEN 0 THEN ' + tail' ELSE '' END", "dyn": "CASE c_custkey % 2 WHEN 0 THEN 'sqlDynamic=true|' ELSE '' END",
    },
    "supplier": {
        "k": "s_suppkey", "n": "s_nationkey", "whens": "repeat('if By > 1 and then Twice then Level := Level + By; end if; ', CAST(1 + s_suppkey % 3 AS INT))", "cc": "1 + 2 * (1 + s_suppkey % 3)",
        "null": "CASE s_suppkey % 2 WHEN 0 THEN ' NOT NULL' ELSE '' END", "must": "CASE s_suppkey % 2 WHEN 0 THEN 'true' ELSE 'false' END", "secret": "CASE s_suppkey % 2 WHEN 0 THEN 'password' ELSE 'handler' END",
        "scope": "CASE s_suppkey % 2 WHEN 0 THEN '<scope>test</scope>' ELSE '' END", "scoped": "CASE s_suppkey % 2 WHEN 0 THEN 'test' ELSE 'compile' END",
    },
}


def _pieces(template: str) -> list[str]:
    """Text and names by turns. A name stands in double angle marks."""
    return re.split("<<([a-z]+)>>", template)


def column(table: str, template: str):
    return F.concat(*(F.expr(FIELDS[table][p]).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(_pieces(template))))


def sql(table: str, template: str) -> str:
    one = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(f"CAST({FIELDS[table][p]} AS VARCHAR)" if i % 2 else one(p) for i, p in enumerate(_pieces(template)) if i % 2 or p) or "''"


def tree(spark, d: str, table: str, files: list[tuple[str, str]]) -> DataFrame:
    """path, size and content of every row's files. Rows are dealt out first: the files are hundreds of times as large as the
    table's own, which is read in as few tasks as its bytes make."""
    rows = F.array(*(F.struct(column(table, p).alias("path"), F.encode(column(table, c), "utf-8").alias("content")) for p, c in files))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return es.table(spark, d, table).repartition(width).select(F.explode(rows).alias("f")).select("f.path", F.octet_length("f.content").cast("long").alias("size"), "f.content")


def _bag(attrs):
    kept = F.map_filter(attrs, lambda k, v: ~k.isin("analyzerId", "ruleVersion"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def facts(parsed: DataFrame) -> DataFrame:
    """Every entity (but FILE, whose hash content_hash checks) and every edge: id, kind, fact, with all attributes. One pass:
    two branches over parsed would parse every file twice."""
    e = F.transform(F.filter("entities", lambda x: x["kind"] != "FILE"), lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), F.concat(F.lit("is "), x["name"]).alias("what"), x["loc"]["s_line"].alias("line"), F.lit("").alias("status"), x["attrs"].alias("attrs")))
    r = F.transform("relationships", lambda x: F.struct(x["from_id"].alias("id"), x["kind"].alias("kind"), F.concat(F.lit("to "), x["to_id"]).alias("what"), x["loc"]["s_line"].alias("line"), F.concat(x["status"], F.lit("|")).alias("status"), x["attrs"].alias("attrs")))
    both = parsed.select(F.explode(F.concat(e, r)).alias("f")).select("f.*")
    return both.select("id", "kind", F.concat("what", F.lit("@"), F.coalesce(F.col("line").cast("string"), F.lit("-")), F.lit("|"), "status", _bag(F.col("attrs"))).alias("fact"))


def expected(table: str, rows: list[tuple[str, ...]]) -> str:
    """The SQL of facts: (id, kind, fact) templates, with a condition where a fact does not hold for every row."""
    return " UNION ALL ".join(f"SELECT {sql(table, r[0])} AS id, '{r[1]}' AS kind, {sql(table, r[2])} AS fact FROM {table}" + (f" WHERE {r[3]}" if len(r) > 3 else "") for r in rows)


JAVA = [("src/n<<n>>/C<<k>>.java", """package estate.n<<n>>;
import java.util.List;
@Service
public class C<<k>> extends Base implements Port {
  private Store<<n>> store;
  <<vis>>List<Reply> load(int id, Ask ask) {
    <<ifs>>
    return store.findAll(id);
  }
  native int tick();
  void keep() {
    run("INSERT INTO <<seg>> (a) SELECT b FROM t<<n>> "<<plus>>);
    new Reply();
  }
}
@RestController
@RequestMapping("/<<seg>>/c<<k>>")
class D<<k>> {
  @PostMapping("/{id}/")
  ResponseEntity<Reply> post(@PathVariable long id, @Valid @RequestBody Ask ask) { return null; }
}
@Entity @Table(name = "<<seg>>_<<n>>")
class E<<k>> { }
interface R<<k>> extends JpaRepository<E<<k>>, Long> { E<<k>> find(int id); }
""")]
_P, _C, _D, _E, _R = "java:package:estate.n<<n>>", "java:type:estate.n<<n>>.C<<k>>", "java:type:estate.n<<n>>.D<<k>>", "java:type:estate.n<<n>>.E<<k>>", "java:type:estate.n<<n>>.R<<k>>"
_M, _F, _END = "java:method:estate.n<<n>>.", "file:src/n<<n>>/C<<k>>.java", "java:endpoint:POST:/<<seg>>/c<<k>>/{id}"
JAVA_ENTITIES = [
    (_P, "PACKAGE", "is n<<n>>@-|"),
    (_C, "CLASS", "is C<<k>>@3|externallyExposed=true|loc=13|role=service|visibility=public"),
    ("java:field:estate.n<<n>>.C<<k>>#store", "FIELD", "is store@5|fieldType=Store<<n>>|visibility=private"),
    (_M + "C<<k>>#load(int,Ask)", "METHOD", "is load@6|cyclomaticComplexity=<<cc>>|externallyExposed=<<out>>|loc=4|paramTypes=int,Ask|returnType=List<Reply>|returnTypeNormalized=Reply|signature=load(int,Ask)|visibility=<<seen>>"),
    (_M + "C<<k>>#tick()", "METHOD", "is tick@10|cyclomaticComplexity=1|externallyExposed=false|loc=1|nativeMethod=true|returnType=int|returnTypeNormalized=int|signature=tick()|visibility=package"),
    (_M + "C<<k>>#keep()", "METHOD", "is keep@11|cyclomaticComplexity=1|externallyExposed=false|loc=4|returnType=void|signature=keep()|<<dyn>>sqlReads=t<<n>>|sqlWrites=<<seg>>|visibility=package"),
    (_D, "CLASS", "is D<<k>>@16|externallyExposed=true|loc=6|role=controller|visibility=package"),
    (_M + "D<<k>>#post(long,Ask)", "METHOD", "is post@19|cyclomaticComplexity=1|externallyExposed=true|loc=2|paramTypes=long,Ask|returnType=ResponseEntity<Reply>|returnTypeNormalized=Reply|signature=post(long,Ask)|visibility=package"),
    (_END, "ENDPOINT", "is POST /<<seg>>/c<<k>>/{id}@19|externallyExposed=true|httpMethod=POST|httpParams=id:path|httpPath=/<<seg>>/c<<k>>/{id}|requestBodyType=Ask|returnTypeNormalized=Reply|validated=true"),
    (_E, "CLASS", "is E<<k>>@22|externallyExposed=true|jpaEntity=true|jpaTableName=<<seg>>_<<n>>|loc=2|visibility=package"),
    (_R, "INTERFACE", "is R<<k>>@24|externallyExposed=false|loc=1|managedEntityType=E<<k>>|role=repository|springDataRepository=true|visibility=package"),
    (_M + "R<<k>>#find(int)", "METHOD", "is find@24|cyclomaticComplexity=1|externallyExposed=true|loc=1|paramTypes=int|returnType=E<<k>>|returnTypeNormalized=E<<k>>|signature=find(int)|visibility=package"),
]
_own = lambda a, b: (a, "CONTAINS", f"to {b}@-|DISCOVERED|")
_ref = lambda a, b, kind="REFERENCES": (a, kind, f"to {b}@-|UNRESOLVED|typeName={b}")
_rule = "confidence=1.00|ruleId=ENDPOINT-001"
JAVA_EDGES = [
    _ref(_C, "Base", "INHERITS"), _ref(_C, "Port", "IMPLEMENTS"), _ref(_R, "JpaRepository", "INHERITS"), _ref(_F, "java.util.List", "IMPORTS"), _ref(_M + "C<<k>>#keep()", "Reply", "INSTANTIATES"),
    *(_ref(_C, t) for t in ("Store<<n>>", "List", "Ask")), *(_ref(_D, t) for t in ("ResponseEntity", "Ask")), _ref(_R, "E<<k>>"),
    *(_own(a, t) for t in (_C, _D, _E, _R) for a in (_F, _P)),
    _own(_C, "java:field:estate.n<<n>>.C<<k>>#store"), *(_own(_C, _M + "C<<k>>#" + m) for m in ("load(int,Ask)", "tick()", "keep()")), _own(_D, _M + "D<<k>>#post(long,Ask)"), _own(_R, _M + "R<<k>>#find(int)"),
    *((_M + "C<<k>>#load(int,Ask)", "CALLS", "to probe@7|UNRESOLVED|argCount=2|callName=probe", f"c_custkey % 4 >= {i}") for i in (1, 2, 3)),
    (_M + "C<<k>>#load(int,Ask)", "CALLS", "to findAll@8|UNRESOLVED|argCount=1|callName=findAll|receiverName=store"),
    (_M + "C<<k>>#keep()", "CALLS", "to run@12|UNRESOLVED|argCount=1|callName=run"),
    (_D, "EXPOSES", f"to {_END}@19|DISCOVERED|{_rule}"), (_END, "INVOKES", f"to {_M}D<<k>>#post(long,Ask)@19|DISCOVERED|{_rule}"),
]


@query(expected("customer", JAVA_ENTITIES + JAVA_EDGES))
def extract_java(spark, d):
    return facts(extract(tree(spark, d, "customer", JAVA)))


ADA = [("n<<n>>/unit<<k>>.adb", """with Ada.Text_IO;
package body Unit<<k>> is
   Level : Integer := 0; -- Level := "not" read;
   procedure Raise_It (By : in Integer; Twice : Boolean) with Pre => By > <<n>> is
   begin
      <<whens>>
      Remote<<n>>.Send (By);
   end Raise_It;
   task Watch;
   type Depth is record
      Low : Integer;
   end record;
end Unit<<k>>;
"""), ("n<<n>>/unit<<k>>.ads", """package Unit<<k>> is
   function Twice (X : Integer) return Integer with Post => Twice'Result > X;
   Full : exception;
end Unit<<k>>;
""")]
_U, _UF, _US = "ada:package:Unit<<k>>", "file:n<<n>>/unit<<k>>.adb", "file:n<<n>>/unit<<k>>.ads"
_RAISE, _body, _spec = "ada:procedure:Unit<<k>>.Raise_It(Integer,Boolean)", "bodyLocation=n<<n>>/unit<<k>>.adb:", "specLocation=n<<n>>/unit<<k>>.ads:"
ADA_FACTS = [
    (_U, "PACKAGE", f"is Unit<<k>>@2|adaPart=body|{_body}2|externallyExposed=true|hasBody=true|hasSpec=false|loc=12"),
    (_U, "PACKAGE", f"is Unit<<k>>@1|adaPart=spec|externallyExposed=true|hasBody=false|hasSpec=true|loc=4|{_spec}1"),
    ("ada:variable:Unit<<k>>.Level", "VARIABLE", f"is Level@3|adaPart=body|{_body}3|externallyExposed=false|hasBody=true|hasSpec=false|variableType=Integer"),
    (_RAISE, "PROCEDURE", f"is Raise_It@4|adaPart=body|{_body}4|cyclomaticComplexity=<<cc>>|externallyExposed=false|hasBody=true|hasSpec=false|languageFeature=spark-contract|loc=5|paramTypes=Integer,Boolean|sparkPrecondition=By > <<n>>"),
    ("ada:task:Unit<<k>>.Watch", "TASK", "is Watch@9|"), ("ada:type:Unit<<k>>.Depth", "TYPE", "is Depth@10|externallyExposed=false|languageFeature=record"), ("ada:exception:Unit<<k>>.Full", "EXCEPTION", "is Full@3|"),
    ("ada:function:Unit<<k>>.Twice(Integer)", "FUNCTION", f"is Twice@2|adaPart=spec|externallyExposed=true|hasBody=false|hasSpec=true|languageFeature=spark-contract|paramTypes=Integer|returnType=Integer|sparkPostcondition=Twice'Result > X|{_spec}2"),
    (_UF, "IMPORTS", "to Ada.Text_IO@1|UNRESOLVED|typeName=Ada.Text_IO"), _own(_UF, _U), _own(_US, _U), _own(_U, _RAISE),
    *(_own(_U, f"ada:{x}") for x in ("variable:Unit<<k>>.Level", "task:Unit<<k>>.Watch", "type:Unit<<k>>.Depth", "exception:Unit<<k>>.Full", "function:Unit<<k>>.Twice(Integer)")),
    (_RAISE, "WRITES_TO", "to Level@6|UNRESOLVED|enclosingPackage=Unit<<k>>|stateName=Level"), (_RAISE, "READS_FROM", "to Level@6|UNRESOLVED|enclosingPackage=Unit<<k>>|stateName=Level"),
    (_RAISE, "CALLS", "to Send@7|UNRESOLVED|callName=Send|qualifiedCallName=Remote<<n>>.Send"),
]


@query(expected("supplier", ADA_FACTS))
def extract_ada(spark, d):
    return facts(extract(tree(spark, d, "supplier", ADA)))


DDL = [("db/s<<k>>.sql", """CREATE TABLE IF NOT EXISTS estate.s<<k>> ( -- CREATE TABLE none (a INT)
  id INT PRIMARY KEY,
  name VARCHAR(25)<<null>>,
  nation INT REFERENCES n<<n>> (id)
);
CREATE OR REPLACE VIEW v<<k>> AS SELECT id FROM s<<k>>;
ALTER TABLE s<<k>> ADD CONSTRAINT c FOREIGN KEY (id) REFERENCES "Ghost" (id);
""")]
_T, _TF = "sql:table:s<<k>>", "file:db/s<<k>>.sql"
_field = lambda c, t, key, must: (f"sql:field:s<<k>>.{c}", "FIELD", f"is {c}@1|externallyExposed=true|notNull={must}|primaryKey={key}|sqlType={t}")
_fk = lambda to, c, line: (_T, "REFERENCES", f"to {to}@{line}|DISCOVERED|confidence=1.00|foreignKeyColumn={c}|ruleId=SQL-FOREIGN-KEY-001|typeName={to}")
DDL_FACTS = [
    (_T, "DATABASE_OBJECT", "is s<<k>>@1|columnCount=3|dbObjectType=table|declaredIn=db/s<<k>>.sql:1|declaredName=estate.s<<k>>|externallyExposed=true"),
    ("sql:table:v<<k>>", "DATABASE_OBJECT", "is v<<k>>@6|columnCount=0|dbObjectType=view|declaredIn=db/s<<k>>.sql:6|declaredName=v<<k>>|externallyExposed=true"),
    _field("id", "INT", "true", "false"), _field("name", "VARCHAR(25)", "false", "<<must>>"), _field("nation", "INT", "false", "false"),
    _own(_TF, _T), _own(_TF, "sql:table:v<<k>>"), *(_own(_T, f"sql:field:s<<k>>.{c}") for c in ("id", "name", "nation")), _fk("n<<n>>", "nation", 1), _fk("ghost", "id", 7),
]


@query(expected("supplier", DDL_FACTS))
def extract_ddl(spark, d):
    return facts(extract(tree(spark, d, "supplier", DDL)))


CONFIG = [
    ("c<<k>>/a.properties", "# estate.No\na.<<secret>>=estate.n<<n>>.Handler<<k>>\nurl=http://n<<n>>.example.org\nlogger: com.lower.only\n"),
    ("c<<k>>/a.yml", "app:\n  mapper:\n    impl: \"estate.n<<n>>.Mapper<<k>>\" # estate.No\n  token: estate.n<<n>>.Hidden\n"),
    ("c<<k>>/a.xml", "<c><bean class=\"estate.n<<n>>.Bean<<k>>\"><ref>estate.n<<n>>.Ref<<k>></ref></bean></c>"),
]
_cfg = lambda e, refs, masked: ("config:c<<k>>/a." + e, "CONFIGURATION", f"is a.{e}@0|format={e}|references={refs}|secretKeysMasked={masked}")
_sets = lambda e, key, name, line, *when: ("config:c<<k>>/a." + e, "CONFIGURES", f"to estate.n<<n>>.{name}<<k>>@{line}|UNRESOLVED|configKey={key}|typeName=estate.n<<n>>.{name}<<k>>", *when)
CONFIG_FACTS = [
    (*_cfg("properties", 0, 1), "s_suppkey % 2 = 0"), (*_cfg("properties", 1, 0), "s_suppkey % 2 = 1"), _cfg("yml", 1, 1), _cfg("xml", 2, 0),
    *(_own(f"file:c<<k>>/a.{e}", f"config:c<<k>>/a.{e}") for e in ("properties", "yml", "xml")),
    _sets("properties", "a.handler", "Handler", 2, "s_suppkey % 2 = 1"), _sets("yml", "app.mapper.impl", "Mapper", 3), _sets("xml", "bean@class", "Bean", 1), _sets("xml", "ref", "Ref", 1),
]


@query(expected("supplier", CONFIG_FACTS))
def extract_config(spark, d):
    return facts(extract(tree(spark, d, "supplier", CONFIG)))


BUILD = [
    ("b<<k>>/pom.xml", "<project><groupId>estate.n<<n>></groupId><artifactId>c<<k>></artifactId><version>1.<<k>></version><dependencies><dependency><groupId>estate</groupId><artifactId>core<<n>></artifactId><<scope>></dependency></dependencies></project>"),
    ("b<<k>>/g/build.gradle", "rootProject.name = 'g<<k>>' // 'no'\ngroup = \"estate.n<<n>>\"\ndependencies {\n  implementation 'estate:core<<n>>:1'\n  api project(':n<<n>>')\n}\n"),
    ("b<<k>>/p<<k>>.gpr", "with \"lib/core<<n>>.gpr\";\nproject P<<k>> is\n  for Source_Dirs use (\"src\", \"gen<<n>>\"); -- for Main use (\"no.adb\");\n  for Main use (\"main<<k>>.adb\");\nend P<<k>>;\n"),
]
_MVN, _GRD, _GPR = "build:module:estate.n<<n>>:c<<k>>", "build:module:estate.n<<n>>:g<<k>>", "build:module:P<<k>>"
_dep = lambda a, to, line, scope: (a, "DEPENDS_ON", f"to {to}@{line}|DISCOVERED|ruleId=BUILD-DEPENDENCY-001|scope={scope}|typeName={to}")
BUILD_FACTS = [
    (_MVN, "MODULE", "is c<<k>>@0|artifactId=c<<k>>|buildFile=b<<k>>/pom.xml|buildSystem=maven|groupId=estate.n<<n>>|moduleDir=b<<k>>|moduleVersion=1.<<k>>|packaging=jar"),
    (_GRD, "MODULE", "is g<<k>>@0|buildFile=b<<k>>/g/build.gradle|buildSystem=gradle|groupId=estate.n<<n>>|moduleDir=b<<k>>/g"),
    (_GPR, "MODULE", "is P<<k>>@0|buildFile=b<<k>>/p<<k>>.gpr|buildSystem=gnat|mains=main<<k>>|moduleDir=b<<k>>|sourceDirs=src,gen<<n>>"),
    _own("file:b<<k>>/pom.xml", _MVN), _own("file:b<<k>>/g/build.gradle", _GRD), _own("file:b<<k>>/p<<k>>.gpr", _GPR),
    _dep(_MVN, "estate:core<<n>>", 1, "<<scoped>>"), _dep(_GRD, "estate:core<<n>>", 4, "implementation"), _dep(_GRD, "n<<n>>", 5, "api"), _dep(_GPR, "core<<n>>", 1, "with"),
    (_GPR, "DECLARES_MAIN", "to main<<k>>@4|DISCOVERED|callName=main<<k>>|confidence=1.00|ruleId=GNAT-MAIN-001"),
]


@query(expected("supplier", BUILD_FACTS))
def extract_build(spark, d):
    return facts(extract(tree(spark, d, "supplier", BUILD)))


#: One small system for each supplier: a Java service with every kind of field and call that a rule knows, an Ada unit with state, console and calls.
_JP = "s<<k>>/src/"
_class = lambda name, body="", head="class": (_JP + name + ".java", f"package estate.s<<k>>;\n{head} {name} {{{body}}}\n")
SYSTEM = [
    (_JP + "Desk<<k>>.java", """package estate.s<<k>>;
@RestController
@RequestMapping("/s<<k>>")
public class Desk<<k>> {
  private Ledger<<k>> ledger;
  @PutMapping("/{id}")
  Receipt<<k>> record(@Valid @RequestBody Sounding<<k>> sounding) { return ledger.enter(sounding); }
}
"""),
    (_JP + "Ledger<<k>>.java", """package estate.s<<k>>;
@Service
public class Ledger<<k>> {
  private Store<<k>> store;
  private Logs<<k>> logs;
  private Feed<<k>> feed;
  private Horn<<k>> horn;
  private Bell<<k>> bell;
  public Receipt<<k>> enter(Sounding<<k>> sounding) {
    validateDepth(sounding);
    feed.poll(<<n>>);
    horn.blow(sounding);
    bell.ring(sounding);
    Reading<<k>> next = asReading(sounding);
    store.save(next);
    store.flush();
    logs.findLast();
    return toReceipt(next);
  }
  private Reading<<k>> asReading(Sounding<<k>> sounding) { return new Reading<<k>>(); }
  private Receipt<<k>> toReceipt(Reading<<k>> reading) { return null; }
  private void validateDepth(Sounding<<k>> sounding) { }
  void audit() { run("SELECT a FROM audit<<k>> WHERE n = <<n>>"); }
  void purge() { run("DELETE FROM old<<k>> WHERE n = " + nation()); }
}
"""),
    _class("Reading<<k>>", head='@Entity @Table(name = "reading_<<n>>_<<k>>") class'), _class("Log<<k>>", head="@Entity class"), _class("Receipt<<k>>"), _class("Sounding<<k>>"),
    (_JP + "Store<<k>>.java", "package estate.s<<k>>;\ninterface Store<<k>> extends JpaRepository<Reading<<k>>, Long> { }\n"),
    (_JP + "Logs<<k>>.java", "package estate.s<<k>>;\ninterface Logs<<k>> extends CrudRepository<Log<<k>>, Long> { Log<<k>> findLast(); }\n"),
    _class("Horn<<k>>", " void blow(Sounding<<k>> sounding); ", "interface"), _class("Bell<<k>>", " void ring(Sounding<<k>> sounding); ", "interface"),
    *((_JP + f"{c}<<k>>.java", f"package estate.s<<k>>;\nclass {c}<<k>> implements {i}<<k>> {{ public void {m}(Sounding<<k>> sounding) {{ }} }}\n") for c, i, m in (("Brass", "Horn", "blow"), ("High", "Bell", "ring"), ("Low", "Bell", "ring"))),
    ("s<<k>>/ada/state<<k>>.ads", """package State<<k>> is
   Depth : Integer;
   type Raw<<k>> is new Integer;
   type Fix<<k>> is new Integer;
   function To_Fix (R : Raw<<k>>) return Fix<<k>>;
   function Smooth (R : Raw<<k>>) return Fix<<k>>;
   procedure Clear;
end State<<k>>;
"""),
    ("s<<k>>/ada/ops<<k>>.adb", """with Ada.Text_IO;
with State<<k>>, Radio<<k>>;
package body Ops<<k>> is
   Count : Integer := <<n>>;
   procedure Twin<<k>> (A : Integer) is
   begin
      null;
   end Twin<<k>>;
   procedure Twin<<k>> (A : Boolean) is
   begin
      null;
   end Twin<<k>>;
   procedure Step<<k>> is
   begin
      null;
   end Step<<k>>;
   procedure Run is
   begin
      State<<k>>.Depth := <<n>>;
      Count := Count + 1;
      State<<k>>.Clear;
      Step<<k>>;
      Twin<<k>> (1);
      Ada.Text_IO.Put_Line ("Step");
      Ada.Text_IO.Get_Line (Line, Last);
      Radio<<k>>.Send (1);
   end Run;
end Ops<<k>>;
"""),
]


def model(spark, d):
    from .plans.pipeline import build_model

    return build_model(durable(extract(tree(spark, d, "supplier", SYSTEM))), "estate", "scan")


def _j(name: str) -> str:
    """java type or, with #, method of a supplier's system."""
    return f"java:{'method' if '#' in name else 'type'}:estate.s<<k>>.{name}"


_ENTER, _RUN = _j("Ledger<<k>>#enter(Sounding<<k>>)"), "ada:procedure:Ops<<k>>.Run"
_AS, _TO, _ENDP = _j("Ledger<<k>>#asReading(Sounding<<k>>)"), _j("Ledger<<k>>#toReceipt(Reading<<k>>)"), "java:endpoint:PUT:/s<<k>>/{id}"
_READING, _LOG = "sql:table:reading_<<n>>_<<k>>", "sql:table:log<<k>>"
_SMOOTH, _FIX = "ada:function:State<<k>>.Smooth(Raw<<k>>)", "ada:function:State<<k>>.To_Fix(Raw<<k>>)"
#: (from, kind, to, rule, confidence, status); the rules' ids and weights are fixed values.
RULE_EDGES = [
    (_j("Desk<<k>>"), "EXPOSES", _ENDP, "ENDPOINT-001", "1.00", "DISCOVERED"), (_ENDP, "INVOKES", _j("Desk<<k>>#record(Sounding<<k>>)"), "ENDPOINT-001", "1.00", "DISCOVERED"),
    (_ENDP, "CONSUMES", _j("Sounding<<k>>"), "ENDPOINT-002", "0.95", "RESOLVED"), (_ENDP, "PRODUCES", _j("Receipt<<k>>"), "ENDPOINT-002", "0.95", "RESOLVED"),
    (_j("Reading<<k>>"), "MAPS_TO", _READING, "JPA-TABLE-001", "1.00", "RESOLVED"), (_j("Log<<k>>"), "MAPS_TO", _LOG, "JPA-TABLE-002", "0.60", "INFERRED"),
    (_j("Store<<k>>"), "MANAGES", _j("Reading<<k>>"), "REPOSITORY-001", "1.00", "RESOLVED"), (_j("Logs<<k>>"), "MANAGES", _j("Log<<k>>"), "REPOSITORY-001", "1.00", "RESOLVED"),
    (_j("Store<<k>>"), "PERSISTS_TO", _READING, "REPOSITORY-002", "0.95", "RESOLVED"), (_j("Logs<<k>>"), "PERSISTS_TO", _LOG, "REPOSITORY-002", "0.60", "INFERRED"),
    (_j("Desk<<k>>#record(Sounding<<k>>)"), "INVOKES", _ENTER, "CALL-001", "0.95", "RESOLVED"), *((_ENTER, "INVOKES", t, "CALL-001", "0.95", "RESOLVED") for t in (_AS, _TO, _j("Ledger<<k>>#validateDepth(Sounding<<k>>)"), _j("Logs<<k>>#findLast()"))),
    (_ENTER, "INVOKES", "Feed<<k>>#poll", "UNRESOLVED-001", "0.40", "UNRESOLVED"), (_ENTER, "INVOKES", _j("Brass<<k>>#blow(Sounding<<k>>)"), "DI-001", "0.90", "RESOLVED"),
    *((_ENTER, "INVOKES", _j(f"{c}<<k>>#ring(Sounding<<k>>)"), "DI-002", "0.50", "INFERRED") for c in ("High", "Low")),
    (_ENTER, "WRITES_TO", _READING, "WRITE-001", "0.90", "RESOLVED"), (_ENTER, "USES", _READING, "REPOSITORY-003", "0.70", "RESOLVED"), (_ENTER, "READS_FROM", _LOG, "READ-001", "0.54", "INFERRED"),
    (_j("Ledger<<k>>#audit()"), "READS_FROM", "sql:table:audit<<k>>", "SQL-001", "0.95", "RESOLVED"), (_j("Ledger<<k>>#purge()"), "WRITES_TO", "sql:table:old<<k>>", "SQL-002", "0.60", "INFERRED"),
    (_AS, "CONSUMES", _j("Sounding<<k>>"), "MAP-001", "0.90", "RESOLVED"), (_AS, "PRODUCES", _j("Reading<<k>>"), "MAP-001", "0.90", "RESOLVED"),
    (_TO, "CONSUMES", _j("Reading<<k>>"), "MAP-002", "0.60", "INFERRED"), (_TO, "PRODUCES", _j("Receipt<<k>>"), "MAP-002", "0.60", "INFERRED"),
    (_j("Sounding<<k>>"), "VALIDATED_BY", _j("Ledger<<k>>#validateDepth(Sounding<<k>>)"), "VALIDATION-001", "0.90", "RESOLVED"),
    (_RUN, "WRITES_TO", "ada:variable:State<<k>>.Depth", "ADA-WRITE-001", "0.90", "RESOLVED"), (_RUN, "WRITES_TO", "ada:variable:Ops<<k>>.Count", "ADA-WRITE-001", "0.85", "RESOLVED"),
    (_RUN, "READS_FROM", "ada:variable:Ops<<k>>.Count", "ADA-READ-001", "0.85", "RESOLVED"),
    (_RUN, "INVOKES", "ada:procedure:State<<k>>.Clear", "ADA-CALL-001", "0.95", "RESOLVED"), (_RUN, "INVOKES", "ada:procedure:Ops<<k>>.Step<<k>>", "ADA-CALL-001", "0.85", "RESOLVED"),
    *((_RUN, "INVOKES", f"ada:procedure:Ops<<k>>.Twin<<k>>({t})", "ADA-CALL-002", "0.50", "INFERRED") for t in ("Integer", "Boolean")),
    (_RUN, "WRITES_TO", "ada:sink:console_output", "ADA-IO-002", "0.85", "RESOLVED"), (_RUN, "READS_FROM", "ada:source:console_input", "ADA-IO-001", "0.85", "RESOLVED"),
    (_RUN, "INVOKES", "Radio<<k>>.Send", "ADA-EXTERNAL-001", "0.40", "UNRESOLVED"),
    *((f, k, f"ada:type:State<<k>>.{t}<<k>>", r, c, s) for f, r, c, s in ((_FIX, "ADA-MAP-001", "0.85", "RESOLVED"), (_SMOOTH, "ADA-MAP-002", "0.60", "INFERRED")) for k, t in (("CONSUMES", "Raw"), ("PRODUCES", "Fix"))),
]


def expected_rules(rows) -> str:
    return " UNION ALL ".join(f"SELECT {sql('supplier', a)} AS from_id, '{k}' AS kind, {sql('supplier', b)} AS to_id, '{r}' AS rule, '{c}' AS confidence, '{s}' AS status FROM supplier" for a, k, b, r, c, s in rows)


@query(expected_rules(RULE_EDGES))
def lineage_rules(spark, d):
    r = model(spark, d).relationships
    return r.where(attr("ruleId").isNotNull()).select("from_id", "kind", "to_id", attr("ruleId").alias("rule"), attr("confidence").alias("confidence"), "status")


_typed = lambda owner, kind, *names: [(_j(f"{owner}<<k>>"), kind, _j(f"{n}<<k>>")) for n in names]
#: References by name that have at most eight bearers, linked once for each reference; Java calls are left to the rules.
LINKED = [
    *_typed("Desk", "REFERENCES", "Ledger", "Receipt", "Sounding"), *_typed("Ledger", "REFERENCES", "Store", "Logs", "Horn", "Bell", "Receipt", "Receipt", "Reading", "Reading", "Sounding", "Sounding", "Sounding"),
    *_typed("Logs", "REFERENCES", "Log"), *(x for c in ("Horn", "Bell", "Brass", "High", "Low") for x in _typed(c, "REFERENCES", "Sounding")),
    *_typed("Brass", "IMPLEMENTS", "Horn"), *_typed("High", "IMPLEMENTS", "Bell"), *_typed("Low", "IMPLEMENTS", "Bell"), (_AS, "INSTANTIATES", _j("Reading<<k>>")),
    (_RUN, "CALLS", "ada:procedure:Ops<<k>>.Step<<k>>"), *((_RUN, "CALLS", f"ada:procedure:Ops<<k>>.Twin<<k>>({t})") for t in ("Integer", "Boolean")),
]


def expected_links(rows) -> str:
    return " UNION ALL ".join(f"SELECT {sql('supplier', a)} AS from_id, '{k}' AS kind, {sql('supplier', b)} AS to_id, 'RESOLVED' AS status FROM supplier" for a, k, b in rows)


@query(expected_links(LINKED))
def linked_references(spark, d):
    from .operators import analysis as an
    from .operators import resolution as rs
    from .plans.pipeline import _rows

    rows, edges = _rows(durable(extract(tree(spark, d, "supplier", SYSTEM))), "estate")
    links = rs.link(rs.resolve(durable(an.merge_entities(rows)[0]), durable(edges)))
    return links.where("NOT (kind = 'CALLS' AND startswith(from_id, 'java:'))").select("from_id", "kind", "to_id", "status")


_VIEWS = [
    ("entry point", _ENDP, "3 endpoint"), ("endpoint", _ENDP, "estate.s<<k>>.Desk<<k>>#record(Sounding<<k>>) true s<<k>>/src/Desk<<k>>.java:6"),
    ("store", _READING, _j("Reading<<k>>") + " 0 1 false"), ("store", _LOG, _j("Log<<k>>") + " 1 0 true"), ("store", "sql:table:audit<<k>>", "- 1 0 false"), ("store", "sql:table:old<<k>>", "- 0 1 true"),
    ("source", "ada:source:console_input", _RUN + " 0.85"),
    ("path", _ENDP, "|".join((_ENDP, _j("Desk<<k>>#record(Sounding<<k>>)"), _ENTER, _AS, _j("Reading<<k>>"), _READING)) + " 0.9"),
    # Calls that an invocation of the same pair covers are not shown beside it.
    *(("callee", a, f"{k} {b}") for a, k, b, *_, s in RULE_EDGES if k == "INVOKES" and s != "UNRESOLVED"), ("callee", _ENTER, f"INVOKES {_j('Logs<<k>>#findLast()')}"),
]
_VIEWS = list(dict.fromkeys(_VIEWS))


@query(" UNION ALL ".join(f"SELECT '{v}' AS what, {sql('supplier', i)} AS id, {sql('supplier', f)} AS fact FROM supplier" for v, i, f in _VIEWS))
def system_views(spark, d):
    """Entry points, endpoints, stores, sources, the endpoints' representative paths and callees of every system. Java names have a bearer
    in each system, so the linker leaves them open where there are more than eight suppliers."""
    from . import workflows as wf
    from .api import Api
    from .model import CALL_KINDS
    from .operators import graph as gr
    from .operators import neighbors as nb

    m = model(spark, d)
    api = Api.of(m)
    row = lambda df, what, id_, *fact: df.select(F.lit(what).alias("what"), F.col(id_).alias("id"), F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fact)).alias("fact"))
    ends = m.entities.where("kind = 'ENDPOINT'").select("id")
    paths = gr.representative_paths(gr.trace_ranked(gr.lineage_edges(m.relationships), ends), m.entities).withColumn("path", F.array_join("nodes", "|"))
    out = row(wf.entry_points(api), "entry point", "id", "sort", "how")
    for df in (row(wf.endpoint_views(api), "endpoint", "id", "handler", "validated", "location"), row(wf.store_views(api), "store", "id", "mapped_from", "readers", "writers", "inferred"), row(wf.source_traces(api), "source", "source", "reader", "confidence"),
               row(paths, "path", "start", "path", "confidence"), row(nb.neighbors(m.entities, m.relationships, None, CALL_KINDS, incoming=False), "callee", "entity_id", "edge_kind", "other_id")):
        out = out.unionByName(df)
    return out


CROSSING = [
    ("x<<k>>/Bridge<<k>>.java", """package estate.x<<k>>;
class Bridge<<k>> {
  native int step<<k>>();
  native int other<<k>>();
  void go() {
    exec("main<<n>>");
    queue.send(1);
    new Socket();
    drift<<k>>();
    execute(<<n>>);
    twice<<k>>();
  }
}
"""),
    ("x<<k>>/far<<k>>.adb", """package body Far<<k>> is
   procedure Step_<<k>> is
   begin
      null;
   end Step_<<k>>;
   procedure Drift_<<k>> is
   begin
      null;
   end Drift_<<k>>;
   procedure Twice_<<k>> (A : Integer) is
   begin
      null;
   end Twice_<<k>>;
   procedure Twice_<<k>> (A : Boolean) is
   begin
      null;
   end Twice_<<k>>;
end Far<<k>>;
"""),
]
_GO, _NAT = "java:method:estate.x<<k>>.Bridge<<k>>#go()", "java:method:estate.x<<k>>.Bridge<<k>>#"
CROSSED = [
    ("DIRECT_BOUNDARY", _NAT + "step<<k>>()", "ada:procedure:Far<<k>>.Step_<<k>>", "native method step<<k>>", "INFERRED"), ("UNRESOLVED_BOUNDARY", _NAT + "other<<k>>()", "", "native method other<<k>>", "UNRESOLVED"),
    ("PROCESS_BOUNDARY", _GO, "", "exec", "UNRESOLVED"), ("MESSAGE_BOUNDARY", _GO, "", "send", "UNRESOLVED"), ("NETWORK_BOUNDARY", _GO, "", "Socket", "UNRESOLVED"), ("INFERRED_BOUNDARY", _GO, "ada:procedure:Far<<k>>.Drift_<<k>>", "drift<<k>>", "INFERRED"),
]


@query(" UNION ALL ".join(f"SELECT '{b}' AS boundary, {sql('supplier', j)} AS java_id, {sql('supplier', a)} AS ada_id, {sql('supplier', w)} AS artifact, '{s}' AS status FROM supplier" for b, j, a, w, s in CROSSED))
def boundary_crossings(spark, d):
    from . import onboarding as ob
    from .api import Api
    from .operators import analysis as an
    from .plans.pipeline import _rows

    files = durable(extract(tree(spark, d, "supplier", CROSSING)))
    rows, edges = _rows(files, "estate")
    api = Api(spark, durable(an.merge_entities(rows)[0]), durable(edges), files, files, "scan")
    return ob.boundaries(api, spark.createDataFrame([], "id string"))
