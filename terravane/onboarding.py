"""What a newcomer is told beyond counts: boundaries between languages, central components, layers, sampled paths, what
to read first, whom to ask what, and a summary of facts by how sure they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Api, records
from .model import attr
from .operators import analysis as an
from .operators import graph as gr
from .operators import neighbors as nb
from .operators.resolution import unique
from .session import durable

#: Names of programming interfaces that cross a boundary, whole and without underscores; build files.
PROCESS = ("processbuilder", "runtime", "exec", "processimpl", "process")
MESSAGE = ("jmstemplate", "kafkatemplate", "rabbittemplate", "amqptemplate", "send", "publish", "convertandsend", "enqueue", "produce")
NETWORK = ("socket", "serversocket", "httpclient", "urlconnection", "resttemplate", "webclient")
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "build.xml", "makefile", "cmakelists.txt")
DATA_KINDS = ("READS_FROM", "WRITES_TO", "PERSISTS_TO", "MAPS_TO")
COMPONENTS = ("CLASS", "INTERFACE", "RECORD", "ENUM")


def plain(c):
    """A name without case and underscores."""
    return F.lower(F.replace(c, F.lit("_"), F.lit("")))


def boundaries(api: Api, mains: DataFrame) -> DataFrame:
    """boundary, java_id, ada_id ('' where unknown), artifact, status. mains: id of Ada mains.

    A native method is a direct boundary if one Ada routine alone has its name, else unresolved. An unresolved reference
    of Java to an interface for processes, messages or networks is one where the estate has Ada; any other whose name is
    that of one Ada routine is inferred. A store that Java and Ada touch is shared, between the smallest ids of both."""
    e, r = api.entities, api.relationships
    routines = e.where("language = 'ada' AND kind IN ('PROCEDURE', 'FUNCTION')")
    has_ada = not e.where("language = 'ada' AND kind IN ('PROCEDURE', 'FUNCTION', 'PACKAGE')").isEmpty()
    ada = unique(routines.select(plain(F.col("name")).alias("k"), "id"), "k").select(F.col("k").alias("_k"), F.col("id").alias("match"))
    out = lambda d, b, other, what, status: d.select(b.alias("boundary"), F.col("id").alias("java_id"), F.coalesce(other, F.lit("")).alias("ada_id"), what.alias("artifact"), status.alias("status"))
    native = e.where("language = 'java' AND kind = 'METHOD'").where(attr("nativeMethod") == "true").select("id", "name", plain(F.col("name")).alias("k")).join(ada, F.col("k") == F.col("_k"), "left")
    met = F.col("match").isNotNull()
    parts = [out(native, F.when(met, "DIRECT_BOUNDARY").otherwise("UNRESOLVED_BOUNDARY"), F.col("match"), F.concat(F.lit("native method "), "name"), F.when(met, "INFERRED").otherwise("UNRESOLVED"))]
    told = nb.unresolved_references(r).where(F.col("from_id").startswith("java:")).select(F.col("from_id").alias("id"), "target", plain(F.substring_index(F.substring_index("target", "#", 1), ".", -1)).alias("k")).distinct()
    sort = F.when(F.col("k").isin(*PROCESS), "PROCESS_BOUNDARY").when(F.col("k").isin(*MESSAGE), "MESSAGE_BOUNDARY").when(F.col("k").isin(*NETWORK), "NETWORK_BOUNDARY") if has_ada else F.lit(None).cast("string")
    told = told.withColumn("sort", sort)
    first = mains.agg(F.min("id").alias("main"))  # one row
    through = told.where("sort IS NOT NULL").join(F.broadcast(first), F.lit(True))
    main = F.when(F.col("sort") == "PROCESS_BOUNDARY", F.col("main"))
    parts.append(out(through, F.col("sort"), main, F.col("target"), F.when(main.isNotNull(), "INFERRED").otherwise("UNRESOLVED")))
    parts.append(out(told.where("sort IS NULL").join(ada, F.col("k") == F.col("_k")), F.lit("INFERRED_BOUNDARY"), F.col("match"), F.col("target"), F.lit("INFERRED")))
    stores = e.where("kind = 'DATABASE_OBJECT' OR (kind = 'VARIABLE' AND language = 'ada')").select(F.col("id").alias("_s"), F.col("name").alias("store"))
    touch = nb.neighbors(e, r, None).join(stores, F.col("entity_id") == F.col("_s"))
    side = lambda l: F.min(F.when(F.col("other_id").startswith(l + ":"), F.col("other_id")))
    shared = touch.groupBy("_s", "store").agg(side("java").alias("id"), side("ada").alias("other")).where("id IS NOT NULL AND other IS NOT NULL")
    parts.append(out(shared, F.lit("SHARED_DATA_BOUNDARY"), F.col("other"), F.concat(F.lit("store "), "store"), F.lit("DISCOVERED")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.distinct()


def central_components(api: Api, entries: DataFrame, borders: DataFrame, flows: DataFrame) -> DataFrame:
    """Java types and Ada packages by what they and their members take part in: id, score, and each part of the score.
    entries, borders, flows: id of entry points, of boundary sides and of nodes on sampled paths."""
    e, r = api.entities, api.relationships
    c = e.where((F.col("language") == "java") & F.col("kind").isin(*COMPONENTS) | (F.col("language") == "ada") & (F.col("kind") == "PACKAGE")).select("id", "language", "qualified_name").distinct()
    inside = r.where("kind = 'CONTAINS' AND resolved").select(F.col("from_id").alias("c"), F.col("to_id").alias("part"))
    own = inside.join(c, F.col("c") == F.col("id"), "left_semi").unionByName(c.select(F.col("id").alias("c"), F.col("id").alias("part"))).distinct()
    shown = r.where("kind = 'EXPOSES'").select("from_id", "to_id").join(entries.select(F.col("id").alias("_e")), F.col("to_id") == F.col("_e"), "left_semi").select(F.col("from_id").alias("id"))
    mark = lambda d, m: d.select(F.col("id").alias("_p"), F.lit(m).alias("mark"))
    lost = nb.without_twins(r).select(F.col("from_id").alias("id")).distinct()
    data = r.where(F.col("resolved") & F.col("kind").isin(*DATA_KINDS)).select(F.col("from_id").alias("id"))
    tables = nb.neighbors(e, r, None, incoming=False).where("other_kind = 'DATABASE_OBJECT'").select(F.col("entity_id").alias("id"))
    marks = mark(entries.select("id").unionByName(shown), "entry").unionByName(mark(borders, "boundary")).unionByName(mark(flows, "lineage")).unionByName(mark(lost, "lost")).distinct()
    has = lambda m: F.count_if(F.col("mark") == m)
    hit = own.join(marks, F.col("part") == F.col("_p")).groupBy(F.col("c").alias("_c")).agg(*((has(m) > 0).alias(m) for m in ("entry", "boundary", "lineage")), has("lost").alias("unresolved"))
    touches = data.unionByName(tables).distinct().select(F.col("id").alias("_d"), F.lit(True).alias("data"))
    fan = lambda incoming, n: nb.fan(e, r, incoming).select(F.col("id").alias(f"_{n}"), F.col("n").alias(n))
    complex_ = an.max_member_complexity(e, r).select(F.col("id").alias("_m"), "max_complexity")
    j = c
    for d, k in ((hit, "_c"), (touches, "_d"), (fan(True, "fan_in"), "_fan_in"), (fan(False, "fan_out"), "_fan_out"), (complex_, "_m")):
        j = j.join(d, F.col("id") == F.col(k), "left").drop(k)
    j = j.fillna(0, ["unresolved", "fan_in", "fan_out", "max_complexity"]).fillna(False, ["entry", "boundary", "lineage", "data"])
    flag = lambda n, w: w * F.col(n).cast("int")
    score = 5 * F.col("fan_in") + 2 * F.col("fan_out") + flag("lineage", 8) + flag("entry", 10) + flag("data", 6) + flag("boundary", 12) + F.least("max_complexity", F.lit(20)) + F.least("unresolved", F.lit(5))
    return j.withColumn("score", score.cast("long")).where("score > 0")


def sampled_paths(api: Api, starts: DataFrame, borders: DataFrame, most: int = 5) -> list[dict]:
    """The best path of each start's trace (id), scored by confidence, length, boundaries met and languages spanned. The best
    Java and the best Ada path have a place where there are any; paths without an edge are none."""
    p = gr.best_path_per_start(gr.trace_all(gr.lineage_edges(api.relationships), starts), api.entities).withColumn("nodes", F.split("path", "\\|")).where(F.size("nodes") > 1)
    met = p.select("start", F.explode("nodes").alias("n")).join(borders.select(F.col("id").alias("_b")).distinct(), F.col("n") == F.col("_b"), "left_semi").select(F.col("start").alias("_s")).distinct().withColumn("crosses", F.lit(True))
    p = p.join(met, F.col("start") == F.col("_s"), "left").drop("_s")
    some = lambda l: F.exists("nodes", lambda n: n.startswith(l + ":"))
    score = F.round(F.col("confidence") * 100).cast("int") + 4 * F.least(F.size("nodes"), F.lit(8)) + F.when(F.col("crosses"), 30).otherwise(0) + F.when(some("java") & some("ada"), 25).otherwise(0)
    p = durable(p.select("start", "path", "confidence", "store", score.alias("score")))
    top = lambda d, n: records(d.orderBy(F.desc("score"), "start").limit(n))
    out = [x for l in ("java", "ada") for x in top(p.where(F.col("start").startswith(f"{l}:")), 1)]
    out += [x for x in top(p, most) if x not in out][: max(0, most - len(out))]
    return out[:most]


def layers(api: Api) -> list[str]:
    """Layers that roles and kinds suggest."""
    e = api.entities
    role = attr("role")
    seen = e.agg(
        F.coalesce(F.bool_or((F.col("kind") == "ENDPOINT") | (role == "controller")), F.lit(False)).alias("presentation"), F.coalesce(F.bool_or(role == "service"), F.lit(False)).alias("service"),
        F.coalesce(F.bool_or((F.col("kind") == "DATABASE_OBJECT") | (role == "repository") | (attr("jpaEntity") == "true")), F.lit(False)).alias("persistence"), F.coalesce(F.bool_or((F.col("kind") == "PACKAGE") & (F.col("language") == "ada")), F.lit(False)).alias("ada core"),
    ).first()
    return [f"{name} (inferred)" for name, there in seen.asDict().items() if there]


def reading_order(api: Api, entries: DataFrame, borders: DataFrame) -> DataFrame:
    """id, stage, key: build files, entry points, interfaces, controllers, services, boundary sides, the largest Ada packages, stores,
    sinks, tests. An entity stays in its first stage; sort by stage, key and id. entries: id, sort; borders: id.
    Of interfaces, tables, variables and sinks the first six are named, of Ada packages and tests four."""
    e = api.entities
    low, path = F.lower(F.col("name")), F.lower(F.col("qualified_name"))
    files = e.where("kind = 'FILE'")
    tests = files.where(path.contains("/test/") | low.endswith("test.java") | low.endswith("tests.java") | low.contains("_test"))
    big = nb.fan(e, api.relationships, False, ("CONTAINS",)).select(F.col("id").alias("_b"), "n")
    ada = e.where("kind = 'PACKAGE' AND language = 'ada'").select("id").distinct().join(big, F.col("id") == F.col("_b"), "left")
    plainly = lambda d, key=None: d.select("id", (F.col("id") if key is None else key).alias("key"))
    first = lambda d, n: d.orderBy("key", "id").limit(n)
    kind = lambda k, *also: plainly(e.where(F.col("kind") == k).where(also[0] if also else F.lit(True)).select("id").distinct())
    role = lambda x: plainly(e.where("kind = 'CLASS' AND language = 'java'").where(attr("role") == x).select("id").distinct())
    stages = [
        (1, plainly(files.where(low.isin(*BUILD_FILES) | low.endswith(".gpr")), F.col("qualified_name"))), (2, plainly(entries, F.concat_ws("|", F.lpad(F.col("sort").cast("string"), 2, "0"), "id"))), (3, first(kind("INTERFACE", F.col("language") == "java"), 6)),
        (4, role("controller")), (5, role("service")), (6, plainly(borders.select("id").where("id <> ''").distinct())),
        (7, first(plainly(ada, F.lpad((F.lit(10**12) - F.coalesce("n", F.lit(0))).cast("string"), 13, "0")), 4)),
        (8, first(kind("DATABASE_OBJECT"), 6).unionByName(first(kind("VARIABLE", F.col("language") == "ada"), 6))), (9, first(kind("DATA_SINK"), 6)), (10, first(plainly(tests, F.col("qualified_name")), 4)),
    ]
    whole = None
    for n, d in stages:
        d = d.withColumn("stage", F.lit(n))
        whole = d if whole is None else whole.unionByName(d)
    return whole.groupBy("id").agg(F.min(F.struct("stage", "key")).alias("m")).select("id", "m.stage", "m.key")


def expert_questions(api: Api, borders: list[dict], central: list[dict], paths: list[dict], endpoints: list[str]) -> list[dict]:
    """One question for each role that the evidence supports, with the ids it rests on."""
    e = api.entities
    out: list[dict] = []
    ask = lambda who, ids, question, basis="UNRESOLVED": out.append({"expert": who, "question": question, "ids": [i for i in ids if i], "basis": basis})
    if borders:
        b = borders[0]
        ids, far = [b["java_id"], b["ada_id"]], b["ada_id"] or "something outside Java"
        ask("Technical lead", ids, f"{b['java_id']} meets {far} through {b['artifact']} ({b['boundary']}): is that the path used in production, or does configuration choose another?")
        ask("Systems engineer", ids, f"How are both sides of {b['artifact']} ({b['boundary']}) deployed, and where is it configured?")
    if java := next((c for c in central if c["language"] == "java"), None):
        ask("Java specialist", [java["id"]], f"{java['qualified_name']} is central (score {java['score']}): is it used by several threads, and how is it changed safely?", "CONFIRMED")
    state = e.where("kind = 'VARIABLE' AND language = 'ada'").agg(F.min_by("qualified_name", "id").alias("name"), F.min("id").alias("id")).first()
    unit = e.where("kind = 'PACKAGE' AND language = 'ada'").agg(F.min_by("qualified_name", "id").alias("name"), F.min("id").alias("id")).first()
    if state.id:
        ask("Ada specialist", [state.id], f"Is the package state {state.name} the authority for its data, or a copy of what is stored elsewhere?")
    elif unit.id:
        ask("Ada specialist", [unit.id], f"What is the package {unit.name} responsible for, and which of its routines are called from outside?")
    table = e.where("kind = 'DATABASE_OBJECT'").agg(F.min_by("name", "id").alias("name"), F.min("id").alias("id")).first()
    if table.id:
        writer = nb.neighbors(e, api.relationships, table.id).where(F.col("edge_kind").isin("WRITES_TO", "PERSISTS_TO", "MAPS_TO")).agg(F.min("other_id")).first()[0]
        ask("Database engineer", [table.id], f"Who owns the schema of {table.name}, written by {writer or 'nothing that was resolved'}, and how are concurrent writers kept apart?")
    source = endpoints[0] if endpoints else e.where("kind = 'DATA_SOURCE'").agg(F.min("id")).first()[0]
    if source:
        ask("Cybersecurity engineer", [source], f"Input enters at {source}: where is it validated, and who may send it?")
    if paths:
        nodes = paths[0]["path"].split("|")
        ask("Test engineer", [nodes[0], nodes[-1]], f"Is the flow from {nodes[0]} to {nodes[-1]} covered by an automatic test, and which of its edge cases are risky?")
    return out


def final_summary(stages: dict) -> dict:
    """Ten questions answered from the stages before, and their facts by how sure they are. A stage that failed answers with nothing."""
    got = lambda name, empty: v if not isinstance(v := stages.get(name, empty), dict) or "unavailable" not in v else empty
    summary, health, inventory = got("intake", {}).get("summary", {}), got("health", {}), got("inventory", [])
    entries, borders, central = got("entry points", []), got("boundaries", []), got("central components", [])
    paths, risks, asked, layered = got("lineage", {}).get("samples", []), got("risks", []), got("expert questions", []), got("architecture", {}).get("layers", [])
    name = lambda rows, key, n=5: ", ".join(str(x[key]) for x in rows[:n]) or "none found"
    of = lambda l: [c for c in central if c["language"] == l]
    outside = [x for x in risks if x["risk"] == "external dependency"]
    stores = [x for x in inventory if x["category"] in ("tables", "state") and x["n"]]
    flow = lambda p: f"{p['path'].split('|')[0]} to {p['path'].split('|')[-1]}"
    flows = [{"flow": flow(p)} for p in paths]
    sides = [{"what": f"{b['boundary']}: {b['java_id']} and {b['ada_id'] or 'unknown'} through {b['artifact']}", "status": b["status"]} for b in borders]
    answers = [
        ("What is this system?", f"{summary.get('files', 0)} files in {', '.join(summary.get('languages', [])) or 'no known language'}; the scan is {health.get('state', 'unknown')}"),
        ("Where does it start?", name(entries, "id", 4)), ("Which Java components matter most?", name(of("java"), "qualified_name")), ("Which Ada components matter most?", name(of("ada"), "qualified_name")),
        ("How do Java and Ada meet?", f"{len(sides)}: {name(sides, 'what', 3)}" if sides else "no crossing was found"), ("Which data flows matter?", name(flows, "flow", 3)),
        ("Where is data stored?", ", ".join(f"{x['n']} {x['category']}" for x in stores) or "no store was found"), ("What should be understood first?", name(central, "qualified_name")),
        ("What is not resolved?", f"{health.get('unresolved', 0)} references, {len(outside)} external dependencies"), ("What should the team be asked?", asked[0]["question"] if asked else "nothing that evidence supports"),
    ]
    sure = "DISCOVERED"
    facts = {
        "confirmed": [f"{x['how']}: {x['id']}" for x in entries if "inferred" not in x["how"]] + [f"{x['n']} {x['category']}" for x in inventory if x["n"]],
        "resolved": [x["what"] for x in sides if x["status"] == sure] + [f"{flow(p)} ({p['confidence']:.2f})" for p in paths], "inferred": layered + [f"{x['what']} ({x['status']})" for x in sides if x["status"] != sure],
        "unresolved": [x["what"] for x in outside] + [f"{flow(p)} does not end in a store" for p in paths if not p["store"]], "limitations": [x["what"] for x in risks if x["risk"] == "limitation"],
    }
    return {"answers": [{"question": q, "answer": a} for q, a in answers], "facts": facts}
