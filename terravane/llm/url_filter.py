"""URL filters, native: DataFrame functions only, training included.

Method: logistic regression on hashed character n-grams of host and path. The labelled URLs are turned into n-gram
indexes by the same expressions that score pages. Gradient descent runs as one nested aggregate over them: examples
with their n-grams, n-grams with their examples, both bounded by the table. Scoring is a projection without a shuffle;
the weights reach it as a scalar subquery of `DIM` + 1 doubles (1 MB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii

DIM, GRAM, EPOCHS, RATE, DECAY = 1 << 17, 4, 200, 2.0, 0.0002
#: The hash of four characters: a random multiplier each, and one number for hosts and paths each, modulo a prime.
MULTIPLIERS, PRIME = (1540483477, 668265263, 374761393, 2028178513), (1 << 31) - 1
HOST, PATH = 97, 1203793794

#: (pattern of the host and path, allow or block). Longest fitting rule wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Words of hosts that a crawl should leave out, and of others.
UNWANTED = """adult backlinks betting bingo bitcoin bonus cams casino cheap cialis clickbait crack credit dating discount doorway
escort followers forex free gambling giveaway hookup jackpot keygen lender loans lottery nude payday pharmacy pills poker porn prize
replica roulette serials sexy slots steroids streamz sweepstakes torrent viagra warez winner xxx""".split()
WANTED = """academy archive astronomy atlas biology botany bridge bulletin chemistry chess choir city climate college compiler
council courier cricket database docs energy farmers festival forest forum gallery gardens gazette geology grammar guide harbour
health history hospital island journal kitchen language law library magazine manual maps maths meadow medicine mountain museum
music nature news novel observatory ocean opera orchestra painting parish parliament philosophy physics poetry project railway
recipes research review rivers school science software station statistics teacher theatre theory tribune university valley
village weather wiki woodland""".split()
UNWANTED_PATHS = ("/buy/now", "/claim?id={i}", "/offer/{i}", "/{b}/{i}", "/win/{b}.html", "/go.php?x={i}")
WANTED_PATHS = ("/{b}/{i}", "/articles/{b}.html", "/en/{i}", "/fr/{i}.html", "/es/{i}/", "/de/{i}#top", "/2019/{b}", "/", "/page/{i}?page=2")


def labelled_urls(step: int = 7) -> list[tuple[str, int]]:
    """The labelled table, made by a rule: two words of one kind a host, three hosts a word; 1 for URLs to leave out."""
    out = []
    for kind, paths, label in ((UNWANTED, UNWANTED_PATHS, 1), (WANTED, WANTED_PATHS, 0)):
        for i, a in enumerate(kind):
            b, c = kind[(i * step + 3) % len(kind)], kind[(i * step + 11) % len(kind)]
            for k, host in enumerate((f"{a}-{b}.example.com", f"www.{a}{c}.example.net", f"{'blog' if i % 2 else 'm'}.{a}.example.org")):
                path = paths[(3 * i + k) % len(paths)].format(b=c, i=37 * i + k)
                out.append((f"http{'s' if (i + k) % 2 else ''}://{host}{path}", label))
    return out


LABELLED = labelled_urls()


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(text: Column, part: int) -> Column:
    """Indexes (1 to DIM) of the hashed n-grams of ^text$."""
    codes = F.transform(F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def index(i: Column, cs: Column) -> Column:
        return sum((F.element_at(cs, (i + k).cast("int")) * F.lit(m) for k, m in enumerate(MULTIPLIERS)), F.lit(part)) % PRIME % DIM + 1

    # transform over a one-element array binds the codes once
    return F.element_at(F.transform(F.array(codes), lambda cs: F.when(F.size(cs) < GRAM, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - (GRAM - 1), F.lit(1))), lambda i: index(i, cs).cast("int")))), 1)


def features(df: DataFrame, url_col: str) -> DataFrame:
    """Adds _host, _path and _grams: one array of indexes a URL."""
    d = df.withColumns({"_host": host_of(F.col(f"`{url_col}`")), "_path": path_of(F.col(f"`{url_col}`"))})
    return d.withColumn("_grams", F.concat(grams(F.col("_host"), HOST), grams(F.col("_path"), PATH)))


def margin(w: Column, g: Column) -> Column:
    """Mean weight of the n-grams, times 8, plus the intercept (the last weight)."""
    def of(v: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda s, i: s + F.element_at(v, i))
        return F.when(F.size(g) > 0, 8.0 * total / F.size(g)).otherwise(F.lit(0.0)) + F.element_at(v, DIM + 1)

    return F.element_at(F.transform(F.array(w), of), 1)  # binds the weights, which are not copied into rows


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> DataFrame:
    """One row, weights array<double> of DIM + 1. labelled is small by contract (bound 10,000 rows).

    Each example has its n-grams, with 8 / their number each, and the intercept with 1. Every epoch takes the errors of
    all examples, then moves each weight by the errors of the examples that have it.
    """
    ex = features(labelled, url_col).select(F.struct(F.col(url_col).alias("u"), F.col("_grams").alias("g"), F.col(label_col).cast("double").alias("y")).alias("e"))
    ex = ex.agg(F.array_sort(F.collect_list("e")).alias("ex")).select(F.size("ex").alias("n"), F.posexplode("ex").alias("i", "e"))
    each = F.transform("e.g", lambda x: F.struct(x.alias("at"), (8.0 / F.size("e.g")).alias("s")))
    own = F.array(F.struct(F.lit(DIM + 1).alias("at"), F.lit(1.0).alias("s")))
    has = ex.select("n", "i", F.col("e.y").alias("y"), F.explode(F.concat(each, own)).alias("f")).groupBy("n", "i", "y", "f.at").agg(F.sum("f.s").alias("s"))
    # Weights in use, in the order of their index; each with its examples, and each example with its weights.
    posts = has.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("post")).agg(F.array_sort(F.collect_list(F.struct("at", "post"))).alias("posts"))
    place = posts.select(F.posexplode("posts").alias("j", "p")).select("j", F.col("p.at").alias("at"))
    rows = has.join(place, "at").groupBy("n", "i", "y").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("f"))
    rows = rows.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("i", "y", "f"))).alias("ex"))

    def errors(w: Column) -> Column:
        return F.transform("ex", lambda e: e["y"] - 1.0 / (1.0 + F.exp(-F.aggregate(e["f"], F.lit(0.0), lambda s, x: s + F.element_at(w, x["j"] + 1) * x["s"]))))

    def epoch(w: Column) -> Column:
        def move(err: Column) -> Column:
            return F.transform(w, lambda x, j: x * (1.0 - DECAY) + RATE / F.col("n") * F.aggregate(F.element_at("posts", j + 1)["post"], F.lit(0.0), lambda s, p: s + F.element_at(err, p["i"] + 1) * p["s"]))

        return F.element_at(F.transform(F.array(errors(w)), move), 1)

    w0 = F.array_repeat(F.lit(0.0), F.size("posts"))
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), w0, lambda w, _: epoch(w))
    fitted = rows.crossJoin(posts).select(F.explode(F.arrays_zip(F.col("posts.at").alias("at"), fit.alias("w"))).alias("z")).select("z.at", "z.w")  # one row by one row
    every = labelled.sparkSession.range(1, DIM + 2).select(F.col("id").cast("int").alias("at"))
    dense = every.join(fitted, "at", "left").select(F.struct("at", F.coalesce("w", F.lit(0.0)).alias("w")).alias("z"))
    return dense.agg(F.transform(F.array_sort(F.collect_list("z")), lambda z: z["w"]).alias("weights"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, null where none fits. The rules are a parameter of bounded size."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, probability and verdict (the rule's, else block where the model's probability is 0.5 or more).

    Null URLs and those without :// have an empty host and path and are judged by the intercept and the n-grams of two
    empty strings. Rows keep their number; input columns named like an output column are replaced.
    """
    w = train(labelled).scalar()
    d = features(pages, url_col).withColumn("_w", w)  # referred to once, so the optimizer puts the subquery in its place
    p = 1.0 / (1.0 + F.exp(-margin(F.col("_w"), F.col("_grams"))))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    new = {"host": F.col("_host"), "path": F.col("_path"), "rule": rule, "probability": p}
    d = d.withColumns(new)
    d = d.withColumn("verdict", F.coalesce(verdict, F.when(F.col("probability") >= 0.5, "block").otherwise("allow")))
    return d.drop("_host", "_path", "_grams", "_w")


def labelled_table(spark) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labelled_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _reference_weights() -> list[float]:
    """The same training in plain Python over LABELLED: for the SQL check and the tests."""
    import math

    ex = []
    for url, y in sorted(LABELLED):
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:].split("?")[0].split("#")[0]
        g = []
        for s, part in ((host, HOST), (path, PATH)):
            codes = [ord(c) for c in f"^{s}$"]
            g += [(part + sum(codes[i + k] * m for k, m in enumerate(MULTIPLIERS))) % PRIME % DIM for i in range(len(codes) - GRAM + 1)]
        f = {DIM: 1.0}
        for i in g:
            f[i] = f.get(i, 0.0) + 8.0 / len(g)
        ex.append((f, float(y)))
    w = dict.fromkeys((i for f, _ in ex for i in f), 0.0)
    for _ in range(EPOCHS):
        move = dict.fromkeys(w, 0.0)
        for f, y in ex:
            err = y - 1.0 / (1.0 + math.exp(-sum(w[i] * s for i, s in f.items())))
            for i, s in f.items():
                move[i] += err * s
        w = {i: x * (1.0 - DECAY) + RATE / len(ex) * move[i] for i, x in w.items()}
    return [w.get(i, 0.0) for i in range(DIM + 1)]


def oracle() -> str:
    """DuckDB SQL: the rules and n-grams in SQL, the weights that are not 0 as a table from plain Python."""
    weights = _reference_weights()
    table = ", ".join(f"({i + 1}, {x!r}::DOUBLE)" for i, x in enumerate(weights[:DIM]) if x)
    cases = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    idx = lambda c, part: f"list_transform(range(1, len({c}) - {GRAM - 2}), lambda i: ({part} + {' + '.join(f'{c}[i + {k}] * {m}::BIGINT' for k, m in enumerate(MULTIPLIERS))}) % {PRIME} % {DIM} + 1)"
    return f"""
WITH r AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), f AS MATERIALIZED (
  SELECT *, CASE
{cases}
    ELSE NULL END AS rule,
    list_transform(string_split('^' || host || '$', ''), lambda c: unicode(c)) AS hc,
    list_transform(string_split('^' || path || '$', ''), lambda c: unicode(c)) AS pc
  FROM u
), g AS (
  SELECT rid, unnest(list_concat({idx('hc', HOST)}, {idx('pc', PATH)})) AS ix FROM f
), wt(ix, w) AS (
  VALUES {table}
), s AS (
  SELECT rid, 8.0::DOUBLE * sum(coalesce(w, 0)) / count(*) AS m FROM g LEFT JOIN wt USING (ix) GROUP BY rid
)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN 1.0 / (1.0 + exp(-(coalesce(m, 0) + {weights[DIM]!r}))) >= 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM f LEFT JOIN s USING (rid)
"""
