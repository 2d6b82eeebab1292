import duckdb

from terravane.llm import url_filter as uf

URLS = [
    "http://Cheap-Pills.example.com/buy", "https://a.example.org/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "https://www.shop.com/fr/", "https://shop.com/de/x#a", "https://shop.com", "nothing here", None, "", "://", "http://x.org/a://b",
    "ftp://notorg/", "http://org/", "http://ORG.:80/?a", "https://xn--é.net/ü/" + "p" * 3000, "https://thering.example.net/en/770",
]


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df, uf.labelled_table(spark)).collect()}
    assert got[0][:3] == ("cheap-pills.example.com", "/buy", None) and got[0][3] == "block"
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][1:] == ("/de/x", "com/de/", "block")
    assert got[6][:3] == ("shop.com", "", None) and got[7][:2] == ("", "") and got[8][:2] == ("", "")
    assert got[11][:2] == ("x.org", "/a://b") and got[12][2] is None and got[13][2] == "org/"
    assert got[16][3] == "allow" and len(got) == len(URLS)


def test_training_equals_plain_python(spark):
    w = uf.train(uf.labelled_table(spark)).first().weights
    assert max(abs(a - b) for a, b in zip(w, uf._reference_weights(), strict=True)) < 1e-9


def test_labelled_table_is_learned(spark):
    df = spark.createDataFrame([(u, y) for u, y in uf.LABELLED], "url string, label int")
    wrong = [r for r in uf.judge(df, uf.labelled_table(spark), rules=()).collect() if (r.verdict == "block") != (r.label == 1)]
    assert not wrong


def test_sql_twin_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(str, map(tuple, uf.op9_url_filters(spark, str(tmp_path)).collect()))) == sorted(map(str, con.execute(uf.oracle()).fetchall()))
    assert uf.judge(df, uf.labelled_table(spark)).columns.count("host") == 1


def test_empty(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string"), uf.labelled_table(spark)).count() == 0


def test_hosts_that_are_not_in_the_table(spark):
    seen = {u.split("/")[2] for u, _ in uf.LABELLED}
    new = [(u, y) for u, y in uf.labelled_urls(13) if u.split("/")[2] not in seen]
    assert len(new) > 200 and len({u for u, _ in uf.LABELLED}) == len(uf.LABELLED) > 300
    got = uf.judge(spark.createDataFrame(new, "url string, label int"), uf.labelled_table(spark), rules=()).collect()
    assert sum((r.verdict == "block") == (r.label == 1) for r in got) / len(got) >= 0.95
