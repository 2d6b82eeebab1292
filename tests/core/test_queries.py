"""Every registered estate query against its SQL, over the smallest tables."""

import duckdb
import pytest

from terravane.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    return float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str(tuple(plain(r[cols.index(c)]) for c in sorted(cols))) for r in cur.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in sorted(cols))) for r in rows) == want
