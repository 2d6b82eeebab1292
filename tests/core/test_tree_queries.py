"""Extractors, linker, rules and views over trees made from tables, each against its SQL."""

import pytest

import terravane.tree_queries as tq
from terravane.queries import ORACLES, QUERIES
from tests.core.test_queries import DATA, con, plain  # noqa: F401


@pytest.mark.parametrize("name", [n for n, f in QUERIES.items() if f.__module__ == tq.__name__])
def test_tree_query_equals_sql(spark, con, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str(tuple(plain(r[cols.index(c)]) for c in sorted(cols))) for r in cur.fetchall())
    got = sorted(str(tuple(plain(r[c]) for c in sorted(cols))) for r in df.collect())
    assert got and got == want
