"""What the queries over source trees cost: each file is parsed once, by as many tasks as the cluster runs."""

import pytest

from terravane.queries import QUERIES
from terravane.sources import java

from .test_queries import DATA


@pytest.mark.parametrize("name", ["extract_java", "extract_ada", "extract_ddl", "extract_config", "extract_build"])
def test_files_are_parsed_once_and_by_many_tasks(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_lines_and_columns_of_tokens():
    got = [(t.text, t.line, t.col, t.end) for t in java.lex('a /* x\n */ b"s\\\nt" c\n"""q\nr""" /d')]
    assert got == [("a", 1, 1, 1), ("b", 2, 5, 2), ('"s\\\nt"', 2, 6, 3), ("c", 3, 4, 3), ('"""q\nr"""', 4, 1, 5), ("/", 5, 6, 5), ("d", 5, 7, 5)]
    for bad in ("a \x00\ud800 /* b", "'", 'a "b\n"', "x /*"):
        with pytest.raises(java.Malformed):
            java.lex(bad)
