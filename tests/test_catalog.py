import importlib
import os

import duckdb
import pytest

entry_point = importlib.import_module("__spark_entry__")
DATA = "/root/testdata/sf0.001"
FAST = ["normalize_text", "canonical_urls", "category_counts", "ingredient_topk", "lexical_topk", "strict_linkage", "distinctiveness", "round_robin", "json_fields", "coverage", "hybrid_search", "ingested", "rate_limit", "facts", "steps", "source_linkage"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")


def test_entry(spark):
    assert 0 < entry_point.entry(spark).count() <= 10


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", FAST)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    rel = con.execute(entry_point.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    got = entry_point.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want
