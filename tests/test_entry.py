import os

import duckdb
import pytest

import __spark_entry__ as entry
from motifline import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_flagship(spark):
    assert entry.entry(spark).first()[0] == 22489


def test_registry():
    assert set(catalog.oracle_sql()) == set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["count_square", "nlf_filter", "frontier_classify", "multi_query_shared_counts", "minhash_signature", "adjacency_rows"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    heads = [d[0] for d in con.description]
    assert sorted(heads) == cols
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(dict(zip(heads, r))[c] for c in cols) for r in want)
