"""Every query of the library against its SQL on the smallest tables, and on empty ones."""

import glob
import math
import os

import duckdb
import pytest

from strandline.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, str):
        return v
    return round(float(v), 9)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(([plain(v) for v in r] for r in df.astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    have, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}


def test_rows_only(spark):
    for name in ("probe_logistic",):
        assert catalog.queries()[name](spark, DATA).count() > 0


def test_probe_searches_the_whole_grid(spark):
    assert sorted(r["c"] for r in catalog.queries()["probe_logistic"](spark, DATA).collect()) == [1e-3, 1e-2, 1e-1, 1.0, 10.0]


def test_documents_of_an_item_are_one_group(spark, duck):
    held = duck.execute("SELECT 'd' || doc_id, 'k' || item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall()
    of = {r["node"]: r["component"] for r in catalog.queries()["components_held"](spark, DATA).collect()}
    assert held and all(of[d] == of[k] for d, k in held)
    group = {r["window_id"]: r["group"] for r in catalog.queries()["split_by_hash_held"](spark, DATA).collect()}
    assert all(group[a] == group[b] for a, k in held for b, j in held if k == j) and len(group) == 200
    assert all(r["violations"] == 0 for r in catalog.queries()["leak_checks_held"](spark, DATA).collect())
