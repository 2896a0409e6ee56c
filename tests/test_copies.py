"""Queries on tables that hold copies with shifted keys, against their SQL."""

import os

import duckdb
import pytest
from test_queries import DATA, rows

from strandline.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Lineitem, and a copy of it whose intervals all lie past the made-up chromosomes' ends; documents, and ids beyond a copy's."""
    at, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    con.execute(f"COPY (SELECT l.* REPLACE (l_partkey + i * 20000 AS l_partkey, l_suppkey + i * 1000 AS l_suppkey) FROM '{DATA}/lineitem.parquet' l, range(2) r(i) WHERE l_orderkey % 5 = 0) TO '{at}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["interval_gaps", "background_tiles", "extract_background", "extract_transposons", "extract_positives"])
def test_names_without_an_interval_in_their_span(spark, copies, name):
    at, con = copies
    have, want = catalog.queries()[name](spark, at).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert len(want) and rows(have) == rows(want[have.columns])


def test_only_chunks_under_windows_are_made(spark):
    from pyspark.sql import functions as F

    from strandline.operators.extraction import with_sequence

    asked = []

    def made(needed):
        asked.append(needed)
        return needed.withColumn("seq", F.repeat(F.col("name"), 10))

    windows = spark.createDataFrame([("a", 5, 15), ("a", 8, 12), ("b", 900, 910), ("x", 0, 10)], "chrom string, start long, end long")
    lengths = spark.createDataFrame([("a", 100), ("b", 100)], "chrom string, length long")
    out = with_sequence(windows, lengths, made, 10).collect()
    assert {(r["chrom"], r["start"]): r["seq"] for r in out} == {("a", 5): "a" * 10, ("a", 8): "a" * 4, ("b", 900): "", ("x", 0): ""}
    assert sorted(tuple(r) for r in asked[0].collect()) == [("a", 0), ("a", 1)]
