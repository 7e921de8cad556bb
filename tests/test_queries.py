"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from corpusflow.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(rows, order):
    return sorted((tuple(None if r[i] is None or r[i] != r[i] else str(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        found = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert len(rows) == len(expected := found.fetchall())
        by = sorted(columns)
        assert shown(rows, [df.columns.index(c) for c in by]) == shown(expected, [columns.index(c) for c in by])


@pytest.mark.parametrize("name", ["page_extraction", "text_extraction"])
def test_extraction_is_spread_over_the_cores(spark, name):
    """A file of one row group is one split; its rows are extracted in several tasks all the same."""
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    sizes = QUERIES[name](spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) > 4 and max(sizes) * 4 < sum(sizes)


def test_lexical_overlap_lists_every_pair(spark, db):
    """All pairs with a common token, also of queries that have more than a search would fetch."""
    pairs = QUERIES["lexical_overlap"](spark, SF).groupBy("query_id").count().agg({"count": "max"}).first()[0]
    assert pairs == db.execute(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({ORACLE_SQL['lexical_overlap']}) GROUP BY query_id)").fetchone()[0] and pairs > 30


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
