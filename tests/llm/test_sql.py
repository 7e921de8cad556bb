"""Every query of this subpackage that has SQL against it on the smallest tables."""

import glob
import os

import pytest

from corpusflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, found = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    assert columns == sorted(df.columns)
    expected = [dict(zip((c[0] for c in found.description), r, strict=True)) for r in found.fetchall()]
    shown = lambda rows: sorted(tuple(str(r[c]) for c in columns) for r in rows)
    assert shown(r.asDict(recursive=True) for r in df.collect()) == shown(expected)
