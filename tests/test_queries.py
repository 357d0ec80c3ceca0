"""Every query with SQL, against DuckDB on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def _names():
    from pricelake.plans import retail as plans

    return sorted(plans.SQL)


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(spark, name):
    import duckdb

    from pricelake.plans import retail as plans

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    made = plans.QUERIES[name](spark, DATA)
    columns = sorted(made.columns)
    got = sorted(repr([_value(r[c]) for c in columns]) for r in made.collect())
    answer = con.execute(plans.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(repr([_value(r[names.index(c)]) for c in columns]) for r in answer.fetchall())
    assert got == want
