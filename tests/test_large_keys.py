"""Queries against their SQL on few rows with keys that only large tables have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from pricelake.plans import retail as plans


def _check(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), folder / f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    made = plans.QUERIES[name](spark, str(folder))
    answer = con.execute(plans.SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(made.columns)
    want = sorted(map(repr, answer.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in made.collect()) == want
    return want


def test_store_metadata(spark, tmp_path):
    keys = [*range(9_990, 10_030), *range(53_290, 53_310), *range(123_450, 123_470)]
    assert len(_check(spark, tmp_path, "f24_store_metadata", supplier=[{"s_suppkey": k} for k in keys])) == len(keys)


def test_workbook_names_that_files_share(spark, tmp_path):
    """Files 1230 to 1239 are all P123.xlsx, as file 123 is: rows of all are there, and a name that failed is told once."""
    files = [3, 5, 123, *range(1228, 1242), 5999]
    part = [{"p_partkey": f * 200 + i, "p_name": f"thing {f}", "p_brand": "Brand#1", "p_type": "T", "p_size": 1, "p_retailprice": 9.5 + i} for f in files for i in (0, 1, 7)]
    want = _check(spark, tmp_path, "src11_workbook_rows", part=part)
    assert sum("P123.xlsx" in w and w.endswith("False)") for w in want) == 3 * 8 and sum("P123.xlsx" in w and w.endswith("True)") for w in want) == 1
