"""Exact duplicates by a stream's state, against brute force; new files, weak digests, hot groups."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from pricelake.llm import exact_dedup, oracle, queries

SCHEMA = "doc_id long, text string, digest string, _metadata string, file int, row int, n long"
TEXTS = ["a", "b", "a", None, "", "  ", "A", "a ", "x" * 300_000, "x" * 300_000, "x" * 299_999 + "y", "é", "é", "\0", "a", "z\n", "z"]


def save(spark, rows, path, files=2):
    spark.createDataFrame([(i, t, "d", "m", 1, 2, 3) for i, t in rows], SCHEMA).repartition(files).write.parquet(path)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, last[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr), len(groups)


def check(rows, result):
    got = result.collect()
    want, groups = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.length(t) % 3])
def test_groups(spark, tmp_path, digest):
    rows = [*enumerate(TEXTS), (3, "tie"), (3, "tie"), (None, "a"), (None, "none"), (None, "none"), (2**62, "z")]
    save(spark, rows, f"{tmp_path}/docs")
    check(rows, exact_dedup.duplicates(spark, f"{tmp_path}/docs", digest=digest))
    kept = exact_dedup.deduplicated(spark, f"{tmp_path}/docs", digest=digest)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t in rows})


def test_new_files_only_change_what_they_hold(spark, tmp_path):
    path, checkpoint = f"{tmp_path}/docs", f"{tmp_path}/state"
    first, second = [(1, "a"), (2, "b"), (9, "c")], [(3, "a"), (4, "d"), (5, "c")]
    save(spark, first, path, 1)
    before = {r["digest"]: tuple(r) for r in exact_dedup.remembered(spark, path, checkpoint).collect()}
    spark.createDataFrame([(i, t, "d", "m", 1, 2, 3) for i, t in second], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    after = {r["digest"]: tuple(r) for r in exact_dedup.remembered(spark, path, checkpoint).collect()}
    name = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert after[name("b")] == before[name("b")] and after[name("a")][1] == 3 and after[name("a")][4] == 2
    assert after[name("c")][1:4] == before[name("c")][1:4] and len(after) == 4
    check(first + second, exact_dedup.duplicates(spark, path, checkpoint))
    assert any(f.endswith((".zip", ".changelog")) for _, _, files in os.walk(f"{checkpoint}/state") for f in files)
    assert exact_dedup.remembered(spark, path, checkpoint).count() == 4  # no file is read twice


def test_large_group_and_single_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", 16)
    monkeypatch.setattr(exact_dedup, "HEAVY", 3)
    rows = [(i, "same" if i % 3 == 0 else f"text {i % 50}") for i in range(900)]
    save(spark, rows, f"{tmp_path}/docs", 1)
    (part,) = (f for f in os.listdir(f"{tmp_path}/docs") if f.endswith(".parquet"))
    check(rows, exact_dedup.duplicates(spark, f"{tmp_path}/docs/{part}"))


def test_empty_table_and_settings(spark, tmp_path):
    save(spark, [], f"{tmp_path}/docs", 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    made = exact_dedup.duplicates(spark, f"{tmp_path}/docs")
    assert made.count() == 0 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stores_take_no_disk_in_advance(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    seen, key = [], "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
    for kind, name in ((DataStreamWriter, "start"), (DataFrameReader, "load")):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), name=name, **k: (seen.append((name, spark.conf.get(key))), f(self, *a, **k))[1])
    save(spark, [(1, "a"), (2, "a")], f"{tmp_path}/docs", 1)
    before = spark.conf.get(key, "unset")
    assert exact_dedup.remembered(spark, f"{tmp_path}/docs", f"{tmp_path}/state").count() == 1
    assert ("start", "false") in seen and ("load", "false") in seen and spark.conf.get(key, "unset") == before


def test_query_is_native_and_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    made = queries.op11_exact_dedup(spark, d)
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    answer = con.execute(oracle.SQL["op11_exact_dedup"])
    assert [c[0] for c in answer.description] == made.columns
    assert sorted(map(tuple, made.collect())) == sorted(answer.fetchall())
