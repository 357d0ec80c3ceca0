"""Archives, expiry, reprocessing and runs over several batches and days."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from pricelake.operators import pricing, runs
from pricelake.sources.archive import Archive
from pricelake.streaming import expiry

T = datetime(2024, 1, 1)


def test_archive(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame([(c, u, None if b is None else bytearray(b)) for c, u, b in rows], "chain_slug string, url string, content binary")
    kept = Archive(spark, str(tmp_path / "a"))
    one, two, three = ("k", "https://x.example/d/one.csv?v=1", b"1"), ("k", "https://x.example/two.zip", b"2"), ("m", "https://x.example/three.xml", b"1")
    assert kept.rows().count() == 0 and kept.store(made(one, three, ("k", "u", None)), date(2024, 1, 5)) == 1
    assert kept.store(made(one, three), date(2024, 1, 5)) == 0 and kept.store(made(one, two), date(2024, 1, 5)) == 1
    assert kept.store(made(("m", "https://x.example/new.csv", b"3"), two), date(2024, 1, 6)) == 1
    rows = {r["archive_key"]: (r["bytes"], bytes(r["content"]), r["day"].day) for r in kept.rows().collect()}
    assert rows == {"archives/k/2024/01/05/one.csv": (1, b"1", 5), "archives/k/2024/01/05/two.zip": (1, b"2", 5), "archives/m/2024/01/06/new.csv": (1, b"3", 6)}


def test_expiry_over_batches_equals_the_purge(spark, tmp_path):
    schema = "store string, item long, at timestamp, until timestamp"
    hour = lambda h: T + timedelta(hours=h)
    batches = [
        [("a", 1, hour(0), hour(5)), ("a", 2, hour(0), hour(50)), ("b", 1, hour(1), None), ("a", 1, hour(2), hour(4))],
        [("a", 1, hour(6), hour(30)), ("b", 1, hour(7), hour(8)), ("a", 2, hour(7), None), ("c", 9, hour(8), hour(8)), ("a", 1, hour(3), hour(4))],
        [("d", 1, hour(40), hour(60)), ("a", 2, hour(40), hour(41))],
        [("e", 1, hour(90), hour(95))],
    ]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with expiry.keeping_state(spark):
            query = expiry.expired(stream, ["store", "item"], "at", "until").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(300)
        assert number or query.exception() is None
    got = sorted((r["store"], r["item"], (r["expired_at"] - T) // timedelta(hours=1)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, 4), ("a", 1, 30), ("a", 2, 41), ("b", 1, 8), ("c", 9, 8), ("d", 1, 60)]
    left = expiry.purged(spark.read.parquet(str(tmp_path / "in")), ["store", "item"], "at", "until", hour(89)).collect()
    assert [(r["store"], r["item"]) for r in left] == [("e", 1)]


def test_reprocess(spark, tmp_path):
    rows = [("1", "k", '{"Naziv":"Sol","MPC":"1,20"}', True), ("2", "k", '{"Naziv":"","MPC":"1,20"}', True), ("3", "k", "broken", True), ("4", "k", '{"name":"A","mpc":"2"}', False), ("5", "k", None, True)]
    failed = spark.createDataFrame(rows, "id string, chain_slug string, raw_data string, reprocessable boolean")
    ids = spark.createDataFrame([(str(i),) for i in (1, 2, 3, 4, 5, 5, 9)], "id string")
    made = runs.reprocess(spark, failed, ids, {"name": ("name", "naziv"), "price": ("mpc",), "discount_price": ("x",)}, str(tmp_path / "r"), T)
    assert [(r["id"], r["name"], r["price"], r["reprocessable"], r["reprocessed_at"]) for r in made.mended.collect()] == [("1", "Sol", 120, False, T)]
    assert {r["id"]: r["errors"] for r in made.still_bad.collect()} == {"2": ["missing_name"], "3": ["missing_name", "invalid_price"], "5": ["missing_name", "invalid_price"]}
    (run,) = made.run.collect()
    assert (run["source"], run["status"], run["total_entries"], run["good_entries"]) == ("reprocess", "running", 4, 1)
    none = runs.reprocess(spark, failed, ids.limit(0), {"name": ("name",), "price": ("mpc",), "discount_price": ("x",)}, str(tmp_path / "n"), T)
    assert none.run.count() == 0 and none.mended.count() == 0


def test_runs_followed_over_batches(spark, tmp_path):
    known = spark.createDataFrame([(1, "running", 2), (2, "running", 2), (3, "failed", 1), (4, "running", 0), (5, "running", 3)], "run_id long, status string, total_files long")
    schema = "run_id long, file_id string, status string, entries long, finished_at timestamp"
    for batch in ([(1, "a", "processed", 5, T), (1, "b", "pending", 0, None), (2, "a", "processed", 1, T)], [(1, "b", "failed", 2, T + timedelta(hours=1)), (3, "a", "processed", 1, T), (4, "a", "processed", 4, T)], [(2, "a", "processed", 7, T)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = runs.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), known, str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination(120)
    rows = runs.followed(spark, known, str(tmp_path / "out"))
    got = {r["run_id"]: (r["status"], r["processed_files"], r["processed_entries"]) for r in rows.collect()}
    assert got == {1: ("completed", 2, 7), 2: ("running", 1, 7), 3: ("failed", 1, 1), 4: ("running", 1, 4), 5: ("running", 0, 0)}
    after = {r["run_id"]: (r["status"], r["completed_at"]) for r in runs.swept(rows, T + timedelta(days=1)).collect()}
    assert after[1] == ("completed", T + timedelta(hours=1)) and after[2] == after[5] == ("interrupted", T + timedelta(days=1)) and after[3][0] == "failed"


def test_changes_over_batches(spark, tmp_path):
    from pricelake.streaming import ingest

    schema, path, keys = "store long, item long, day int, price long", str(tmp_path / "changes"), ["store", "item"]
    batches = [[(1, 1, 5, 10), (1, 1, 4, 9), (2, 1, 5, 20), (3, None, 1, 1)], [(1, 1, 3, 8), (2, 1, 6, 21)], [(1, 1, 5, 11), (4, 1, 1, 1)]]
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.write_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "c"), keys, ["day"]).awaitTermination(120)
        assert spark.read.parquet(f"{path}/batch={number}").count() == len({r[:2] for r in rows})
    want = {(1, 1, 5, 11), (2, 1, 6, 21), (3, None, 1, 1), (4, 1, 1, 1)}
    assert set(map(tuple, ingest.current(spark, path, keys, ["day"]).collect())) == want
    ingest.compacted(spark, path, str(tmp_path / "one"), keys, ["day"])
    assert set(map(tuple, ingest.current(spark, str(tmp_path / "one"), keys, ["day"]).collect())) == want


def test_clusters_and_coverage(spark):
    rows = [("k", s, i, p) for s, items in {"a": "xy", "b": "yx", "c": "xyz", "d": "z"}.items() for p, i in enumerate(sorted(items))]
    prices = spark.createDataFrame(rows, "chain_slug string, store_id string, item_id string, price long")
    assert tuple(pricing.signature_clusters(prices).first()) == ("k", 4, 3, 0.5)
    got = {r["store_id"]: (r["items"], r["coverage"], r["mean_spread"]) for r in pricing.assortment_coverage(prices).collect()}
    assert got == {"a": (2, 0.666667, 0.75), "b": (2, 0.666667, 0.75), "c": (3, 1.0, 0.666667), "d": (1, 0.333333, 0.5)}
    assert pricing.signature_clusters(prices.where(F.lit(False))).count() == 0
