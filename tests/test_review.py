"""Decisions on queues and stores: order, versions, refusals."""

from datetime import datetime

from pricelake.operators import enrichment, review

NOW = datetime(2024, 1, 1)
ACTIONS = "action_id int, queue_id int, action string, product int, version int, user string, reason string"


def test_reviewed(spark):
    queue = spark.createDataFrame([(1, 10, "pending", 0, None), (2, 20, "pending", 0, 7), (3, 30, "approved", 0, 1), (4, 40, "pending", 3, None), (5, 50, "pending", 0, None)], "queue_id int, item int, status string, version int, linked_product int")
    candidates = spark.createDataFrame([(10, 5, 1), (10, 6, 2), (20, 9, 1), (40, 8, 2)], "item int, candidate int, rank int")
    rows = [
        (1, 1, "reject", 6, 0, "a", None), (2, 1, "reject", 6, 0, "b", "why"), (3, 1, "approve", None, 0, "a", None), (4, 1, "reject", 5, 0, "a", None),  # two rejections of one product, approved, then too late
        (5, 2, "approve", None, 0, "a", None), (6, 3, "approve", 1, 0, "a", None), (7, 4, "approve", None, 3, "a", None), (8, 4, "reject", None, 2, "a", None), (9, 5, "reject", 4, 0, "a", None), (10, 9, "approve", 1, 0, "a", None), (11, 4, "other", 1, 3, "a", None),
    ]
    made = review.reviewed(queue, candidates, spark.createDataFrame(rows, ACTIONS), NOW)
    after = {r["queue_id"]: (r["status"], r["version"], r["linked_product"], r["decision"]) for r in made.queue.collect()}
    assert after == {1: ("approved", 1, 5, "linked"), 2: ("approved", 1, 7, "linked"), 3: ("approved", 0, 1, None), 4: ("pending", 3, None, None), 5: ("rejected", 1, None, "no_match")}
    assert {tuple(r) for r in made.links.collect()} == {(10, 5, "manual"), (20, 7, "manual")}
    assert {tuple(r) for r in made.rejections.collect()} == {(10, 6, "rejected", "a"), (50, 4, "rejected", "a")}
    assert {r["action_id"]: r["action"] for r in made.audit.collect()} == {1: "rejected_candidate", 2: "rejected_candidate", 3: "approved", 5: "approved", 9: "rejected_candidate"}
    refused = {r["action_id"]: r["reason"] for r in made.refused.collect()}
    assert refused == {4: "modified by another user", 6: "already processed", 7: "no product", 8: "modified by another user", 10: "modified by another user", 11: "unknown action"}


def test_stores_after(spark):
    stores = spark.createDataFrame([("a", "pending", None, 1), ("b", "active", "a", 1), ("c", "active", "d", 1), ("d", "active", None, 1), ("e", "pending", None, 1)], "store_id string, status string, price_source_store_id string, version int")
    rows = [(1, "a", "approve", None, 1), (2, "a", "reject", None, 1), (3, "d", "merge", "b", 1), (4, "b", "link", "d", 0), (5, "e", "link", "e", 0), (6, "e", "reject", None, 1), (7, "c", "approve", None, 1), (8, "x", "reject", None, 1), (9, "b", "unlink", None, 0)]
    after, told = review.stores_after(stores, spark.createDataFrame([(*r, "u") for r in rows], "action_id int, store_id string, action string, other string, version int, user string"), NOW)
    assert {r["store_id"]: (r["status"], r["price_source_store_id"], r["version"]) for r in after.collect()} == {"a": ("active", None, 2), "b": ("active", None, 2), "c": ("active", "b", 2)}
    assert {r["action_id"]: r["refused"] for r in told.collect() if r["refused"]} == {2: "modified by someone else", 4: "other store is taken away", 5: "a store and itself", 7: "not pending", 8: "store not found"}


def test_place_confidence(spark):
    rows = [("N", "house", None, None, "high"), ("W", "house", None, "Split", "low"), ("W", "road", None, None, "medium"), ("W", "city", "Novi Split", "split", "medium"), (None, None, None, "x", "low"), ("N", "city", "Zadar", "", "low")]
    frame = spark.createDataFrame(rows, "t string, v string, f string, w string, want string")
    got = frame.select(enrichment.place_confidence(frame["t"], frame["v"], frame["f"], frame["w"]).alias("c"), "want").collect()
    assert all(r["c"] == r["want"] for r in got)
