"""Operators on small tables, against results worked out by hand or by plain Python."""

from datetime import datetime
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelake.operators import basket, catalog, matching, operations, pricing


def test_hash_of_price_lists(spark):
    rows = [("s1", "A", 100, None), ("s1", "b", 200, 150), ("s2", "B", 200, 150), ("s2", "a", 100, None), ("s3", "a", 100, 0), ("s3", "b", 200, 150)]
    got = {r["store_id"]: r["price_hash"] for r in pricing.price_list_hashes(spark.createDataFrame(rows, "store_id string, item_id string, price long, discount_price long"), ["store_id"]).collect()}
    assert got["s1"] == got["s2"] != got["s3"] and len(got["s1"]) == 64


def test_hash_of_long_price_lists(spark):
    """Lists of many batches, in any order, null keys and prices among them, without a list's lines being gathered in a row."""
    import hashlib

    lines = [(None if s == 3 else f"s{s % 3}", f"I{(i * 7919) % 25_000:05d}", None if i % 97 == 0 else i % 50, None if i % 3 else i % 5) for s in range(4) for i in range(25_000 - s % 3)]
    frame = spark.createDataFrame(lines, "store_id string, item_id string, price long, discount_price long").repartition(7)
    made = pricing.price_list_hashes(frame, ["store_id"])
    want = {}
    for s in (None, "s0", "s1", "s2"):
        rows = sorted(((i.lower(), -1 if p is None else p, -1 if d is None else d) for k, i, p, d in lines if k == s))
        text = "\n".join(":".join([i, *([] if p < 0 else [str(p)]), "null" if d < 0 else str(d)]) for i, p, d in rows)
        want[s] = (hashlib.sha256(text.encode()).hexdigest(), len(rows))
    assert {r["store_id"]: (r["price_hash"], r["item_count"]) for r in made.collect()} == want
    assert "collect_list" not in made._jdf.queryExecution().toString()


def test_overrides(spark):
    prices = spark.createDataFrame([("s", "a", 1000, None), ("s", "b", 2000, 1500)], "store_id string, item_id string, price long, discount_price long")
    exceptions = spark.createDataFrame(
        [("s", "a", 800, None, datetime(2025, 1, 1)), ("s", "b", 1, None, datetime(2023, 1, 1)), ("s", "c", 5, None, datetime(2025, 1, 1))],
        "store_id string, item_id string, price long, discount_price long, expires_at timestamp",
    )
    got = {r["item_id"]: (r["price"], r["effective"], r["is_exception"]) for r in pricing.effective_prices(prices, exceptions, datetime(2024, 1, 1)).collect()}
    assert got == {"a": (800, 800, True), "b": (2000, 1500, False), "c": (5, 5, True)}
    listed = {r["item_id"]: (r["price"], r["is_exception"]) for r in pricing.price_listing(prices, exceptions, datetime(2024, 1, 1)).collect()}
    assert listed == {"a": (1000, True), "b": (2000, False)}


def test_intervals_and_as_of(spark):
    days = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (1, 4, None), (1, 5, "x")], "k int, d int, v string")
    made = pricing.membership_intervals(days, ["k"], "d", "v")
    assert [tuple(r) for r in made.orderBy("valid_from").collect()] == [(1, "x", 1, 3), (1, "y", 3, 4), (1, None, 4, 5), (1, "x", 5, None)]
    probes = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, 9)], "k int, at int")
    assert sorted((r["at"], r["v"]) for r in pricing.as_of(made, probes, ["k"]).collect()) == [(2, "x"), (3, "y"), (9, "x")]


def test_state_and_changes(spark):
    seen = spark.createDataFrame([("k", 1, 10, None), ("k", 2, 10, None), ("k", 3, 12, 11)], "k string, t int, price long, discount_price long")
    assert tuple(pricing.item_state(seen, ["k"], ["t"]).first()) == ("k", 12, 11, 10, 1, 3)
    old = spark.createDataFrame([("a", 10, None, 0), ("b", 5, None, 2)], "k string, price long, previous_price long, price_changes long")
    new = spark.createDataFrame([("a", 11), ("c", 7)], "k string, price long")
    got = {r["k"]: (r["price"], r["previous_price"], r["price_changes"]) for r in pricing.upsert_state(old, new, ["k"]).collect()}
    assert got == {"a": (11, 10, 1), "b": (5, None, 2), "c": (7, None, 0)}


def _basket(spark, lines, stores, prices):
    lines = spark.createDataFrame([(1, "c", i, q) for i, q in lines], "basket_id long, chain_slug string, item_id string, quantity long")
    table = spark.createDataFrame([(s, i, p) for (s, i), p in prices.items()], "store_id string, item_id string, effective long")
    averages = table.groupBy(F.lit("c").alias("chain_slug"), "item_id").agg(F.expr("sum(effective) div count(*)").alias("avg_price"))
    places = spark.createDataFrame([("c", s) for s in stores], "chain_slug string, store_id string")
    return basket.offers(basket.penalised_lines(lines, averages), places, table)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.sampled_from("wxyz"), st.sampled_from("abcd")), st.integers(1, 50), min_size=6, max_size=16))
def test_searches_against_plain_python(spark, prices):
    lines = [("a", 2), ("b", 1), ("c", 3), ("d", 1)]
    offer = _basket(spark, lines, "wxyz", prices).cache()
    chosen = basket.candidates(basket.single_store(offer)).cache()
    stores = sorted(r["store_id"] for r in chosen.collect())
    cost = {s: {i: prices[s, i] * q for i, q in lines if (s, i) in prices} for s in stores}
    single = {r["store_id"]: (r["n_found"], r["real_total"]) for r in basket.single_store(offer).collect()}
    assert all(single[s] == (len(cost[s]), sum(cost[s].values())) for s in stores)
    greedy = {r["item_id"]: (r["store_id"], r["line_total"]) for r in basket.greedy(offer, chosen).collect()}
    for i, _ in lines if stores else []:
        sold = [(cost[s][i], s) for s in stores if i in cost[s]]
        assert greedy[i] == ((min(sold)[1], min(sold)[0]) if sold else (None, None))
    best = basket.exhaustive(offer, chosen).collect()
    if not stores:
        assert not best
        return
    tried = []
    for n in (1, 2, 3):
        for some in combinations(range(len(stores)), n):
            found = [min((cost[stores[k]][i] for k in some if i in cost[stores[k]]), default=None) for i, _ in lines if any(i in cost[s] for s in stores)]
            tried.append((-sum(f is not None for f in found), sum(f or 0 for f in found), n, [k + 1 for k in some]))
    want = min(tried)
    assert (best[0]["n_found"], best[0]["total"], best[0]["n_stores"], best[0]["places"]) == (-want[0], want[1], want[2], want[3])


def test_penalties_and_ranks(spark):
    offer = _basket(spark, [("a", 1), ("b", 1), ("c", 1)], "xyz", {("x", "a"): 30, ("x", "b"): 30, ("x", "c"): 40, ("y", "a"): 20, ("y", "b"): 20, ("z", "c"): 20})
    ranked = basket.ranked_stores(basket.single_store(offer)).orderBy("rank").collect()
    assert [(r["store_id"], r["n_found"], r["coverage_bin"]) for r in ranked][0] == ("x", 3, 4)
    assert {r["store_id"]: r["sorting_total"] for r in ranked}["y"] == 40 + 2 * 30


def test_barcodes_and_decisions(spark):
    items = spark.createDataFrame(
        [("1", "3850012345678", "mlijeko", "dukat", "l", "1", None, ""), ("2", "3850012345678", "mlijeko", "z bregov", "l", "1", None, ""), ("3", "1234567890128", "kruh", None, "g", "500", "x", "pekara"), ("4", "000", "x", None, "g", "1", None, "")],
        "item_id string, barcode string, name string, brand string, unit string, unit_quantity string, image_url string, category string",
    )
    groups = matching.barcode_groups(items)
    sanity = {r["code"]: r["sanity"] for r in matching.barcode_sanity(groups).collect()}
    assert sanity == {"3850012345678": "brand_conflict", "1234567890128": "ok"}
    assert {r["code"]: r["item_id"] for r in matching.canonical_items(groups, F.lit(5)).collect()}["3850012345678"] == "1"
    best = spark.createDataFrame([("a", 0.96, False), ("b", 0.96, True), ("c", 0.85, False), ("d", 0.5, False), ("e", None, False)], "item string, similarity double, conflict boolean")
    got = {r["item"]: r["decision"] for r in matching.decisions(best, F.col("conflict")).collect()}
    assert got == {"a": "auto_link", "b": "review", "c": "review", "d": "no_match", "e": "no_match"}


def test_review_and_transitions(spark):
    queue = spark.createDataFrame([("a", "pending", 1), ("b", "pending", 2), ("c", "linked", 1)], "item string, status string, version long")
    made = spark.createDataFrame([("a", "approved", 1), ("b", "approved", 1), ("c", "approved", 1)], "item string, decision string, version long")
    assert sorted(tuple(r) for r in matching.reviewed(queue, made).collect()) == [("a", "approved", 2), ("b", "pending", 2), ("c", "linked", 1)]
    stores = spark.createDataFrame([("a", None), ("b", "a"), ("c", None)], "store_id string, price_source_store_id string")
    merged = operations.merged_stores(stores, spark.createDataFrame([("a", "c")], "store_id string, into string"))
    assert sorted(tuple(r) for r in merged.collect()) == [("b", "c"), ("c", None)]


def test_validation_and_queue(spark):
    rows = spark.createDataFrame([("a", 10, 20), (" ", 0, None), (None, 200_000_000, None)], "name string, price long, discount_price long")
    checked = operations.validated(rows)
    assert [(r["errors"], r["warnings"], r["is_valid"]) for r in checked.collect()] == [
        ([], ["discount_not_lower"], True), (["missing_name", "invalid_price"], [], False), (["missing_name"], ["large_price"], False),
    ]
    assert operations.quarantine(checked).count() == 2
    now = datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(1, 0, 3, now), (2, 3, 3, now)], "task_id int, retry_count int, max_retries int, scheduled_for timestamp")
    assert [(r["status"], r["retry_count"], r["scheduled_for"]) for r in operations.retried(tasks, now).orderBy("task_id").collect()] == [("pending", 1, datetime(2024, 1, 1, 0, 1)), ("failed", 3, now)]


def test_search_escapes_wildcards(spark):
    items = spark.createDataFrame([("1", "100% juice", "b", "c"), ("2", "1000 juice", "b", "c")], "item_id string, name string, brand string, chain_slug string")
    state = spark.createDataFrame([("1", "s", 100), ("1", "t", 201)], "item_id string, store_id string, price long")
    assert [tuple(r) for r in catalog.item_search(items, state, "00% j").collect()] == [("1", "100% juice", "b", 150, 2)]
    with pytest.raises(ValueError):
        catalog.item_search(items, state, "ab")


def test_trigram_search_in_blocks(spark, monkeypatch):
    from pricelake.operators import matching

    names = ["Milk whole 1l", "milk WHOLE 1 l", "Whole milk", "šećer", "Secer 1kg", "", "!!", None, "x", "bread", "bread white", "white bread", "b" * 500]
    frame = spark.createDataFrame(list(enumerate(names)), "id int, text string")

    def grams(text):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    def want(most):
        out = set()
        for a, x in enumerate(names):
            rows = [(len(grams(x) & grams(y)) / len(grams(x) | grams(y)), b) for b, y in enumerate(names) if grams(x) and grams(y)]
            out |= {(a, b, r, round(s, 9)) for r, (s, b) in enumerate(sorted((r for r in rows if r[0] > 0.1), key=lambda r: (-r[0], r[1]))[:most], 1)}
        return out

    ascii_only = frame.where("text IS NULL OR text NOT LIKE 'š%'")
    expected = {most: {row for row in want(most) if 3 not in row[:2]} for most in (2, 200)}
    for sizes in ((4096, 16384), (3, 2)):
        monkeypatch.setattr(matching, "LEFT_BLOCK", sizes[0])
        monkeypatch.setattr(matching, "RIGHT_BLOCK", sizes[1])
        got = {(r["a"], r["b"], r["rank"], round(r["similarity"], 9)) for r in matching.trigram_matches(ascii_only, ascii_only).collect()}
        assert got == expected[200]
    best = {(r["a"], r["b"]) for r in matching.trigram_matches(ascii_only, ascii_only, most=1).collect()}
    assert best == {(a, b) for a, b, r, _ in expected[2] if r == 1}
    assert matching.trigram_matches(frame.limit(0), frame).count() == 0 and matching.trigram_matches(frame, frame.limit(0)).count() == 0


def test_retrieval_metrics(spark):
    from pricelake.operators import matching

    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1), (2, 7, 2), (4, 1, 1)], "query int, candidate int, rank long")
    truth = spark.createDataFrame([(1, 7), (1, 5), (2, 7), (3, 1)], "query int, candidate int")
    assert tuple(matching.retrieval_metrics(ranked, truth, k=2).first()) == (3, 0.333333, 0.5, 0.666667, 0.333333, 0.5)


def test_trigram_search_holds_no_pair_of_blocks(spark):
    """Nothing is dealt by pairs of blocks: the left side is shuffled once, without keys, and the ranks come from the task."""
    frame = spark.createDataFrame([(i, f"name {i} of {i % 7}") for i in range(300)], "id long, text string")
    made = matching.trigram_matches(frame, frame, most=3)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Repartition") == 1
    rows = made.collect()
    assert len(rows) == 900 and all(r["a"] == r["b"] or r["rank"] > 1 or r["similarity"] == 1.0 for r in rows)


def test_rerank_by_cosine(spark):
    """Vectors of different lengths, zero vectors and missing ones have 0; equal similarities are by id."""
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [4.0, 0.0]), (4, [1.0, 1.0]), (5, [1.0]), (6, [0.0, 0.0]), (7, None)], "id long, vector array<double>")
    pairs = spark.createDataFrame([(1, c) for c in (7, 6, 5, 4, 3, 2)], "item long, candidate long")
    got = matching.reranked(pairs, vectors, 6).orderBy("rank").collect()
    assert [(r["candidate"], round(r["similarity"], 6)) for r in got] == [(2, 1.0), (3, 1.0), (4, 0.707107), (5, 0.0), (6, 0.0), (7, 0.0)]
