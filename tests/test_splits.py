"""Splits of whole baskets in packed columns, against the row-wise operators and by their plan."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricelake.operators import basket, pricing, splits
from pricelake.plans import retail as plans

DATA, NOW = "/root/testdata/sf0.001", datetime(2024, 1, 1)


def _rows(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


@pytest.mark.parametrize("small", [False, True])
def test_like_the_row_wise_operators(spark, monkeypatch, small):
    """Two chains, lists that lack items, exceptions that add items or have run out, a basket of over ten lines, unknown items, equal totals."""
    if small:
        for name, value in (("PACKED", 7), ("BUCKET", 20), ("NUMBERS", 50)):
            monkeypatch.setattr(splits, name, value)
    dice = random.Random(3)
    stores = [(c, f"{c}{i:02d}", f"{c}-{i % 3}") for c, n in (("p", 13), ("q", 4)) for i in range(n)]
    items = [f"i{k:02d}" for k in range(14)]
    prices = [(c, f"{c}-{t}", i, dice.randint(1, 6), dice.choice([None, None, 0, 2, 9])) for c in "pq" for t in range(3) for i in items if dice.random() < 0.8]
    extra = [(s, i, dice.randint(1, 6), None, datetime(2030 if dice.random() < 0.7 else 2020, 1, 1)) for _, s, _ in stores for i in [*items, "new"] if dice.random() < 0.15]
    lines = [(b, "pq"[b % 2], i, dice.randint(1, 3)) for b in range(60) for i in dice.sample([*items, "new", "none"], 12 if b % 9 == 0 else dice.randint(1, 5))]
    make = spark.createDataFrame
    stores = make(stores, "chain_slug string, store_id string, group_id string")
    prices = make(prices, "chain_slug string, group_id string, item_id string, price long, discount_price long")
    extra = make(extra, "store_id string, item_id string, price long, discount_price long, expires_at timestamp")
    count, lines = len(lines), make(lines, "basket_id long, chain_slug string, item_id string, quantity long")
    offer = basket.offers(
        basket.penalised_lines(lines, pricing.chain_item_averages(prices)), stores, pricing.effective_prices(stores.join(prices, ["chain_slug", "group_id"]), extra, NOW)
    ).cache()
    chosen = basket.candidates(basket.single_store(offer)).cache()
    greedy, best = basket.greedy(offer, chosen), basket.exhaustive(offer, chosen)
    got = {what: splits.splits(lines, stores, prices, extra, NOW, what, count) for what in ("greedy", "best", "split")}
    assert _rows(got["greedy"]) == _rows(greedy) and greedy.where("store_id IS NULL").count() > 0
    assert _rows(got["best"]) == _rows(best.select(*got["best"].columns))
    optimal = best.select("basket_id", "n_found", "n_stores", F.col("total").alias("sorting_total"), F.lit("optimal").alias("algorithm"))
    rest = basket.allocation_totals(greedy).join(best.select("basket_id"), "basket_id", "left_anti")
    assert rest.count() > 0
    assert _rows(got["split"]) == _rows(optimal.union(rest.select("basket_id", "n_found", "n_stores", "sorting_total", F.lit("greedy"))))


@pytest.mark.parametrize("name", ["bo6_multi_greedy", "bo7_multi_exhaustive", "bo8_best_split"])
def test_no_line_is_a_row_for_each_store(spark, name):
    """What is shuffled doesn't grow with the number of stores, and sets of candidates are no rows."""
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.count("MapInArrow") == 2
