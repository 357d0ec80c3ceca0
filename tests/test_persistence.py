"""Histories kept day by day against all days at once, reruns, failed days."""

from datetime import date

import pytest

from pricelake.operators.persistence import PriceHistory

ROWS = "chain_slug string, store_id string, item_id string, price long, discount_price long"
DAYS = {
    date(2024, 1, 1): {"a": [("i", 1, None), ("j", 2, 1)], "b": [("J", 2, 1), ("I", 1, None)], "c": [("i", 9, None)]},
    date(2024, 1, 2): {"a": [("i", 1, None), ("j", 2, 1)], "b": [("i", 5, None)]},
    date(2024, 1, 4): {"a": [("i", 5, None)], "b": [("i", 1, None), ("j", 2, 1)], "c": [("i", 9, 0)], "d": [("i", 7, None), ("i", 8, None)]},
    date(2024, 1, 5): {},
}


def snapshot(spark, day):
    return spark.createDataFrame([("k", s, *row) for s, rows in DAYS[day].items() for row in rows], ROWS)


def state(history):
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    return rows(history.memberships()), rows(history.groups()), rows(history.group_prices())


def test_days(spark, tmp_path):
    history = PriceHistory(spark, str(tmp_path / "h"))
    assert history.days() == [] and history.memberships().count() == 0 and history.groups().count() == 0
    told = [history.ingest(snapshot(spark, day), day) for day in DAYS]
    assert told[0] == {"stores": 3, "kept": 0, "moved": 0, "added": 3, "new_groups": 2}
    assert told[1] == {"stores": 3, "kept": 2, "moved": 1, "added": 0, "new_groups": 1}
    assert told[2] == {"stores": 4, "kept": 0, "moved": 3, "added": 1, "new_groups": 2}
    assert told[3] == {"stores": 4, "kept": 4, "moved": 0, "added": 0, "new_groups": 0}
    spans = {(r["store_id"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in history.memberships().collect()}
    assert spans == {("a", 1, 4), ("a", 4, None), ("b", 1, 2), ("b", 2, 4), ("b", 4, None), ("c", 1, 4), ("c", 4, None), ("d", 4, None)}
    ids = {(r["store_id"], r["valid_from"].day): r["group_id"] for r in history.memberships().collect()}
    assert ids["a", 1] == ids["b", 1] == ids["b", 4] and ids["a", 4] == ids["b", 2]
    groups = {r["group_id"]: r for r in history.groups().collect()}
    assert (groups[ids["a", 1]]["store_count"], groups[ids["c", 1]]["store_count"], groups[ids["c", 1]]["last_seen"]) == (1, 0, date(2024, 1, 1))
    assert groups[ids["d", 4]]["item_count"] == 1  # the list has two prices of one item, the group the last
    assert [(r["item_id"], r["price"]) for r in history.group_prices().where(f"group_id = '{ids['d', 4]}'").collect()] == [("i", 8)]
    assert {r["store_id"] for r in history.memberships(date(2024, 1, 3)).collect()} == {"a", "b", "c"}


def test_rerun_and_failed_day(spark, tmp_path, monkeypatch):
    history = PriceHistory(spark, str(tmp_path / "h"))
    first, second, third, _ = DAYS
    history.ingest(snapshot(spark, first), first)
    one = state(history)
    history.ingest(snapshot(spark, first), first)
    assert state(history) == one
    write = PriceHistory._write

    def breaks(self, name, rows, day):
        if name == "group_state":
            raise OSError("lost")
        write(self, name, rows, day)

    monkeypatch.setattr(PriceHistory, "_write", breaks)
    with pytest.raises(OSError, match="lost"):
        history.ingest(snapshot(spark, second), second)
    assert state(history) == one and history.days() == [first]
    monkeypatch.setattr(PriceHistory, "_write", write)
    history.ingest(snapshot(spark, second), second)
    two = state(history)
    history.ingest(snapshot(spark, second), second)
    assert state(history) == two and two != one
    with pytest.raises(ValueError, match="is committed"):
        history.ingest(snapshot(spark, first), first)
    history.ingest(snapshot(spark, third), third)
    assert len(history.days()) == 3


def test_group_stored_without_items_is_mended(spark, tmp_path):
    history = PriceHistory(spark, str(tmp_path / "h"))
    first, second, *_ = DAYS
    history.ingest(snapshot(spark, first), first)
    rows = [tuple(r) for r in history.table("group").drop("day").collect()]
    empty = spark.createDataFrame([(g, c, h, 0, f) for g, c, h, _, f in rows], "group_id string, chain_slug string, price_hash string, item_count long, first_seen date")
    history._write("group", empty, first)
    assert history.ingest(snapshot(spark, second), second)["new_groups"] == 2
    counts = sorted(r["item_count"] for r in history.groups().collect())
    assert counts == [0, 1, 2]
