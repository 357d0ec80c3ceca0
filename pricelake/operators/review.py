"""Decisions of people on queues and stores, many at once: each is checked against the state that it was made on, applied or refused, and told.

Actions are taken in the order of their ids. One that closes or changes a row makes those after it on that row out of date, as
they were made on a state that is gone.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Reviewed:
    """A queue after decisions, what they add, and the actions that were refused, each with a reason."""

    queue: DataFrame
    links: DataFrame
    rejections: DataFrame
    audit: DataFrame
    refused: DataFrame


def reviewed(queue: DataFrame, candidates: DataFrame, actions: DataFrame, now: datetime) -> Reviewed:
    """Decisions on matches.

    ``queue`` has queue_id, item, status, version and linked_product, ``candidates`` item, candidate and rank, ``actions`` action_id,
    queue_id, action (approve or reject), product, version, user and reason. Approving links the product named, else the queue's, else
    the first candidate; without any it is refused. Rejecting a product leaves the row pending, unless its item has no
    candidates; rejecting without a product closes it.
    """
    per_item = candidates.groupBy("item").agg(F.count("*").alias("_n"), F.min(F.when(F.col("rank") == 1, F.col("candidate"))).alias("_first"))
    known = queue.join(per_item, "item", "left").select("queue_id", "item", F.col("status").alias("_status"), F.col("version").alias("_version"), "linked_product", "_n", "_first")
    rows = actions.join(known, "queue_id", "left")
    approves, names = F.col("action") == "approve", F.col("product").isNotNull()
    product = F.when(approves, F.coalesce("product", "linked_product", "_first")).otherwise(F.col("product"))
    rows = rows.withColumn("_product", product)
    bad = (
        F.when(F.col("item").isNull() | (F.col("_version") != F.col("version")), "modified by another user").when(F.col("_status") != "pending", "already processed")
        .when(~F.col("action").isin("approve", "reject"), "unknown action").when(approves & F.col("_product").isNull(), "no product")
    )
    closes = approves | ~names | (F.coalesce("_n", F.lit(0)) == 0)
    rows = rows.withColumn("_bad", bad).withColumn("_closes", F.col("_bad").isNull() & closes)
    first = F.min(F.when(F.col("_closes"), F.col("action_id"))).over(Window.partitionBy("queue_id"))
    rows = rows.withColumn("_close", first).withColumn("_bad", F.coalesce("_bad", F.when(F.col("action_id") > F.col("_close"), "modified by another user")))
    done = rows.where("_bad IS NULL")
    ends = done.where(F.col("action_id") == F.col("_close"))
    new = ends.select("queue_id", F.when(approves, "approved").otherwise("rejected").alias("_new"), F.when(approves, "linked").otherwise("no_match").alias("_decision"), F.when(approves, F.col("_product")).alias("_linked"), F.col("user").alias("_by"))
    hit = F.col("_new").isNotNull()
    after = queue.join(new, "queue_id", "left").select(
        "queue_id", "item", F.coalesce("_new", "status").alias("status"), (F.col("version") + hit.cast("long")).alias("version"), F.coalesce("_linked", "linked_product").alias("linked_product"),
        F.col("_decision").alias("decision"), F.col("_by").alias("reviewed_by"), F.when(hit, F.lit(now)).alias("reviewed_at"),
    )
    what = F.when(approves, "approved").when(names, "rejected_candidate").otherwise("rejected")
    state = F.when(approves, F.to_json(F.struct(F.lit("approved").alias("status"), F.col("_product").alias("productId")))).otherwise(F.to_json(F.struct("reason", F.col("product").alias("productId"))))
    return Reviewed(
        after,
        done.where(approves).select("item", F.col("_product").alias("product"), F.lit("manual").alias("confidence")),
        done.where(~approves & names).groupBy("item", "product").agg(F.min_by(F.coalesce("reason", F.lit("rejected")), "action_id").alias("reason"), F.min_by("user", "action_id").alias("rejected_by")),
        done.select("action_id", "queue_id", what.alias("action"), "user", F.when(approves, F.to_json(F.struct(F.col("_status").alias("status")))).alias("previous_state"), state.alias("new_state")),
        rows.where("_bad IS NOT NULL").select("action_id", "queue_id", F.col("_bad").alias("reason")),
    )


def stores_after(stores: DataFrame, actions: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Stores (store_id, status, price_source_store_id, version) after actions, and the actions with the reason why they were refused, or null.

    ``actions`` has action_id, store_id, action, other (a store), version and user. approve makes a pending store active; reject takes it
    away; merge takes it away too, and stores that took prices from it take them from the other one; link and unlink set its
    source of prices. Of a store's actions the first good one counts. The store must be there in the version named (link and
    unlink don't look at it), and so must the other one, which no action of the batch may take away.
    """
    known = stores.select("store_id", F.col("status").alias("_status"), F.col("version").alias("_version"))
    others = stores.select(F.col("store_id").alias("other"), F.lit(True).alias("_other"))
    leaving = actions.where(F.col("action").isin("reject", "merge")).select(F.col("store_id").alias("other"), F.lit(True).alias("_leaves")).distinct()
    rows = actions.join(known, "store_id", "left").join(others, "other", "left").join(leaving, "other", "left")
    two = F.col("action").isin("merge", "link")
    bad = (
        F.when(F.col("_status").isNull(), "store not found").when(~F.col("action").isin("approve", "reject", "merge", "link", "unlink"), "unknown action")
        .when(two & (F.col("store_id") == F.col("other")), "a store and itself").when(two & F.col("_other").isNull(), "other store not found").when(two & F.col("_leaves").isNotNull(), "other store is taken away")
        .when((F.col("action") == "approve") & (F.col("_status") != "pending"), "not pending").when(F.col("action").isin("approve", "reject", "merge") & ~F.col("version").eqNullSafe(F.col("_version")), "modified by someone else")
    )
    rows = rows.withColumn("_bad", bad)
    first = F.min(F.when(F.col("_bad").isNull(), F.col("action_id"))).over(Window.partitionBy("store_id"))
    rows = rows.withColumn("_bad", F.coalesce("_bad", F.when(F.col("action_id") > first, "modified by someone else")))
    done = rows.where("_bad IS NULL").select("store_id", F.col("action").alias("_action"), F.col("other").alias("_to"), F.col("user").alias("_user"))
    merged = done.where("_action = 'merge'").select(F.col("store_id").alias("_old"), F.col("_to").alias("_into"))
    is_ = lambda name: F.coalesce(F.col("_action") == name, F.lit(False))
    left = stores.join(done, "store_id", "left").where(~is_("reject") & ~is_("merge")).join(merged, F.col("price_source_store_id") == F.col("_old"), "left")
    source: Column = F.when(is_("link"), F.col("_to")).when(~is_("unlink"), F.coalesce("_into", "price_source_store_id"))
    changed = F.col("_action").isNotNull() | F.col("_into").isNotNull()
    after = left.select(
        "store_id", F.when(is_("approve"), "active").otherwise(F.col("status")).alias("status"), source.alias("price_source_store_id"), (F.col("version") + changed.cast("long")).alias("version"),
        F.when(is_("approve"), F.col("_user")).alias("approved_by"), F.when(is_("approve"), F.lit(now)).alias("approved_at"),
    )
    return after, rows.select("action_id", "store_id", "action", F.col("_bad").alias("refused"))
