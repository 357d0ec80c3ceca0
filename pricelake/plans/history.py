"""Queries over histories that are kept from day to day, and SQL that gives their rows from all days at once."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pricing, runs
from ..operators.persistence import PriceHistory
from ..session import scratch_folder
from ..sources.archive import Archive
from ..streaming import expiry, ingest
from .catalog import _with
from .fixtures import table
from .portals import QUERIES, SQL, _query

__all__ = ["QUERIES", "SQL"]

# --- price groups -----------------------------------------------------------------------------------------------------

#: Price lists of each supplier for every two years, coarse enough for lists to be alike; a supplier has none every fourth time.
_LISTS = """select concat('c', cast(l_suppkey % 2 as varchar(5))) as chain_slug, concat('s', cast(l_suppkey as varchar(20))) as store_id, concat('I', cast(l_partkey % 3 as varchar(5))) as item_id,
    cast(floor(sum(l_quantity) / count(*) / 9) as bigint) as price, cast(case when l_partkey % 3 = 1 then floor(max(l_discount) * 10) end as bigint) as discount_price, year(l_shipdate) - year(l_shipdate) % 2 as y
    from {lineitem} where (l_suppkey + floor(year(l_shipdate) / 2)) % 4 <> 0 group by l_suppkey, l_partkey % 3, year(l_shipdate) - year(l_shipdate) % 2"""


def price_history(spark: SparkSession, d: str) -> PriceHistory:
    """The lists of the line items, those of two years ingested as a day, one after another."""
    folder = scratch_folder(spark)
    spark.sql(_LISTS, lineitem=table(spark, d, "lineitem")).repartition("y").write.partitionBy("y").parquet(f"{folder}/lists")
    lists = spark.read.parquet(f"{folder}/lists")
    history = PriceHistory(spark, f"{folder}/history")
    for year in sorted(r["y"] for r in lists.select("y").distinct().collect()):
        history.ingest(lists.where(F.col("y") == year).drop("y"), date(year, 1, 1))
    return history


_ONCE = f"""with lists as ({_LISTS.format(lineitem="lineitem")}),
    hashed as (select chain_slug, store_id, y, sha256(string_agg(concat(lower(item_id), ':', price, ':', coalesce(cast(discount_price as varchar), 'null')), chr(10) order by lower(item_id), price, discount_price nulls first)) as price_hash, count(*) as items from lists group by 1, 2, 3),
    named as (select *, concat('grp_', substr(sha256(concat(chain_slug, ':', price_hash)), 1, 20)) as group_id from hashed),
    marked as (select *, lag(group_id) over (partition by store_id order by y) as before from named),
    spans as (select store_id, group_id, make_date(y, 1, 1) as valid_from, make_date(lead(y) over (partition by store_id order by y), 1, 1) as valid_to from marked where before is distinct from group_id) """


@_query("pg5_memberships", _ONCE + "select store_id, group_id, cast(valid_from as varchar) as valid_from, cast(valid_to as varchar) as valid_to from spans")
def memberships(spark: SparkSession, d: str) -> DataFrame:
    rows = price_history(spark, d).memberships()
    return rows.select("store_id", "group_id", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@_query(
    "pg3_groups",
    _ONCE + """select n.group_id, chain_slug, price_hash, max(items) as item_count, cast(make_date(min(y), 1, 1) as varchar) as first_seen, cast(make_date(max(y), 1, 1) as varchar) as last_seen,
        (select count(*) from spans s where s.group_id = n.group_id and valid_to is null) as store_count from named n group by n.group_id, chain_slug, price_hash""",
)
def groups(spark: SparkSession, d: str) -> DataFrame:
    rows = price_history(spark, d).groups()
    return rows.select("group_id", "chain_slug", "price_hash", "item_count", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "store_count")


@_query(
    "pg3_group_prices",
    _ONCE + """select distinct n.group_id, lower(item_id) as item_id, price, discount_price from named n join lists l on l.store_id = n.store_id and l.y = n.y""",
)
def group_prices(spark: SparkSession, d: str) -> DataFrame:
    return price_history(spark, d).group_prices().select("group_id", "item_id", "price", "discount_price")


# --- archives, snapshots ----------------------------------------------------------------------------------------------


@_query(
    "src16_archive",
    """with docs as (select *, coalesce(source, 'none') as chain_slug, concat('https://x.example/', cast(doc_id as varchar), case when doc_id % 2 = 0 then '.csv' else '.XML?v=1' end) as url from documents where text is not null),
    days as (select *, case when doc_id % 3 < 2 then date '2024-01-15' else date '2024-01-16' end as day from docs),
    firsts as (select *, row_number() over (partition by text order by day, chain_slug, url) as n from days)
    select concat('archives/', chain_slug, strftime(day, '/%Y/%m/%d/'), cast(doc_id as varchar), case when doc_id % 2 = 0 then '.csv' else '.XML' end) as archive_key, url as source_url, case when doc_id % 2 = 0 then 'csv' else 'xml' end as file_type,
        cast(octet_length(encode(text)) as bigint) as bytes, sha256(text) as checksum, chain_slug, cast(day as varchar) as day from firsts where n = 1""",
)
def archive(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    end = F.when(F.col("doc_id") % 2 == 0, ".csv").otherwise(".XML?v=1")
    files = docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("chain_slug"), F.concat(F.lit("https://x.example/"), F.col("doc_id"), end).alias("url"), F.col("text").cast("binary").alias("content"))
    kept = Archive(spark, scratch_folder(spark))
    for day, part in ((15, "doc_id % 6 = 0"), (15, "doc_id % 3 < 2"), (16, "true"), (16, "true")):
        # The first day comes in two parts, of which the second has the first again; the second day comes twice.
        chosen = files.where(part) if part != "doc_id % 6 = 0" else files.where("doc_id % 3 < 2")
        kept.store(chosen.drop("doc_id"), date(2024, 1, day))
    return kept.rows().select("archive_key", "source_url", "file_type", "bytes", "checksum", "chain_slug", F.col("day").cast("string").alias("day"))


@_query(
    "bo10_snapshot_health",
    _with("store_prices") + "select chain_slug, count(*) as rows, true as has_size, false as is_stale, true as is_stale_later from fx_store_prices group by 1",
)
def snapshot_health(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_folder(spark)
    table(spark, d, "store_prices").write.partitionBy("chain_slug").parquet(folder)
    now = datetime.now()
    kept = spark.read.parquet(folder)
    health, later = pricing.snapshot_health(kept, "chain_slug", now), pricing.snapshot_health(kept, "chain_slug", now + timedelta(hours=30))
    return health.select("chain_slug", "rows", (F.col("bytes") > 0).alias("has_size"), "is_stale").join(later.select("chain_slug", F.col("is_stale").alias("is_stale_later")), "chain_slug")


@_query(
    "ag21_signature_clusters",
    _with("store_prices") + """, signed as (select chain_slug, store_id, sha256(string_agg(concat(item_id, ':', price), ',' order by item_id)) as s from fx_store_prices group by 1, 2),
    clusters as (select chain_slug, s, count(*) as n from signed group by 1, 2)
    select chain_slug, cast(sum(n) as bigint) as stores, count(*) as clusters, round(max(n) / sum(n), 6) as largest_share from clusters group by 1""",
)
def signature_clusters(spark: SparkSession, d: str) -> DataFrame:
    return pricing.signature_clusters(table(spark, d, "store_prices"))


@_query(
    "ag21_coverage",
    _with("store_prices") + """, l as (select distinct chain_slug, store_id, item_id from fx_store_prices), i as (select chain_slug, item_id, count(*) as n from l group by 1, 2), c as (select chain_slug, count(*) as chain_items from i group by 1),
    s as (select chain_slug, count(distinct store_id) as stores from l group by 1)
    select l.chain_slug, l.store_id, count(*) as items, any_value(chain_items) as chain_items, round(count(*) / any_value(chain_items), 6) as coverage, round(sum(n) / count(*) / any_value(stores), 6) as mean_spread
    from l join i on i.chain_slug = l.chain_slug and i.item_id = l.item_id join c on c.chain_slug = l.chain_slug join s on s.chain_slug = l.chain_slug group by 1, 2""",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return pricing.assortment_coverage(table(spark, d, "store_prices"))


# --- expiry -----------------------------------------------------------------------------------------------------------


@_query(
    "st5_expired",
    """with rows as (select user_id, epoch_us(ts) // 1000 as t, case when event_type <> 'view' then epoch_us(ts) // 1000 + cast(floor(value) as bigint) * 60000 end as deadline from events),
    held as (select *, lead(t) over w as after, row_number() over w as n, count(*) over (partition by user_id) as every from rows window w as (partition by user_id order by t, deadline nulls first))
    select user_id, deadline as expired_ms from held where deadline is not null and (deadline <= after or (n = every and deadline <= (select max(t) from rows) - 3600000))""",
)
def expired(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_folder(spark)
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    deadline = F.when(F.col("event_type") != "view", F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(floor(value) as int))"))
    rows = events.select("user_id", "ts", deadline.alias("deadline"))
    with expiry.keeping_state(spark):
        query = expiry.expired(rows, ["user_id"], "ts", "deadline").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/expired")
    query.awaitTermination()
    return spark.read.schema("user_id long, expired_at timestamp").parquet(f"{folder}/expired").select("user_id", F.unix_millis("expired_at").alias("expired_ms"))


@_query(
    "st4_current_prices",
    """select l_suppkey, l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_suppkey, l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc) as n from lineitem) where n = 1""",
)
def current_prices(spark: SparkSession, d: str) -> DataFrame:
    folder, keys, order = scratch_folder(spark), ["l_suppkey", "l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]
    columns = [*keys, *order, "l_extendedprice"]
    stream = spark.readStream.schema(table(spark, d, "lineitem").select(*columns).schema).parquet(f"{d}/lineitem.parque[t]")
    ingest.write_changes(stream, f"{folder}/changes", f"{folder}/checkpoint", keys, order).awaitTermination()
    return ingest.current(spark, f"{folder}/changes", keys, order)


# --- runs -------------------------------------------------------------------------------------------------------------

_NOW = datetime(2024, 3, 1, 12)


@_query(
    "mut_reprocess",
    """with failed as (select *, p_size % 4 as k from part where p_partkey % 3 = 0 and p_size % 5 <> 0)
    select p_partkey as id, case when k = 1 then null else p_name end as name, case when k < 3 and k <> 2 then cast(round(p_retailprice * 100) as bigint) end as price,
        case when k = 0 then '' when k = 1 then 'missing_name' when k = 2 then 'invalid_price' else 'invalid_price' end as errors, k = 0 as is_valid, false as reprocessable,
        concat('run_', substr(sha256('2024-03-01 12:00:00'), 1, 20)) as run_id, (select count(*) from failed) as total_entries, (select count(*) from failed where k = 0) as good_entries from failed""",
)
def reprocess(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    price = F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    raw = F.when(k == 0, F.to_json(F.struct(F.col("p_name").alias("Naziv"), price.alias("CIJENA"), F.lit("").alias("price")))).when(k == 1, F.to_json(F.struct(F.lit(" ").alias("name"), price.alias("price"))))
    raw = raw.when(k == 2, F.to_json(F.struct(F.col("p_name").alias("name"), F.lit("none").alias("price")))).otherwise(F.to_json(F.struct(F.col("p_name").alias("NAME"))))
    failed = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("chain_slug"), raw.alias("raw_data"), (F.col("p_size") % 5 != 0).alias("reprocessable"))
    ids = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))
    made = runs.reprocess(spark, failed, ids, {"name": ("name", "naziv"), "price": ("price", "cijena"), "discount_price": ("discount",)}, scratch_folder(spark), _NOW)
    rows = made.mended.unionByName(made.still_bad)
    shown = rows.select("id", "name", "price", F.array_join("errors", ",").alias("errors"), "is_valid", "reprocessable", "chain_slug")
    return shown.join(made.run.select("chain_slug", "run_id", "total_entries", "good_entries"), "chain_slug").drop("chain_slug")


@_query(
    "mut_run_completion",
    """with runs as (select s_suppkey as run_id, case when s_suppkey % 11 = 0 then 'failed' else 'running' end as status, case when s_suppkey % 9 = 0 then null when s_suppkey % 3 = 0 then 100000 else 5 end as total_files from supplier),
    files as (select l_suppkey as run_id, l_linestatus as s, l_quantity as entries, l_shipdate as t from lineitem),
    done as (select run_id, count(*) as n, sum(cast(entries as bigint)) as e, max(t) as t from files where s = 'F' group by 1),
    told as (select r.*, coalesce(n, 0) as n, coalesce(e, 0) as e, t, r.status = 'running' and coalesce(total_files, 0) > 0 and coalesce(n, 0) >= total_files as closes from runs r left join done using (run_id))
    select run_id, case when closes then 'completed' when status = 'running' then 'interrupted' else status end as status, n as processed_files, cast(e as bigint) as processed_entries,
        case when closes then strftime(t, '%Y-%m-%d %H:%M:%S') when status = 'running' then '2024-03-01 12:00:00' end as completed_at,
        case when status = 'running' and not closes then '{"interrupted_reason":"Service restarted during processing"}' end as metadata from told""",
)
def run_completion(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    total = F.when(key % 9 == 0, None).when(key % 3 == 0, 100000).otherwise(5)
    known = table(spark, d, "supplier").select(key.alias("run_id"), F.when(key % 11 == 0, "failed").otherwise("running").alias("status"), total.alias("total_files"))
    files = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", "processed").otherwise("pending").alias("status"), F.col("l_quantity").cast("long").alias("entries"), F.col("l_shipdate").alias("finished_at"))
    rows = runs.swept(runs.with_progress(known, files), _NOW)
    return rows.select("run_id", "status", "processed_files", "processed_entries", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"), "metadata")
