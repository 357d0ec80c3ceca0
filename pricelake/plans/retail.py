"""Queries of operators with inputs that the other queries lack: places of baskets, splits, statuses, enrichment; with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import basket, catalog, enrichment, matching, operations, registry, review
from ..sources import discovery
from .catalog import _GREEDY, _OFFERS, _offers, _splits, _with
from .fixtures import table
from .history import QUERIES, SQL, _query

__all__ = ["QUERIES", "SQL"]

# --- baskets with places ----------------------------------------------------------------------------------------------

#: Where a basket's customer is: on a grid that most stores are far from; every tenth basket has no place.
_PLACES = "case when o_orderkey % 10 <> 3 then 42.3e0 + (o_custkey * 31 % 420) / 100.0e0 end as at_latitude, case when o_orderkey % 10 <> 3 then 13.5e0 + (o_custkey * 47 % 590) / 100.0e0 end as at_longitude"
_FAR = f""", places as (select o_orderkey as basket_id, lower(replace(r_name, ' ', '-')) as chain_slug, {_PLACES} from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
    angles as (select basket_id, store_id, pow(sin(radians(s.latitude - at_latitude) / 2), 2) + cos(radians(at_latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - at_longitude) / 2), 2) as a
      from places p join fx_stores s on s.chain_slug = p.chain_slug where s.status = 'active' and at_latitude is not null),
    far as (select basket_id, store_id, 6371.0e0 * 2 * atan2(sqrt(a), sqrt(1 - a)) as km from angles),
    near as (select * from (select *, row_number() over (partition by basket_id order by km, store_id) as n from far where km <= 150) where n <= 5) """
_KM = 150.0


def _places(spark: SparkSession, d: str) -> DataFrame:
    names = ("orders", "customer", "nation", "region")
    sql = f"select o_orderkey as basket_id, lower(replace(r_name, ' ', '-')) as chain_slug, {_PLACES} from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey"
    return spark.sql(sql, **{n: table(spark, d, n) for n in names}).where("at_latitude IS NOT NULL")


def _near(spark: SparkSession, d: str, k: int = basket.NEAREST) -> DataFrame:
    return basket.nearest_stores(_places(spark, d), table(spark, d, "stores").where("status = 'active'"), "basket_id", k, within_km=_KM)


_UNION = _OFFERS + _FAR + """, united as (select basket_id, store_id from chosen union select n.basket_id, n.store_id from near n where n.basket_id in (select basket_id from lines)),
    placed as (select * from (select *, row_number() over (partition by basket_id order by store_id) as place from united) where place <= 20) """


def _near_baskets(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).join(table(spark, d, "baskets").select("basket_id").distinct(), "basket_id", "left_semi")


@_query("bo5_candidates_near", _UNION + "select basket_id, store_id, place from placed")
def candidates_near(spark: SparkSession, d: str) -> DataFrame:
    return basket.candidates(basket.single_store(_offers(spark, d)), _near_baskets(spark, d))


@_query(
    "wn7_rank_by_distance",
    _OFFERS + _FAR + """, coarse as (select e.basket_id, e.store_id, coverage_bin, sorting_total // 10000000 as sorting_total, case when km > 0 then km end as km from evaluated e left join far f on f.basket_id = e.basket_id and f.store_id = e.store_id)
    select basket_id, store_id, coverage_bin, sorting_total, row_number() over (partition by basket_id order by coverage_bin desc, sorting_total, km nulls last, store_id) as rank from coarse""",
)
def rank_by_distance(spark: SparkSession, d: str) -> DataFrame:
    """Totals by the 100,000, so that many stores cost the same and the distance decides."""
    far = basket.nearest_stores(_places(spark, d), table(spark, d, "stores").where("status = 'active'"), "basket_id", basket.MOST_NEAR, within_km=30_000.0)
    rows = basket.single_store(_offers(spark, d)).withColumn("sorting_total", F.expr("sorting_total div 10000000"))
    rows = rows.join(far.select("basket_id", "store_id", F.col("km").alias("distance_km")), ["basket_id", "store_id"], "left")
    return basket.ranked_stores(rows).select("basket_id", "store_id", "coverage_bin", "sorting_total", "rank")


@_query(
    "wn8_visit_order",
    _GREEDY + _FAR + """, bought as (select g.basket_id, g.store_id, count(*) as n_lines, cast(sum(line_total) as bigint) as store_total from greedy g where g.store_id is not null group by 1, 2)
    select b.basket_id, b.store_id, n_lines, store_total, row_number() over (partition by b.basket_id order by coalesce(km, 0), b.store_id) as visit from bought b left join far f on f.basket_id = b.basket_id and f.store_id = b.store_id""",
)
def visit_order(spark: SparkSession, d: str) -> DataFrame:
    offer = _offers(spark, d)
    split = basket.greedy(offer, basket.candidates(basket.single_store(offer)))
    far = basket.nearest_stores(_places(spark, d), table(spark, d, "stores").where("status = 'active'"), "basket_id", basket.MOST_NEAR, within_km=30_000.0)
    return basket.visit_order(split, far).select("basket_id", "store_id", "n_lines", "store_total", "visit")


@_query(
    "bo8_best_split",
    f"""with best as ({SQL["bo7_multi_exhaustive"]}), totals as ({SQL["ag12_greedy_totals"]})
    select basket_id, n_found, n_stores, total as sorting_total, 'optimal' as algorithm from best
    union all select basket_id, n_found, n_stores, sorting_total, 'greedy' from totals where basket_id not in (select basket_id from best)""",
)
def best_split(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d, "split")


@_query(
    "bo1_request_places",
    _with("baskets") + """, per as (select basket_id, count(*) as n from fx_baskets group by 1)
    select basket_id, n as n_lines, concat_ws(',', case when basket_id % 400 - 200 not between -90 and 90 then 'latitude_out_of_range' end, case when basket_id % 700 - 300 not between -180 and 180 then 'longitude_out_of_range' end) as errors from per""",
)
def request_places(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "baskets").withColumns({"latitude": (F.col("basket_id") % 400 - 200).cast("double"), "longitude": (F.col("basket_id") % 700 - 300).cast("double")})
    return registry.request_errors(lines)


# --- listings, codes, links -------------------------------------------------------------------------------------------


@_query(
    "jn9_source_names",
    _with("stores") + "select a.store_id, a.name, b.name as source_name from fx_stores a left join fx_stores b on b.store_id = a.price_source_store_id",
)
def source_names(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_source_names(table(spark, d, "stores")).select("store_id", "name", "source_name")


@_query("ag1_filtered_count", "select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from part where p_type = 'ECONOMY' and lower(p_name) like '%ring%' and p_retailprice >= 950")
def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    """The count of what the page before it is taken from: both take the same filtered rows."""
    rows = table(spark, d, "part").where(catalog.all_of(F.col("p_type") == "ECONOMY", F.lower("p_name").like("%ring%"), None, F.col("p_retailprice") >= 950))
    return catalog.page_counts(rows, 20)


@_query(
    "mt1_barcode_counts",
    """with c as (select case when p_size % 5 = 0 then null when p_size % 5 = 1 then 'none' else cast(p_partkey % 300 + 10000000 as varchar) end as code from part)
    select count(*) as items, count(*) filter (where code <> 'none') as coded, count(*) filter (where code is null or code = 'none') as skipped, count(distinct case when code <> 'none' then code end) as codes from c""",
)
def barcode_counts(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 5
    code = F.when(size == 0, None).when(size == 1, "none").otherwise((F.col("p_partkey") % 300 + 10_000_000).cast("string"))
    return matching.barcode_counts(table(spark, d, "part").select(code.alias("barcode")))


@_query(
    "src14_discovered_files",
    """with l as (select p_partkey // 20 as page, p_partkey as k, case p_size % 4 when 0 then 'csv' when 1 then 'XML' when 2 then 'html' else 'zip' end as e, p_size % 3 as how from part),
    f as (select *, case how when 0 then concat('https://shop.example/lists/', cast(page as varchar), '/f', cast(k % 700 as varchar), '.', e) when 1 then concat('https://shop.example/d/f', cast(k % 700 as varchar), '.', e, '?v=1') else concat('http://other.example/f', cast(k % 700 as varchar), '.', e) end as u from l where e <> 'html')
    select distinct u as file_url, concat('f', cast(k % 700 as varchar), '.', e) as file_name, lower(e) as file_type from f""",
)
def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("page", F.floor(F.col("p_partkey") / 20).cast("long"))
    kind = F.element_at(F.array(*map(F.lit, ("csv", "XML", "html", "zip"))), (F.col("p_size") % 4 + 1).cast("int"))
    name = F.concat(F.lit("f"), (F.col("p_partkey") % 700).cast("string"), F.lit("."), kind)
    href = F.when(F.col("p_size") % 3 == 0, name).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/d/"), name, F.lit("?v=1"))).otherwise(F.concat(F.lit("http://other.example/"), name))
    pages = rows.groupBy("page").agg(F.array_join(F.collect_list(F.concat(F.lit("<a class=x HREF='"), href, F.lit("'>f</a>"))), " ").alias("html"))
    pages = pages.select(F.concat(F.lit("https://shop.example/lists/"), F.col("page"), F.lit("/index.html?p=1")).alias("url"), "html")
    return discovery.discovered_files(pages)


# --- statuses, durations, models --------------------------------------------------------------------------------------


@_query(
    "ag13_counts_by_status",
    """with q as (select case p_size % 5 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' when 3 then 'skipped' else 'other' end as s from part),
    l as (select case when l_linenumber % 2 = 0 then 'barcode' when l_linenumber % 3 = 0 then 'manual' else 'ai' end as t, 1 - l_discount as c from lineitem)
    select (select count(*) from q) as queued, (select count(*) from q where s = 'pending') as pending, (select count(*) from q where s = 'approved') as approved, (select count(*) from q where s = 'rejected') as rejected, (select count(*) from q where s = 'skipped') as skipped,
    (select count(*) from l) as links, (select count(*) from l where t = 'barcode') as by_barcode, (select count(*) from l where t = 'ai') as by_ai, (select count(*) from l where c >= 0.95) as sure, (select count(*) from orders) as candidates""",
)
def counts_by_status(spark: SparkSession, d: str) -> DataFrame:
    size, number = F.col("p_size") % 5, F.col("l_linenumber")
    queue = table(spark, d, "part").select(F.when(size == 0, "pending").when(size == 1, "approved").when(size == 2, "rejected").when(size == 3, "skipped").otherwise("other").alias("status"))
    links = table(spark, d, "lineitem").select(F.when(number % 2 == 0, "barcode").when(number % 3 == 0, "manual").otherwise("ai").alias("match_type"), (1 - F.col("l_discount")).alias("confidence"))
    return matching.counts_by_status(queue, links, table(spark, d, "orders"))


@_query(
    "ag19_mean_durations",
    """with t as (select event_type as task_type, case when user_id % 3 = 0 then 'claimed' else 'completed' end as status, ts as started_at, ts + to_milliseconds(cast(floor(value * 1000) as bigint)) as completed_at from events), m as (select max(completed_at) as e from t)
    select task_type, round(avg(epoch_us(completed_at) // 1000 - epoch_us(started_at) // 1000) / 1000, 6) as mean_seconds from t, m where status = 'completed' and completed_at > e - interval 1 hour group by 1""",
)
def mean_durations(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("user_id") % 3 == 0, "claimed").otherwise("completed")
    done = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000) * 1000)
    tasks = table(spark, d, "events").select(F.col("event_type").alias("task_type"), status.alias("status"), F.col("ts").alias("started_at"), done.alias("completed_at"))
    return operations.mean_durations(tasks, tasks.agg(F.max("completed_at")).first()[0])


@_query(
    "tk10_ranked_models",
    """with r as (select event_type as model, avg(case when user_id % 2 = 0 then 1.0e0 else 0 end) as recall_at_10, sum(value) as total_cost from events group by 1)
    select model, round(recall_at_10 / (total_cost + 0.001), 6) as worth, row_number() over (order by recall_at_10 / (total_cost + 0.001) desc, model) as rank from r""",
)
def ranked_models(spark: SparkSession, d: str) -> DataFrame:
    found = F.avg((F.col("user_id") % 2 == 0).cast("double")).alias("recall_at_10")
    results = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(found, F.sum("value").alias("total_cost"))
    return matching.ranked_models(results).select("model", "worth", "rank")


# --- enrichment -------------------------------------------------------------------------------------------------------

_NOW = datetime(2024, 3, 1, 12)
_TASKS = _with("stores") + """, tasks as (select c_custkey as task_id, concat('sto_', lpad(cast(c_custkey % 80 as varchar), 4, '0')) as store_id, case c_custkey % 7 when 0 then 'verify_address' when 1 then 'ai_categorize' when 2 then 'other' else 'geocode' end as task_type,
      c_custkey % 11 <> 0 as found, 40 + c_custkey % 1000 / 100.0e0 as lat, 13 + c_custkey % 700 / 100.0e0 as lon, case when c_custkey % 5 < 2 then 'N' else 'W' end as ot, ['house', 'road', 'city', 'building'][cast(c_custkey % 4 + 1 as int)] as ov, concat('Old nation_', cast(c_custkey % 25 as varchar)) as town from customer),
    judged as (select t.*, s.store_id is not null as known, s.city, case when s.store_id is null then concat('Store not found: ', t.store_id) when task_type = 'other' then 'Unknown enrichment task type: other' end as error_message from tasks t left join fx_stores s on s.store_id = t.store_id),
    sure as (select *, case when error_message is not null then null when task_type = 'verify_address' then 'medium' when task_type <> 'geocode' or not found then 'low' when ot = 'N' and ov in ('house', 'building') then 'high'
      when ov = 'road' or contains(lower(town), lower(city)) then 'medium' else 'low' end as confidence from judged) """


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (key % n + 1).cast("int"))
    return table(spark, d, "customer").select(
        key.alias("task_id"), F.concat(F.lit("sto_"), F.lpad((key % 80).cast("string"), 4, "0")).alias("store_id"), pick(("verify_address", "ai_categorize", "other", "geocode", "geocode", "geocode", "geocode"), 7).alias("task_type"),
        (key % 11 != 0).alias("found"), (40 + key % 1000 / 100).alias("found_latitude"), (13 + key % 700 / 100).alias("found_longitude"), F.when(key % 5 < 2, "N").otherwise("W").alias("osm_type"),
        pick(("house", "road", "city", "building"), 4).alias("osm_value"), F.concat(F.lit("Old nation_"), (key % 25).cast("string")).alias("found_town"),
    )


@_query(
    "mut_enrichment_tasks",
    _TASKS + """select task_id, case when error_message is null then 'completed' else 'failed' end as status, error_message, confidence,
        case when error_message is not null then null when task_type = 'verify_address' then '{"needsReview":true}' when task_type <> 'geocode' then '{}' when not found then '{"found":false}' else 'place' end as output, case when task_type = 'geocode' and found and confidence = 'high' then 'system' end as verified_by from sure""",
)
def enrichment_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = enrichment.finished_tasks(_tasks(spark, d), table(spark, d, "stores"), _NOW)
    output = F.when(F.col("output_data").startswith('{"found":true'), "place").otherwise(F.col("output_data"))
    return rows.select("task_id", "status", "error_message", "confidence", output.alias("output"), "verified_by")


@_query(
    "mut_enrichment_stores",
    _TASKS + """, best as (select *, row_number() over (partition by store_id order by task_id desc) as n from sure where task_type = 'geocode' and found and confidence = 'high')
    select s.store_id, coalesce(lat, s.latitude) as latitude, coalesce(lon, s.longitude) as longitude, task_id as location_source from fx_stores s left join best b on b.store_id = s.store_id and n = 1""",
)
def enrichment_stores(spark: SparkSession, d: str) -> DataFrame:
    stores = table(spark, d, "stores")
    rows = enrichment.enriched_stores(stores, enrichment.finished_tasks(_tasks(spark, d), stores, _NOW), _NOW)
    return rows.select("store_id", "latitude", "longitude", "location_source")


# --- decisions --------------------------------------------------------------------------------------------------------

#: Parts are a queue, suppliers that sold them in large lots their candidates, and orders decisions on them, several for a part.
_REVIEW = """with q as (select p_partkey as queue_id, case when p_size % 6 = 0 then 'approved' else 'pending' end as status, p_size % 3 as version, case when p_size % 4 = 0 then p_partkey % 10 end as linked from part),
    sold as (select l_partkey as item, l_suppkey as candidate, sum(l_quantity) as s from lineitem where l_quantity > 46 group by 1, 2),
    c as (select *, row_number() over (partition by item order by s desc, candidate) as rank from sold),
    n as (select item, count(*) as n, min(case when rank = 1 then candidate end) as first from c group by 1),
    a as (select o_orderkey as action_id, o_custkey % (select count(*) from part) as queue_id, case when o_orderkey % 3 = 0 then 'approve' else 'reject' end as action, case when o_orderkey % 4 < 2 then o_orderkey % 50 end as product, o_orderkey % 7 % 3 as version from orders),
    j as (select a.*, q.status, case when action = 'approve' then coalesce(product, linked, first) else product end as p,
      case when q.version <> a.version then 'modified by another user' when q.status <> 'pending' then 'already processed' when action = 'approve' and coalesce(product, linked, first) is null then 'no product' end as bad,
      action = 'approve' or product is null or coalesce(n, 0) = 0 as closes from a join q on q.queue_id = a.queue_id left join n on n.item = a.queue_id),
    t as (select *, min(case when bad is null and closes then action_id end) over (partition by queue_id) as ended from j),
    d as (select *, coalesce(bad, case when action_id > ended then 'modified by another user' end) as why from t) """


def _review(spark: SparkSession, d: str) -> review.Reviewed:
    part = table(spark, d, "part")
    queue = part.select(F.col("p_partkey").alias("queue_id"), F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 6 == 0, "approved").otherwise("pending").alias("status"), (F.col("p_size") % 3).cast("long").alias("version"), F.when(F.col("p_size") % 4 == 0, F.col("p_partkey") % 10).alias("linked_product"))
    sold = table(spark, d, "lineitem").where("l_quantity > 46").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("candidate")).agg(F.sum("l_quantity").alias("s"))
    candidates = sold.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), "candidate")))
    key = F.col("o_orderkey")
    actions = table(spark, d, "orders").select(
        key.alias("action_id"), (F.col("o_custkey") % part.count()).alias("queue_id"), F.when(key % 3 == 0, "approve").otherwise("reject").alias("action"), F.when(key % 4 < 2, key % 50).alias("product"),
        (key % 7 % 3).alias("version"), F.concat(F.lit("u"), (key % 5).cast("string")).alias("user"), F.lit(None).cast("string").alias("reason"),
    )
    return review.reviewed(queue, candidates, actions, _NOW)


@_query(
    "mt14_review_queue",
    _REVIEW + """, e as (select queue_id as qid, action, p, action_id from d where why is null and action_id = ended)
    select q.queue_id, case when e.action = 'approve' then 'approved' when e.action = 'reject' then 'rejected' else q.status end as status, q.version + case when e.qid is null then 0 else 1 end as version,
        coalesce(case when e.action = 'approve' then e.p end, linked) as linked_product, case e.action when 'approve' then 'linked' when 'reject' then 'no_match' end as decision, 'u' || cast(e.action_id % 5 as varchar) as reviewed_by
    from q left join e on e.qid = q.queue_id""",
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return _review(spark, d).queue.select("queue_id", "status", "version", "linked_product", "decision", "reviewed_by")


@_query(
    "mt14_review_audit",
    _REVIEW + """select action_id, queue_id, case when action = 'approve' then 'approved' when product is not null then 'rejected_candidate' else 'rejected' end as action, case when action = 'approve' then '{"status":"pending"}' end as previous_state,
        case when action = 'approve' then concat('{"status":"approved","productId":', p, '}') when product is not null then concat('{"productId":', product, '}') else '{}' end as new_state, cast(null as varchar) as refused from d where why is null
    union all select action_id, queue_id, null, null, null, why from d where why is not null""",
)
def review_audit(spark: SparkSession, d: str) -> DataFrame:
    made = _review(spark, d)
    audit = made.audit.select("action_id", "queue_id", "action", "previous_state", "new_state", F.lit(None).cast("string").alias("refused"))
    return audit.unionByName(made.refused.select("action_id", "queue_id", F.col("reason").alias("refused")), allowMissingColumns=True)


@_query(
    "mt14_review_results",
    _REVIEW + """select 'link' as kind, queue_id as item, p as product from d where why is null and action = 'approve'
    union all select distinct 'rejection', queue_id, product from d where why is null and action = 'reject' and product is not null""",
)
def review_results(spark: SparkSession, d: str) -> DataFrame:
    made = _review(spark, d)
    return made.links.select(F.lit("link").alias("kind"), "item", "product").union(made.rejections.select(F.lit("rejection"), "item", "product"))


#: Customers' actions on the stores, three quarters of them on the same version.
_WORK = _with("stores") + """, s as (select store_id, status, price_source_store_id as source, store_key % 4 as version from fx_stores),
    a as (select c_custkey as action_id, concat('sto_', lpad(cast(c_custkey * 7 % 90 as varchar), 4, '0')) as store_id, ['approve', 'link', 'unlink', 'merge', 'reject', 'other', 'link'][cast(c_custkey % 7 + 1 as int)] as action,
      concat('sto_', lpad(cast(c_custkey * 11 % 90 as varchar), 4, '0')) as other, c_custkey * 7 % 90 % 4 + case when c_custkey % 4 = 3 then 1 else 0 end as version from customer where c_custkey % 5 < 2),
    l as (select distinct store_id from a where action in ('reject', 'merge')),
    j as (select a.*, case when s.store_id is null then 'store not found' when action = 'other' then 'unknown action' when action in ('merge', 'link') and a.store_id = other then 'a store and itself' when action in ('merge', 'link') and other not in (select store_id from s) then 'other store not found'
      when action in ('merge', 'link') and other in (select store_id from l) then 'other store is taken away' when action = 'approve' and s.status <> 'pending' then 'not pending' when action in ('approve', 'reject', 'merge') and a.version <> s.version then 'modified by someone else' end as bad from a left join s on s.store_id = a.store_id),
    d as (select *, coalesce(bad, case when action_id > min(case when bad is null then action_id end) over (partition by store_id) then 'modified by someone else' end) as refused from j),
    g as (select * from d where refused is null) """


def _worked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stores = table(spark, d, "stores").select("store_id", "status", "price_source_store_id", (F.col("store_key") % 4).cast("long").alias("version"))
    key = F.col("c_custkey")
    store = lambda n: F.concat(F.lit("sto_"), F.lpad((key * n % 90).cast("string"), 4, "0"))
    kinds = F.array(*map(F.lit, ("approve", "link", "unlink", "merge", "reject", "other", "link")))
    actions = table(spark, d, "customer").where("c_custkey % 5 < 2").select(
        key.alias("action_id"), store(7).alias("store_id"), F.element_at(kinds, (key % 7 + 1).cast("int")).alias("action"), store(11).alias("other"), (key * 7 % 90 % 4 + F.when(key % 4 == 3, 1).otherwise(0)).alias("version"), F.lit("u").alias("user")
    )
    return review.stores_after(stores, actions, _NOW)


@_query(
    "mut_store_workflow",
    _WORK + """select s.store_id, case when g.action = 'approve' then 'active' else s.status end as status, case when g.action = 'link' then g.other when g.action = 'unlink' then null else coalesce(m.other, s.source) end as price_source_store_id,
        s.version + case when g.action is not null or m.other is not null then 1 else 0 end as version from s left join g on g.store_id = s.store_id left join (select * from g where action = 'merge') m on m.store_id = s.source where g.action is null or g.action not in ('reject', 'merge')""",
)
def store_workflow(spark: SparkSession, d: str) -> DataFrame:
    return _worked(spark, d)[0].select("store_id", "status", "price_source_store_id", "version")


@_query("mut_store_workflow_refused", _WORK + "select action_id, store_id, action, refused from d")
def store_workflow_refused(spark: SparkSession, d: str) -> DataFrame:
    return _worked(spark, d)[1]
