"""What lookups find out about stores: how sure a place is, and where it may be applied."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of places that are a house, those that are about a street, and the types of tasks.
HOUSES, STREETS = ("house", "building"), ("street", "road", "shop", "amenity")
TASK_TYPES = ("geocode", "verify_address", "ai_categorize")


def place_confidence(osm_type: Column, osm_value: Column, found_town: Column, wanted_town: Column) -> Column:
    """high for a node that is a house, medium for a street or a town that has the wanted one's name in it, else low."""
    same = (F.coalesce(wanted_town, F.lit("")) != "") & F.contains(F.lower(found_town), F.lower(wanted_town))
    return (
        F.when((osm_type == "N") & osm_value.isin(*HOUSES), "high").when(osm_value.isin(*STREETS) | F.coalesce(same, F.lit(False)), "medium").otherwise("low")
    )


def finished_tasks(tasks: DataFrame, stores: DataFrame, now: datetime) -> DataFrame:
    """Tasks (task_id, store_id, task_type, found, found_latitude, found_longitude, osm_type, osm_value, found_town) as they end.

    Adds status, error_message, confidence, output_data (JSON), verified_at and verified_by. A task of a store that isn't there, or of
    an unknown type, fails. A geocoding task without a place is completed with nothing found; one of high confidence is verified by the system.
    """
    known = stores.select("store_id", F.lit(True).alias("_known"), F.col("city").alias("_city"))
    rows = tasks.join(known, "store_id", "left")
    bad = F.when(F.col("_known").isNull(), F.concat(F.lit("Store not found: "), F.col("store_id"))).when(~F.col("task_type").isin(*TASK_TYPES), F.concat(F.lit("Unknown enrichment task type: "), F.col("task_type")))
    found = F.coalesce("found", F.lit(False))
    place = place_confidence(F.col("osm_type"), F.col("osm_value"), F.col("found_town"), F.col("_city"))
    sure = F.when(F.col("task_type") == "geocode", F.when(found, place).otherwise("low")).when(F.col("task_type") == "verify_address", "medium").otherwise("low")
    rows = rows.withColumn("error_message", bad).withColumn("confidence", F.when(bad.isNull(), sure))
    verified = F.col("error_message").isNull() & (F.col("task_type") == "geocode") & found & (F.col("confidence") == "high")
    output = F.when(F.col("task_type") == "geocode", F.when(found, F.to_json(F.struct(F.lit(True).alias("found"), F.col("found_latitude").alias("lat"), F.col("found_longitude").alias("lon"), verified.alias("autoVerified")))).otherwise('{"found":false}'))
    output = output.when(F.col("task_type") == "verify_address", '{"needsReview":true}').otherwise("{}")
    return rows.withColumns({
        "status": F.when(F.col("error_message").isNotNull(), "failed").otherwise("completed"), "output_data": F.when(F.col("error_message").isNull(), output),
        "verified_at": F.when(verified, F.lit(now)), "verified_by": F.when(verified, "system"),
    }).drop("_known", "_city")


def enriched_stores(stores: DataFrame, finished: DataFrame, now: datetime) -> DataFrame:
    """Stores with the places that finished tasks verified, each field with where it comes from.

    Only verified places are applied, of several that of the last task; ``location_source`` is that task (null where the
    coordinates are the store's own) and ``location_updated_at`` when.
    """
    place = F.max_by(F.struct("found_latitude", "found_longitude", "task_id"), "task_id").alias("_p")
    best = finished.where("verified_by = 'system'").groupBy("store_id").agg(place)
    hit = F.col("_p").isNotNull()
    return stores.join(best, "store_id", "left").withColumns({
        "latitude": F.when(hit, F.col("_p.found_latitude")).otherwise(F.col("latitude")), "longitude": F.when(hit, F.col("_p.found_longitude")).otherwise(F.col("longitude")),
        "location_source": F.col("_p.task_id"), "location_updated_at": F.when(hit, F.lit(now)),
    }).drop("_p")
