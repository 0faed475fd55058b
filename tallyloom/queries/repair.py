"""Queries of the general table problems (p1 to p4 and p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_number, id_text, present
from ..functions.instants import instant
from ..operators.csv_rows import explained, failed_rows, loaded_rows
from ..operators.instants import extend_dictionary, normalise_instants
from ..operators.orphans import find_orphans, orphan_report
from ..operators.packed_values import known_values, split_values
from ..operators.schema_drift import drift, fused_schema, unified
from ..plans.shared import new_path, written
from ..sources.tables import table

ORDERS, MAIN, SYNTH = "store_main_orders", "shop2_catalog_joined_main", "shop2_catalog_joined_set_synth1"
VARIANTS, LEVELS = "shop2_products_variants_set_synth1", "shop2_inventory_levels_set_synth1"
SHOP_ZONE = "America/New_York"


def _text(c):
    return id_number(c).cast("string")


def _key(c):
    """The number of an id as text, else the id as it is: what has no number is still a reference."""
    return F.coalesce(_text(c), F.when(present(c), id_text(c)))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory levels with their key and the zone of their location."""
    zones = table(spark, folder, "locations").groupBy(id_number(F.col("location_id")).alias("_l")).agg(F.max("tz_name").alias("zone"))
    rows = table(spark, folder, LEVELS).select(
        id_number(F.col("inventory_item_id")).alias("item"), _key(F.col("inventory_item_id")).alias("item_key"), id_number(F.col("location_id")).alias("_l"), F.col("updated_at").alias("raw")
    )
    return rows.join(zones, "_l", "left").withColumn("record_key", F.concat_ws("|", F.col("item_key"), F.coalesce(F.col("_l").cast("string"), F.lit(""))))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    deleted = lambda c: F.lower(F.trim(c)) == "deleted"
    never = F.lit(None).cast("timestamp")
    refs = (
        table(spark, folder, ORDERS)
        .where(present(F.col("variantid")))
        .select(F.lit(ORDERS).alias("relation"), _text(F.col("lineitemid")).alias("record_key"), _key(F.col("variantid")).alias("key"), F.col("createdat").alias("raw"), F.lit(SHOP_ZONE).alias("zone"))
        .unionByName(
            table(spark, folder, VARIANTS)
            .where(present(F.col("variant_id")))
            .select(F.lit(VARIANTS).alias("relation"), _text(F.col("variant_id")).alias("record_key"), _key(F.col("variant_id")).alias("key"), F.lit(None).cast("string").alias("raw"), F.lit("UTC").alias("zone"))
        )
        .unionByName(
            _levels(spark, folder).where(F.col("item_key").isNotNull()).select(F.lit(LEVELS).alias("relation"), "record_key", F.col("item_key").alias("key"), "raw", "zone")
        )
    )
    refs = refs.withColumn("at", instant(F.col("raw"), F.col("zone"))).drop("raw", "zone")
    parents = (
        table(spark, folder, MAIN)
        .select(F.lit(ORDERS).alias("relation"), _key(F.col("variant_id")).alias("key"), deleted(F.col("status")).alias("deleted"), F.col("created_at").cast("timestamp").alias("created_at"))
        .unionByName(table(spark, folder, SYNTH).select(F.lit(VARIANTS).alias("relation"), _key(F.col("variant_id")).alias("key"), deleted(F.col("product_status")).alias("deleted"), never.alias("created_at")))
        .unionByName(table(spark, folder, VARIANTS).select(F.lit(LEVELS).alias("relation"), _key(F.col("inventory_item_id")).alias("key"), F.lit(False).alias("deleted"), F.col("created_at").cast("timestamp").alias("created_at")))
    )
    return find_orphans(refs, parents)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select(F.col("relation").alias("source_table"), "record_key", "kind").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = [table(spark, folder, t).select(F.lit(t).alias("source_table"), id_number(F.col("variant_id")).alias("variant_no"), "tags") for t in (MAIN, SYNTH)]
    return rows[0].unionByName(rows[1]).where(F.col("variant_no").isNotNull())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_values(_tags(spark, folder), "tags").distinct()


def p2_known(spark: SparkSession, folder: str) -> DataFrame:
    """The values that may hold delimiters, and how many cells back each."""
    return known_values(_tags(spark, folder), "tags")


def _times(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda t, key, raw: table(spark, folder, t).select(F.lit(t).alias("source"), _text(F.col(key)).alias("record_key"), F.lit(SHOP_ZONE).alias("zone"), F.col(raw).alias("raw"))
    rows = (
        one(ORDERS, "order_id", "createdat")
        .unionByName(one(MAIN, "variant_id", "published_at"))
        .unionByName(_levels(spark, folder).where(F.col("item").isNotNull()).select(F.lit(LEVELS).alias("source"), "record_key", "zone", "raw"))
    )
    # written, as the dictionary and the join both read them
    return written(rows.where(present(F.col("raw")) & F.col("record_key").isNotNull()).distinct(), "times")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_instants(_times(spark, folder)).where(F.col("utc_micros").isNotNull()).select(F.col("source").alias("source_table"), "record_key", "utc_micros").distinct()


def p3_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """One dictionary over three loads (the catalogue, all tables, all tables again): the texts that each load has and
    those that it had to parse, as the ones before had left them to it."""
    path, rows, out, before = new_path(spark, "instants-kept"), _times(spark, folder), [], 0
    for load, d in enumerate((rows.where(F.col("source") == MAIN), rows, rows), 1):
        after = extend_dictionary(d, path).count()
        out.append((load, d.select("source", F.coalesce("zone", F.lit("")), "raw").distinct().count(), after - before))
        before = after
    return spark.createDataFrame(out, "load int, texts long, parsed long")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return failed_rows(table(spark, folder, "upload_requests")).select("upload_id", "line_no", "reason").distinct()


def p4_broken(spark: SparkSession, folder: str) -> DataFrame:
    """The broken rows with their whole raw text."""
    return failed_rows(table(spark, folder, "upload_requests"))


def p4_messages(spark: SparkSession, folder: str) -> DataFrame:
    """What csv_uploads.error_message says beside what is wrong in the text."""
    return explained(failed_rows(table(spark, folder, "upload_requests")), table(spark, folder, "csv_uploads"))


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return loaded_rows(table(spark, folder, "upload_requests"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift(table(spark, folder, "feed_files"))


def p6_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every alternative type of every field, with the file where it first came up."""
    d = fused_schema(table(spark, folder, "feed_files"))
    return d.withColumn("names", F.array_join("names", "|"))


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    return unified(table(spark, folder, "feed_files"))


QUERIES = {f.__name__: (f, None) for f in (p1_found, p1_report, p2_found, p2_known, p3_found, p3_incremental, p4_found, p4_broken, p4_messages, p4_loaded, p6_found, p6_alternatives, p6_unified)}
