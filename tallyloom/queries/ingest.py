"""Scans, sinks, coercions and extraction from the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import id_number
from ..operators import ingest as I
from ..plans.shared import new_path
from ..sources import files
from .define import Book

book = Book()
add = book.add


def number(c: str) -> str:
    t = f"trim({c})"
    plain = f"CASE WHEN starts_with({t}, 'Z2lkOi8v') THEN decode(from_base64({t})) ELSE {t} END"
    return f"TRY_CAST(nullif(regexp_extract({plain}, '([0-9]+)\\s*$', 1), '') AS BIGINT)"


@add("s01_csv_roundtrip", "SELECT variant_id, product_title, vendor, price FROM catalog")
def _(t):
    path = new_path(t.spark, "csv")
    files.write_csv(t.catalog.select("variant_id", "product_title", "vendor", "price"), path)
    return files.read_csv(t.spark, path, "variant_id long, product_title string, vendor string, price double")


@add("s15_json_roundtrip", "SELECT order_id, shop_id, total FROM ords")
def _(t):
    path = new_path(t.spark, "json")
    t.orders.select("order_id", "shop_id", "total").write.json(path)
    return files.read_json(t.spark, path, "order_id long, shop_id string, total double")


@add("w07_partition_overwrite", "SELECT shop_id, count(*) AS n, CAST(sum(CASE WHEN shop_id = 'building' THEN 1 ELSE 0 END) AS BIGINT) AS replaced FROM ords GROUP BY 1")
def _(t):
    path = new_path(t.spark, "partitions")
    d = t.orders.select("order_id", "shop_id", F.lit(0).alias("fresh"))
    files.overwrite_partitions(d, path, ["shop_id"])
    files.overwrite_partitions(d.where("shop_id = 'building'").withColumn("fresh", F.lit(1)), path, ["shop_id"])
    return t.spark.read.parquet(path).groupBy("shop_id").agg(F.count("*").alias("n"), F.sum(F.col("fresh").cast("long")).alias("replaced"))


@add("w13_cache_with_expiry", "SELECT DISTINCT vendor AS key, md5(vendor) AS value FROM catalog")
def _(t):
    path, keys = new_path(t.spark, "cache"), t.catalog.select(F.col("vendor").alias("key"))
    make = lambda k: k.select("key", F.md5("key").alias("value"), F.lit("2030-01-01").cast("timestamp").alias("expires_at"))
    files.cached(t.spark, path, keys.where("key < 'Brand#3'"), make, "2024-01-01")
    return files.cached(t.spark, path, keys, make, "2024-01-02")


_NAMES = ("createdAt", "Published Scope", " line-item.Name ", '"sku"', "inventory_policy.1", "ID", "productHTMLTitle", "Line/Item Name", "Line__Item", "Variant Price", "status", "variantId", "_Product ID_", "SKUCode2Big", "aB")


def _canonical(c: str) -> str:
    """The steps one by one, as there is no look-around."""
    aliases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in I.ALIASES.items())
    cut = f"regexp_replace(regexp_replace(regexp_replace(trim({c}), '[\\s\\-/]+', '_', 'g'), '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    base = f"lower(trim(regexp_replace({cut}, '__+', '_', 'g'), '_'))"
    return f"CASE {base} {aliases} ELSE {base} END"


@add("s03_canonical_headers", f"SELECT h AS header, {_canonical('h')} AS canonical FROM (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") x(h)")
def _(t):
    d = t.spark.createDataFrame([(x,) for x in _NAMES], "header string")
    return d.select("header", I.canonical_column(F.col("header")).alias("canonical"))


_TABLES = {"store_main_orders": "orders", "shop2_catalog_joined_set_synth1": "catalog_joined", "shop2_products_variants_set_synth1": "variants", "shop2_inventory_levels_set_synth1": "inventory_levels", "shop2_inventory_levels_main": "inventory_levels", "shop2_products_variants_main": "variants", "shop2_catalog_joined_main": "catalog_joined"}
_COLUMNS = f"SELECT table_name, lower(trim(column_name)) AS c FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in _TABLES)})"


@add(
    "s02_detect_kind",
    f"""WITH c AS ({_COLUMNS}) SELECT table_name, CASE WHEN bool_or(c = 'order_id') AND bool_or(c IN ('line_item_id', 'sku')) THEN 'orders' WHEN bool_or(c = 'inventory_item_id') AND bool_or(c = 'location_id') THEN 'inventory_levels'
WHEN bool_or(c = 'variant_id') AND bool_or(c = 'product_id') AND bool_or(c = 'inventory_item_id') THEN 'variants' WHEN bool_or(c = 'variant_id') AND bool_or(c = 'product_id') AND bool_or(c = 'product_title') THEN 'catalog_joined' END AS kind FROM c GROUP BY 1""",
)
def _(t):
    return t.spark.createDataFrame([(name, I.detect_kind(t.raw(name).columns)) for name in _TABLES], "table_name string, kind string")


_ASKED = "(VALUES " + ", ".join(f"('{n}', '{r}')" for n, k in _TABLES.items() for r in I.REQUIRED[k]) + ") a(table_name, wanted)"


@add(
    "s04_schema_validation",
    f"""WITH c AS ({_COLUMNS}), h AS (SELECT table_name, {_canonical('c')} AS have FROM c), m AS (SELECT a.table_name, a.wanted, {_canonical('a.wanted')} AS w FROM {_ASKED}),
o AS (SELECT count(CASE WHEN have IN ('order_id', 'name') THEN 1 END) AS named, count(CASE WHEN have IN ('variant_id', 'sku') THEN 1 END) AS item FROM h WHERE table_name = 'store_main_orders')
SELECT t.table_name, coalesce((SELECT string_agg(wanted, ', ' ORDER BY wanted) FROM m WHERE m.table_name = t.table_name AND NOT EXISTS (SELECT 1 FROM h WHERE h.table_name = m.table_name AND have = w)), '') AS missing,
CASE WHEN t.table_name = 'store_main_orders' THEN (SELECT CAST(named = 0 AS BIGINT) + CAST(item = 0 AS BIGINT) FROM o) ELSE 0 END AS groups_missing FROM (SELECT DISTINCT table_name FROM c) t""",
)
def _(t):
    """What each raw table lacks of the kind that its name promises."""
    rows = []
    for name, kind in _TABLES.items():
        missing, groups = I.schema_errors(kind, t.raw(name).columns)
        rows.append((name, ", ".join(missing), len(groups)))
    return t.spark.createDataFrame(rows, "table_name string, missing string, groups_missing long")


@add(
    "s13_point_lookups",
    f"""SELECT 'sku' AS by, sku, {number('variant_id')} AS variant_no FROM (SELECT DISTINCT sku, variant_id FROM shop2_products_variants_set_synth1) WHERE sku = (SELECT min(sku) FROM shop2_products_variants_set_synth1)
UNION SELECT 'number', sku, {number('variant_id')} FROM shop2_products_variants_set_synth1 WHERE {number('variant_id')} IN (SELECT max({number('variant_id')}) FROM shop2_products_variants_set_synth1)""",
)
def _(t):
    """Records by one value of a key: the value is a filter of the scan, not a join."""
    d = t.raw("shop2_products_variants_set_synth1")
    no = id_number(F.col("variant_id"))
    sku, last = d.agg(F.min("sku"), F.max(no)).first()
    cut = lambda rows, by: rows.select(F.lit(by).alias("by"), "sku", no.alias("variant_no"))
    return cut(d.where(F.col("sku") == sku), "sku").unionByName(cut(d.where(no == last), "number")).distinct()


@add("w14_known_columns", "SELECT variant_id, price FROM catalog")
def _(t):
    return I.known_columns(t.catalog.withColumn("other", F.lit(1)), ["variant_id", "price", "not_there"])


@add("w15_plain_json", """SELECT variant_id, '{"price":' || CAST(CAST(CAST(price AS DECIMAL(12,2)) AS DOUBLE) AS VARCHAR) || '}' AS doc FROM catalog""")
def _(t):
    d = t.catalog.select("variant_id", F.struct(F.col("price").cast("decimal(12,2)").alias("price")).alias("doc"))
    return I.decimals_as_doubles(d).select("variant_id", F.to_json("doc").alias("doc"))


@add("prj27_half_up", "SELECT variant_id, CAST(round(CAST(price AS DECIMAL(18,4)) / 8, 2) AS DOUBLE) AS eighth FROM (SELECT variant_id, CAST(price * 100 AS BIGINT) / 100.0 AS price FROM catalog)")
def _(t):
    price = (F.col("price") * 100).cast("long") / F.lit(100)
    return t.catalog.select("variant_id", F.round(price.cast("decimal(18,4)") / 8, 2).cast("double").alias("eighth"))


@add("prj40_coercions", "SELECT x AS raw, lower(trim(coalesce(x, ''))) IN ('true', '1', 'yes', 'y', 'on') AS truth, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(nullif(trim(x), '') AS DOUBLE), 0.5))) AS share FROM (VALUES ('TRUE'), (' yes '), ('0.25'), ('7'), ('-1'), ('x'), (''), (NULL)) v(x)")
def _(t):
    d = t.spark.createDataFrame([(x,) for x in ("TRUE", " yes ", "0.25", "7", "-1", "x", "", None)], "raw string")
    return d.select("raw", I.truth(F.col("raw")).alias("truth"), I.clamped(F.col("raw"), 0.0, 1.0, 0.5).alias("share"))


@add(
    "s05_sample_validation",
    """SELECT count(*) AS n, count(CASE WHEN nullif(trim(updated_at), '') IS NULL THEN 1 END) AS no_time, count(CASE WHEN available IS NULL THEN 1 END) AS no_count, count(CASE WHEN available < 0 THEN 1 END) AS negative FROM shop2_inventory_levels_set_synth1""",
)
def _(t):
    d = t.raw("shop2_inventory_levels_set_synth1")
    return d.agg(F.count("*").alias("n"), F.count(F.when(I.filled(F.col("updated_at")).isNull(), 1)).alias("no_time"), F.count(F.when(F.col("available").isNull(), 1)).alias("no_count"), F.count(F.when(F.col("available") < 0, 1)).alias("negative"))


@add(
    "s06_order_headers",
    f"""SELECT order_no, status, currencycode, total FROM (SELECT *, row_number() OVER (PARTITION BY order_no ORDER BY l NULLS FIRST, createdat NULLS FIRST, status NULLS FIRST, total NULLS FIRST, currencycode NULLS FIRST) AS r FROM
(SELECT {number('order_id')} AS order_no, {number('lineitemid')} AS l, createdat, displayfinancialstatus AS status, currencycode, totalprice AS total FROM store_main_orders) WHERE order_no IS NOT NULL) WHERE r = 1""",
)
def _(t):
    return I.order_headers(t.raw("store_main_orders")).select("order_no", "status", "currencycode", "total")


@add(
    "s06_order_lines",
    f"""SELECT line_no, order_no, variant_no, quantity, unit_price, sku FROM (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY order_no NULLS FIRST, variant_no NULLS FIRST, quantity, unit_price NULLS FIRST, sku NULLS FIRST) AS r FROM
(SELECT {number('lineitemid')} AS line_no, {number('order_id')} AS order_no, {number('variantid')} AS variant_no, greatest(coalesce(lineitemquantity, 0), 0) AS quantity, originalunitprice AS unit_price,
coalesce(nullif(trim(sku), ''), 'no-sku-' || right(coalesce(nullif(trim(variantid), ''), nullif(trim(lineitemid), ''), ''), 10)) AS sku FROM store_main_orders) WHERE line_no IS NOT NULL) WHERE r = 1""",
)
def _(t):
    return I.order_lines(t.raw("store_main_orders"))


@add("s07_variants", f"SELECT DISTINCT {number('variant_id')} AS variant_no, sku, price, coalesce(nullif(trim(variant_title), ''), 'Default') AS title FROM shop2_products_variants_set_synth1 WHERE nullif(trim(variant_id), '') IS NOT NULL")
def _(t):
    d = t.raw("shop2_products_variants_set_synth1").where(I.filled(F.col("variant_id")).isNotNull())
    return d.select(id_number(F.col("variant_id")).alias("variant_no"), "sku", "price", F.coalesce(I.filled(F.col("variant_title")), F.lit("Default")).alias("title")).distinct()


@add("s08_inventory", f"SELECT {number('inventory_item_id')} AS item_no, {number('location_id')} AS location_no, max(coalesce(available, 0)) AS available FROM shop2_inventory_levels_set_synth1 WHERE nullif(trim(location_id), '') IS NOT NULL GROUP BY 1, 2")
def _(t):
    d = t.raw("shop2_inventory_levels_set_synth1").where(I.filled(F.col("location_id")).isNotNull())
    return d.groupBy(id_number(F.col("inventory_item_id")).alias("item_no"), id_number(F.col("location_id")).alias("location_no")).agg(F.max(I.lenient_int(F.col("available"))).alias("available"))


@add("s09_catalog", f"SELECT DISTINCT {number('variant_id')} AS variant_no, lower(trim(product_status)) AS status, CASE WHEN price > 0 AND cost > 0 THEN round((price - cost) / price, 6) END AS margin FROM shop2_catalog_joined_set_synth1")
def _(t):
    margin = F.when((F.col("price") > 0) & (F.col("cost") > 0), F.round((F.col("price") - F.col("cost")) / F.col("price"), 6))
    return t.raw("shop2_catalog_joined_set_synth1").select(id_number(F.col("variant_id")).alias("variant_no"), F.lower(F.trim("product_status")).alias("status"), margin.alias("margin")).distinct()


@add("prj10_synthetic_sku", f"SELECT {number('lineitemid')} AS line_no, 'no-sku-' || right(coalesce(nullif(trim(variantid), ''), nullif(trim(productid), ''), lineitemid), 10) AS sku FROM store_main_orders")
def _(t):
    return t.raw("store_main_orders").select(id_number(F.col("lineitemid")).alias("line_no"), I.synthetic_sku(F.col("variantid"), F.col("productid"), F.col("lineitemid")).alias("sku"))


@add("prj11_lenient_numbers", "SELECT x AS raw, CAST(coalesce(TRY_CAST(nullif(trim(x), '') AS DECIMAL(10,2)), 0) AS DOUBLE) AS d, coalesce(TRY_CAST(trunc(TRY_CAST(nullif(trim(x), '') AS DOUBLE)) AS INT), 0) AS i FROM (VALUES ('1.50'), (' 7 '), (''), ('abc'), ('3.0'), ('-2'), (NULL)) v(x)")
def _(t):
    d = t.spark.createDataFrame([("1.50",), (" 7 ",), ("",), ("abc",), ("3.0",), ("-2",), (None,)], "raw string")
    return d.select("raw", I.lenient_decimal(F.col("raw")).cast("double").alias("d"), I.lenient_int(F.col("raw")).alias("i"))


@add("prj12_defaults", "SELECT doc_id, coalesce(nullif(trim(lang), ''), 'und') AS lang, coalesce(nullif(trim(source), ''), 'unknown') AS source FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.coalesce(I.filled(F.col("lang")), F.lit("und")).alias("lang"), F.coalesce(I.filled(F.col("source")), F.lit("unknown")).alias("source"))


@add("prj15_shop_id", "SELECT id, nullif(lower(trim(shop_id)), '') AS shop FROM csv_uploads")
def _(t):
    return t.raw("csv_uploads").select("id", F.lower(I.filled(F.col("shop_id"))).alias("shop"))


@add("prj16_inferred_shop", "SELECT run_id, min(nullif(lower(trim(shop_id)), '')) AS shop FROM csv_uploads WHERE run_id IS NOT NULL GROUP BY 1")
def _(t):
    return t.raw("csv_uploads").where("run_id is not null").groupBy("run_id").agg(F.min(F.lower(I.filled(F.col("shop_id")))).alias("shop"))


@add("prj17_truncate", "SELECT doc_id, substr(text, 1, 60) AS head FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.substring("text", 1, 60).alias("head"))


@add("prj20_gids", "SELECT variant_id, 'gid://shopify/ProductVariant/' || CAST(variant_id AS VARCHAR) AS gid FROM catalog")
def _(t):
    return t.catalog.select("variant_id", I.gid("ProductVariant", F.col("variant_id")).alias("gid"))


@add("prj21_id_spellings", f"SELECT {number('variantid')} AS variant_no, count(DISTINCT variantid) AS spellings, count(*) AS n FROM store_main_orders WHERE {number('variantid')} IS NOT NULL GROUP BY 1")
def _(t):
    d = t.raw("store_main_orders").select(id_number(F.col("variantid")).alias("variant_no"), "variantid").where("variant_no is not null")
    return d.groupBy("variant_no").agg(F.count_distinct("variantid").alias("spellings"), F.count("*").alias("n"))


@add("prj23_text_parts", "SELECT variant_id, concat_ws(' | ', product_title, vendor, CASE WHEN price > 950 THEN NULL ELSE product_type END) AS text FROM catalog")
def _(t):
    return t.catalog.select("variant_id", F.concat_ws(" | ", "product_title", "vendor", F.when(F.col("price") > 950, F.lit(None)).otherwise(F.col("product_type"))).alias("text"))


@add("prj24_hashes", "SELECT variant_id, md5(product_title) AS m, sha256(vendor || ', ' || product_type) AS s FROM catalog")
def _(t):
    return t.catalog.select("variant_id", F.md5("product_title").alias("m"), F.sha2(F.concat_ws(", ", "vendor", "product_type"), 256).alias("s"))


@add("prj25_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@add("prj36_tiers", "SELECT variant_id, CASE WHEN price < 920 THEN 'small' WHEN price < 960 THEN 'medium' ELSE 'large' END AS tier FROM catalog")
def _(t):
    return t.catalog.select("variant_id", F.when(F.col("price") < 920, "small").when(F.col("price") < 960, "medium").otherwise("large").alias("tier"))


@add("x08_latest_upload_of_run", "SELECT run_id, csv_type, max(created_at) AS latest, count(DISTINCT id) AS uploads FROM csv_uploads WHERE run_id IS NOT NULL GROUP BY 1, 2")
def _(t):
    return t.raw("csv_uploads").where("run_id is not null").groupBy("run_id", "csv_type").agg(F.max("created_at").alias("latest"), F.count_distinct("id").alias("uploads"))


@add("t10_complete_runs", "SELECT run_id FROM csv_uploads WHERE csv_type IN ('orders', 'variants', 'catalog_joined', 'inventory_levels') AND run_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT csv_type) = 4")
def _(t):
    from ..streaming.windows import complete_groups

    d = t.raw("csv_uploads").where("run_id is not null").withColumnRenamed("created_at", "ts")
    return complete_groups(d, "run_id", "csv_type", ["orders", "variants", "catalog_joined", "inventory_levels"]).select("run_id")


QUERIES = book.queries
