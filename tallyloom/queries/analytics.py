"""Aggregates, windows, percentiles, normalisers, trends and forecasts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import statistics as S
from .define import Book

book = Book()
add = book.add
#: The end of the data, in place of the clock.
ANCHOR = "2001-08-01"


def daily(t):
    return t.orders.groupBy("order_date").agg(F.sum("total").alias("revenue"), F.count("*").alias("n_orders"), F.count_distinct("customer_id").alias("customers"))


def r(name: str, to: int = 4):
    return F.round(name, to).alias(name)


# ---- aggregates
@add("a01_table_counts", "SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part")
def _(t):
    d = None
    for n in ("orders", "lineitem", "part"):
        one = t.raw(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
        d = one if d is None else d.unionByName(one)
    return d


@add(
    "a02_coverage",
    """SELECT c AS n_catalog, s AS n_sold, greatest(c - s, 0) AS missing, round(s * 1.0::DOUBLE / c, 6) AS ratio FROM (SELECT count(*) AS c FROM catalog), (SELECT count(DISTINCT variant_id) AS s FROM lines WHERE quantity > 49)""",
)
def _(t):
    c = t.catalog.agg(F.count("*").alias("n_catalog"))
    s = t.lines.where("quantity > 49").agg(F.count_distinct("variant_id").alias("n_sold"))
    return c.join(F.broadcast(s)).select("n_catalog", "n_sold", F.greatest(F.col("n_catalog") - F.col("n_sold"), F.lit(0)).alias("missing"), F.round(F.col("n_sold") / F.col("n_catalog"), 6).alias("ratio"))  # one row


@add("a03_filtered_counts", "SELECT shop_id, count(*) AS n, count(*) FILTER (WHERE total > 200000) AS n_large, count(DISTINCT channel) FILTER (WHERE financial_status = 'F') AS n_channels FROM ords GROUP BY 1")
def _(t):
    return t.orders.groupBy("shop_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("total") > 200000, 1)).alias("n_large"), F.count_distinct(F.when(F.col("financial_status") == "F", F.col("channel"))).alias("n_channels"))


@add("a04_type_averages", "SELECT product_type, count(*) AS n, round(avg(price), 4) AS avg_price, round(avg(available_total), 4) AS avg_stock FROM catalog GROUP BY 1")
def _(t):
    return t.catalog.groupBy("product_type").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("avg_price"), F.round(F.avg("available_total"), 4).alias("avg_stock"))


@add("a05_upload_counts", "SELECT upload_id, shop_id, count(*) AS n, max(order_date) AS latest FROM ords GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("upload_id", "shop_id").agg(F.count("*").alias("n"), F.max("order_date").alias("latest"))


@add("a12_inventory_totals", "SELECT variant_id, CAST(sum(available) AS BIGINT) AS total, count(*) AS n_locations, string_agg(CAST(location_id AS VARCHAR), ',' ORDER BY location_id) AS locations FROM inventory GROUP BY 1")
def _(t):
    own = F.array_join(F.transform(F.array_sort(F.collect_list("location_id")), lambda x: x.cast("string")), ",")
    return t.inventory.groupBy("variant_id").agg(F.sum("available").alias("total"), F.count("*").alias("n_locations"), own.alias("locations"))


@add("a13_velocity", f"SELECT variant_id, round(sum(quantity) / 60.0::DOUBLE, 6) AS velocity FROM lines WHERE ship_date >= DATE '{ANCHOR}' - INTERVAL 60 DAY GROUP BY 1")
def _(t):
    return t.lines.where(F.col("ship_date") >= F.date_sub(F.lit(ANCHOR).cast("date"), 60)).groupBy("variant_id").agg(F.round(F.sum("quantity") / 60, 6).alias("velocity"))


@add(
    "a14_window_metrics",
    f"""SELECT variant_id, CAST(sum(quantity) AS BIGINT) AS units, CAST(round(sum(line_total) * 10000) AS BIGINT) AS revenue_points, CAST(sum(CAST(round(least(greatest(discount_rate, 0), 0.08) * 10000) AS BIGINT)) AS BIGINT) // count(*) AS discount_points FROM lines
WHERE ship_date >= DATE '{ANCHOR}' - INTERVAL 900 DAY GROUP BY 1""",
)
def _(t):
    d = t.lines.where(F.col("ship_date") >= F.date_sub(F.lit(ANCHOR).cast("date"), 900))
    points = F.round(F.least(F.greatest("discount_rate", F.lit(0)), F.lit(0.08)) * 10000).cast("long")
    return d.groupBy("variant_id").agg(F.sum("quantity").alias("units"), F.round(F.sum("line_total") * 10000).cast("long").alias("revenue_points"), F.floor(F.sum(points) / F.count("*")).alias("discount_points"))


@add("a16_historical_discount", "SELECT variant_id, round(discount / (revenue + discount) * 100, 4) AS pct FROM sold")
def _(t):
    d, n = F.sum("line_discount"), F.sum("line_total")
    return t.lines.groupBy("variant_id").agg(F.round(d / (n + d) * 100, 4).alias("pct"))


@add("a18_unit_prices", "SELECT variant_id, round(sum(CASE WHEN unit_price > 1000 THEN unit_price ELSE 0 END) / count(*), 4) AS avg_unit, count(*) AS n FROM lines GROUP BY 1")
def _(t):
    return t.lines.groupBy("variant_id").agg(F.round(F.sum(F.when(F.col("unit_price") > 1000, F.col("unit_price")).otherwise(0)) / F.count("*"), 4).alias("avg_unit"), F.count("*").alias("n"))


@add("a19_catalog_statistics", "SELECT count(*) AS n, round(avg(price), 4) AS avg_price, max(price) AS max_price, min(price) AS min_price, round(avg(CASE WHEN available_total > 5 THEN available_total END), 4) AS avg_stock, count(CASE WHEN available_total <= 5 THEN 1 END) AS n_out FROM catalog")
def _(t):
    return t.catalog.agg(
        F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("avg_price"), F.max("price").alias("max_price"), F.min("price").alias("min_price"),
        F.round(F.avg(F.when(F.col("available_total") > 5, F.col("available_total"))), 4).alias("avg_stock"), F.count(F.when(F.col("available_total") <= 5, 1)).alias("n_out"),
    )


_RANKED = "(SELECT variant_id, quantity, row_number() OVER (PARTITION BY variant_id ORDER BY quantity) - 1 AS i, count(*) OVER (PARTITION BY variant_id) AS n FROM lines)"


@add(
    "a20_quantity_distribution",
    f"""SELECT variant_id, max(n) AS n, round(avg(quantity), 4) AS mean, round(median(quantity), 4) AS median, max(quantity) AS most, max(CASE WHEN i = least(CAST(floor(0.75::DOUBLE * n) AS BIGINT), n - 1) THEN quantity END) AS p75,
max(CASE WHEN i = least(CAST(floor(0.9::DOUBLE * n) AS BIGINT), n - 1) THEN quantity END) AS p90, round(avg(CASE WHEN quantity >= 25 THEN 1.0 ELSE 0.0 END), 4) AS share_large FROM {_RANKED} GROUP BY 1""",
)
def _(t):
    p = S.ranked_percentiles(t.lines.select("variant_id", "quantity"), ["variant_id"], "quantity", {"p75": 0.75, "p90": 0.9}, "floor")
    d = t.lines.groupBy("variant_id").agg(
        F.count("*").alias("n"), F.round(F.avg("quantity"), 4).alias("mean"), F.round(F.median("quantity"), 4).alias("median"), F.max("quantity").alias("most"), F.round(F.avg(F.when(F.col("quantity") >= 25, 1.0).otherwise(0.0)), 4).alias("share_large")
    )
    return d.join(p, "variant_id")


@add(
    "a21_velocity_percentiles",
    """WITH v AS (SELECT c.vendor, s.units, row_number() OVER (PARTITION BY c.vendor ORDER BY s.units) - 1 AS i, count(*) OVER (PARTITION BY c.vendor) AS n FROM sold s JOIN catalog c ON s.variant_id = c.variant_id)
SELECT vendor, max(CASE WHEN i = greatest(CAST(floor(n * 0.25::DOUBLE) AS BIGINT) - 1, 0) THEN units END) AS slow, max(CASE WHEN i = greatest(CAST(floor(n * 0.75::DOUBLE) AS BIGINT) - 1, 0) THEN units END) AS fast FROM v GROUP BY 1""",
)
def _(t):
    d = t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("units")).join(t.catalog.select("variant_id", "vendor"), "variant_id")
    return S.ranked_percentiles(d, ["vendor"], "units", {"slow": 0.25, "fast": 0.75})


@add(
    "a22_linear_percentiles",
    "SELECT product_type, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95 FROM catalog GROUP BY 1",
)
def _(t):
    d = S.ranked_percentiles(t.catalog.select("product_type", "price"), ["product_type"], "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}, "linear")
    return d.select("product_type", *[F.round(n, 4).alias(n) for n in ("p25", "p50", "p75", "p95")])


@add(
    "a23_phase_statistics",
    """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, min(value) AS least, max(value) AS most,
round(stddev_samp(value), 4) AS deviation FROM events GROUP BY 1""",
)
def _(t):
    p = S.ranked_percentiles(t.events.select("event_type", "value"), ["event_type"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99}, "linear")
    d = t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 4).alias("deviation")
    )
    return d.join(p.select("event_type", *[F.round(n, 4).alias(n) for n in ("median", "p95", "p99")]), "event_type")


@add("a24_share_of_total", "SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def _(t):
    # the window is over the groups, one row each
    d = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return d.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4)).orderBy(F.desc("n"), "event_type").limit(5)


@add("a25_namespaced_counters", "SELECT shop_id || ':' || channel AS counter, count(*) AS n FROM ords GROUP BY 1")
def _(t):
    return t.orders.groupBy(F.concat_ws(":", "shop_id", "channel").alias("counter")).agg(F.count("*").alias("n"))


@add("a26_hourly_buckets", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_over FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("n_over"))


@add("a27_dashboard", "SELECT round(avg(total), 4) AS aov, count(*) AS n_orders, count(DISTINCT customer_id) AS n_customers, round(sum(total), 2) AS revenue, count(CASE WHEN financial_status = 'F' THEN 1 END) AS n_approved FROM ords")
def _(t):
    return t.orders.agg(F.round(F.avg("total"), 4).alias("aov"), F.count("*").alias("n_orders"), F.count_distinct("customer_id").alias("n_customers"), F.round(F.sum("total"), 2).alias("revenue"), F.count(F.when(F.col("financial_status") == "F", 1)).alias("n_approved"))


@add("a28_status_table", "SELECT k.status, coalesce(count(o.order_id), 0) AS n, round(coalesce(avg(o.total), 0), 4) AS mean FROM (VALUES ('O'), ('F'), ('P'), ('X')) k(status) LEFT JOIN ords o ON o.financial_status = k.status GROUP BY 1")
def _(t):
    own = t.orders.groupBy(F.col("financial_status").alias("status")).agg(F.count("*").alias("n"), F.avg("total").alias("mean"))
    fixed = t.spark.createDataFrame([("O",), ("F",), ("P",), ("X",)], "status string")
    return fixed.join(own, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("mean"))


@add("a29_overview", "SELECT round(sum(total), 2) AS revenue, count(*) AS n_orders, round(avg(total), 4) AS aov, count(DISTINCT customer_id) AS n_customers, round((count(*) - count(DISTINCT customer_id)) * 1.0::DOUBLE / count(DISTINCT customer_id), 6) AS repeat_rate FROM ords")
def _(t):
    u = F.count_distinct("customer_id")
    return t.orders.agg(F.round(F.sum("total"), 2).alias("revenue"), F.count("*").alias("n_orders"), F.round(F.avg("total"), 4).alias("aov"), u.alias("n_customers"), F.round((F.count("*") - u) / u, 6).alias("repeat_rate"))


@add("a30_grouping_sets", "SELECT shop_id, channel, count(*) AS n, round(avg(total), 4) AS mean FROM ords GROUP BY GROUPING SETS ((shop_id), (channel), (shop_id, channel))")
def _(t):
    return t.orders.groupingSets([[F.col("shop_id")], [F.col("channel")], [F.col("shop_id"), F.col("channel")]], "shop_id", "channel").agg(F.count("*").alias("n"), F.round(F.avg("total"), 4).alias("mean"))


@add("a31_customer_profile", "SELECT customer_id, count(*) AS n, CAST(round(sum(total) * 100) AS BIGINT) AS cents, CAST(round(sum(total) * 100) AS BIGINT) // count(*) AS mean_cents, count(DISTINCT channel) AS n_channels, min(order_date) AS first_date, max(order_date) AS last_date FROM ords GROUP BY 1")
def _(t):
    cents = F.round(F.sum("total") * 100).cast("long")
    return t.orders.groupBy("customer_id").agg(F.count("*").alias("n"), cents.alias("cents"), F.floor(cents / F.count("*")).alias("mean_cents"), F.count_distinct("channel").alias("n_channels"), F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))


@add("a32_daily_revenue", "SELECT order_date, round(revenue, 2) AS revenue, n_orders FROM daily")
def _(t):
    return daily(t).select("order_date", r("revenue", 2), "n_orders")


@add("a32_top_products", "SELECT variant_id, round(revenue, 2) AS revenue FROM sold ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    d = t.lines.groupBy("variant_id").agg(F.round(F.sum("line_total"), 2).alias("revenue"))
    return d.orderBy(F.desc("revenue"), "variant_id").limit(20)


@add("a33_daily_customers", "SELECT order_date, customers, CAST(round(revenue * 100) AS BIGINT) // n_orders AS aov_cents FROM daily")
def _(t):
    return daily(t).select("order_date", "customers", F.floor(F.round(F.col("revenue") * 100).cast("long") / F.col("n_orders")).alias("aov_cents"))


@add("a34_revenue_by_dimension", "SELECT 'country' AS dimension, country AS value, round(sum(total), 2) AS revenue, count(*) AS n FROM ords GROUP BY 2 UNION ALL SELECT 'channel', channel, round(sum(total), 2), count(*) FROM ords GROUP BY 2")
def _(t):
    # both dimensions in one pass over the orders
    d = t.orders.select("total", F.explode(F.create_map(F.lit("country"), F.col("country"), F.lit("channel"), F.col("channel"))).alias("dimension", "value"))
    return d.groupBy("dimension", "value").agg(F.round(F.sum("total"), 2).alias("revenue"), F.count("*").alias("n"))


@add("a35_revenue_stability", "SELECT round(stddev_pop(revenue) / avg(revenue), 6) AS cv, round(greatest(0, 100 - stddev_pop(revenue) / avg(revenue) * 100), 4) AS stability FROM daily")
def _(t):
    cv = F.stddev_pop("revenue") / F.avg("revenue")
    return daily(t).agg(F.round(cv, 6).alias("cv"), F.round(F.greatest(F.lit(0), 100 - cv * 100), 4).alias("stability"))


@add("a36_lifetime_value", "SELECT round(sum(total) / count(DISTINCT customer_id), 4) AS per_customer, round(count(*) * 1.0::DOUBLE / count(DISTINCT customer_id), 6) AS frequency, round(3 * sum(total) / count(DISTINCT customer_id), 4) AS ltv FROM ords")
def _(t):
    u = F.count_distinct("customer_id")
    return t.orders.agg(F.round(F.sum("total") / u, 4).alias("per_customer"), F.round(F.count("*") / u, 6).alias("frequency"), F.round(3 * F.sum("total") / u, 4).alias("ltv"))


@add("a38_share_below", "SELECT shop_id, round(avg(CASE WHEN total < 50000 THEN 1.0 ELSE 0.0 END), 6) AS share_small FROM ords GROUP BY 1")
def _(t):
    return t.orders.groupBy("shop_id").agg(F.round(F.avg(F.when(F.col("total") < 50000, 1.0).otherwise(0.0)), 6).alias("share_small"))


@add(
    "a39_unpivoted_metrics",
    "WITH m AS (SELECT shop_id, count(*)::DOUBLE AS orders, avg(total) AS aov, count(DISTINCT customer_id)::DOUBLE AS customers FROM ords GROUP BY 1) SELECT shop_id, 'orders' AS metric, round(orders, 4) AS value FROM m UNION ALL SELECT shop_id, 'aov', round(aov, 4) FROM m UNION ALL SELECT shop_id, 'customers', round(customers, 4) FROM m",
)
def _(t):
    m = t.orders.groupBy("shop_id").agg(F.count("*").cast("double").alias("orders"), F.avg("total").alias("aov"), F.count_distinct("customer_id").cast("double").alias("customers"))
    return m.unpivot("shop_id", ["orders", "aov", "customers"], "metric", "value").select("shop_id", "metric", r("value"))


@add("a40_filled_shares", "SELECT round(avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS text_share, round(avg(CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS lang_share, round(avg(CASE WHEN source IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS source_share FROM documents")
def _(t):
    return t.raw("documents").agg(*[F.round(F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)), 6).alias(f"{c}_share") for c in ("text", "lang", "source")])


@add(
    "a41_cohort_retention",
    """WITH f AS (SELECT customer_id, date_trunc('month', min(order_date)) AS cohort FROM ords GROUP BY 1), a AS (SELECT DISTINCT customer_id, date_trunc('month', order_date) AS m FROM ords),
k AS (SELECT cohort, count(*) AS size FROM f GROUP BY 1 HAVING count(*) >= 5)
SELECT CAST(f.cohort AS DATE) AS cohort, CAST(date_diff('month', f.cohort, a.m) AS BIGINT) AS months, count(*) AS active, round(count(*) * 1.0::DOUBLE / max(k.size), 6) AS retention FROM f JOIN a ON f.customer_id = a.customer_id JOIN k ON k.cohort = f.cohort GROUP BY 1, 2""",
)
def _(t):
    a = t.orders.select("customer_id", F.trunc("order_date", "month").alias("m")).distinct()
    f = a.groupBy("customer_id").agg(F.min("m").alias("cohort"))
    k = f.groupBy("cohort").agg(F.count("*").alias("size")).where("size >= 5")
    d = a.join(f, "customer_id").join(k, "cohort")
    months = F.months_between("m", "cohort").cast("long")
    return d.groupBy("cohort", months.alias("months")).agg(F.count("*").alias("active"), F.round(F.count("*") / F.max("size"), 6).alias("retention"))


@add(
    "a42_mode_and_counts",
    "SELECT shop_id, channel, n FROM (SELECT shop_id, channel, count(*) AS n, row_number() OVER (PARTITION BY shop_id ORDER BY count(*) DESC, channel) AS rk FROM ords GROUP BY 1, 2) WHERE rk = 1",
)
def _(t):
    d = t.orders.groupBy("shop_id", "channel").agg(F.count("*").alias("n"))
    return B.top_per_group(d, ["shop_id"], [F.desc("n"), F.col("channel")], 1).drop("rank")


@add(
    "a43_store_metrics",
    """SELECT vendor, round(var_pop(price), 4) AS price_variance, round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 4) AS price_iqr, round(median(available_total), 4) AS median_stock, round(stddev_pop(available_total), 4) AS stock_deviation,
count(DISTINCT product_type) AS n_types FROM catalog GROUP BY 1""",
)
def _(t):
    return t.catalog.groupBy("vendor").agg(
        F.round(F.var_pop("price"), 4).alias("price_variance"), F.round(F.percentile("price", 0.75) - F.percentile("price", 0.25), 4).alias("price_iqr"), F.round(F.median("available_total"), 4).alias("median_stock"),
        F.round(F.stddev_pop("available_total"), 4).alias("stock_deviation"), F.count_distinct("product_type").alias("n_types"),
    )


@add("a46_price_ranges", "SELECT product_type, round(avg(price), 4) AS mean, min(price) AS least, max(price) AS most, round(max(price) - min(price), 4) AS spread FROM catalog WHERE price > 0 GROUP BY 1")
def _(t):
    return t.catalog.where("price > 0").groupBy("product_type").agg(F.round(F.avg("price"), 4).alias("mean"), F.min("price").alias("least"), F.max("price").alias("most"), F.round(F.max("price") - F.min("price"), 4).alias("spread"))


# ---- windows
@add("n02_cap_per_type", "SELECT product_type, variant_id FROM (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY price DESC, variant_id) AS rk FROM catalog) WHERE rk <= 15")
def _(t):
    return B.top_per_group(t.catalog.select("product_type", "variant_id", "price"), ["product_type"], [F.desc("price"), F.col("variant_id")], 15).select("product_type", "variant_id")


@add("n03_cap_per_two_keys", "SELECT product_type, vendor, variant_id FROM (SELECT *, row_number() OVER (PARTITION BY product_type, vendor ORDER BY variant_id) AS rk FROM catalog) WHERE rk <= 3")
def _(t):
    return B.top_per_group(t.catalog.select("product_type", "vendor", "variant_id"), ["product_type", "vendor"], [F.col("variant_id")], 3).drop("rank")


@add("n05_prior_uses", "SELECT order_id, line_item_id, least(count(*) OVER (PARTITION BY variant_id ORDER BY order_id, line_item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS prior_uses FROM lines")
def _(t):
    w = W.partitionBy("variant_id").orderBy("order_id", "line_item_id")
    return t.lines.select("order_id", "line_item_id", F.least((F.row_number().over(w) - 1).cast("long"), F.lit(3).cast("long")).alias("prior_uses"))


@add("n06_min_max", "SELECT variant_id, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) AS price_norm, round((available_total - min(available_total) OVER ()) * 1.0::DOUBLE / (max(available_total) OVER () - min(available_total) OVER ()), 6) AS stock_norm FROM catalog")
def _(t):
    d = S.min_max(t.catalog.select("variant_id", "price", "available_total"), ["price", "available_total"])
    return d.select("variant_id", F.round("price_norm", 6).alias("price_norm"), F.round("available_total_norm", 6).alias("stock_norm"))


@add("n07_robust_scale", "SELECT variant_id, round(1 / (1 + exp(-(price - m) / (b - a))), 6) AS price_robust FROM catalog, (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) AS b FROM catalog)")
def _(t):
    return S.robust_scale(t.catalog.select("variant_id", "price"), "price").select("variant_id", r("price_robust", 6))


@add(
    "n07_z_without_outliers",
    """WITH q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM ords), m AS (SELECT avg(total) AS m, stddev_pop(total) AS s FROM ords, q WHERE total BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a))
SELECT order_id, round(1 / (1 + exp(-(total - m) / s)), 6) AS total_z FROM ords, m""",
)
def _(t):
    return S.z_sigmoid_without_outliers(t.orders.select("order_id", "total"), "total", 0.3).select("order_id", r("total_z", 6))


@add(
    "n11_remainder_allocation",
    """WITH s AS (SELECT order_id, line_item_id, variant_id, x, sum(x) OVER (PARTITION BY order_id) AS t, row_number() OVER (PARTITION BY order_id ORDER BY line_item_id DESC, variant_id DESC, x DESC) AS last FROM (SELECT *, CAST(floor(line_total * 10000 + 0.5::DOUBLE) AS BIGINT) AS x FROM lines)),
p AS (SELECT *, CASE WHEN last > 1 THEN CAST((20000 * x + t) // (2 * t) AS BIGINT) ELSE 0 END AS points FROM s)
SELECT order_id, line_item_id, variant_id, CASE WHEN last = 1 THEN 10000 - CAST(sum(points) OVER (PARTITION BY order_id) AS BIGINT) ELSE points END AS points FROM p""",
)
def _(t):
    own = W.partitionBy("order_id")
    d = t.lines.select("order_id", "line_item_id", "variant_id", F.floor(F.col("line_total") * 10000 + 0.5).alias("x"))
    d = d.withColumns({"t": F.sum("x").over(own), "last": F.row_number().over(own.orderBy(F.desc("line_item_id"), F.desc("variant_id"), F.desc("x")))})
    d = d.withColumn("points", F.when(F.col("last") > 1, F.expr("(20000 * x + t) div (2 * t)")).otherwise(0))
    return d.select("order_id", "line_item_id", "variant_id", F.when(F.col("last") == 1, 10000 - F.sum("points").over(own)).otherwise(F.col("points")).alias("points"))


@add("n12_latest_per_group", "SELECT shop_id, channel, max_by(order_id, order_date * 1.0) AS order_id FROM (SELECT shop_id, channel, order_id, CAST(epoch(order_date) AS BIGINT) * 10000000 + order_id AS order_date FROM ords) GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("shop_id", "channel").agg(F.max_by("order_id", F.struct("order_date", "order_id")).alias("order_id"))


@add(
    "n13_half_growth",
    "SELECT round((avg(CASE WHEN i > n // 2 THEN revenue END) / avg(CASE WHEN i <= n // 2 THEN revenue END) - 1) * 100, 4) AS growth FROM (SELECT revenue, row_number() OVER (ORDER BY order_date) AS i, count(*) OVER () AS n FROM daily)",
)
def _(t):
    d = daily(t).select("revenue", F.row_number().over(W.orderBy("order_date")).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    half = F.floor(F.col("n") / 2)
    later, early = F.avg(F.when(F.col("i") > half, F.col("revenue"))), F.avg(F.when(F.col("i") <= half, F.col("revenue")))
    return d.agg(F.round((later / early - 1) * 100, 4).alias("growth"))


@add("n14_trend", "SELECT round(regr_slope(revenue, i), 4) AS slope, round(regr_intercept(revenue, i), 2) AS intercept, count(*) AS n FROM (SELECT revenue, (row_number() OVER (ORDER BY order_date) - 1)::DOUBLE AS i FROM daily)")
def _(t):
    return S.linear_trend(daily(t), "order_date", "revenue").select(r("slope"), r("intercept", 2), "n")


@add("n15_moving_average", "SELECT order_date, round(avg(revenue) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS smooth FROM daily")
def _(t):
    return daily(t).select("order_date", F.round(F.avg("revenue").over(W.orderBy("order_date").rowsBetween(-6, 0)), 2).alias("smooth"))


@add(
    "n16_crowding_distance",
    """WITH d AS (SELECT product_type, variant_id, price, lag(price) OVER w AS a, lead(price) OVER w AS b, max(price) OVER (PARTITION BY product_type) - min(price) OVER (PARTITION BY product_type) AS r FROM catalog WINDOW w AS (PARTITION BY product_type ORDER BY price, variant_id))
SELECT product_type, variant_id, round(CASE WHEN a IS NULL OR b IS NULL THEN -1 ELSE (b - a) / r END, 6) AS gap FROM d""",
)
def _(t):
    w, every = W.partitionBy("product_type").orderBy("price", "variant_id"), W.partitionBy("product_type")
    a, b = F.lag("price").over(w), F.lead("price").over(w)
    gap = F.when(a.isNull() | b.isNull(), F.lit(-1.0)).otherwise((b - a) / (F.max("price").over(every) - F.min("price").over(every)))
    return t.catalog.select("product_type", "variant_id", F.round(gap, 6).alias("gap"))


@add("n18_duration_share", "SELECT user_id, event_type, round(sum(value) * 100 / sum(sum(value)) OVER (PARTITION BY user_id), 4) AS pct FROM events GROUP BY 1, 2")
def _(t):
    d = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return d.select("user_id", "event_type", F.round(F.col("v") * 100 / F.sum("v").over(W.partitionBy("user_id")), 4).alias("pct"))


@add("n19_first_order", "SELECT order_id, customer_id, CASE WHEN order_date = min(order_date) OVER (PARTITION BY customer_id) THEN 1 ELSE 0 END AS is_first FROM ords")
def _(t):
    return t.orders.select("order_id", "customer_id", F.when(F.col("order_date") == F.min("order_date").over(W.partitionBy("customer_id")), 1).otherwise(0).alias("is_first"))


# ---- forecasts
_FORECAST = """WITH s AS (SELECT revenue, row_number() OVER (ORDER BY order_date) - 1 AS i, row_number() OVER (ORDER BY order_date DESC) AS d, count(*) OVER () AS n FROM daily),
f AS (SELECT regr_slope(revenue, i::DOUBLE) AS slope, regr_intercept(revenue, i::DOUBLE) AS icpt, max(n) AS n, avg(CASE WHEN d <= least(7, n // 2) THEN revenue END) AS ma, max(CASE WHEN d = 1 THEN revenue END) AS last FROM s),
g AS (SELECT k AS step, icpt + slope * (n - 1 + k) AS linear, ma, last FROM f, range(1, 31) r(k)) """


@add("f01_linear_forecast", _FORECAST + "SELECT CAST(step AS INT) AS step, round(linear, 2) AS linear FROM g")
def _(t):
    return S.forecast(daily(t), "order_date", "revenue", 30).select("step", r("linear", 2))


@add("f02_ensemble_forecast", _FORECAST + "SELECT CAST(step AS INT) AS step, round((linear + ma + last) / 3, 2) AS mean, round(ma, 2) AS moving_average FROM g")
def _(t):
    return S.forecast(daily(t), "order_date", "revenue", 30).select("step", r("mean", 2), r("moving_average", 2))


@add(
    "f03_holdout_accuracy",
    """WITH s AS (SELECT revenue, (row_number() OVER (ORDER BY order_date) - 1)::DOUBLE AS i, count(*) OVER () AS n FROM daily), m AS (SELECT regr_slope(revenue, i) AS b, regr_intercept(revenue, i) AS a FROM s WHERE i < n // 2)
SELECT round(greatest(0.1, least(0.95, 1 - avg(abs(revenue - (a + b * i)) / revenue))), 6) AS accuracy FROM s, m WHERE i >= n // 2 AND revenue > 0""",
)
def _(t):
    s = daily(t).select("revenue", (F.row_number().over(W.orderBy("order_date")) - 1).cast("double").alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    half = F.floor(F.col("n") / 2)
    m = s.where(F.col("i") < half).agg(F.regr_slope("revenue", "i").alias("b"), F.regr_intercept("revenue", "i").alias("a"))
    error = F.avg(F.abs(F.col("revenue") - (F.col("a") + F.col("b") * F.col("i"))) / F.col("revenue"))
    return s.where((F.col("i") >= half) & (F.col("revenue") > 0)).join(F.broadcast(m)).agg(F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.95), 1 - error)), 6).alias("accuracy"))  # one row


@add(
    "r16_pareto_front",
    """SELECT product_type, variant_id FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM catalog d WHERE d.product_type = c.product_type AND d.price >= c.price AND d.available_total >= c.available_total AND (d.price > c.price OR d.available_total > c.available_total))""",
)
def _(t):
    """Front of two objectives by one sort: a row is on it if its stock beats all rows of a higher price, and is the best of its own price."""
    own = W.partitionBy("product_type")
    higher = F.coalesce(F.max("_s").over(own.orderBy(F.desc("_d")).rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    levels = t.catalog.groupBy("product_type", F.col("price").alias("_d")).agg(F.max("available_total").alias("_s")).withColumn("_h", higher)
    front = levels.where(F.col("_s") > F.col("_h")).select("product_type", F.col("_d").alias("price"), F.col("_s").alias("available_total"))
    return t.catalog.join(front, ["product_type", "price", "available_total"], "left_semi").select("product_type", "variant_id")


QUERIES = book.queries
