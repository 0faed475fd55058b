"""Joins, scans, upserts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import relational as R
from ..operators import similarity as S
from ..plans.shared import new_path
from ..sources import keyed as K
from .define import Book

book = Book()
add = book.add


# ---- scans and predicates
@add("s11_scan_by_upload", "SELECT order_id, customer_id FROM ords WHERE upload_id = 'building-1996'")
def _(t):
    return t.orders.where("upload_id = 'building-1996'").select("order_id", "customer_id")


@add("s12_last_wins_map", "SELECT variant_id, location_id, available FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY updated_on DESC, location_id DESC) AS r FROM inventory) WHERE r = 1")
def _(t):
    return R.first_per_key(t.inventory, ["variant_id"], [F.desc("updated_on"), F.desc("location_id")]).select("variant_id", "location_id", "available")


@add("s17_recent_uploads", "SELECT upload_id, max(order_date) AS latest FROM ords GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return t.orders.groupBy("upload_id").agg(F.max("order_date").alias("latest")).orderBy(F.desc("latest"), "upload_id").limit(10)


@add("prj02_or_predicate", "SELECT order_id, line_item_id FROM lines WHERE variant_id = 17 OR location_id = 3")
def _(t):
    return t.lines.where((F.col("variant_id") == 17) | (F.col("location_id") == 3)).select("order_id", "line_item_id")


@add("prj03_in_list", "SELECT variant_id, price FROM catalog WHERE vendor IN ('Brand#11', 'Brand#23', 'Brand#45')")
def _(t):
    return t.catalog.where(F.col("vendor").isin("Brand#11", "Brand#23", "Brand#45")).select("variant_id", "price")


@add("prj04_like_wildcard", "SELECT variant_id, vendor FROM catalog WHERE vendor LIKE '_rand#1%'")
def _(t):
    return t.catalog.where(F.col("vendor").like("_rand#1%")).select("variant_id", "vendor")


@add("prj05_not_in", "SELECT order_id FROM ords WHERE financial_status NOT IN ('F', 'P')")
def _(t):
    return t.orders.where(~F.col("financial_status").isin("F", "P")).select("order_id")


# ---- joins
@add("j01_upload_join", "SELECT l.order_id, l.line_item_id, o.shop_id FROM lines l JOIN ords o ON l.order_id = o.order_id WHERE o.upload_id = 'machinery-1997'")
def _(t):
    o = t.orders.where("upload_id = 'machinery-1997'").select("order_id", "shop_id")
    return t.lines.select("order_id", "line_item_id").join(o, "order_id")


@add("j02_three_way", "SELECT o.shop_id, c.vendor, count(*) AS n_lines, CAST(sum(l.quantity) AS BIGINT) AS units FROM lines l JOIN ords o ON l.order_id = o.order_id JOIN catalog c ON l.variant_id = c.variant_id GROUP BY 1, 2")
def _(t):
    d = t.lines.select("order_id", "variant_id", "quantity").join(t.catalog.select("variant_id", "vendor"), "variant_id").join(t.orders.select("order_id", "shop_id"), "order_id")
    return d.groupBy("shop_id", "vendor").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("units"))


@add(
    "j03_backfill",
    """SELECT l.order_id, l.line_item_id, CASE WHEN l.return_flag = 'N' THEN coalesce(c.vendor, '') ELSE l.return_flag END AS sku FROM lines l LEFT JOIN catalog c ON l.variant_id = c.variant_id""",
)
def _(t):
    blank = t.lines.select("order_id", "line_item_id", "variant_id", F.when(F.col("return_flag") == "N", F.lit(" ")).otherwise(F.col("return_flag")).alias("sku"))
    return R.backfill(blank, t.catalog.select("variant_id", F.col("vendor").alias("sku")), "variant_id", "sku").select("order_id", "line_item_id", "sku")


@add("j05_outer_counts", "SELECT c.c_custkey AS customer_id, count(o.o_orderkey) AS n_orders, count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) AS n_filled FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("customer_id"))
    # counted before the join: one row per customer crosses
    o = t.raw("orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    return c.join(o, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("f", F.lit(0)).alias("n_filled"))


@add("j06_composite_key", "SELECT l.order_id, l.line_item_id, i.available FROM lines l JOIN inventory i ON l.variant_id = i.variant_id AND l.location_id = i.location_id WHERE l.quantity >= 49")
def _(t):
    return t.lines.where("quantity >= 49").join(t.inventory, ["variant_id", "location_id"]).select("order_id", "line_item_id", "available")


@add("j07_nested_lines", "SELECT o.order_id, count(l.order_id) AS n_lines, coalesce(string_agg(CAST(l.variant_id AS VARCHAR), ',' ORDER BY l.line_item_id, l.variant_id), '') AS variants FROM ords o LEFT JOIN lines l ON l.order_id = o.order_id GROUP BY 1")
def _(t):
    nested = t.lines.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("line_item_id", "variant_id"))).alias("own"))
    d = t.orders.select("order_id").join(nested, "order_id", "left")
    own = F.coalesce("own", F.array().cast("array<struct<line_item_id:int,variant_id:bigint>>"))
    return d.select("order_id", F.size(own).cast("long").alias("n_lines"), F.array_join(F.transform(own, lambda x: x["variant_id"].cast("string")), ",").alias("variants"))


@add(
    "j08_either_key_in_window",
    """SELECT order_id, line_item_id, variant_id FROM lines WHERE ship_date >= DATE '1997-01-01' AND ship_date < DATE '1997-04-01' AND (variant_id IN (5, 17, 99) OR location_id IN (5, 17, 99))""",
)
def _(t):
    wanted = t.spark.createDataFrame([(5,), (17,), (99,)], "wanted long")
    own = t.lines.where("ship_date >= date '1997-01-01' and ship_date < date '1997-04-01'").select("order_id", "line_item_id", "variant_id", "location_id")
    return R.either_key_join(own, wanted, [("variant_id", "wanted"), ("location_id", "wanted")], ["order_id", "line_item_id", "variant_id", "location_id"]).select("order_id", "line_item_id", "variant_id")


@add(
    "j09_enriched_lines",
    """SELECT l.order_id, l.line_item_id, c.product_title, c.vendor, coalesce(CAST(s.stock AS BIGINT), -1) AS stock, CASE WHEN c.variant_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution
FROM lines l LEFT JOIN catalog c ON l.variant_id = c.variant_id AND c.price < 1000 LEFT JOIN (SELECT variant_id, sum(available) AS stock FROM inventory WHERE available > 1 GROUP BY 1) s ON s.variant_id = l.variant_id""",
)
def _(t):
    stock = t.inventory.where("available > 1").groupBy("variant_id").agg(F.sum("available").alias("stock"))
    c = t.catalog.where("price < 1000").select("variant_id", "product_title", "vendor", F.lit(True).alias("_hit"))
    d = t.lines.select("order_id", "line_item_id", "variant_id").join(c, "variant_id", "left").join(stock, "variant_id", "left")
    return d.select("order_id", "line_item_id", "product_title", "vendor", F.coalesce("stock", F.lit(-1)).alias("stock"), F.when(F.col("_hit"), "resolved").otherwise("unresolved").alias("resolution"))


@add(
    "j09_resolution_metrics",
    "SELECT count(*) AS n_lines, count(CASE WHEN c.variant_id IS NOT NULL THEN 1 END) AS resolved, round(count(CASE WHEN c.variant_id IS NOT NULL THEN 1 END) * 1.0::DOUBLE / count(*), 6) AS share FROM lines l LEFT JOIN catalog c ON l.variant_id = c.variant_id AND c.price < 1000",
)
def _(t):
    c = t.catalog.where("price < 1000").select("variant_id", F.lit(1).alias("_hit"))
    d = t.lines.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n")).join(c, "variant_id", "left")
    hit = F.sum(F.when(F.col("_hit").isNotNull(), F.col("n")).otherwise(0))
    return d.agg(F.sum("n").alias("n_lines"), hit.alias("resolved"), F.round(hit / F.sum("n"), 6).alias("share"))


@add("j11_catalog_coverage", "SELECT variant_id, 'catalog only' AS side FROM catalog WHERE variant_id NOT IN (SELECT variant_id FROM lines WHERE quantity > 49) UNION ALL SELECT DISTINCT variant_id, 'orders only' FROM lines WHERE quantity > 49 AND variant_id NOT IN (SELECT variant_id FROM catalog WHERE price < 1000)")
def _(t):
    sold = t.lines.where("quantity > 49").select("variant_id").distinct()
    only = t.catalog.select("variant_id").join(sold, "variant_id", "left_anti").withColumn("side", F.lit("catalog only"))
    return only.unionByName(sold.join(t.catalog.where("price < 1000").select("variant_id"), "variant_id", "left_anti").withColumn("side", F.lit("orders only")))


@add("j20_catalog_semi", "SELECT variant_id, product_title FROM catalog WHERE variant_id IN (SELECT variant_id FROM lines WHERE quantity = 50 AND discount_rate > 0.09)")
def _(t):
    wanted = t.lines.where("quantity = 50 and discount_rate > 0.09").select("variant_id")
    return t.catalog.join(wanted, "variant_id", "left_semi").select("variant_id", "product_title")


@add(
    "j22_discount_priors",
    """SELECT c.vendor, c.variant_id, round(s.discount / (s.revenue + s.discount) * 100, 4) AS own_pct, round(v.d / (v.r + v.d) * 100, 4) AS vendor_pct, round(g.d / (g.r + g.d) * 100, 4) AS all_pct
FROM catalog c JOIN sold s ON s.variant_id = c.variant_id JOIN (SELECT c.vendor, sum(s.discount) AS d, sum(s.revenue) AS r FROM sold s JOIN catalog c ON s.variant_id = c.variant_id GROUP BY 1) v ON v.vendor = c.vendor
CROSS JOIN (SELECT sum(discount) AS d, sum(revenue) AS r FROM sold) g""",
)
def _(t):
    s = t.lines.groupBy("variant_id").agg(F.sum("line_discount").alias("d"), F.sum("line_total").alias("r")).join(t.catalog.select("variant_id", "vendor"), "variant_id")
    v = s.groupBy("vendor").agg(F.sum("d").alias("vd"), F.sum("r").alias("vr"))
    g = s.agg(F.sum("d").alias("gd"), F.sum("r").alias("gr"))
    pct = lambda d, r: F.round(F.col(d) / (F.col(r) + F.col(d)) * 100, 4)
    return s.join(v, "vendor").join(F.broadcast(g)).select("vendor", "variant_id", pct("d", "r").alias("own_pct"), pct("vd", "vr").alias("vendor_pct"), pct("gd", "gr").alias("all_pct"))  # one row


# ---- upserts
@add(
    "w01_upsert_latest",
    """WITH old AS (SELECT order_id, customer_id, total FROM ords WHERE order_date < DATE '1998-01-01'), fresh AS (SELECT order_id, customer_id, total + 1 AS total FROM ords WHERE order_date >= DATE '1997-01-01' AND order_date < DATE '1999-01-01')
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE order_id NOT IN (SELECT order_id FROM fresh)""",
)
def _(t):
    o = t.orders.select("order_id", "customer_id", "total", "order_date")
    old = o.where("order_date < date '1998-01-01'").drop("order_date")
    new = o.where("order_date >= date '1997-01-01' and order_date < date '1999-01-01'").withColumn("total", F.col("total") + 1).drop("order_date")
    return R.upsert(old, new, ["order_id"], [F.desc("total")])


@add(
    "w02_line_upsert",
    """WITH k AS (SELECT * FROM lines WHERE line_item_id > 1), n AS (SELECT * FROM lines WHERE line_item_id = 1 OR quantity < 10)
SELECT order_id, line_item_id, quantity, 'keyed' AS how FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_item_id ORDER BY quantity DESC, variant_id) AS r FROM k) WHERE r = 1
UNION ALL SELECT order_id, line_item_id, quantity, 'largest' FROM (SELECT *, row_number() OVER (PARTITION BY order_id, variant_id ORDER BY quantity DESC, line_item_id, unit_price) AS r FROM n) WHERE r = 1""",
)
def _(t):
    keyed = R.first_per_key(t.lines.where("line_item_id > 1"), ["order_id", "line_item_id"], [F.desc("quantity"), F.col("variant_id")])
    largest = R.first_per_key(t.lines.where("line_item_id = 1 or quantity < 10"), ["order_id", "variant_id"], [F.desc("quantity"), F.col("line_item_id"), F.col("unit_price")])
    cut = lambda d, how: d.select("order_id", "line_item_id", "quantity", F.lit(how).alias("how"))
    return cut(keyed, "keyed").unionByName(cut(largest, "largest"))


@add(
    "w03_replace_orders",
    """SELECT order_id, line_item_id, quantity FROM lines WHERE order_id NOT IN (SELECT order_id FROM lines WHERE quantity = 50) UNION ALL SELECT order_id, line_item_id, 0 FROM lines WHERE quantity = 50""",
)
def _(t):
    own = t.lines.select("order_id", "line_item_id", "quantity")
    return R.replace_groups(own, own.where("quantity = 50").withColumn("quantity", F.lit(0)), ["order_id"])


@add(
    "w04_inventory_upsert",
    """WITH f AS (SELECT variant_id, location_id, available + 100 AS available FROM inventory WHERE updated_on >= DATE '1997-01-01'), o AS (SELECT variant_id, location_id, available FROM inventory WHERE updated_on < DATE '1998-01-01')
SELECT * FROM f UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.variant_id = o.variant_id AND f.location_id = o.location_id)""",
)
def _(t):
    """Newer levels replace those of the same item and location in a stored table, others are added."""
    table, cut = K.Keyed(t.spark, new_path(t.spark, "levels"), ["variant_id", "location_id"]), ["variant_id", "location_id", "available"]
    table.upsert(t.inventory.where("updated_on < date '1998-01-01'").select(*cut))
    table.upsert(t.inventory.where("updated_on >= date '1997-01-01'").withColumn("available", F.col("available") + 100).select(*cut))
    return table.read()


@add("w08_delete_counts", "SELECT 'deleted' AS what, count(*) AS n FROM ords WHERE order_date < DATE '1998-01-01' UNION ALL SELECT 'left', count(*) FROM ords WHERE order_date >= DATE '1998-01-01'")
def _(t):
    """Rows deleted from a stored table: how many went, and how many are there when it is read back."""
    table = K.Keyed(t.spark, new_path(t.spark, "orders"), ["order_id"])
    table.upsert(t.orders.select("order_id", "order_date"))
    gone = table.delete(F.col("order_date") < F.lit("1998-01-01").cast("date"))
    one = t.spark.createDataFrame([("deleted", gone)], "what string, n long")
    return one.unionByName(table.read().agg(F.count(F.lit(1)).alias("n")).select(F.lit("left").alias("what"), "n"))


@add("w10_json_rows", """SELECT order_id, '{"order_id":' || CAST(order_id AS VARCHAR) || ',"shop":"' || shop_id || '"}' AS doc FROM ords WHERE financial_status = 'P'""")
def _(t):
    return t.orders.where("financial_status = 'P'").select("order_id", F.to_json(F.struct("order_id", F.col("shop_id").alias("shop"))).alias("doc"))


@add("w11_joined_names", "SELECT order_id, string_agg(DISTINCT item, '; ' ORDER BY item) AS names, CASE WHEN count(*) > 3 THEN 'Yes' ELSE 'No' END AS large FROM vlines GROUP BY 1")
def _(t):
    return t.vendor_lines.groupBy("order_id").agg(F.array_join(F.array_sort(F.collect_set("item")), "; ").alias("names"), F.when(F.count(F.lit(1)) > 3, "Yes").otherwise("No").alias("large"))


# ---- top-k
@add("k01_nulls_last", "SELECT order_id, total FROM (SELECT order_id, total, nullif(financial_status, 'P') AS s FROM ords) ORDER BY s ASC NULLS LAST, total DESC, order_id LIMIT 50")
def _(t):
    s = F.nullif(F.col("financial_status"), F.lit("P"))
    return t.orders.orderBy(s.asc_nulls_last(), F.desc("total"), "order_id").limit(50).select("order_id", "total")


@add("k02_top_by_shop", "SELECT shop_id, order_id, total FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY total DESC, order_id) AS r FROM ords) WHERE r <= 20")
def _(t):
    return B.top_per_group(t.orders.select("shop_id", "order_id", "total"), ["shop_id"], [F.desc("total"), F.col("order_id")], 20).drop("rank")


@add("k05_lines_of_top_products", "SELECT order_id, line_item_id, variant_id FROM lines WHERE variant_id IN (SELECT variant_id FROM sold ORDER BY units DESC, variant_id LIMIT 50)")
def _(t):
    top = t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("u")).orderBy(F.desc("u"), "variant_id").limit(50)
    return t.lines.join(top, "variant_id", "left_semi").select("order_id", "line_item_id", "variant_id")


@add("k06_top_volume", "SELECT variant_id, units, round(0.6 * least(1.0, units / 100.0) + 0.4 * least(1.0, n_lines / 10.0), 6) AS score FROM sold ORDER BY 3 DESC, units DESC, variant_id LIMIT 10")
def _(t):
    s = t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("n"))
    score = F.round(0.6 * F.least(F.lit(1.0), F.col("units") / 100.0) + 0.4 * F.least(F.lit(1.0), F.col("n") / 10.0), 6)
    return s.select("variant_id", "units", score.alias("score")).orderBy(F.desc("score"), F.desc("units"), "variant_id").limit(10)


@add("k08_top_price", "SELECT variant_id, price FROM catalog ORDER BY price DESC, variant_id LIMIT 25")
def _(t):
    return t.catalog.select("variant_id", "price").orderBy(F.desc("price"), "variant_id").limit(25)


@add(
    "k09_tiered_fill",
    """WITH c AS (SELECT variant_id, available_total, 1 AS tier FROM catalog WHERE available_total >= 49 UNION ALL SELECT variant_id, available_total, 2 FROM catalog WHERE available_total >= 45 UNION ALL SELECT variant_id, available_total, 3 FROM catalog),
b AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY tier) AS r FROM c) SELECT variant_id, tier FROM b WHERE r = 1 ORDER BY tier, available_total DESC, variant_id LIMIT 300""",
)
def _(t):
    c = t.catalog.select("variant_id", "available_total")
    return R.tiered_fill([c.where("available_total >= 49"), c.where("available_total >= 45"), c], "variant_id", [F.desc("available_total"), F.col("variant_id")], 300).select("variant_id", "tier")


@add("k13_waves", "SELECT variant_id, CAST(ceil(r / 10.0) AS INT) AS wave FROM (SELECT variant_id, row_number() OVER (ORDER BY units DESC, variant_id) AS r FROM sold) WHERE r <= 78")
def _(t):
    # the global order is over the first 78 rows only
    top = t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("u")).orderBy(F.desc("u"), "variant_id").limit(78)
    from pyspark.sql import Window as W

    return top.select("variant_id", F.ceil(F.row_number().over(W.orderBy(F.desc("u"), "variant_id")) / 10).cast("int").alias("wave"))


# ---- set operations
_CANDS = """WITH c AS (SELECT variant_id AS product, 1 AS source, units AS score FROM sold WHERE units > 800 UNION ALL SELECT variant_id, 2, CAST(available_total AS BIGINT) FROM catalog WHERE available_total > 40
 UNION ALL SELECT variant_id, 3, CAST(sum(available) AS BIGINT) FROM inventory GROUP BY 1 HAVING sum(available) > 35) """


def _candidates(t):
    a = t.lines.groupBy(F.col("variant_id").alias("product")).agg(F.sum("quantity").alias("score")).where("score > 800").withColumn("source", F.lit(1))
    b = t.catalog.where("available_total > 40").select(F.col("variant_id").alias("product"), F.col("available_total").cast("long").alias("score"), F.lit(2).alias("source"))
    c = t.inventory.groupBy(F.col("variant_id").alias("product")).agg(F.sum("available").alias("score")).where("score > 35").withColumn("source", F.lit(3))
    return a.unionByName(b).unionByName(c)


@add("u01_first_wins_union", _CANDS + "SELECT product, source, score FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY source) AS r FROM c) WHERE r = 1")
def _(t):
    return R.first_per_key(_candidates(t), ["product"], [F.col("source")]).select("product", "source", "score")


@add("u02_source_attribution", _CANDS + "SELECT product, string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS sources FROM c GROUP BY 1")
def _(t):
    return _candidates(t).groupBy("product").agg(F.array_join(F.array_sort(F.collect_set(F.col("source").cast("string"))), ",").alias("sources"))


@add("u04_merge_duplicates", _CANDS + "SELECT product, max(score) AS score, count(*) AS n, min(source) AS best FROM c WHERE product NOT IN (SELECT variant_id FROM catalog WHERE vendor = 'Brand#11') GROUP BY 1")
def _(t):
    seen = t.catalog.where("vendor = 'Brand#11'").select(F.col("variant_id").alias("product"))
    d = _candidates(t).groupBy("product").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"), F.min("source").alias("best"))
    return d.join(seen, "product", "left_anti")


@add("u05_except", "SELECT variant_id FROM catalog EXCEPT SELECT variant_id FROM sold WHERE units > 500")
def _(t):
    return t.catalog.select("variant_id").distinct().join(t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("u")).where("u > 500"), "variant_id", "left_anti")


@add("u07_both_ways", "SELECT variant_id, 'stock' AS side FROM (SELECT variant_id FROM catalog WHERE available_total > 25 EXCEPT SELECT variant_id FROM sold WHERE units > 700) UNION ALL SELECT variant_id, 'sold' FROM (SELECT variant_id FROM sold WHERE units > 700 EXCEPT SELECT variant_id FROM catalog WHERE available_total > 25)")
def _(t):
    sold = t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("u")).where("u > 700")
    return R.symmetric_difference(t.catalog.where("available_total > 25"), sold, "variant_id", ("stock", "sold"))


@add("u08_inject_missing", _CANDS + ", d AS (SELECT product, min(source) AS source FROM c GROUP BY 1), e AS (SELECT variant_id AS product, 9 AS source FROM catalog WHERE variant_id NOT IN (SELECT product FROM d) ORDER BY price DESC, variant_id LIMIT 12) SELECT * FROM d UNION ALL SELECT * FROM e")
def _(t):
    d = _candidates(t).groupBy("product").agg(F.min("source").alias("source"))
    extra = t.catalog.select(F.col("variant_id").alias("product"), "price").join(d.select("product"), "product", "left_anti").orderBy(F.desc("price"), "product").limit(12)
    return d.unionByName(extra.select("product", F.lit(9).alias("source")))


@add("u11_distinct_combinations", "SELECT DISTINCT shop_id, channel, financial_status FROM ords")
def _(t):
    return t.orders.select("shop_id", "channel", "financial_status").distinct()


@add(
    "u06_jaccard",
    """WITH w AS (SELECT DISTINCT vendor, unnest(string_split(lower(product_title), ' ')) AS word FROM catalog), n AS (SELECT vendor, count(*) AS k FROM w GROUP BY 1)
SELECT a, b, round(s * 1.0::DOUBLE / (x.k + y.k - s), 6) AS jaccard FROM (SELECT p.vendor AS a, q.vendor AS b, count(*) AS s FROM w p JOIN w q ON p.word = q.word AND p.vendor < q.vendor GROUP BY 1, 2)
JOIN n x ON x.vendor = a JOIN n y ON y.vendor = b""",
)
def _(t):
    words = t.catalog.select(F.col("vendor").alias("key"), F.explode(F.split(F.lower("product_title"), " ")).alias("w")).distinct()
    d = S.jaccard_pairs(words.groupBy("key").agg(F.collect_list("w").alias("words")))
    return d.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@add(
    "j18_nearest_vectors",
    """SELECT query, other, round(cosine, 5) AS cosine, CAST(rk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, other) AS rk FROM
(SELECT q.vec_id AS query, e.vec_id AS other, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id AND q.vec_id % 100 = 0)) WHERE rk <= 5""",
)
def _(t):
    e = t.raw("embeddings")
    return S.nearest(e, e.where("vec_id % 100 = 0"), 5).select("query", "other", F.round("cosine", 5).alias("cosine"), "rank")


@add(
    "m13_similarity_band",
    """SELECT query, other, round(cosine, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, other) AS rk FROM
(SELECT q.vec_id AS query, e.vec_id AS other, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id AND q.vec_id % 100 = 0)) WHERE rk <= 20 AND cosine BETWEEN 0.1 AND 0.9""",
)
def _(t):
    e = t.raw("embeddings")
    d = S.nearest(e, e.where("vec_id % 100 = 0"), 20).where("cosine between 0.1 and 0.9")
    return d.select("query", "other", F.round("cosine", 5).alias("cosine"))


@add(
    "m14_label_similarity",
    """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 5) AS mean_cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""",
)
def _(t):
    return S.set_similarity(t.raw("embeddings"), "label").where("n > 1").select("label", F.round("mean_cosine", 5).alias("mean_cosine"))


QUERIES = book.queries
