"""Ranks, caps, candidate lists, greedy matching, near-duplicates and progress states."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import ingest as I
from ..operators import relational as R
from ..operators import selection as S
from ..operators import similarity as Z
from ..operators.mining import frequent_sets, in_large_orders
from ..plans.codes import dense_codes
from ..plans.shared import new_path
from ..sources import keyed as K
from .define import Book

book = Book()
add = book.add


def vendor_pairs(t):
    return B.pair_counts(B.distinct_items(t.vendor_lines))


# ---- windows and top-k
@add("n01_rank_position", "SELECT variant_id, row_number() OVER (ORDER BY price DESC, variant_id) AS rank_position FROM catalog")
def _(t):
    """The rank of every row: numbered inside ranges, so no task sorts the whole."""
    d = t.catalog.select((-F.col("price")).alias("_order"), "variant_id")
    return dense_codes(d, ["_order", "variant_id"]).select("variant_id", (F.col("code") + 1).alias("rank_position"))


@add("n04_cap_per_item_set", "WITH s AS (SELECT order_id, string_agg(item, '|' ORDER BY item) AS items FROM vb GROUP BY 1) SELECT order_id, items FROM (SELECT *, row_number() OVER (PARTITION BY items ORDER BY order_id) AS r FROM s) WHERE r <= 2")
def _(t):
    d = B.baskets(B.distinct_items(t.vendor_lines), 1).select("order_id", F.array_join("items", "|").alias("items"))
    return B.top_per_group(d, ["items"], [F.col("order_id")], 2).select("order_id", "items")


@add("n10_top_partners", "WITH e AS (SELECT item_a AS item, item_b AS other, n FROM vpairs UNION ALL SELECT item_b, item_a, n FROM vpairs) SELECT item, other, n FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, other) AS r FROM e) WHERE r <= 2")
def _(t):
    both = B.both_ways(vendor_pairs(t), "other", "n")
    return B.top_per_group(both, ["item"], [F.desc("n"), F.col("other")], 2).select("item", "other", "n")


@add("k11_priority_targets", "WITH c AS (SELECT variant_id, 1 AS tier FROM (SELECT variant_id FROM sold ORDER BY units DESC, variant_id LIMIT 60) UNION ALL SELECT variant_id, 2 FROM catalog WHERE available_total = 50 UNION ALL SELECT variant_id, 3 FROM catalog) SELECT variant_id, min(tier) AS tier FROM c GROUP BY 1 ORDER BY 2, 1 LIMIT 200")
def _(t):
    top = t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("u")).orderBy(F.desc("u"), "variant_id").limit(60).select("variant_id")
    return R.tiered_fill([top, t.catalog.where("available_total = 50").select("variant_id"), t.catalog.select("variant_id")], "variant_id", [F.col("variant_id")], 200)


@add(
    "k12_tier_ladder",
    "WITH c AS (SELECT item_a, item_b, 1 AS tier, n FROM vpairs WHERE n >= 40 UNION ALL SELECT item_a, item_b, 2, n FROM vpairs WHERE n >= 20 UNION ALL SELECT item_a, item_b, 3, n FROM vpairs), b AS (SELECT item_a, item_b, min(tier) AS tier, max(n) AS n FROM c GROUP BY 1, 2) SELECT item_a, item_b, tier FROM b ORDER BY tier, n DESC, item_a, item_b LIMIT 120",
)
def _(t):
    p = vendor_pairs(t).withColumn("pair", F.concat_ws("|", "item_a", "item_b"))
    d = R.tiered_fill([p.where("n >= 40"), p.where("n >= 20"), p], "pair", [F.desc("n"), F.col("item_a"), F.col("item_b")], 120)
    return d.select("item_a", "item_b", "tier")


# ---- sets
_SOURCES = "WITH c AS (SELECT item_a || '|' || item_b AS products, 'pair' AS source, n AS score FROM vpairs UNION ALL SELECT greatest(item_a, item_b) || '|' || least(item_a, item_b), 'swap', n + 1 FROM vpairs WHERE n % 2 = 0) "


@add("u03_merge_by_set", _SOURCES + ", k AS (SELECT list_aggregate(list_sort(string_split(products, '|')), 'string_agg', '|') AS signature, source, score FROM c) SELECT signature, max(score) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, arg_max(source, score) AS best FROM k GROUP BY 1")
def _(t):
    p = vendor_pairs(t)
    one = p.select(F.array("item_a", "item_b").alias("products"), F.lit("pair").alias("source"), F.col("n").alias("score"))
    two = p.where("n % 2 = 0").select(F.array("item_b", "item_a").alias("products"), F.lit("swap").alias("source"), (F.col("n") + 1).alias("score"))
    return S.merge_by_set(one.unionByName(two)).select(F.array_join("signature", "|").alias("signature"), "score", F.array_join("sources", ",").alias("sources"), "best")


@add(
    "u04_merge_candidates",
    """WITH c AS (SELECT item_a AS x, item_b AS y, 'pair' AS source, n * 1.0::DOUBLE AS score, n % 7 * 1.0::DOUBLE AS confidence, n % 5 * 1.0::DOUBLE AS lift, n % 3 * 1.0::DOUBLE AS support, n % 11 * 1.0::DOUBLE AS fit FROM vpairs
UNION ALL SELECT item_b, item_a, 'swap', n + 1.0::DOUBLE, n % 4 * 1.0::DOUBLE, n % 6 * 1.0::DOUBLE, n % 2 * 1.0::DOUBLE, n % 13 * 1.0::DOUBLE FROM vpairs WHERE n % 2 = 0)
SELECT least(x, y) || '|' || greatest(x, y) AS signature, max(score) AS score, max(confidence) AS confidence, max(lift) AS lift, max(support) AS support, avg(fit) AS fit, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, arg_max(x || '|' || y, score) AS products
FROM c WHERE least(x, y) <> 'Brand#11' GROUP BY 1""",
)
def _(t):
    """Sets that are already there are left out, those of several sources become one."""
    p, n = vendor_pairs(t), F.col("n")
    row = lambda d, a, b, source, add, *mods: d.select(F.array(a, b).alias("products"), F.lit("pair").alias("kind"), F.lit(source).alias("source"), (n + add).cast("double").alias("score"), *[(n % m).cast("double").alias(c) for c, m in zip(("confidence", "lift", "support", "fit"), mods)])
    known = p.where("item_a = 'Brand#11'").select(F.array("item_a", "item_b").alias("signature"), F.lit("pair").alias("kind"))
    d = S.merge_candidates(row(p, "item_a", "item_b", "pair", 0, 7, 5, 3, 11).unionByName(row(p.where("n % 2 = 0"), "item_b", "item_a", "swap", 1, 4, 6, 2, 13)), known)
    join = lambda c, by: F.array_join(c, by).alias(c)
    return d.select(join("signature", "|"), "score", "confidence", "lift", "support", "fit", join("sources", ","), join("products", "|"))


@add("u10_concat_and_cut", "WITH c AS (SELECT 1 AS p, item_a AS a, item_b AS b, n FROM vpairs WHERE n >= 30 UNION ALL SELECT 2, item, '', n_item FROM vitems) SELECT p, a, b FROM c ORDER BY p, n DESC, a, b LIMIT 40")
def _(t):
    p = vendor_pairs(t).where("n >= 30").select(F.lit(1).alias("p"), F.col("item_a").alias("a"), F.col("item_b").alias("b"), "n")
    i = B.item_counts(B.distinct_items(t.vendor_lines)).select(F.lit(2).alias("p"), F.col("item").alias("a"), F.lit("").alias("b"), F.col("n_item").alias("n"))
    return p.unionByName(i).orderBy("p", F.desc("n"), "a", "b").limit(40).select("p", "a", "b")


# ---- selection
@add(
    "r05_weighted_rank",
    """WITH s AS (SELECT variant_id, (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS p, (available_total - min(available_total) OVER ()) * 1.0::DOUBLE / (max(available_total) OVER () - min(available_total) OVER ()) AS a FROM catalog)
SELECT variant_id, round(0.7::DOUBLE * p + 0.3::DOUBLE * a, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 100""",
)
def _(t):
    return S.weighted_top(t.catalog.select("variant_id", "price", "available_total"), {"price": 0.7, "available_total": 0.3}, "variant_id", 100)


@add("r15_constrained_top", "SELECT variant_id, price FROM catalog WHERE available_total >= 20 ORDER BY price DESC, variant_id LIMIT 15")
def _(t):
    return t.catalog.where("available_total >= 20").select("variant_id", "price").orderBy(F.desc("price"), "variant_id").limit(15)


@add(
    "r04_best_option",
    "SELECT variant_id, arg_max(o, price * (1 - o / 100.0::DOUBLE) * (1 + o / 20.0::DOUBLE) - o * 0.000001::DOUBLE) AS option FROM catalog, (VALUES (5), (10), (15), (20), (25)) v(o) GROUP BY 1",
)
def _(t):
    score = F.col("price") * (1 - F.col("o") / 100.0) * (1 + F.col("o") / 20.0) - F.col("o") * 0.000001
    d = t.catalog.select("variant_id", "price", F.explode(F.array(*[F.lit(x) for x in (5, 10, 15, 20, 25)])).alias("o"))
    return d.groupBy("variant_id").agg(F.max_by("o", score).alias("option"))


@add("n20_greedy_matching")
def _(t):
    """Variant pairs taken by count, each variant at most once: tested against a walk over a fixture."""
    p = B.pair_counts(B.distinct_items(t.lines, item="variant_id"), 2)
    return S.greedy_matching(p, "item_a", "item_b", [-F.col("n"), F.col("item_a"), F.col("item_b")])


@add("r17_pareto_search")
def _(t):
    """Seeded evolutionary search per product type for spread-out compromises of price and stock: rows only."""
    return S.pareto_search(t.catalog.select("product_type", "variant_id", "price", F.col("available_total").cast("double").alias("stock")), "product_type", "variant_id", ["price", "stock"], keep=12, seed=42)


@add(
    "r16_all_fronts",
    """WITH f AS (SELECT product_type, price, max(available_total) AS s FROM catalog GROUP BY 1, 2) SELECT product_type, count(*) AS n FROM catalog c WHERE NOT EXISTS
(SELECT 1 FROM f WHERE f.product_type = c.product_type AND ((f.price > c.price AND f.s >= c.available_total) OR (f.price = c.price AND f.s > c.available_total))) GROUP BY 1""",
)
def _(t):
    d = S.pareto_fronts(t.catalog.select("product_type", "variant_id", "price", "available_total"), ["product_type"], "price", "available_total", 3)
    return d.where("front = 1").groupBy("product_type").agg(F.count("*").alias("n"))


@add(
    "r16_front_counts",
    """SELECT product_type, front, CAST(sum(n) AS BIGINT) AS n FROM (WITH RECURSIVE p AS (SELECT product_type, price, available_total AS s, count(*) AS n FROM catalog GROUP BY 1, 2, 3),
r AS (SELECT 1 AS front, * FROM p UNION ALL SELECT front + 1, product_type, price, s, n FROM (SELECT *, max(s) OVER (PARTITION BY product_type ORDER BY price DESC, s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM r) WHERE s <= above)
SELECT product_type, price, s, max(front) AS front, any_value(n) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def _(t):
    """Rows on each front, down to the last; r16_all_fronts counts the first one only."""
    d = S.front_numbers(t.catalog.select("product_type", "price", "available_total"), ["product_type"], "price", "available_total")
    return d.groupBy("product_type", "front").agg(F.count("*").alias("n"))


@add("m05_sets_of_four", """WITH big AS (SELECT * FROM vb WHERE order_id IN (SELECT order_id FROM vbig)) SELECT x.item || '|' || y.item || '|' || z.item || '|' || u.item AS items, count(*) AS n FROM big x JOIN big y ON x.order_id = y.order_id AND x.item < y.item
JOIN big z ON x.order_id = z.order_id AND y.item < z.item JOIN big u ON x.order_id = u.order_id AND z.item < u.item GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    return frequent_sets(in_large_orders(B.distinct_items(t.vendor_lines)), 3, 4).where("size = 4").select(F.array_join("items", "|").alias("items"), "n")


@add(
    "j17_similar_by_attributes",
    """WITH p AS (SELECT a.variant_id AS a, b.variant_id AS b, abs(a.price - b.price) AS gap FROM catalog a JOIN catalog b ON a.product_type = b.product_type AND a.vendor = b.vendor AND a.variant_id <> b.variant_id)
SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(gap, 4), b) AS r FROM p) WHERE r <= 3""",
)
def _(t):
    return Z.nearest_in_block(t.catalog, ["product_type", "vendor"], "variant_id", "price", 3).select("a", "b")


@add(
    "j19_near_duplicate_baskets",
    """WITH s AS (SELECT order_id, list(item ORDER BY item) AS items FROM vb GROUP BY 1 HAVING count(*) >= 5), g AS (SELECT items, min(order_id) AS class_id, count(*) AS n FROM s GROUP BY 1),
w AS (SELECT class_id, len(items) AS k, unnest(items) AS item FROM g),
l AS (SELECT x.class_id AS a, y.class_id AS b FROM w x JOIN w y ON x.item = y.item AND x.class_id < y.class_id GROUP BY 1, 2 HAVING count(*) >= 0.8::DOUBLE * (max(x.k) + max(y.k) - count(*)) - 1e-9),
e AS (SELECT a AS class_id FROM l UNION ALL SELECT b FROM l), c AS (SELECT class_id, count(*) AS links FROM e GROUP BY 1)
SELECT s.order_id, g.class_id, coalesce(c.links, 0) AS links FROM s JOIN g ON s.items = g.items LEFT JOIN c ON c.class_id = g.class_id""",
)
def _(t):
    sets = B.baskets(B.distinct_items(t.vendor_lines), 5)
    return Z.near_duplicate_sets(sets, "order_id", "items", 0.8)


@add("m15_tier7_same_group_links", "SELECT product_type, count(*) * (count(*) - 1) // 2 AS links FROM catalog GROUP BY 1")
def _(t):
    """How many pairs share a group, from the group sizes: no pair is made."""
    n = F.count("*")
    return t.catalog.groupBy("product_type").agg(F.floor(n * (n - 1) / 2).alias("links"))


# ---- text and small projections
@add("prj18_currency", "SELECT order_id, CASE country WHEN 'UNITED STATES' THEN '$' WHEN 'JAPAN' THEN '¥' WHEN 'INDIA' THEN '₹' ELSE '€' END AS symbol FROM ords")
def _(t):
    symbols = F.create_map(*[F.lit(x) for kv in {"UNITED STATES": "$", "JAPAN": "¥", "INDIA": "₹"}.items() for x in kv])
    return t.orders.select("order_id", F.coalesce(symbols[F.col("country")], F.lit("€")).alias("symbol"))


@add("prj19_normalised_text")
def _(t):
    """SQL has no NFKC: tested on a fixture."""
    return t.raw("documents").select("doc_id", I.compatible_text(F.col("text")).alias("text"))


@add("prj22_title_words", "SELECT variant_id, list_aggregate(list_transform(list_filter(string_split(replace(lower(product_title), '-', ' '), ' '), lambda x: x <> '')[1:4], lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS title FROM catalog")
def _(t):
    return t.catalog.select("variant_id", I.title_words(F.col("product_title")).alias("title"))


@add("prj14_time_shape", r"SELECT count(*) AS n, count(CASE WHEN regexp_matches(createdat, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') THEN 1 END) AS iso, count(CASE WHEN regexp_matches(createdat, '^\d+$') THEN 1 END) AS numeric_times FROM store_main_orders")
def _(t):
    c = F.col("createdat")
    return t.raw("store_main_orders").agg(F.count("*").alias("n"), F.count(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), 1)).alias("iso"), F.count(F.when(c.rlike(r"^\d+$"), 1)).alias("numeric_times"))


# ---- writes
@add(
    "w05_keep_last",
    """WITH f AS (SELECT variant_id, location_id, updated_on FROM inventory WHERE updated_on >= DATE '1997-01-01' AND variant_id IS NOT NULL), o AS (SELECT variant_id, min(location_id) AS location_id FROM inventory GROUP BY 1)
SELECT variant_id, location_id FROM (SELECT variant_id, location_id, row_number() OVER (PARTITION BY variant_id ORDER BY updated_on DESC, location_id DESC) AS r FROM f) WHERE r = 1
UNION ALL SELECT * FROM o WHERE variant_id NOT IN (SELECT variant_id FROM f)""",
)
def _(t):
    """A stored table with one row per variant gets newer rows, several for one variant: the last one stays."""
    table = K.Keyed(t.spark, new_path(t.spark, "variants"), ["variant_id"])
    table.upsert(t.inventory.groupBy("variant_id").agg(F.min("location_id").alias("location_id"), F.lit(None).cast("date").alias("updated_on")))
    fresh = t.inventory.where("updated_on >= date '1997-01-01'").select("variant_id", "location_id", "updated_on")
    table.upsert(fresh, [F.desc("updated_on"), F.desc("location_id")])
    return table.read().select("variant_id", "location_id")


@add("w06_resolve_then_drop", "SELECT u.id, coalesce(nullif(lower(trim(u.shop_id)), ''), r.shop) AS shop FROM csv_uploads u LEFT JOIN (SELECT run_id, min(nullif(lower(trim(shop_id)), '')) AS shop FROM csv_uploads WHERE run_id IS NOT NULL GROUP BY 1) r ON r.run_id = u.run_id WHERE coalesce(nullif(lower(trim(u.shop_id)), ''), r.shop) IS NOT NULL")
def _(t):
    u = t.raw("csv_uploads").select("id", "run_id", F.lower(I.filled(F.col("shop_id"))).alias("own"))
    runs = u.where("run_id is not null").groupBy("run_id").agg(F.min("own").alias("shop"))
    return u.join(runs, "run_id", "left").select("id", F.coalesce("own", "shop").alias("shop")).where("shop is not null")


@add("w09_conditional_update", "SELECT order_id, CASE WHEN financial_status = 'P' AND total > 100000 THEN 'H' ELSE financial_status END AS status FROM ords")
def _(t):
    """A stored table changed in place and read back."""
    table = K.Keyed(t.spark, new_path(t.spark, "orders"), ["order_id"])
    table.upsert(t.orders.select("order_id", "total", F.col("financial_status").alias("status")))
    table.update((F.col("status") == "P") & (F.col("total") > 100000), {"status": F.lit("H")})
    return table.read().select("order_id", "status")


@add("u09_distinct_rules", "WITH r AS (SELECT item_a AS x, item_b AS y, n FROM vpairs UNION ALL SELECT item_b, item_a, n + 1 FROM vpairs) SELECT least(x, y) || '|' || greatest(x, y) AS products, n % 2 AS kind, arg_max(x, n) AS first, max(n) AS n FROM r GROUP BY 1, 2")
def _(t):
    """Rules with the same products in any order and the same kind are one: the strongest stays."""
    p = vendor_pairs(t)
    r = p.select(F.col("item_a").alias("x"), F.col("item_b").alias("y"), "n").unionByName(p.select(F.col("item_b").alias("x"), F.col("item_a").alias("y"), (F.col("n") + 1).alias("n")))
    d = r.select(F.array_join(F.array_sort(F.array("x", "y")), "|").alias("products"), (F.col("n") % 2).alias("kind"), F.col("x").alias("first"), "n")
    return R.first_per_key(d, ["products", "kind"], [F.desc("n"), F.col("first")])


@add("x12_without_embedding", "SELECT variant_id FROM catalog WHERE variant_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")
def _(t):
    """Catalogue records that an embedding has still to be made for."""
    have = t.raw("embeddings").where("embedding is not null").select(F.col("vec_id").alias("variant_id"))
    return t.catalog.select("variant_id").join(have, "variant_id", "left_anti")


@add(
    "x14_lookup_with_fallback",
    """WITH r AS (SELECT order_id, line_item_id, variant_id, location_id FROM lines), own AS (SELECT variant_id, location_id, max(available) AS a FROM inventory WHERE updated_on >= DATE '1998-01-01' GROUP BY 1, 2), any_place AS (SELECT variant_id, max(available) AS a FROM inventory WHERE updated_on >= DATE '1998-06-01' GROUP BY 1)
SELECT CASE WHEN own.a IS NOT NULL THEN 'place' WHEN any_place.a IS NOT NULL THEN 'store' ELSE 'none' END AS found, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM r LEFT JOIN own ON own.variant_id = r.variant_id AND own.location_id = r.location_id LEFT JOIN any_place ON any_place.variant_id = r.variant_id GROUP BY 1""",
)
def _(t):
    """Stock of each line by its place, else by any place of the store; how many lines each way finds."""
    level = lambda day, *keys: t.inventory.where(F.col("updated_on") >= F.lit(day).cast("date")).groupBy(*keys).agg(F.max("available").alias("_".join(("stock", *keys))))
    d = t.lines.select("variant_id", "location_id").join(level("1998-01-01", "variant_id", "location_id"), ["variant_id", "location_id"], "left").join(level("1998-06-01", "variant_id"), "variant_id", "left")
    found = F.when(F.col("stock_variant_id_location_id").isNotNull(), "place").when(F.col("stock_variant_id").isNotNull(), "store").otherwise("none")
    n = d.groupBy(found.alias("found")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4))  # three rows


@add("a45_category_counts", "SELECT vendor, product_type, count(*) AS n, count(CASE WHEN available_total > 0 THEN 1 END) AS in_stock FROM catalog GROUP BY CUBE (vendor, product_type)")
def _(t):
    return t.catalog.cube("vendor", "product_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("available_total") > 0, 1)).alias("in_stock"))


@add("x03_first_of_wave", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return R.first_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@add(
    "j15_attribute_similarity",
    """WITH c AS (SELECT variant_id, product_type, vendor, price, ln(price) AS l FROM catalog), p AS (SELECT a.variant_id AS a, b.variant_id AS b, (a.product_type = b.product_type) AS t, (a.vendor = b.vendor) AS v, round(abs(a.l - b.l), 4) AS gap,
0.5::DOUBLE * CAST(a.product_type = b.product_type AS INT) + 0.3::DOUBLE * CAST(a.vendor = b.vendor AS INT) + 0.2::DOUBLE * least(a.price, b.price) / greatest(a.price, b.price) AS score FROM c a JOIN c b ON a.variant_id <> b.variant_id AND (a.product_type = b.product_type OR a.vendor = b.vendor))
SELECT a, b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY t DESC, v DESC, gap, b) AS r FROM p WHERE score > 0.4) WHERE r <= 5""",
)
def _(t):
    return Z.similar_by_attributes(t.catalog, "variant_id", "product_type", "vendor", "price", 5).select("a", "b", F.round("score", 6).alias("score"))


@add(
    "m23_metadata_similarity",
    """WITH c AS (SELECT variant_id, product_type, vendor, price, ntile_band, list_filter(list_distinct(string_split(lower(product_title), ' ')), lambda x: x <> '') AS w, regexp_replace(lower(vendor), '[^a-z0-9]', '', 'g') AS m FROM (SELECT *, CASE WHEN price < 25 THEN 0 WHEN price < 50 THEN 1 WHEN price < 100 THEN 2 WHEN price < 500 THEN 3 WHEN price < 950 THEN 4 ELSE 5 END AS ntile_band FROM catalog)),
p AS (SELECT q.variant_id AS query, o.variant_id AS other, 0.35::DOUBLE * CAST(lower(q.product_type) = lower(o.product_type) AS INT) + CASE WHEN q.vendor = o.vendor THEN 0.3::DOUBLE WHEN contains(q.m, o.m) OR contains(o.m, q.m) THEN 0.175::DOUBLE ELSE 0.0::DOUBLE END
+ 0.2::DOUBLE * (CASE abs(q.ntile_band - o.ntile_band) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
+ 0.15::DOUBLE * len(list_intersect(q.w, o.w)) / (len(q.w) + len(o.w) - len(list_intersect(q.w, o.w))) AS score FROM c q JOIN c o ON q.variant_id <> o.variant_id)
SELECT query, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, other) AS r FROM p WHERE score > 0.2) WHERE r <= 10""",
)
def _(t):
    c = t.catalog
    d = Z.similar_by_metadata(c, c, "variant_id", "product_type", "vendor", "price", "product_title", (25, 50, 100, 500, 950), 10)
    return d.select("query", "other", F.round("score", 6).alias("score"))


# ---- event states
@add(
    "t01_monotone_progress",
    """WITH e AS (SELECT event_id, user_id, ts, CAST(least(floor(value), 100) AS BIGINT) AS progress FROM events), m AS (SELECT *, max(progress) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT event_id, user_id, progress FROM m WHERE before IS NULL OR progress >= before""",
)
def _(t):
    e = t.events.select("event_id", "user_id", "ts", F.least(F.floor("value"), F.lit(100).cast("long")).alias("progress"))
    before = F.max("progress").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    return e.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("progress") >= F.col("_b"))).select("event_id", "user_id", "progress")


@add("t03_active_users", "SELECT user_id, max(ts) AS latest FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def _(t):
    per = t.events.groupBy("user_id").agg(F.max("ts").alias("latest"))
    end = per.agg(F.max("latest").alias("_e"))
    return per.join(F.broadcast(end)).where(F.col("latest") >= F.col("_e") - F.expr("interval 24 hours")).drop("_e")  # one row


@add("x17_last_hundred", "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 4) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY 1")
def _(t):
    d = B.top_per_group(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 100)
    return d.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", 0.95), 4).alias("p95"))


@add("x16_variation", "SELECT vendor, round(max(price) - min(price), 4) AS spread, round(stddev_pop(price) / avg(price), 6) AS cv FROM catalog GROUP BY 1")
def _(t):
    return t.catalog.groupBy("vendor").agg(F.round(F.max("price") - F.min("price"), 4).alias("spread"), F.round(F.stddev_pop("price") / F.avg("price"), 6).alias("cv"))


@add("a44_funnel", "SELECT 'orders' AS stage, count(*) AS n FROM ords UNION ALL SELECT 'with two items', count(*) FROM vbig UNION ALL SELECT 'pairs', count(*) FROM vpairs UNION ALL SELECT 'frequent pairs', count(*) FROM vpairs WHERE n >= 30")
def _(t):
    items = B.distinct_items(t.vendor_lines)
    p = B.pair_counts(items)
    stages = [("orders", t.orders.agg(F.count("*").alias("n"))), ("with two items", B.baskets(items).agg(F.count("*").alias("n"))), ("pairs", p.agg(F.count("*").alias("n"))), ("frequent pairs", p.where("n >= 30").agg(F.count("*").alias("n")))]
    out = None
    for name, d in stages:
        one = d.select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = book.queries
