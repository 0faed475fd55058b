"""Baskets, pairs, item sets, rules and co-visitation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import covisitation as C
from ..operators import mining as M
from ..operators.item_vectors import item_vectors
from ..plans.shared import written
from ..sources.shop_frames import ShopFrames
from .define import Book

book = Book()
add = book.add


def vendor_items(t: ShopFrames) -> DataFrame:
    return B.distinct_items(t.vendor_lines)


def variant_items(t: ShopFrames) -> DataFrame:
    return B.distinct_items(t.lines, item="variant_id")


def many(t: ShopFrames) -> DataFrame:
    """Vendor items of orders with at least two."""
    return M.in_large_orders(vendor_items(t))


def total(items: DataFrame) -> DataFrame:
    return items.agg(F.count_distinct("order_id").alias("total"))


def vendor_rules(t: ShopFrames) -> DataFrame:
    own = many(t)
    return B.pair_measures(B.pair_counts(own, 2), B.item_counts(own), total(own))


def vendor_cosines(t: ShopFrames, weighting: str = "lift") -> DataFrame:
    return C.cosine_pairs(C.covisit_vectors(t.vendor_lines, weighting=weighting))


def rounded(d: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return d.withColumns({n: F.round(n, to) for n in names})


@add("a06_baskets", "SELECT order_id, string_agg(item, '|' ORDER BY item) AS items, count(*) AS n_items FROM vb GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return B.baskets(vendor_items(t)).select("order_id", F.array_join("items", "|").alias("items"), F.size("items").cast("long").alias("n_items"))


@add("a07_purchase_sequences", "SELECT order_id, string_agg(CAST(variant_id AS VARCHAR), '>' ORDER BY line_item_id, variant_id) AS sequence FROM lines GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return B.purchase_sequences(t.lines, "variant_id", "line_item_id").select("order_id", F.array_join(F.transform("sequence", lambda x: x.cast("string")), ">").alias("sequence"))


@add("a08_item_frequency", "SELECT variant_id, count(DISTINCT order_id) AS n_item FROM lines GROUP BY 1")
def _(t):
    return B.item_counts(variant_items(t)).withColumnRenamed("item", "variant_id")


@add("a09_multi_line_orders", "SELECT count(*) AS n_orders FROM (SELECT order_id FROM lines GROUP BY 1 HAVING count(*) >= 2)")
def _(t):
    return t.lines.groupBy("order_id").count().where("count >= 2").agg(F.count(F.lit(1)).alias("n_orders"))


@add(
    "a10_order_analytics",
    """SELECT l.variant_id, count(*) AS occurrences, CAST(sum(l.quantity) AS BIGINT) AS units, CAST(max(l.quantity) AS INT) AS most, count(DISTINCT l.order_id) AS n_orders,
count(DISTINCT CASE WHEN m.order_id IS NOT NULL THEN l.order_id END) AS n_multi
FROM lines l LEFT JOIN (SELECT order_id FROM lines GROUP BY 1 HAVING count(DISTINCT variant_id) >= 2) m ON l.order_id = m.order_id GROUP BY 1""",
)
def _(t):
    # one exchange per order flags the multi-item orders, one per variant counts
    flagged = t.lines.groupBy("order_id", "variant_id").agg(F.count(F.lit(1)).alias("k"), F.sum("quantity").alias("q"), F.max("quantity").alias("m"))
    sizes = flagged.groupBy("order_id").agg((F.count(F.lit(1)) >= 2).alias("multi"))
    d = flagged.join(sizes, "order_id")
    return d.groupBy("variant_id").agg(F.sum("k").alias("occurrences"), F.sum("q").alias("units"), F.max("m").alias("most"), F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("multi").cast("long")).alias("n_multi"))


@add("a11_units_sold", "SELECT variant_id, units FROM sold")
def _(t):
    return t.lines.groupBy("variant_id").agg(F.sum("quantity").alias("units"))


@add("j12_pair_self_join", "SELECT item_a, item_b, n FROM vpairs")
def _(t):
    return B.pair_counts(vendor_items(t))


@add(
    "j12_variant_pairs",
    """SELECT variant_a, variant_b, n FROM (SELECT x.variant_id AS variant_a, y.variant_id AS variant_b, count(DISTINCT x.order_id) AS n
FROM lines x JOIN lines y ON x.order_id = y.order_id AND x.variant_id < y.variant_id GROUP BY 1, 2) WHERE n >= 2""",
)
def _(t):
    return B.pair_counts(variant_items(t), 2).select(F.col("item_a").alias("variant_a"), F.col("item_b").alias("variant_b"), "n")


_MEASURES = """WITH i AS (SELECT item, count(*) AS n_item FROM vb WHERE order_id IN (SELECT order_id FROM vbig) GROUP BY 1), k AS (SELECT count(*) AS total FROM vbig),
m AS (SELECT p.item_a, p.item_b, p.n, a.n_item AS n_a, b.n_item AS n_b, p.n * 1.0::DOUBLE / total AS support, p.n * 1.0::DOUBLE / a.n_item AS cab, p.n * 1.0::DOUBLE / b.n_item AS cba,
 p.n * total * 1.0::DOUBLE / (a.n_item * b.n_item) AS lift FROM vpairs p JOIN i a ON p.item_a = a.item JOIN i b ON p.item_b = b.item CROSS JOIN k WHERE p.n >= 2) """


@add("m06_pair_measures", _MEASURES + "SELECT item_a, item_b, n, round(support, 6) AS support, round(greatest(cab, cba), 6) AS confidence, round(lift, 6) AS lift FROM m")
def _(t):
    return rounded(vendor_rules(t).select("item_a", "item_b", "n", "support", "confidence", "lift"), "support", "confidence", "lift")


@add(
    "j13_pair_catalog",
    """SELECT variant_a, variant_b, n, n_a, n_b, a.product_title AS title_a, b.product_title AS title_b, round(a.price + b.price, 2) AS price FROM
(SELECT x.variant_id AS variant_a, y.variant_id AS variant_b, count(DISTINCT x.order_id) AS n FROM lines x JOIN lines y ON x.order_id = y.order_id AND x.variant_id < y.variant_id GROUP BY 1, 2) p
JOIN (SELECT variant_id, count(DISTINCT order_id) AS n_a FROM lines GROUP BY 1) ca ON ca.variant_id = variant_a JOIN (SELECT variant_id, count(DISTINCT order_id) AS n_b FROM lines GROUP BY 1) cb ON cb.variant_id = variant_b
JOIN catalog a ON a.variant_id = variant_a JOIN catalog b ON b.variant_id = variant_b WHERE n >= 3""",
)
def _(t):
    own = variant_items(t)
    counts = B.item_counts(own)
    side = lambda x: t.catalog.join(counts, F.col("variant_id") == F.col("item")).select(F.col("item").alias(f"variant_{x}"), F.col("n_item").alias(f"n_{x}"), F.col("product_title").alias(f"title_{x}"), F.col("price").alias(f"p_{x}"))
    pairs = B.pair_counts(own, 3).select(F.col("item_a").alias("variant_a"), F.col("item_b").alias("variant_b"), "n")
    d = pairs.join(side("a"), "variant_a").join(side("b"), "variant_b")
    return d.select("variant_a", "variant_b", "n", "n_a", "n_b", "title_a", "title_b", F.round(F.col("p_a") + F.col("p_b"), 2).alias("price"))


@add("k03_rules_by_lift", _MEASURES + "SELECT item_a, item_b, round(lift, 6) AS lift FROM m ORDER BY 3 DESC, 1, 2 LIMIT 100")
def _(t):
    return rounded(vendor_rules(t).select("item_a", "item_b", "lift"), "lift").orderBy(F.desc("lift"), "item_a", "item_b").limit(100)


@add("k04_top_pairs", "SELECT item_a, item_b, n FROM vpairs ORDER BY n DESC, item_a, item_b LIMIT 20")
def _(t):
    return B.pair_counts(vendor_items(t)).orderBy(F.desc("n"), "item_a", "item_b").limit(20)


_SETS = """WITH big AS (SELECT * FROM vb WHERE order_id IN (SELECT order_id FROM vbig)),
s1 AS (SELECT 1 AS size, item AS items, item AS a, '' AS b, '' AS c, count(*) AS n FROM big GROUP BY item),
s2 AS (SELECT 2 AS size, x.item || '|' || y.item AS items, x.item AS a, y.item AS b, '' AS c, count(*) AS n FROM big x JOIN big y ON x.order_id = y.order_id AND x.item < y.item GROUP BY x.item, y.item),
s3 AS (SELECT 3 AS size, x.item || '|' || y.item || '|' || z.item AS items, x.item AS a, y.item AS b, z.item AS c, count(*) AS n FROM big x JOIN big y ON x.order_id = y.order_id AND x.item < y.item
 JOIN big z ON x.order_id = z.order_id AND y.item < z.item GROUP BY x.item, y.item, z.item),
s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) """


@add("m01_frequent_sets", _SETS + "SELECT size, items, n FROM s WHERE n >= 5")
def _(t):
    return M.frequent_sets(many(t), 5).select("size", F.array_join("items", "|").alias("items"), "n")


_SIDES = """, r AS (SELECT a AS ante, b AS cons, n FROM s WHERE size = 2 UNION ALL SELECT b, a, n FROM s WHERE size = 2
 UNION ALL SELECT a, b || '|' || c, n FROM s WHERE size = 3 UNION ALL SELECT b, a || '|' || c, n FROM s WHERE size = 3 UNION ALL SELECT c, a || '|' || b, n FROM s WHERE size = 3
 UNION ALL SELECT b || '|' || c, a, n FROM s WHERE size = 3 UNION ALL SELECT a || '|' || c, b, n FROM s WHERE size = 3 UNION ALL SELECT a || '|' || b, c, n FROM s WHERE size = 3),
q AS (SELECT ante AS antecedent, cons AS consequent, r.n, r.n * 1.0::DOUBLE / total AS support, r.n * 1.0::DOUBLE / x.n AS confidence, r.n * total * 1.0::DOUBLE / (x.n * y.n) AS lift
 FROM r JOIN s x ON x.items = ante JOIN s y ON y.items = cons CROSS JOIN (SELECT count(*) AS total FROM vbig) WHERE r.n >= 5) """


def _vendor_set_rules(t):
    own = many(t)
    n = own.select("order_id").distinct().count()
    d = M.rules(M.frequent_sets(own, 5), n, 0.1)
    join = lambda c: F.array_join(c, "|").alias(c)
    return rounded(d.select(join("antecedent"), join("consequent"), "n", "support", "confidence", "lift"), "support", "confidence", "lift")


@add("m02_set_rules", _SETS + _SIDES + "SELECT antecedent, consequent, n, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM q WHERE confidence >= 0.1")
def _(t):
    return _vendor_set_rules(t)


@add("m03_rules_pipeline", _SETS + _SIDES + "SELECT antecedent, consequent, round(lift, 6) AS lift FROM q WHERE confidence >= 0.1 ORDER BY 3 DESC, 1, 2 LIMIT 50")
def _(t):
    return _vendor_set_rules(t).select("antecedent", "consequent", "lift").orderBy(F.desc("lift"), "antecedent", "consequent").limit(50)


@add(
    "m04_fpgrowth",
    """SELECT items, n FROM (WITH RECURSIVE big AS (SELECT * FROM vb WHERE order_id IN (SELECT order_id FROM vbig)), s AS (SELECT order_id, item AS items, item AS last FROM big UNION ALL SELECT s.order_id, s.items || '|' || b.item, b.item FROM s JOIN big b ON b.order_id = s.order_id AND b.item > s.last)
SELECT items, count(*) AS n FROM s GROUP BY 1) WHERE n >= 0.01::DOUBLE * (SELECT count(*) FROM vbig)""",
)
def _(t):
    """Sets of any size."""
    return M.fpgrowth_sets(vendor_items(t), 0.01).select(F.array_join("items", "|").alias("items"), "n")


@add("k07_top_sets", _SETS + "SELECT items, n FROM s WHERE size >= 2 AND n >= 5 ORDER BY n DESC, items LIMIT 100")
def _(t):
    d = M.frequent_sets(many(t), 5).where("size >= 2").select(F.array_join("items", "|").alias("items"), "n")
    return d.orderBy(F.desc("n"), "items").limit(100)


@add("m07_rules_to_candidates", _SETS + _SIDES + "SELECT antecedent || '|' || consequent AS products, round(confidence, 6) AS confidence FROM q WHERE confidence >= 0.1")
def _(t):
    return _vendor_set_rules(t).select(F.concat_ws("|", "antecedent", "consequent").alias("products"), "confidence")


def _covis_sql(weight: str, having: str = "TRUE") -> str:
    return f"""WITH k AS (SELECT count(DISTINCT order_id) AS total FROM vb),
e AS (SELECT item_a AS item, item_b AS neighbour, n FROM vpairs UNION ALL SELECT item_b, item_a, n FROM vpairs),
f AS (SELECT e.item, e.neighbour, e.n, e.n * total * 1.0::DOUBLE / (a.n_item * b.n_item) AS lift FROM e JOIN vitems a ON a.item = e.item JOIN vitems b ON b.item = e.neighbour CROSS JOIN k),
w AS (SELECT item, neighbour, {weight} AS weight FROM f WHERE {having}),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight DESC, neighbour) AS rk FROM w),
v AS (SELECT item, neighbour, weight / sqrt(sum(weight * weight) OVER (PARTITION BY item)) AS weight FROM r WHERE rk <= 50),
cs AS (SELECT x.item AS item_a, y.item AS item_b, sum(x.weight * y.weight) AS cosine FROM v x JOIN v y ON x.neighbour = y.neighbour AND x.item < y.item GROUP BY 1, 2) """


for _name, _weighting, _sql in (("raw", "raw", "CAST(n AS DOUBLE)"), ("lift", "lift", "lift"), ("pmi", "pmi", "ln(greatest(lift, 0.001))")):

    @add(f"m08_covisit_{_name}", _covis_sql(_sql) + "SELECT item, neighbour, round(weight, 6) AS weight FROM v")
    def _(t, w=_weighting):
        return rounded(C.covisit_vectors(t.vendor_lines, weighting=w), "weight")


@add("n08_top_neighbours", _covis_sql("CAST(n AS DOUBLE)") + "SELECT item, neighbour, rk AS rank FROM r WHERE rk <= 3")
def _(t):
    raw = B.pair_counts(vendor_items(t))
    both = B.both_ways(raw, "neighbour", "n")
    return B.top_per_group(both, ["item"], [F.desc("n"), "neighbour"], 3).select("item", "neighbour", F.col("rank").cast("long").alias("rank"))


@add("n09_vector_norms", _covis_sql("lift") + "SELECT item, round(sum(weight * weight), 6) AS norm FROM v GROUP BY 1")
def _(t):
    return C.covisit_vectors(t.vendor_lines).groupBy("item").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


@add("j21_sparse_cosine", _covis_sql("lift") + "SELECT item_a, item_b, round(cosine, 6) AS cosine FROM cs")
def _(t):
    return rounded(vendor_cosines(t), "cosine")


@add(
    "m09_complements",
    _covis_sql("lift")
    + """, b AS (SELECT item_a AS item, item_b AS other, cosine FROM cs WHERE cosine >= 0.3 UNION ALL SELECT item_b, item_a, cosine FROM cs WHERE cosine >= 0.3)
SELECT item, other, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(cosine, 6) DESC, other) AS rk FROM b) WHERE rk <= 5""",
)
def _(t):
    return rounded(C.complements(vendor_cosines(t)).select("item", "other", "cosine"), "cosine")


@add(
    "m10_set_coherence",
    _covis_sql("lift")
    + """, o AS (SELECT x.order_id, x.item AS item_a, y.item AS item_b FROM vb x JOIN vb y ON x.order_id = y.order_id AND x.item < y.item)
SELECT o.order_id AS set_id, round(avg(coalesce(cosine, 0)), 6) AS mean, round(min(coalesce(cosine, 0)), 6) AS least, round(max(coalesce(cosine, 0)), 6) AS most
FROM o LEFT JOIN cs ON cs.item_a = o.item_a AND cs.item_b = o.item_b GROUP BY 1""",
)
def _(t):
    sets = B.baskets(vendor_items(t)).select(F.col("order_id").alias("set_id"), "items")
    return rounded(C.set_coherence(sets, vendor_cosines(t)), "mean", "least", "most")


@add("m11_item2vec")
def _(t):
    """Skip-gram vectors of variants from purchase sequences, seeded: rows only."""
    return item_vectors(t.lines, "variant_id", "line_item_id").select(F.col("item").cast("string").alias("item"), "vector")


_TIERS = """WITH k AS (SELECT count(DISTINCT order_id) AS total FROM vb),
p AS (SELECT p.item_a, p.item_b, p.n, a.n_item AS n_a, b.n_item AS n_b, total FROM vpairs p JOIN vitems a ON a.item = p.item_a JOIN vitems b ON b.item = p.item_b CROSS JOIN k) """


def _pair_facts(t):
    own = written(vendor_items(t), "vendor-items")
    return B.pair_measures(B.pair_counts(own), B.item_counts(own), total(own))


@add("m15_tier1_strict_rules", _SETS + _SIDES + "SELECT antecedent || '|' || consequent AS products, round(lift, 6) AS lift FROM q WHERE confidence >= 0.1 ORDER BY round(lift, 6) DESC, antecedent, consequent LIMIT 20")
def _(t):
    d = _vendor_set_rules(t).orderBy(F.desc("lift"), "antecedent", "consequent").limit(20)
    return d.select(F.concat_ws("|", "antecedent", "consequent").alias("products"), "lift")


@add(
    "m15_tier2_relaxed_rules",
    """WITH b AS (SELECT DISTINCT l.order_id, c.product_type AS item FROM lines l JOIN catalog c ON l.variant_id = c.variant_id), i AS (SELECT item, count(*) AS k FROM b GROUP BY 1), t AS (SELECT count(DISTINCT order_id) AS total FROM b),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n FROM b x JOIN b y ON x.order_id = y.order_id AND x.item < y.item GROUP BY 1, 2)
SELECT item_a, item_b, n, round(n * 1.0::DOUBLE / least(u.k, v.k), 6) AS confidence FROM p JOIN i u ON u.item = item_a JOIN i v ON v.item = item_b CROSS JOIN t WHERE n >= greatest(3, ceil(0.015::DOUBLE * total)) AND n * 1.0::DOUBLE / least(u.k, v.k) >= 0.2""",
)
def _(t):
    """At the grain of product types: pairs of 25 vendors don't reach the confidence."""
    own = written(B.distinct_items(t.lines.join(t.catalog.select("variant_id", F.col("product_type").alias("item")), "variant_id")), "type-items")
    d = B.relaxed_rules(B.pair_measures(B.pair_counts(own), B.item_counts(own), total(own)))
    return d.select("item_a", "item_b", "n", F.round("confidence", 6).alias("confidence"))


# ---- the same structures at the grain of variants: many items, small counts
_VARIANTS = """WITH b AS (SELECT DISTINCT order_id, variant_id AS item FROM lines), i AS (SELECT item, count(*) AS k FROM b GROUP BY 1), t AS (SELECT count(DISTINCT order_id) AS total FROM b),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n FROM b x JOIN b y ON x.order_id = y.order_id AND x.item < y.item GROUP BY 1, 2)"""


def _variant_measures(t, least: int):
    own = written(variant_items(t), "variant-items")
    return B.pair_measures(B.pair_counts(own, least), B.item_counts(own), total(own))


@add("m06_variant_measures", _VARIANTS + "SELECT item_a, item_b, n, round(n * 1.0::DOUBLE / total, 8) AS support, round(n * 1.0::DOUBLE / least(u.k, v.k), 6) AS confidence, round(n * total * 1.0::DOUBLE / (u.k * v.k), 4) AS lift FROM p JOIN i u ON u.item = item_a JOIN i v ON v.item = item_b CROSS JOIN t WHERE n >= 2")
def _(t):
    d = _variant_measures(t, 2)
    return d.select("item_a", "item_b", "n", F.round("support", 8).alias("support"), F.round("confidence", 6).alias("confidence"), F.round("lift", 4).alias("lift"))


@add(
    "m01_variant_sets",
    """WITH b AS (SELECT DISTINCT order_id, variant_id AS item FROM lines), g AS (SELECT * FROM b WHERE order_id IN (SELECT order_id FROM b GROUP BY 1 HAVING count(*) >= 2)),
s AS (SELECT 1 AS size, CAST(item AS VARCHAR) AS items FROM g UNION ALL SELECT 2, x.item || '|' || y.item FROM g x JOIN g y ON x.order_id = y.order_id AND x.item < y.item
UNION ALL SELECT 3, x.item || '|' || y.item || '|' || z.item FROM g x JOIN g y ON x.order_id = y.order_id AND x.item < y.item JOIN g z ON x.order_id = z.order_id AND y.item < z.item)
SELECT size, items, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(t):
    d = M.frequent_sets(M.in_large_orders(variant_items(t)), 2)
    return d.select("size", F.array_join(F.transform("items", lambda x: x.cast("string")), "|").alias("items"), "n")


@add(
    "m02_variant_rules",
    _VARIANTS
    + """, big AS (SELECT * FROM b WHERE order_id IN (SELECT order_id FROM b GROUP BY 1 HAVING count(*) >= 2)), k AS (SELECT item, count(*) AS k FROM big GROUP BY 1), w AS (SELECT count(DISTINCT order_id) AS total FROM big),
r AS (SELECT item_a AS antecedent, item_b AS consequent, n FROM p WHERE n >= 2 UNION ALL SELECT item_b, item_a, n FROM p WHERE n >= 2)
SELECT antecedent, consequent, n, round(n * 1.0::DOUBLE / x.k, 6) AS confidence, round(n * total * 1.0::DOUBLE / (x.k * y.k), 4) AS lift FROM r JOIN k x ON x.item = antecedent JOIN k y ON y.item = consequent CROSS JOIN w WHERE n * 1.0::DOUBLE / x.k >= 0.05""",
)
def _(t):
    own = M.in_large_orders(variant_items(t))
    d = M.rules(M.frequent_sets(own, 2, 2), own.select("order_id").distinct().count())
    one = lambda c: F.element_at(c, 1).alias(c)
    return d.select(one("antecedent"), one("consequent"), "n", F.round("confidence", 6).alias("confidence"), F.round("lift", 4).alias("lift"))


_VARIANT_COVISIT = (
    _VARIANTS
    + """, e AS (SELECT item_a AS item, item_b AS neighbour, n FROM p UNION ALL SELECT item_b, item_a, n FROM p), f AS (SELECT e.item, neighbour, n * total * 1.0::DOUBLE / (u.k * v.k) AS lift FROM e JOIN i u ON u.item = e.item JOIN i v ON v.item = neighbour CROSS JOIN t),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY lift DESC, neighbour) AS rk FROM f), v AS (SELECT item, neighbour, lift / sqrt(sum(lift * lift) OVER (PARTITION BY item)) AS weight FROM r WHERE rk <= 50) """
)


@add("m08_variant_covisit", _VARIANT_COVISIT + "SELECT item, neighbour, round(weight, 6) AS weight FROM v")
def _(t):
    return rounded(C.covisit_vectors(t.lines, item="variant_id"), "weight")


@add("j21_variant_cosine", _VARIANT_COVISIT + "SELECT x.item AS item_a, y.item AS item_b, round(sum(x.weight * y.weight), 6) AS cosine FROM v x JOIN v y ON x.neighbour = y.neighbour AND x.item < y.item GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.1")
def _(t):
    return rounded(C.close_pairs(t.lines, 0.1, item="variant_id"), "cosine")


_BAYES = """, z AS (SELECT count(*) AS items FROM catalog), s AS (SELECT item_a, item_b, n, greatest(0.0, least(1.0, (n + 1.0::DOUBLE) / (u.k + items) - 0.3::DOUBLE * (u.k - n) / u.k)) AS ab, greatest(0.0, least(1.0, (n + 1.0::DOUBLE) / (v.k + items) - 0.3::DOUBLE * (v.k - n) / v.k)) AS ba
FROM p JOIN i u ON u.item = item_a JOIN i v ON v.item = item_b CROSS JOIN z) """


def _bayesian(t):
    d = _variant_measures(t, 1).join(F.broadcast(t.catalog.agg(F.count("*").alias("items"))))  # one row
    score = lambda x: B.bayesian_score(F.col("n"), F.col(f"n_{x}"), F.col("items"))
    return d.select("item_a", "item_b", "n", score("a").alias("ab"), score("b").alias("ba"))


@add("m16_bayesian_pairs", _VARIANTS + _BAYES + "SELECT item_a, item_b, round(ab, 8) AS ab, round(ba, 8) AS ba FROM s")
def _(t):
    return rounded(_bayesian(t).drop("n"), "ab", "ba", to=8)


@add("m17_sparse_pairs", _VARIANTS + _BAYES + "SELECT item_a, item_b, round((ab + ba) / 2, 8) AS score FROM s ORDER BY round((ab + ba) / 2, 8) DESC, item_a, item_b LIMIT 50")
def _(t):
    """The top 50 pairs by the mean of both directions."""
    d = _bayesian(t).select("item_a", "item_b", F.round((F.col("ab") + F.col("ba")) / 2, 8).alias("score"))
    return d.orderBy(F.desc("score"), "item_a", "item_b").limit(50)


@add("m15_tier3_smoothed", _TIERS + "SELECT item_a, item_b, round((n + 1) / (n_a + 2.0::DOUBLE), 6) AS score FROM p WHERE (n + 1) / (n_a + 2.0::DOUBLE) >= 0.01")
def _(t):
    score = (F.col("n") + 1) / (F.col("n_a") + 2)
    return _pair_facts(t).where(score >= 0.01).select("item_a", "item_b", F.round(score, 6).alias("score"))


@add(
    "m15_tier4_count_similarity",
    _TIERS + "SELECT item_a, item_b, round((n / sqrt(n_a * n_b * 1.0::DOUBLE) + n * 1.0::DOUBLE / (n_a + n_b - n)) / 2, 6) AS score FROM p WHERE (n / sqrt(n_a * n_b * 1.0::DOUBLE) + n * 1.0::DOUBLE / (n_a + n_b - n)) / 2 > 0.02",
)
def _(t):
    n, a, b = F.col("n"), F.col("n_a"), F.col("n_b")
    score = (n / F.sqrt(a * b) + n / (a + b - n)) / 2
    return _pair_facts(t).where(score > 0.02).select("item_a", "item_b", F.round(score, 6).alias("score"))


@add("m15_tier6_popular", "SELECT item, n_item FROM vitems ORDER BY n_item DESC, item LIMIT 3")
def _(t):
    return B.item_counts(vendor_items(t)).orderBy(F.desc("n_item"), "item").limit(3)


@add(
    "j14_all_pairs_smoothed",
    """WITH e AS (SELECT item_a, item_b, n FROM vpairs UNION ALL SELECT item_b, item_a, n FROM vpairs)
SELECT a.item AS item_a, b.item AS item_b, round((coalesce(e.n, 0) + 1) / (a.n_item + 2.0::DOUBLE), 6) AS score FROM vitems a JOIN vitems b ON a.item <> b.item LEFT JOIN e ON e.item_a = a.item AND e.item_b = b.item WHERE (coalesce(e.n, 0) + 1) / (a.n_item + 2.0::DOUBLE) >= 0.005""",
)
def _(t):
    """With the pairs that never meet: they score 1/(n+2), enough for an item_a of fewer than 199 orders."""
    return B.smoothed_pairs(vendor_items(t), 0.005).withColumn("score", F.round("score", 6))


@add(
    "x11_normalised_baskets",
    """SELECT order_id, string_agg(CAST(variant_id AS VARCHAR), '|' ORDER BY variant_id) AS items FROM (SELECT DISTINCT l.order_id, l.variant_id FROM lines l JOIN catalog c ON l.variant_id = c.variant_id WHERE c.price < 950)
GROUP BY 1 HAVING count(*) >= 2""",
)
def _(t):
    valid = t.catalog.where("price < 950").select(F.col("variant_id").alias("item"))
    d = B.baskets(variant_items(t).join(valid, "item", "left_semi"))
    return d.select("order_id", F.array_join(F.transform("items", lambda x: x.cast("string")), "|").alias("items"))


QUERIES = book.queries
