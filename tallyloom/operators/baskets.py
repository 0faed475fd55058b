"""Baskets, item counts and pair counts over (order, item) lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import once, written

#: Baskets with more items than this are cut into chunks by a hash; each pair of chunks is a block of its own.
CHUNK = 512


def distinct_items(lines: DataFrame, order: str = "order_id", item: str = "item") -> DataFrame:
    """Each item of an order once; null orders and items are left out."""
    return lines.where(F.col(order).isNotNull() & F.col(item).isNotNull()).select(F.col(order).alias("order_id"), F.col(item).alias("item")).distinct()


def baskets(items: DataFrame, least: int = 2) -> DataFrame:
    """order_id, items (sorted array) of orders with at least ``least`` items."""
    return items.groupBy("order_id").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") >= least)


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))


def frequent_only(items: DataFrame, least: int) -> DataFrame:
    """The rows of items that stand in at least ``least`` orders: no larger set with another item can be frequent."""
    return items.join(item_counts(items).where(F.col("n_item") >= least).select("item"), "item", "left_semi")


def large_baskets(items: DataFrame, basket: str) -> tuple[int, DataFrame | None]:
    """How many baskets there are, and those of over CHUNK items with their ``_size`` (None if there are none)."""
    sizes = items.groupBy(basket).agg(F.count(F.lit(1)).alias("_size"))
    total, most = sizes.agg(F.count(F.lit(1)), F.max("_size")).first()
    return total, written(sizes.where(F.col("_size") > CHUNK), "large-baskets") if (most or 0) > CHUNK else None


def basket_blocks(items: DataFrame, basket: str, item: str, large: DataFrame | None) -> DataFrame:
    """left and right: lists of items whose pairs, taken over all rows, are each basket's pairs once.

    Where right is null the pairs are those inside left, else those between left and right. items: each item of a basket
    once; large: from ``large_baskets`` (of these items or more). Any other basket is one row. A large one is never a row
    as a whole: its items get a chunk by hash, about CHUNK in each; every item is sent once for each chunk that it is to
    be paired with, and the blocks (basket, chunk, chunk) are gathered by all three into a fixed number of partitions,
    which AQE can't join together for having few bytes.
    """
    small = items if large is None else items.join(large.select(basket), basket, "left_anti")
    rows = small.groupBy(basket).agg(F.collect_list(item).alias("left"))
    none = F.lit(None).cast(rows.schema["left"].dataType)
    rows = rows.where(F.size("left") > 1).select("left", none.alias("right"))
    if large is None:
        return rows
    chunks = F.ceil(F.col("_size") / CHUNK).cast("int")
    own = items.join(large, basket).withColumn("_chunks", chunks).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int"))
    sent = own.select(basket, item, "_own", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other"))
    sent = sent.select(basket, item, F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), (F.col("_own") <= F.col("_other")).alias("_left"))
    sent = sent.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), basket, "_a", "_b")
    pick = lambda side: F.collect_list(F.when(F.col("_left") == side, F.col(item)))
    blocks = sent.groupBy(basket, "_a", "_b").agg(pick(True).alias("left"), pick(False).alias("right"))
    return rows.unionByName(blocks.select("left", F.when(F.col("_a") != F.col("_b"), F.col("right")).alias("right")))


def basket_pairs(items: DataFrame, basket: str, item: str) -> DataFrame:
    """item_a < item_b, one row for each basket that has both."""
    own = basket_blocks(items, basket, item, large_baskets(items, basket)[1])
    own = own.select(F.array_sort("left").alias("left"), "right")
    left = own.select(F.posexplode("left").alias("_at", "x"), F.when(F.col("right").isNull(), F.col("left")).alias("_own"), "right")
    rest = F.slice("_own", F.col("_at") + 2, F.greatest(F.size("_own") - F.col("_at") - 1, F.lit(0)))
    pairs = left.select("x", F.explode(F.coalesce("right", rest)).alias("y"))
    return pairs.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def pair_counts(items: DataFrame, least: int = 1) -> DataFrame:
    """item_a < item_b and in how many orders they stand together.

    Items below ``least`` go first. The pairs of an order come from blocks of its items, gathered by one exchange; the
    counts are combined before the second exchange.
    """
    kept = once(frequent_only(items, least) if least > 1 else items, "pair-items")  # read for the sizes and for the pairs
    return basket_pairs(kept, "order_id", "item").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def both_ways(pairs: DataFrame, other: str, *values: str) -> DataFrame:
    """Each pair from either side: item, ``other`` and the values; the pairs are made once."""
    side = lambda x, y: F.struct(F.col(x).alias("item"), F.col(y).alias(other))
    return pairs.select(F.explode(F.array(side("item_a", "item_b"), side("item_b", "item_a"))).alias("_p"), *values).select("_p.*", *values)


def smoothed_pairs(items: DataFrame, least: float) -> DataFrame:
    """item_a, item_b and score (n + 1) / (orders of item_a + 2) of all ordered pairs of two items that reach ``least``.

    n is 0 for items that never meet; only those item_a whose orders are so few that this reaches ``least`` are paired
    with all items.
    """
    counts = item_counts(items)
    own = counts.select(F.col("item").alias("item_a"), "n_item")
    score = lambda n: (n + 1) / (F.col("n_item") + 2)
    rare = own.where(score(F.lit(0)) >= least).select("item_a")
    never = rare.crossJoin(counts.select(F.col("item").alias("item_b"))).where(F.col("item_a") != F.col("item_b")).withColumn("n", F.lit(0).cast("long"))
    met = both_ways(pair_counts(items), "item_b", "n").withColumnRenamed("item", "item_a")
    n = met.unionByName(never).groupBy("item_a", "item_b").agg(F.max("n").alias("n"))
    return n.join(own, "item_a").select("item_a", "item_b", score(F.col("n")).alias("score")).where(F.col("score") >= least)


def relaxed_rules(measured: DataFrame, share: float = 0.015, fewest: int = 3, confidence: float = 0.2) -> DataFrame:
    """Pairs of ``pair_measures`` that stand in ``share`` of all orders (in ``fewest`` at least) and whose larger
    confidence reaches ``confidence``."""
    orders = F.round(F.col("n") / F.col("support"))
    return measured.where((F.col("n") >= F.greatest(F.lit(fewest), F.ceil(share * orders))) & (F.col("confidence") >= confidence))


def bayesian_score(n: Column, n_a: Column, items: Column, prior: float = 1.0, penalty: float = 0.3) -> Column:
    """How likely the other item is beside item a, smoothed over all items, less a penalty for orders of a without it; 0 to 1."""
    score = (n + prior) / (n_a + items) - F.when(n_a > 0, penalty * (n_a - n) / n_a).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def pair_measures(pairs: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """support, both confidences, their larger one and lift; ``total`` has one row with column total."""
    side = lambda x: counts.select(F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}"))
    joined = pairs.join(side("a"), "item_a").join(side("b"), "item_b").join(F.broadcast(total))  # one row
    n = F.col("n")
    return joined.select(
        "item_a", "item_b", "n", "n_a", "n_b",
        (n / F.col("total")).alias("support"),
        (n / F.col("n_a")).alias("confidence_ab"),
        (n / F.col("n_b")).alias("confidence_ba"),
        F.greatest(n / F.col("n_a"), n / F.col("n_b")).alias("confidence"),
        (n * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
    )


def purchase_sequences(lines: DataFrame, item: str, position: str, least: int = 2) -> DataFrame:
    """order_id and the items in line order, repeats kept."""
    ordered = lines.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct(F.col(position), F.col(item)))).alias("s"))
    return ordered.select("order_id", F.transform("s", lambda x: x[item]).alias("sequence")).where(F.size("sequence") >= least)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; ``order`` must end in a tie-breaker."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
