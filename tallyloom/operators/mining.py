"""Frequent item sets and rules of any antecedent size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import once, written
from .baskets import baskets, frequent_only


def in_large_orders(items: DataFrame) -> DataFrame:
    """The items of orders with two and more, written, as counts and levels read them again."""
    own = once(items, "items")
    return written(own.join(own.groupBy("order_id").count().where("count >= 2"), "order_id", "left_semi"), "items-of-two")


def frequent_sets(many: DataFrame, least: int, largest: int = 3) -> DataFrame:
    """size, items (sorted array), n of sets that stand in at least ``least`` of the orders of ``in_large_orders``.

    Level by level: the rows of a frequent set of k items are joined to the items after it in the same order. A row goes
    on to be counted only if the set without its first item is frequent too; with the join on the first k items, that
    keeps just the sets both of whose neighbours in the level below are frequent. The sets of each level are written to
    the shared folder, as the next level and the rules read them again.
    """
    kept = written(frequent_only(many, least), "frequent-items")
    level = kept.select("order_id", F.array("item").alias("items"))
    out = None
    for k in range(1, largest + 1):
        counted = written(level.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "frequent-sets")
        one = counted.select(F.lit(k).alias("size"), "items", "n")
        out = one if out is None else out.unionByName(one)
        if k == largest:
            return out
        level = level.join(counted.select("items"), "items", "left_semi")
        level = level.join(kept, "order_id").where(F.col("item") > F.element_at("items", -1)).select("order_id", F.concat("items", F.array("item")).alias("items"))
        if k > 1:
            rest = F.slice("items", 2, k)
            level = level.withColumn("_rest", rest).join(counted.select(F.col("items").alias("_rest")), "_rest", "left_semi").drop("_rest")
    return out


def rules(sets: DataFrame, total: int, min_confidence: float = 0.05) -> DataFrame:
    """Every non-empty proper subset as antecedent: antecedent, consequent, n, support, confidence, lift."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("items")) - 2)
    pick = lambda bit: F.filter("items", lambda x, i: F.call_function("getbit", F.col("mask"), i) == bit)
    split = (
        sets.where(F.size("items") >= 2)
        .select("items", "n", F.explode(masks).alias("mask"))
        .select("n", pick(1).alias("antecedent"), pick(0).alias("consequent"))
    )
    support = lambda x: sets.select(F.col("items").alias(x), F.col("n").alias(f"n_{x}"))
    n = F.col("n")
    return (
        split.join(support("antecedent"), "antecedent")
        .join(support("consequent"), "consequent")
        .select("antecedent", "consequent", "n", (n / total).alias("support"), (n / F.col("n_antecedent")).alias("confidence"), (n * total / (F.col("n_antecedent") * F.col("n_consequent"))).alias("lift"))
        .where(F.col("confidence") >= min_confidence)
    )


def fpgrowth_sets(items: DataFrame, min_support: float) -> DataFrame:
    """Sets of any size by parallel FP-growth: items (sorted array), n. Only orders of two items and more count."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(baskets(items, 2))
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
