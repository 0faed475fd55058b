"""Merging and selecting candidates."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import written
from .statistics import min_max


def merge_by_set(candidates: DataFrame) -> DataFrame:
    """One row per set of products, whatever their order: signature, highest score, all sources, source of the best.

    candidates: products array, source, score. Ties of the best go to the last source in order.
    """
    d = candidates.withColumn("signature", F.array_sort(F.array_distinct("products")))
    return d.groupBy("signature").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.max_by("source", F.struct("score", "source")).alias("best"))


def merge_candidates(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per set of products and kind: signature, kind, the largest confidence, lift and support, the mean fit, all
    sources, and products and score of the best.

    candidates: products array, kind, source, score, confidence, lift, support, fit. Sets of ``existing`` (signature, kind)
    are left out. Ties of the best go to the products that come last.
    """
    d = candidates.withColumn("signature", F.array_sort(F.array_distinct("products")))
    if existing is not None:
        d = d.join(existing.select("signature", "kind"), ["signature", "kind"], "left_anti")
    best = F.struct("score", "products")
    return d.groupBy("signature", "kind").agg(
        *[F.max(c).alias(c) for c in ("score", "confidence", "lift", "support")], F.avg("fit").alias("fit"), F.array_sort(F.collect_set("source")).alias("sources"), F.max_by("products", best).alias("products")
    )


def weighted_top(df: DataFrame, weights: dict[str, float], key: str, k: int) -> DataFrame:
    """key and score of the k rows with the highest weighted sum of the scaled columns."""
    d = min_max(df, list(weights))
    score = sum((F.col(f"{c}_norm") * w for c, w in weights.items()), F.lit(0.0))
    return d.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def greedy_matching(pairs: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """The pairs that are taken when all are walked in ``order``, each if neither of its items is taken yet.

    ``order``: values that tell all pairs apart, smallest first; pairs with a null item don't count. No task walks the
    pairs: in each round every pair that comes first for both of its items is taken, as nothing before it can take them,
    and all pairs of these items go. The rounds end when no pair is left; the first of all pairs goes in every round.
    """
    rest = written(pairs.dropDuplicates().where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_order", F.struct(*order)), "pairs")
    out = None
    while True:
        best = rest.select(F.explode(F.array(a, b)).alias("_item"), "_order").groupBy("_item").agg(F.min("_order").alias("_best"))
        first = rest
        for side in (a, b):
            one = best.select(F.col("_item").alias(side), F.col("_best").alias(f"_{side}"))
            first = first.join(one, side).where(F.col(f"_{side}") == F.col("_order")).drop(f"_{side}")
        first = written(first.select(*rest.columns), "taken")
        out = first if out is None else out.unionByName(first)
        if first.isEmpty():
            return out.select(*pairs.columns)
        used = first.select(F.explode(F.array(a, b)).alias("_item"))
        for side in (a, b):
            rest = rest.join(used.withColumnRenamed("_item", side), side, "left_anti")
        rest = written(rest.select(*first.columns), "pairs")


def pareto_fronts(df: DataFrame, group: list[str], x: str, y: str, fronts: int) -> DataFrame:
    """The first fronts of two objectives (both to be large): the rows and their front, from 1.

    A front takes one sort of the distinct values of ``x`` with their largest ``y``: a value is on it if its y beats all
    of higher x. No row is compared with another.
    """
    rest, out = df, None
    for i in range(1, fronts + 1):
        best = rest.groupBy(*group, x).agg(F.max(y).alias(y))
        above = F.max(y).over(W.partitionBy(*group).orderBy(F.desc(x)).rowsBetween(W.unboundedPreceding, -1))
        front = best.withColumn("_a", above).where(F.col("_a").isNull() | (F.col(y) > F.col("_a"))).drop("_a")
        one = rest.join(front, [*group, x, y], "left_semi").withColumn("front", F.lit(i))
        out = one if out is None else out.unionByName(one)
        rest = rest.join(front, [*group, x, y], "left_anti")
    return out


def front_numbers(df: DataFrame, group: list[str], x: str, y: str, most: int | None = None) -> DataFrame:
    """The rows with their front of two objectives (both to be large), from 1; those beyond front ``most`` are left out.

    The distinct points of a group are walked once by falling (x, y): a point's front is the first whose highest y so far is
    lower. A task holds one number for each front, not the points. Rows without a group or an objective are on no front.
    """
    at = [*group, x, y]
    points = df.select(*at).dropna().distinct().repartition(*group).sortWithinPartitions(*group, F.desc(x), F.desc(y))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tops = None, []
        for d in batches:
            fronts = []
            for *g, v in zip(*[d[c] for c in [*group, y]]):
                if g != now:
                    now, tops = g, []
                f = bisect_right(tops, -v)
                if f < len(tops):
                    tops[f] = -v
                elif most is None or f < most:
                    tops.append(-v)
                fronts.append(f + 1)
            d = d.assign(front=np.array(fronts, np.int32))
            yield d if most is None else d[d["front"] <= most]

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in at)
    return df.join(points.mapInPandas(walk, f"{kinds}, front int"), at).select(*df.columns, "front")


def pareto_search(df: DataFrame, group: str, key: str, objectives: list[str], keep: int, seed: int, rounds: int = 30) -> DataFrame:
    """Per group ``keep`` members (all, if it has fewer), front after front; two objectives.

    Fronts that fit are taken whole. Of the first that doesn't, a seeded search that swaps members at random takes those
    that best cover these fronts. No front beyond ``keep`` is needed, as each has a row; nor, at the same x, a row with
    ``keep`` others before it by falling y and key: each of those is on an earlier front or is the same point.
    """
    x, y = objectives
    enough = F.row_number().over(W.partitionBy(group, x).orderBy(F.desc(y), key))
    few = front_numbers(df.withColumn("_r", enough).where(F.col("_r") <= keep).drop("_r"), [group], x, y, keep)

    def search(d: pd.DataFrame) -> pd.DataFrame:
        upto = d["front"].value_counts().sort_index().cumsum()
        over = upto.index[upto > keep]
        if len(over) == 0:
            return d.sort_values(key)
        d = d[d["front"] <= over[0]].sort_values(key).reset_index(drop=True)
        v = d[objectives].to_numpy(float)
        v = (v - v.min(0)) / np.maximum(v.max(0) - v.min(0), 1e-12)
        r = np.random.default_rng(seed)
        sure, last = np.flatnonzero(d["front"] < over[0]), np.flatnonzero(d["front"] == over[0])
        k = keep - len(sure)

        def gaps(chosen: np.ndarray) -> np.ndarray:
            least = np.full(len(v), np.inf)
            for c in chosen:
                least = np.minimum(least, np.linalg.norm(v - v[c], axis=1))
            return least

        base = gaps(sure)

        def worth(chosen: np.ndarray) -> float:
            return float(np.minimum(base, gaps(chosen)).sum())

        best = r.choice(last, k, replace=False)
        for _ in range(rounds if k else 0):
            new = best.copy()
            new[r.integers(k)] = r.choice(np.setdiff1d(last, best))
            if worth(new) < worth(best):
                best = new
        return d.loc[np.sort(np.concatenate([sure, best]))]

    return few.groupBy(group).applyInPandas(search, few.schema)
