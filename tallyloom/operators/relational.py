"""Join, upsert and set helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, which must end in a tie-breaker."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The old rows without the new keys, and the new rows (the first per key in ``order``).

    Rows of ``new`` with a null in a key are dropped.
    """
    for k in keys:
        new = new.where(F.col(k).isNotNull())
    new = first_per_key(new, keys, order) if order else new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drops every old row of a group that ``new`` has, and adds ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def backfill(df: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Fills blank values of ``column`` from ``source`` (one row per key)."""
    s = source.select(key, F.col(column).alias("_fill"))
    blank = F.col(column).isNull() | (F.trim(F.col(column)) == "")
    return df.join(s, key, "left").withColumn(column, F.when(blank, F.coalesce("_fill", column)).otherwise(F.col(column))).drop("_fill")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Keys that only one side has, with the name of that side."""
    one = lambda x, y, n: x.select(key).distinct().join(y.select(key), key, "left_anti").withColumn("side", F.lit(n))
    return one(a, b, names[0]).unionByName(one(b, a, names[1]))


def either_key_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], row_key: list[str]) -> DataFrame:
    """Rows that match by any of several keys, each left-right pair once.

    Each key is an equi-join of its own, so an OR never becomes a nested loop. ``row_key`` tells the rows of the result
    apart.
    """
    out = None
    for a, b in pairs:
        one = left.join(right, left[a] == right[b])
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(row_key)


def tiered_fill(tiers: list[DataFrame], key: str, order: list[Column], n: int) -> DataFrame:
    """Candidates of the first tier, then of the next, until there are n; a key counts in its first tier only.

    ``order`` sorts inside a tier and must end in a tie-breaker.
    """
    every = None
    for i, d in enumerate(tiers):
        one = d.withColumn("tier", F.lit(i + 1))
        every = one if every is None else every.unionByName(one)
    best = first_per_key(every, [key], [F.col("tier"), *order])
    return best.orderBy("tier", *order).limit(n)
