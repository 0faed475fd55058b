"""Percentiles in their several definitions, normalisers, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import written


def _ranked(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value (each distinct one, without nulls), and the places _first to _last, from 0, that it takes among _n sorted.

    Values are counted, sorted by range over all partitions and numbered inside each; only one count for each group and
    partition crosses them. So a group that holds most rows is on many tasks, and no task holds a group.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    own = written(own.repartitionByRange(*group, value).withColumn("_p", F.spark_partition_id()), "value-counts")
    sums = own.groupBy(*[F.col(g).alias(f"_{g}") for g in group], F.col("_p").alias("_at")).agg(F.sum("_c").alias("_k"))
    same = W.partitionBy(*[f"_{g}" for g in group])  # a row for each partition
    before = F.coalesce(F.sum("_k").over(same.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"_before": before, "_n": F.sum("_k").over(same)})
    on = F.col("_p") == F.col("_at")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.sum("_c").over(W.partitionBy(*group, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    last = F.col("_inside") + F.col("_before") - 1
    return own.withColumn("_inside", inside).join(sums, on).select(*group, value, (last - F.col("_c") + 1).alias("_first"), last.alias("_last"), "_n")


def ranked_percentiles(df: DataFrame, group: list[str], value: str, qs: dict[str, float], how: str = "before") -> DataFrame:
    """Percentiles per group, exact. Nulls don't count.

    ``floor`` takes index int(q*n), at most n-1; ``before`` takes max(0, int(n*q)-1); ``linear`` interpolates at q*(n-1).
    """
    n = F.col("_n")
    at = lambda i: F.max(F.when(i.between(F.col("_first"), F.col("_last")), F.col(value)))

    def pick(q: float) -> Column:
        if how == "linear":
            place = (n - 1) * q
            share = F.max(place - F.floor(place))
            return at(F.floor(place)) * (1 - share) + at(F.ceil(place)) * share
        return at(F.least(F.floor(n * q), n - 1) if how == "floor" else F.greatest(F.floor(n * q) - 1, F.lit(0)))

    return _ranked(df, group, value).groupBy(*group).agg(*[pick(q).alias(name) for name, q in qs.items()])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scales columns to 0..1 over the whole frame, 0.5 where a column is flat; one aggregate, joined back as one row."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(ends))  # one row
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(f"{c}_norm", F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)).drop(lo, hi)
    return out


def robust_scale(df: DataFrame, column: str) -> DataFrame:
    """(x - median) / IQR squeezed by the logistic function, 0.5 where the IQR is 0."""
    q = ranked_percentiles(df, [], column, {"_low": 0.25, "_mid": 0.5, "_high": 0.75}, "linear")
    iqr = F.col("_high") - F.col("_low")
    return df.join(F.broadcast(q)).withColumn(f"{column}_robust", F.when(iqr > 0, 1 / (1 + F.exp(-(F.col(column) - F.col("_mid")) / iqr))).otherwise(0.5)).drop("_low", "_mid", "_high")  # one row


def z_sigmoid_without_outliers(df: DataFrame, column: str, reach: float = 3.0) -> DataFrame:
    """Logistic of the z score; mean and deviation of the values within ``reach`` IQRs of the quartiles."""
    q = ranked_percentiles(df, [], column, {"_low": 0.25, "_high": 0.75}, "linear")
    fence = (F.col("_high") - F.col("_low")) * reach
    inside = df.join(F.broadcast(q)).where(F.col(column).between(F.col("_low") - fence, F.col("_high") + fence))
    m = inside.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.join(F.broadcast(m)).withColumn(f"{column}_z", F.when(F.col("_s") > 0, 1 / (1 + F.exp(-(F.col(column) - F.col("_m")) / F.col("_s")))).otherwise(0.5)).drop("_m", "_s")  # one row


def linear_trend(series: DataFrame, order: str, value: str) -> DataFrame:
    """slope, intercept, mean and n over the index 0..n-1 of an ordered (already aggregated) series."""
    d = series.withColumn("_i", (F.row_number().over(W.orderBy(order)) - 1).cast("double"))
    return d.agg(F.regr_slope(value, "_i").alias("slope"), F.regr_intercept(value, "_i").alias("intercept"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def forecast(series: DataFrame, order: str, value: str, days: int, window: int = 7) -> DataFrame:
    """step, linear, moving_average, last and their mean with a band of 1.96 deviations across the methods."""
    t = linear_trend(series, order, value)
    ranked = series.withColumn("_d", F.row_number().over(W.orderBy(F.desc(order))))
    tail = ranked.join(F.broadcast(t.select("n"))).where(F.col("_d") <= F.greatest(F.lit(1), F.least(F.lit(window), F.floor(F.col("n") / 2))))
    base = tail.agg(F.avg(value).alias("moving_average"), F.max(F.when(F.col("_d") == 1, F.col(value))).alias("last"))
    steps = t.join(F.broadcast(base)).select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("step"))
    linear = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    three = F.array(linear, F.col("moving_average"), F.col("last"))
    mean = F.aggregate(three, F.lit(0.0), lambda a, x: a + x) / 3
    d = steps.select("step", linear.alias("linear"), "moving_average", "last", mean.alias("mean"), three.alias("_t"))
    spread = F.sqrt(F.aggregate("_t", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / 3)
    return d.select("step", "linear", "moving_average", "last", "mean", (F.col("mean") - 1.96 * spread).alias("low"), (F.col("mean") + 1.96 * spread).alias("high"))
