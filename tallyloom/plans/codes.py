"""Dense integer codes for keys, made without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def dense_codes(df: DataFrame, key: str | list[str], code: str = "code") -> DataFrame:
    """The frame (one row per key of one or more columns) with codes 0..n-1 in key order.

    The rows are range-partitioned and numbered inside each partition; only one count per partition reaches the
    driver, to make the offsets. The numbered rows are written to the shared folder first, so that a lost executor
    can't renumber them.
    """
    keys = [key] if isinstance(key, str) else key
    own = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    own = written(own.withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "codes")
    at, offsets = 0, []
    for r in own.groupBy("_p").count().orderBy("_p").collect():
        offsets.append((r["_p"], at))
        at += r["count"]
    if not offsets:
        return own.select(*df.columns, F.lit(0).cast("long").alias(code))
    offset = F.create_map(*[F.lit(x) for p in offsets for x in p])[F.col("_p")]
    return own.select(*df.columns, (F.col("_i") + offset).cast("long").alias(code))
