"""References to records that do not exist.

The keys that are referred to are dictionary-encoded as dense integers. For each range of RANGE codes there are compressed
bitmaps: of the codes referred to in a period, and of those whose record was surely there from a period on. Reference
AND-NOT parent is done per range and period; only the bits that survive are decoded and looked at row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..plans.codes import dense_codes
from ..plans.shared import written

NO_TIME = -1
#: Codes of one bitmap; fixed by Spark's bitmap functions.
RANGE = 32_768


def _month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def compressed(bits: bytes) -> bytes:
    """A bitmap in its shorter form: the sorted 16-bit numbers of its bits, or the bits after a mark of odd length."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype("<u2")
    return at.tobytes() if 2 * len(at) < len(bits) else b"." + bits


def expanded(form: bytes) -> np.ndarray:
    """The bits of a compressed bitmap as booleans."""
    if len(form) % 2:
        return np.unpackbits(np.frombuffer(form, np.uint8, offset=1), bitorder="little").view(bool)
    out = np.zeros(RANGE, bool)
    out[np.frombuffer(form, "<u2")] = True
    return out


@F.pandas_udf(BinaryType())
def _compressed(bits: pd.Series) -> pd.Series:
    return bits.map(compressed)


def bitmaps(records: DataFrame) -> DataFrame:
    """relation, range, asked, there: the compressed bitmaps of a range of codes, one for each period.

    records: relation, code, periods (in which the code is referred to) and safe_from (from which on the record is surely
    there, or null). All of a range comes to one task by one exchange of the records, so no part of a bitmap is shuffled.
    A range has RANGE codes at most and one bitmap for each period, which bounds its row.
    """
    own = records.select("relation", "code", "periods", "safe_from", F.floor(F.col("code") / RANGE).alias("range")).repartition("relation", "range")
    asked = F.transform("periods", lambda p: F.struct(F.lit(True).alias("asked"), p.alias("period")))
    there = F.when(F.col("safe_from").isNotNull(), F.array(F.struct(F.lit(False).alias("asked"), F.col("safe_from").alias("period")))).otherwise(F.array())
    bit = own.select("relation", "range", F.bitmap_bit_position(F.col("code") + 1).alias("bit"), F.inline(F.concat(asked, there)))
    one = bit.groupBy("relation", "range", "asked", "period").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("map", F.struct("period", _compressed("bits").alias("bits")))
    pick = lambda x: F.collect_list(F.when(F.col("asked") == x, F.col("map")))
    return one.groupBy("relation", "range").agg(pick(True).alias("maps"), pick(False).alias("there"))


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of each range and period that no record surely covers."""
    for b in batches:
        for row in b.to_pylist():
            there, at = np.zeros(RANGE, bool), 0
            steps = sorted(row["there"], key=lambda x: x["period"])
            for m in sorted(row["maps"], key=lambda x: (x["period"] == NO_TIME, x["period"])):  # without a time: any record will do
                while at < len(steps) and (m["period"] == NO_TIME or steps[at]["period"] <= m["period"]):
                    there |= expanded(steps[at]["bits"])
                    at += 1
                rest = np.flatnonzero(expanded(m["bits"]) & ~there) + row["range"] * RANGE
                if len(rest):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), m["period"], np.int32)), pa.array(rest.astype(np.int64))], ["period", "code"])


def find_orphans(refs: DataFrame, parents: DataFrame, grace_days: int = 2) -> DataFrame:
    """Orphan references: relation, record_key, period (month number or -1), kind, each once per period.

    refs: relation string, record_key string, key (any type), at timestamp (null: never late).
    parents: relation string, key (of the same type), deleted boolean, created_at timestamp (null: always there).
    kind is ``missing`` without a parent, else ``deleted`` if no living record has the key, else ``late`` if the earliest
    record was created more than ``grace_days`` after the reference. Null keys are no references. Repeated rows count once.

    The bitmaps single out the (key, month) that can be orphans: a reference bit survives unless a living
    parent was there by the grace period after the month's first moment. Survivors are checked against the times of their
    rows. A key that a third of all rows hold is one bit a period; its rows are split by AQE in the last join.
    """
    refs = refs.where(F.col("key").isNotNull() & F.col("record_key").isNotNull()).withColumn("period", F.coalesce(_month(F.col("at")), F.lit(NO_TIME)))
    refs = written(refs.select("relation", "period", "key", "record_key", "at"), "references")  # read twice, parsed once
    # one row for each key, with the months in which it is referred to
    seen = refs.groupBy("relation", "key").agg(F.collect_set("period").alias("periods"))
    codes = dense_codes(seen, ["relation", "key"])
    own = (
        parents.where(F.col("key").isNotNull())
        .groupBy("relation", "key")
        .agg(F.min(F.coalesce("deleted", F.lit(False))).alias("deleted"), F.min(F.when(F.col("created_at").isNull(), F.lit("0001-01-01 00:00:00").cast("timestamp")).otherwise(F.col("created_at"))).alias("created_at"))
    )
    # the first month all of whose moments lie less than the grace period before created_at, or after it
    sure = F.col("created_at") - F.expr(f"interval {int(grace_days)} days")
    safe = _month(sure) + F.when(F.date_trunc("month", sure) == sure, 0).otherwise(1)
    own = own.withColumn("safe_from", F.when(F.col("created_at") < F.lit("0001-02-01 00:00:00").cast("timestamp"), F.lit(NO_TIME)).otherwise(safe))
    own = written(codes.join(own, ["relation", "key"], "left"), "records")  # of the keys that are referred to

    alive = own.withColumn("safe_from", F.when(~F.col("deleted"), F.col("safe_from")))
    survivors = bitmaps(alive).select("range", "maps", "there").mapInArrow(_and_not, "period int, code long")
    judged = written(survivors.join(own, "code").select("relation", "period", "key", "deleted", "created_at"), "survivors")
    rows = refs.join(judged, ["relation", "period", "key"])
    kind = (
        F.when(F.col("deleted").isNull(), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("created_at") > F.col("at") + F.expr(f"interval {int(grace_days)} days"), "late")
    )
    return rows.select("relation", "record_key", "period", kind.alias("kind")).where(F.col("kind").isNotNull()).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per relation, month (``yyyy-mm`` or ``unknown``) and kind."""
    month = F.when(F.col("period") == NO_TIME, F.lit("unknown")).otherwise(F.format_string("%04d-%02d", F.floor(F.col("period") / 12).cast("int"), (F.col("period") % 12 + 1).cast("int")))
    return found.groupBy(F.col("relation").alias("source_table"), month.alias("month"), "kind").agg(F.count(F.lit(1)).alias("orphans"))
