"""Mixed timestamp notations: a dictionary of distinct raw texts, parsed once and joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant
from ..plans.shared import new_path

KEYS = ["source", "zone", "raw"]


def extend_dictionary(values: DataFrame, path: str | None = None) -> DataFrame:
    """Parse the distinct (source, zone, raw) of ``values`` that the dictionary at ``path`` lacks, and append them.

    Without a path the dictionary is new. Returns the whole dictionary: source, zone, raw, utc_micros (null for texts
    that stand for no time, so that these too are parsed only once), each text once, also where writers at the same time
    have both appended it. Null raws are left out; a null zone is kept as ''.
    """
    kept = path is not None
    spark = values.sparkSession
    known = None
    if path is not None:
        try:
            known = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    path = path or new_path(spark, "instants")
    fresh = values.where(F.col("raw").isNotNull()).select("source", F.coalesce("zone", F.lit("")).alias("zone"), "raw").groupBy(*KEYS).agg(F.lit(1).alias("_n")).drop("_n")
    if known is not None:
        fresh = fresh.join(known.select(*KEYS), KEYS, "left_anti")
    fresh.withColumn("utc_micros", F.unix_micros(instant(F.col("raw"), F.col("zone")))).write.mode("append").parquet(path)
    whole = spark.read.schema("source string, zone string, raw string, utc_micros long").parquet(path)
    # by the keys of the join that follows, so the grouping needs no exchange of its own; a new dictionary is unique as it is
    return whole.groupBy(*KEYS).agg(F.max("utc_micros").alias("utc_micros")) if kept else whole


def normalise_instants(rows: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """``rows`` (with columns source, zone, raw and any others) with utc_micros.

    Rows whose raw is null, blank or no real time get null; no row is lost or repeated. A raw text that a third of the
    rows share is one dictionary entry; AQE splits its side of the join.
    """
    d = extend_dictionary(rows, dictionary_path)
    found = d.where(F.col("utc_micros").isNotNull()).select(F.col("source").alias("_s"), F.col("zone").alias("_z"), F.col("raw").alias("_r"), "utc_micros")
    on = (F.col("source") == F.col("_s")) & (F.coalesce("zone", F.lit("")) == F.col("_z")) & (F.col("raw") == F.col("_r"))
    return rows.drop("utc_micros").join(found, on, "left").drop("_s", "_z", "_r")
