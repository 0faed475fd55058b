"""Files: text formats under an explicit schema, partition overwrite, key-value cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, corrupt: str | None = None) -> DataFrame:
    """CSV with a header; never infers. With ``corrupt`` broken rows keep their raw text in that column."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    return (r.option("columnNameOfCorruptRecord", corrupt) if corrupt else r).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined by '; '."""
    flat = [F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def cached(spark: SparkSession, path: str, keys: DataFrame, make, now: str) -> DataFrame:
    """key, value of ``keys`` from the cache at ``path``; those that are missing or expired are made and appended.

    ``make`` maps a frame of keys to key, value, expires_at. The latest entry of a key counts.
    """
    schema = "key string, value string, expires_at timestamp"
    try:
        old = spark.read.schema(schema).parquet(path).where(F.col("expires_at") > F.lit(now).cast("timestamp"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], schema)
    keys = keys.select("key").distinct()
    make(keys.join(old.select("key"), "key", "left_anti")).write.mode("append").parquet(path)
    own = spark.read.schema(schema).parquet(path).where(F.col("expires_at") > F.lit(now).cast("timestamp"))
    return keys.join(own.groupBy("key").agg(F.max_by("value", F.struct("expires_at", "value")).alias("value")), "key")
