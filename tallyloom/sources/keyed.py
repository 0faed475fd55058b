"""Tables of parquet files in the shared folder that are changed by key, bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import upsert
from ..plans.shared import written
from .files import overwrite_partitions

BUCKET = "_bucket"


class Keyed:
    """One row per key, in ``buckets`` partitions by a hash of the key.

    A change reads and rewrites only the buckets that have rows to change; each is written elsewhere first and then
    replaced by Spark's dynamic partition overwrite, so a job that fails leaves the buckets as they were. One writer at a
    time. Rows with a null in a key are not taken.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema: StructType | None = None

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, fs = self._files()
        return fs.exists(path)

    def _stored(self) -> DataFrame:
        """The rows with their bucket."""
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _put(self, df: DataFrame) -> None:
        self.schema = df.schema
        overwrite_partitions(df.repartition(BUCKET), self.path, [BUCKET])

    def _change(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the buckets by what ``change`` makes of their rows."""
        if not touched:
            return
        new = written(change(self._stored().where(F.col(BUCKET).isin(touched))), "changed")
        left = {r[0] for r in new.select(BUCKET).distinct().collect()}
        self._put(new)
        path, fs = self._files()
        for b in set(touched) - left:  # at most ``buckets``: an empty one isn't overwritten
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}"), True)

    def _touched(self, df: DataFrame) -> list[int]:
        return [r[0] for r in df.select(BUCKET).distinct().collect()]

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> None:
        """Rows replace those with their key, others are added; of several with one key the first in ``order`` counts."""
        fresh = written(self._with_bucket(rows), "fresh")
        if not self.exists():
            return self._put(upsert(fresh.limit(0), fresh, self.keys, order))
        self._change(self._touched(fresh), lambda old: upsert(old, fresh.select(*old.columns), self.keys, order))

    def delete(self, condition: Column) -> int:
        """Deletes the rows that fulfil the condition; how many there were."""
        hit = self._stored().where(condition).groupBy(BUCKET).count().collect()
        self._change([r[BUCKET] for r in hit], lambda old: old.where(~F.coalesce(condition, F.lit(False))))
        return sum(r["count"] for r in hit)

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        """Sets columns (not those of the key) of the rows that fulfil the condition; how many there were."""
        hit = self._stored().where(condition).groupBy(BUCKET).count().collect()
        sets = lambda old: old.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})
        self._change([r[BUCKET] for r in hit], sets)
        return sum(r["count"] for r in hit)
