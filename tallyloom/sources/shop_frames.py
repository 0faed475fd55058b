"""Logical frames (order lines, orders, catalogue, inventory) over the star-schema tables of a folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


class ShopFrames:
    """Lazily built frames; only the columns that a query uses reach the scans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def lines(self) -> DataFrame:
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_item_id"),
            F.col("l_partkey").alias("variant_id"),
            F.col("l_suppkey").alias("location_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            net.alias("line_total"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("line_discount"),
            F.col("l_discount").alias("discount_rate"),
            F.col("l_returnflag").alias("return_flag"),
            F.to_date("l_shipdate").alias("ship_date"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        c = self.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.lower(F.trim("c_mktsegment")).alias("shop_id"), F.col("c_nationkey").alias("_n"))
        n = self.raw("nation").select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias("country"))
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").alias("total"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_orderstatus").alias("financial_status"),
            F.col("o_orderpriority").alias("channel"),
        )
        return o.join(c, "customer_id").join(n, "_n").drop("_n").withColumn("upload_id", F.concat_ws("-", "shop_id", F.year("order_date").cast("string")))

    @cached_property
    def catalog(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("variant_id"),
            F.col("p_name").alias("product_title"),
            F.col("p_type").alias("product_type"),
            F.col("p_brand").alias("vendor"),
            F.col("p_retailprice").alias("price"),
            F.col("p_size").alias("available_total"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("location_id")).agg(F.count(F.lit(1)).alias("available"), F.max(F.to_date("l_shipdate")).alias("updated_on"))

    @cached_property
    def vendor_lines(self) -> DataFrame:
        """Lines at the grain of vendors: few items, dense pairs."""
        return self.lines.select("order_id", "variant_id", "quantity").join(self.catalog.select("variant_id", F.col("vendor").alias("item")), "variant_id")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")
