"""How a query and its SQL are put together."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shop_frames import ShopFrames

#: The logical frames in SQL.
FRAMES = {
    "lines": """SELECT l_orderkey AS order_id, l_linenumber AS line_item_id, l_partkey AS variant_id, l_suppkey AS location_id, CAST(l_quantity AS INT) AS quantity,
 l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) AS line_total, l_extendedprice * l_discount AS line_discount, l_discount AS discount_rate,
 l_returnflag AS return_flag, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem""",
    "ords": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS financial_status,
 o_orderpriority AS channel, lower(trim(c_mktsegment)) AS shop_id, n_name AS country, lower(trim(c_mktsegment)) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS upload_id
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "catalog": "SELECT p_partkey AS variant_id, p_name AS product_title, p_type AS product_type, p_brand AS vendor, p_retailprice AS price, p_size AS available_total FROM part",
    "inventory": "SELECT l_partkey AS variant_id, l_suppkey AS location_id, count(*) AS available, max(CAST(l_shipdate AS DATE)) AS updated_on FROM lineitem GROUP BY 1, 2",
    "vlines": "SELECT l.order_id, l.variant_id, l.quantity, c.vendor AS item FROM lines l JOIN catalog c ON l.variant_id = c.variant_id",
    "vb": "SELECT DISTINCT order_id, item FROM vlines",
    "vpairs": "SELECT x.item AS item_a, y.item AS item_b, count(*) AS n FROM vb x JOIN vb y ON x.order_id = y.order_id AND x.item < y.item GROUP BY 1, 2",
    "vitems": "SELECT item, count(*) AS n_item FROM vb GROUP BY 1",
    "vbig": "SELECT order_id FROM vb GROUP BY 1 HAVING count(*) >= 2",
    "daily": "SELECT order_date, sum(total) AS revenue, count(*) AS n_orders, count(DISTINCT customer_id) AS customers FROM ords GROUP BY 1",
    "sold": "SELECT variant_id, CAST(sum(quantity) AS BIGINT) AS units, sum(line_total) AS revenue, sum(line_discount) AS discount, count(*) AS n_lines FROM lines GROUP BY 1",
}


def sql(body: str) -> str:
    """The statement with the frames that it uses, directly or through each other, in front."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, own in FRAMES.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                need(own)
                if name not in used:
                    used.append(name)

    need(body)
    ordered = [n for n in FRAMES if n in used]
    head = ", ".join(f"{n} AS ({FRAMES[n]})" for n in ordered)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


class Book:
    """Collects queries: name -> (callable of session and folder, SQL or None)."""

    def __init__(self):
        self.queries: dict = {}

    def add(self, name: str, statement: str | None = None) -> Callable:
        def put(f: Callable[[ShopFrames], DataFrame]) -> Callable:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return f(ShopFrames(spark, folder))

            assert name not in self.queries, name
            self.queries[name] = (run, sql(statement) if statement else None)
            return f

        return put
