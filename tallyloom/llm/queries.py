"""Queries of the training-text and item-set problems (p5, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import id_number
from ..sources.tables import table
from .cooccurrence import item_pairs
from .encoding import encode_corpus
from .leakage import find_leaks
from .line_quality import document_quality, fit_model


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "store_main_orders").select(id_number(F.col("order_id")).alias("basket"), id_number(F.col("variantid")).alias("item"), id_number(F.col("productid")).alias("grp"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return item_pairs(_lines(spark, folder)).select(F.col("item_a").alias("variant_a"), F.col("item_b").alias("variant_b"))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    d = item_pairs(_lines(spark, folder))
    return d.select("item_a", "item_b", "n", "n_a", "n_b", "baskets", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def p5_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of items that meet, with its counts and how far it is from chance."""
    d = item_pairs(_lines(spark, folder), least=1, lift=0.0, other_group=False)
    return d.select("item_a", "item_b", "n", "n_a", "n_b", "baskets", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts come back whole from their ids."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = encode_corpus(docs, decoded=True)
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return back.join(docs, "doc_id").agg(F.count(F.lit(1)).alias("texts"), F.sum(same.cast("long")).alias("same"), F.sum(F.size("ids")).alias("tokens"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_places(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), places=True)


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return document_quality(docs, fit_model(docs, table(spark, folder, "doc_labels")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).where(F.col("prose") < 0.5).select("doc_id").distinct()


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder)


def _number(c: str) -> str:
    text = f"trim({c})"
    gid = f"CASE WHEN starts_with({text}, 'Z2lkOi8v') THEN decode(from_base64({text})) ELSE {text} END"
    return f"TRY_CAST(nullif(regexp_extract({gid}, '([0-9]+)\\s*$', 1), '') AS BIGINT)"


_COUNTS_SQL = f"""
WITH l AS (SELECT {_number('order_id')} AS basket, {_number('variantid')} AS item, {_number('productid')} AS grp FROM store_main_orders),
b AS (SELECT DISTINCT basket, item FROM l WHERE basket IS NOT NULL AND item IS NOT NULL),
t AS (SELECT count(DISTINCT basket) AS total FROM b),
c AS (SELECT item, count(*) AS n FROM b GROUP BY item),
every AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
"""
_PAIRS_SQL = (
    _COUNTS_SQL
    + """, p AS (SELECT * FROM every WHERE n >= 10),
g AS (SELECT DISTINCT item, grp FROM l WHERE basket IS NOT NULL AND item IS NOT NULL AND grp IS NOT NULL),
r AS (SELECT p.item_a, p.item_b, p.n, a.n AS n_a, d.n AS n_b, t.total
      FROM p JOIN c a ON a.item = p.item_a JOIN c d ON d.item = p.item_b CROSS JOIN t
      WHERE p.n * t.total >= 5 * a.n * d.n
        AND NOT EXISTS (SELECT 1 FROM g ga JOIN g gb ON ga.grp = gb.grp WHERE ga.item = p.item_a AND gb.item = p.item_b))
"""
)
_MEASURES_SQL = """round(n * total / (n_a * n_b * 1.0::DOUBLE), 6) AS lift,
round(ln((n + 0.5::DOUBLE) * (total - n_a - n_b + n + 0.5::DOUBLE) / ((n_a - n + 0.5::DOUBLE) * (n_b - n + 0.5::DOUBLE))), 6) AS log_odds"""

SQL = {
    "p5_found": _PAIRS_SQL + "SELECT item_a AS variant_a, item_b AS variant_b FROM r",
    "p5_pairs": _PAIRS_SQL + f"SELECT item_a, item_b, n, n_a, n_b, total AS baskets, {_MEASURES_SQL} FROM r",
    "p5_all_pairs": _COUNTS_SQL
    + f""", r AS (SELECT item_a, item_b, every.n, a.n AS n_a, d.n AS n_b, total FROM every JOIN c a ON a.item = item_a JOIN c d ON d.item = item_b CROSS JOIN t)
SELECT item_a, item_b, n, n_a, n_b, total AS baskets, {_MEASURES_SQL} FROM r""",
}

QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in (p5_found, p5_pairs, p5_all_pairs, p7_ids, p7_roundtrip, p8_found, p8_places, p9_found, p9_quality)}
