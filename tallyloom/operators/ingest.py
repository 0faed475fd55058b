"""Typed extraction from string frames: headers, coercions, defaults, order headers and lines."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import id_number
from ..functions.instants import instant
from .relational import first_per_key

#: What tells a kind of file, in the order of the test; one name of each group must be there.
KINDS = {
    "orders": (("order_id",), ("line_item_id", "sku")),
    "inventory_levels": (("inventory_item_id",), ("location_id",)),
    "variants": (("variant_id",), ("product_id",), ("inventory_item_id",)),
    "catalog_joined": (("variant_id",), ("product_id",), ("product_title",)),
}
#: The columns that each kind must have, and the groups of which one is enough.
REQUIRED = {
    "orders": ("createdAt", "lineItemQuantity", "originalUnitPrice"),
    "variants": ("product_id", "variant_id", "variant_title", "price", "inventory_item_id"),
    "inventory_levels": ("inventory_item_id", "location_id", "available", "updated_at"),
    "catalog_joined": ("product_id", "variant_id", "product_title", "price", "inventory_item_id", "product_status"),
}
ONE_OF = {"orders": (("order_id", "orderId", "name"), ("variantId", "variant_id", "sku"))}
#: Other names of a column.
ALIASES = {
    "variantid": "variant_id",
    "varianttitle": "variant_title",
    "variant_price": "price",
    "variant_compare_at_price": "compare_at_price",
    "variant_sku": "sku",
    "productid": "product_id",
    "inventoryitemid": "inventory_item_id",
    "inventoryitemcreatedat": "inventory_item_created_at",
    "producttitle": "product_title",
    "producttype": "product_type",
    "status": "product_status",
}
#: Where a name is cut: before a capital with a small letter after it, and between a small letter or digit and a capital.
_CUT = r"(?<=.)(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])"


def canonical(name: str) -> str:
    """A header in snake case by its usual name: cut at capitals, white space, dashes and slashes; other marks stay."""
    n = re.sub(r"[\s\-/]+", "_", name.strip().replace("\ufeff", ""))
    n = re.sub("_+", "_", re.sub(_CUT, "_", n)).strip("_").lower()
    return ALIASES.get(n, n)


def canonical_column(c: Column) -> Column:
    """``canonical`` of a column of headers."""
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "\ufeff", ""), r"[\s\-/]+", "_")
    n = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(n, _CUT, "_"), "_+", "_"), "^_|_$", ""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[n], n)


def with_canonical_headers(df: DataFrame) -> DataFrame:
    """Columns by their canonical names; a name that comes twice gets _2, _3 ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = canonical(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def schema_errors(kind: str, columns: list[str]) -> tuple[list[str], list[tuple[str, ...]]]:
    """What a file of the kind lacks: the missing columns, and the groups without any of their columns."""
    have = {canonical(c) for c in columns}
    missing = sorted(n for n in REQUIRED[kind] if canonical(n) not in have)
    return missing, [g for g in ONE_OF.get(kind, ()) if have.isdisjoint(map(canonical, g))]


def validate_schema(kind: str, columns: list[str]) -> None:
    """Raises ValueError with all that a file lacks, or for a kind that there isn't."""
    if kind not in REQUIRED:
        raise ValueError(f"unknown kind {kind!r}; known are {', '.join(sorted(REQUIRED))}")
    missing, groups = schema_errors(kind, columns)
    if missing or groups:
        parts = [f"missing: {', '.join(missing)}"] * bool(missing) + [f"one needed of: {', '.join(sorted(g))}" for g in groups]
        raise ValueError(f"{kind}: " + "; ".join(parts))


def detect_kind(columns: list[str]) -> str | None:
    """The first kind whose groups the headers (trimmed, in lower case) fulfil."""
    have = {c.strip().lower() for c in columns}
    return next((k for k, groups in KINDS.items() if all(have.intersection(g) for g in groups)), None)


def known_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that a table has, in its order; others of the frame are dropped."""
    return df.select(*[n for n in names if n in df.columns])


def decimals_as_doubles(df: DataFrame) -> DataFrame:
    """Every decimal, also inside structs, arrays and maps, as a double, as JSON has no decimals."""

    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.DecimalType):
            return T.DoubleType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(plain(t.keyType), plain(t.valueType), t.valueContainsNull)
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, plain(f.dataType), f.nullable) for f in t.fields])
        return t

    return df.select(*[F.col(f"`{f.name}`").cast(plain(f.dataType)).alias(f.name) for f in df.schema])


def clamped(c: Column, least: float, most: float, default: float) -> Column:
    """A number from any text, kept within bounds; the default where there is none."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(filled(c).try_cast("double"), F.lit(default))))


def truth(c: Column) -> Column:
    """true, 1, yes, y and on in any case are true, all else is false."""
    return F.coalesce(F.lower(filled(c)).isin("true", "1", "yes", "y", "on"), F.lit(False))


def filled(c: Column) -> Column:
    """The trimmed text, or null if blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def lenient_decimal(c: Column) -> Column:
    return F.coalesce(filled(c).try_cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))


def lenient_int(c: Column) -> Column:
    """Whole numbers also from texts like 3.0; 0 where there is none."""
    return F.coalesce(filled(c).try_cast("double").try_cast("int"), F.lit(0))


def synthetic_sku(*ids: Column) -> Column:
    """no-sku- and the last ten characters of the first id there is."""
    return F.substring(F.concat(F.lit("no-sku-"), F.right(F.coalesce(*[filled(c) for c in ids], F.lit("")), F.lit(10))), 1, 100)


def gid(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"gid://shopify/{kind}/"), number.cast("string"))


def compatible_text(c: Column) -> Column:
    """The text in compatibility form (NFKC), trimmed: width variants and ligatures become plain characters."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip())

    return compose(c)


def title_words(c: Column, n: int = 4) -> Column:
    """The first n words of a title, split at spaces and dashes, in initial capitals."""
    return F.initcap(F.array_join(F.slice(F.filter(F.split(F.lower(c), r"[\s\-]+"), lambda x: x != ""), 1, n), " "))


def order_headers(rows: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """One row per order number: the fields of its first line (by line number, then by the raw fields)."""
    d = rows.select(
        id_number(F.col("order_id")).alias("order_no"), id_number(F.col("lineitemid")).alias("_line"), F.col("createdat").alias("created_raw"),
        F.col("displayfinancialstatus").alias("status"), "currencycode", F.col("totalprice").alias("total"),
    ).where(F.col("order_no").isNotNull())
    order = [F.asc_nulls_first(c) for c in ("_line", "created_raw", "status", "total", "currencycode")]
    return first_per_key(d, ["order_no"], order).drop("_line").withColumn("created_at", instant(F.col("created_raw"), F.lit(zone)))


def order_lines(rows: DataFrame) -> DataFrame:
    """One row per line number, the first of its deliveries, with typed fields and a sku wherever one can be made."""
    d = rows.select(
        id_number(F.col("lineitemid")).alias("line_no"), id_number(F.col("order_id")).alias("order_no"), id_number(F.col("variantid")).alias("variant_no"),
        F.greatest(F.coalesce("lineitemquantity", F.lit(0)), F.lit(0)).alias("quantity"), F.col("originalunitprice").alias("unit_price"),
        F.coalesce(filled(F.col("sku")), synthetic_sku(F.col("variantid"), F.col("lineitemid"))).alias("sku"),
    ).where(F.col("line_no").isNotNull())
    order = [F.asc_nulls_first(c) for c in ("order_no", "variant_no", "quantity", "unit_price", "sku")]
    return first_per_key(d, ["line_no"], order)
