"""Rows that fail to parse: a permissive read under an explicit schema, then a second look at what is corrupt."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant
from ..sources.csv_text import read_rows

#: The columns of each kind.
IDS = ("order_id", "lineItemId", "product_id", "productId", "variant_id", "variantId", "inventory_item_id", "location_id")
PRICES = ("price", "compare_at_price", "totalPrice", "originalUnitPrice")
COUNTS = ("lineItemQuantity", "available", "available_total")
TIMES = ("createdAt", "inventory_item_created_at", "updated_at", "last_inventory_update")
TEXTS = ("name", "sku", "currencyCode", "lineItemName", "variant_title", "product_title", "product_type", "tags", "product_status", "vendor")
FIELDS = (*IDS, *PRICES, *COUNTS, *TIMES, *TEXTS)
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$|^\d{8}(?:T\d{6}(?:Z|[+-]\d{4})?)?$"


def read_permissive(uploads: DataFrame, key: str = "upload_id", text: str = "csv_data", chunk: int = 20_000) -> DataFrame:
    """One row per CSV row under an explicit schema: key, line_no, row_no, raw, width, cells, known, other.

    raw is the whole text of the row, width the number of the header's cells, and cells that of the row's, null where it
    isn't well quoted. known has the texts of FIELDS in their order (null where the file has no such column), other the
    columns outside by name; both are null where the row can't be laid on the header. If a name stands twice in a header,
    its first non-empty cell counts. Texts that are null or blank have no rows. Rows come out ``chunk`` at a time, read as
    a stream over the text, so a long text is never held as rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k, x in zip(batch.column(key), batch.column(text)):
                k, rows = k.as_py(), read_rows(x.as_py())
                header = [h.strip() for h in next(rows).cells or ()] if x.is_valid and x.as_py().strip() else []
                width, place = len(header), {h: i for i, h in reversed(list(enumerate(header)))}
                known = [place.get(n) for n in FIELDS]
                others = [(h, i) for h, i in place.items() if h not in _FIELDS]
                twice = [(place[h], [i for i, g in enumerate(header) if g == h]) for h in place if header.count(h) > 1]
                for r in rows if header else ():
                    laid = more = None
                    if r.cells is not None and len(r.cells) == width:
                        cells = [c.strip() for c in r.cells]
                        for first, at in twice:
                            cells[first] = next((cells[i] for i in at if cells[i]), "")
                        laid, more = [None if i is None else cells[i] for i in known], [(h, cells[i]) for h, i in others]
                    held.append((k, r.line_no, r.row_no, r.raw, width, None if r.cells is None else len(r.cells), laid, more))
                    if len(held) >= chunk:
                        yield _batch(held, key)
                        held = []
        if held:
            yield _batch(held, key)

    schema = f"{key} string, line_no int, row_no int, raw string, width int, cells int, known array<string>, other map<string,string>"
    return uploads.select(key, text).mapInArrow(read, schema)


_FIELDS = frozenset(FIELDS)


def _batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()))
    names = [key, "line_no", "row_no", "raw", "width", "cells", "known", "other"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _cell(name: str) -> Column:
    return F.get("known", F.lit(FIELDS.index(name)))


def _filled(c: Column) -> Column:
    """The cell, or null where it counts as empty."""
    return F.when(~F.upper(c).isin("", "NULL", "NONE"), c)


def _instants() -> Column:
    """The instants of the time columns, in their order; null where a cell is empty or isn't a real ISO 8601 time."""
    texts = F.array(*[F.regexp_replace(F.when(_filled(_cell(n)).rlike(_ISO), _cell(n)), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3") for n in TIMES])
    return F.transform(texts, lambda c: instant(c, F.lit("UTC")))


def _invalid() -> Column:
    """Whether a cast check fails."""
    checks = [_cell(n).isNotNull() & ~F.coalesce(_filled(_cell(n)).rlike(r"[0-9]$"), F.lit(False)) for n in IDS]
    checks += [F.coalesce(~_filled(_cell(n)).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), F.lit(False)) for n in PRICES]
    checks += [F.coalesce(~_filled(_cell(n)).rlike(r"^[+-]?[0-9]+$"), F.lit(False)) for n in COUNTS]
    checks += [_filled(_cell(n)).isNotNull() & F.get("times", F.lit(i)).isNull() for i, n in enumerate(TIMES)]
    at = checks[0]
    for c in checks[1:]:
        at = at | c
    return at


def classify(rows: DataFrame) -> DataFrame:
    """The permissive rows looked at again: reason (quoting, column_count, invalid_value or null) and times, the instants.

    raw stays where there is a reason and is null elsewhere.
    """
    reason = (
        F.when(F.col("cells").isNull(), "quoting")
        .when(F.col("cells") != F.col("width"), "column_count")
        .when(_invalid(), "invalid_value")
    )
    d = rows.withColumn("times", _instants()).withColumn("reason", reason)
    return d.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


def failed_rows(uploads: DataFrame) -> DataFrame:
    """upload_id, line_no, row_no, reason, raw of the rows that can't be loaded; an upload that comes twice counts once."""
    return classify(read_permissive(uploads)).where(F.col("reason").isNotNull()).select("upload_id", "line_no", "row_no", "reason", "raw").distinct()


def loaded_rows(uploads: DataFrame) -> DataFrame:
    """The valid rows, typed: ids as texts, prices as decimals, counts as longs, times as instants (UTC where no zone).

    Columns outside the schema are kept as texts in the map ``other``. Rows of an upload that comes twice come twice.
    """
    own = classify(read_permissive(uploads)).where(F.col("reason").isNull())
    snake = lambda n: "".join("_" + c.lower() if c.isupper() else c for c in n)
    typed: dict[str, Column] = {}
    for n in FIELDS:
        c = _filled(_cell(n))
        c = c.try_cast("decimal(18,4)") if n in PRICES else c.try_cast("long") if n in COUNTS else F.get("times", F.lit(TIMES.index(n))) if n in TIMES else c
        name = snake(n)
        typed[name] = F.coalesce(typed[name], c) if name in typed else c
    return own.select("upload_id", "line_no", *[c.alias(n) for n, c in typed.items()], "other")


def explained(failed: DataFrame, uploads: DataFrame) -> DataFrame:
    """How the messages of uploads agree with what is wrong in their rows.

    failed: from ``failed_rows``; uploads: id, error_message, updated_at, one row per state. A message may make several
    statements, parted by |. One row per statement of an upload that has a message, and one per upload that has failed rows
    only: upload_id, part (from 1), broken rows (by reason: quoting, column_count, invalid_value), first_line,
    message (the statement, of the latest state that has any), said (the reason that it names; ``vague`` if none of them,
    ``none`` without a message), said_row (a row number that isn't cut short), agrees (such a row is broken; false where the message is stale, null
    where it names no reason) and placed (that very row is broken for that reason; null without a number).
    """
    states = uploads.select(F.col("id").alias("upload_id"), F.trim("error_message").alias("m"), "updated_at").where((F.col("m") != "") & F.col("upload_id").isNotNull())
    last = states.groupBy("upload_id").agg(F.max_by("m", F.struct("updated_at", "m")).alias("m"))
    last = last.select("upload_id", F.posexplode(F.split("m", r"\s*\|\s*")).alias("part", "message")).withColumn("part", F.col("part") + 1)
    m = F.lower("message")
    said = F.when(m.isNull(), "none").when(m.rlike("quote"), "quoting").when(m.rlike(r"^row \d+ has|columns?, expected"), "column_count").when(m.rlike("^invalid"), "invalid_value").otherwise("vague")
    number = F.regexp_extract(m, r"\brow (\d+)(?![\d…])", 1).try_cast("int")
    last = last.withColumns({"said": said, "said_row": F.when(said != "vague", number)})
    count = lambda r: F.count(F.when(F.col("reason") == r, 1))
    hit = (F.col("reason") == F.col("said")) & (F.col("row_no") == F.col("said_row"))
    own = failed.select("upload_id", "line_no", "row_no", "reason").join(last, "upload_id", "full_outer")
    d = own.groupBy("upload_id", "part", "message", F.coalesce("said", F.lit("none")).alias("said"), "said_row").agg(
        *[count(r).alias(r) for r in ("quoting", "column_count", "invalid_value")], F.min("line_no").alias("first_line"), F.max(F.coalesce(hit, F.lit(False))).alias("_hit")
    )
    named = F.col("said").isin("quoting", "column_count", "invalid_value")
    there = F.coalesce(*[F.when(F.col("said") == r, F.col(r) > 0) for r in ("quoting", "column_count", "invalid_value")])
    placed = F.when(F.col("said_row").isNotNull(), F.col("_hit"))
    return d.withColumns({"agrees": F.when(named, there), "placed": placed}).drop("_hit")
