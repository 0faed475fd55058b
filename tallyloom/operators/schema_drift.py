"""Schemas that drift between the files of a series.

Tagged-union inference: the schema of each file is inferred on its own, in parallel; the schemas are then fused, renamed
columns into one field, keeping every alternative type that a field has had and where it first came up. In the one table
of all files a field of a single type is a column of that type; conflicting types become a struct of typed branches
beside the canonical text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import written
from ..sources.csv_text import read_rows

_TYPES = (
    ("integer", re.compile(r"[+-]?[0-9]+")),
    ("decimal", re.compile(r"[+-]?[0-9]+\.[0-9]+")),
    ("boolean", re.compile(r"true|false", re.I)),
    ("timestamp", re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}Z?")),
)
KEY = "sku"


def type_of(values: list[str]) -> str | None:
    """The type that all non-empty values have, text if they have none in common, None if all are empty."""
    full = [v for x in values if (v := x.strip())]
    if not full:
        return None
    return next((t for t, p in _TYPES if all(p.fullmatch(v) for v in full)), "text")


def read_file(body: str | None) -> tuple[list[str], list[list[str]]]:
    """(names, rows); short rows are filled with '', a name that stands twice counts where it stands first."""
    rows = [r.raw.split(",") if r.cells is None else r.cells for r in read_rows(body, ",")]
    width = len(rows[0]) if rows else 0
    rows = [(r + [""] * width)[:width] for r in rows]
    return ([x.strip() for x in rows[0]], rows[1:]) if rows else ([], [])


def _by_column(body: str | None) -> dict[str, list[str]]:
    names, rows = read_file(body)
    out: dict[str, list[str]] = {}
    for i, n in enumerate(names):
        out.setdefault(n, [r[i] for r in rows])
    return out


def file_schemas(files: DataFrame) -> DataFrame:
    """file_id, series_id, exported_at and fields array<struct<name, type>> of each file; repeated files count once."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fields = [[{"name": n, "type": type_of(v)} for n, v in _by_column(b).items()] for b in batch["body"]]
            yield batch[["file_id", "series_id", "exported_at"]].assign(fields=fields)

    return files.select("file_id", "series_id", "exported_at", "body").mapInPandas(infer, "file_id string, series_id string, exported_at timestamp, fields array<struct<name:string,type:string>>").dropDuplicates(["file_id"])


def in_order(schemas: DataFrame, bucket_days: int = 32) -> DataFrame:
    """Each file with its number in its series and the file before it.

    A series that holds much of the data is cut into time buckets, which are numbered on their own; only one row per
    bucket is then ordered across the series. Files without a time come first in their series, by file_id; a file without
    a series is the first of its own.
    """
    s = schemas.withColumn("_bucket", F.coalesce(F.floor(F.unix_seconds("exported_at") / (86400 * bucket_days)), F.lit(-(1 << 62))))
    own = W.partitionBy("series_id", "_bucket").orderBy("exported_at", "file_id")
    s = s.withColumn("_n", F.row_number().over(own)).withColumn("_before", F.lag("file_id").over(own))
    ends = s.groupBy("series_id", "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.max_by("file_id", F.struct("exported_at", "file_id")).alias("_last"))
    over = W.partitionBy("series_id").orderBy("_bucket")
    ends = ends.select("series_id", "_bucket", F.coalesce(F.sum("_c").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lag("_last").over(over).alias("_prior"))
    within = F.col("series_id").isNotNull()
    place = F.when(within, F.col("_base") + F.col("_n")).otherwise(1).cast("long").alias("place")
    return s.join(ends, ["series_id", "_bucket"], "left").select(*schemas.columns, place, F.when(within, F.coalesce("_before", "_prior")).alias("before"))


def renames(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, old_field, new_field. pairs: file_id, before, gone array<string>, come array<string>, none of them empty.

    A pair of columns is a rename if the texts agree for all keys found in both files and are not all empty. Each column
    is used once, in the order of the columns.
    """
    bodies = files.select("file_id", "body").dropDuplicates(["file_id"])
    both = pairs.join(bodies.withColumnRenamed("body", "now"), "file_id").join(bodies.select(F.col("file_id").alias("before"), F.col("body").alias("then")), "before")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for f, gone, come, then, now in zip(batch["file_id"], batch["gone"], batch["come"], batch["then"], batch["now"]):
                a, b = _by_column(then), _by_column(now)
                at = [{}, {}]
                for d, c in zip(at, (a, b)):
                    for i, k in enumerate(c.get(KEY, [])):
                        if k.strip():
                            d.setdefault(k.strip(), i)
                shared = [(i, at[1][k]) for k, i in at[0].items() if k in at[1]]
                free = list(come)
                for old in gone:
                    x = [a[old][i] for i, _ in shared]
                    if any(v.strip() for v in x):
                        new = next((n for n in free if [b[n][j] for _, j in shared] == x), None)
                        if new is not None:
                            free.remove(new)
                            out.append((f, old, new))
            yield pd.DataFrame(out, columns=["file_id", "old_field", "new_field"])

    return both.select("file_id", "gone", "come", "then", "now").mapInPandas(match, "file_id string, old_field string, new_field string")


#: Files of a series whose columns are looked at together; what came before is carried over from block to block.
BLOCK = 1024


@dataclass
class Compared:
    """Schemas in order, each file beside the one before it, and the columns renamed between them; all written."""

    schemas: DataFrame  # file_id, series_id, exported_at, fields, place, before
    pairs: DataFrame  # file_id, before, fields, old, gone, come
    renamed: DataFrame  # file_id, old_field, new_field


def compare(files: DataFrame) -> Compared:
    s = written(in_order(file_schemas(files)), "schemas")
    names = lambda c: F.transform(c, lambda x: x["name"])
    before = s.select(F.col("file_id").alias("before"), F.col("fields").alias("old"))
    pairs = s.join(before, "before").select(
        "file_id", "before", "fields", "old",
        F.array_except(names("old"), names("fields")).alias("gone"),
        F.array_except(names("fields"), names("old")).alias("come"),
    )
    pairs = written(pairs, "pairs")
    to_match = pairs.where((F.size("gone") > 0) & (F.size("come") > 0)).select("file_id", "before", "gone", "come")
    return Compared(s, pairs, written(renames(to_match, files), "renames"))


def _last_before(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``was``: the last non-null ``value`` at a lower ``place`` among equal keys.

    The places are cut into blocks, as one key may hold most rows: windows see one block, and one row of each block is
    carried to the next ones.
    """
    rows = rows.withColumn("_block", F.floor(F.col("place") / BLOCK))
    inside = W.partitionBy(*keys, "_block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_block").agg(F.max_by(value, "place").alias("_end"))
    # a block without such a value has no end, so the ends are matched to blocks of rows
    blocks = rows.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    carried = F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", carried.alias("_carried"))
    own = rows.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return own.join(blocks, [*keys, "_block"]).withColumn("was", F.coalesce("_inside", "_carried")).drop("_block", "_inside", "_carried")


def drift(files: DataFrame) -> DataFrame:
    """Each change of a file against the one before it in its series: file_id, change_kind, old_field, new_field.

    Files without a header have no fields. Ties of exported_at are ordered by file_id; files without a time come first,
    and those without a series have no file before them, thus no changes. The key column takes part like any
    other, except that it can't be renamed. Null bodies are files without fields.
    """
    c = compare(files)
    s, pairs, renamed = c.schemas, c.pairs, c.renamed
    gone = pairs.select("file_id", F.explode("gone").alias("old_field")).join(renamed.select("file_id", "old_field"), ["file_id", "old_field"], "left_anti")
    come = pairs.select("file_id", F.explode("come").alias("new_field")).join(renamed.select("file_id", "new_field"), ["file_id", "new_field"], "left_anti")
    # kept fields stand in the file before too; the last type in any earlier file, also from before a gap
    f = s.where(F.col("series_id").isNotNull()).select("file_id", "series_id", "place", F.inline("fields"))
    stood = pairs.select("file_id", F.explode("old").alias("x")).select("file_id", F.col("x.name").alias("name"))
    kept = _last_before(f, ["series_id", "name"], "type").where(F.col("type") != F.col("was")).join(stood, ["file_id", "name"], "left_semi")
    typed = lambda c: F.explode(F.col(c))
    new = pairs.select("file_id", typed("fields").alias("x")).select("file_id", F.col("x.name").alias("new_field"), F.col("x.type").alias("now"))
    old = pairs.select("file_id", typed("old").alias("x")).select("file_id", F.col("x.name").alias("old_field"), F.col("x.type").alias("was"))
    turned = renamed.join(new, ["file_id", "new_field"]).join(old, ["file_id", "old_field"]).where(F.col("now") != F.col("was"))
    row = lambda d, kind, a, b: d.select("file_id", F.lit(kind).alias("change_kind"), a.alias("old_field"), b.alias("new_field"))
    none = F.lit("")
    return (
        row(renamed, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(row(come, "added", none, F.col("new_field")))
        .unionByName(row(gone, "removed", F.col("old_field"), none))
        .unionByName(row(kept, "retyped", F.col("name"), F.col("name")))
        .unionByName(row(turned, "retyped", F.col("old_field"), F.col("new_field")))
    )


def _snake(name: str) -> str:
    return re.sub(r"[^\w]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).strip("_").lower() or "column"


def field_names(names: list[str], renamed: dict[str, str]) -> list[str]:
    """The field of each column of a file: the first name of its chain of renames, in snake case.

    Spellings of one name fall together. Where two columns of a file would be one field, the later one goes by its own
    name, and if that is taken too, by that name with a number.
    """
    out: list[str] = []
    for n in names:
        options = [_snake(renamed.get(n, n)), _snake(n)]
        options += [f"{options[1]}_{i}" for i in range(2, len(names) + 2)]
        out.append(next(x for x in options if x not in out))
    return out


def first_names(c: Compared) -> DataFrame:
    """file_id and renamed map<name, first name> of the files that have columns which were renamed earlier.

    A column's life in a series runs from where it comes until it goes. A renamed one goes on with the life of the old
    name; the chains are followed back by doubling, so a chain of n renames takes about log2(n) rounds.
    """
    place = c.schemas.select("file_id", "series_id", "place").where(F.col("series_id").isNotNull())
    starts = (
        c.schemas.where(F.col("before").isNull()).select("file_id", F.explode("fields.name").alias("name"))
        .unionByName(c.pairs.select("file_id", F.explode("come").alias("name")))
        .join(c.renamed.select("file_id", F.col("new_field").alias("name"), "old_field"), ["file_id", "name"], "left")
        .join(place, "file_id")
        .select("series_id", "name", "place", "old_field")
    )
    starts = written(starts, "starts")
    # the life of the old name that a rename goes on with: its last start before
    asked = starts.where(F.col("old_field").isNotNull()).select("series_id", F.col("old_field").alias("name"), "place", F.col("name").alias("new"), F.lit(None).cast("long").alias("at"))
    both = starts.select("series_id", "name", "place", F.lit(None).cast("string").alias("new"), F.col("place").alias("at")).unionByName(asked)
    found = _last_before(both, ["series_id", "name"], "at").where(F.col("new").isNotNull())
    links = found.select("series_id", F.col("new").alias("name"), "place", F.col("name").alias("up"), F.col("was").alias("up_place"))
    links = written(links, "links")
    while True:
        up = links.select("series_id", F.col("name").alias("up"), F.col("place").alias("up_place"), F.col("up").alias("_up"), F.col("up_place").alias("_place"))
        both = links.join(up, ["series_id", "up", "up_place"], "left")
        higher = F.col("_up").isNotNull()
        new = both.select("series_id", "name", "place", F.when(higher, F.col("_up")).otherwise(F.col("up")).alias("up"), F.when(higher, F.col("_place")).otherwise(F.col("up_place")).alias("up_place"), higher.alias("moved"))
        new = written(new, "links")
        moved = new.where("moved").limit(1).count()
        links = new.drop("moved")
        if not moved:
            break
    ends = starts.join(links.select("series_id", "name").distinct(), ["series_id", "name"], "left_semi")
    ends = ends.withColumn("next", F.lead("place").over(W.partitionBy("series_id", "name").orderBy("place"))).select("series_id", "name", "place", "next")
    lives = links.join(ends, ["series_id", "name", "place"]).select("series_id", "name", F.col("place").alias("start"), "next", "up")
    there = c.schemas.where(F.col("series_id").isNotNull()).select("file_id", "series_id", "place", F.explode("fields.name").alias("name"))
    own = there.join(lives, ["series_id", "name"]).where((F.col("place") >= F.col("start")) & (F.col("next").isNull() | (F.col("place") < F.col("next"))))
    return own.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "up"))).alias("renamed"))


def _columns(c: Compared) -> DataFrame:
    """file_id, series_id, exported_at, place, name, field, type of every column of every file."""
    d = c.schemas.join(first_names(c), "file_id", "left")

    @F.pandas_udf("array<string>")
    def fields_of(names: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        none = lambda x: [] if x is None else x
        return pd.Series([field_names(list(none(n)), dict(zip(none(a), none(b)))) for n, a, b in zip(names, old, new)], dtype="object")

    named = d.withColumn("names", fields_of(F.col("fields.name"), F.map_keys("renamed"), F.map_values("renamed")))
    own = named.select("file_id", "series_id", "exported_at", "place", F.explode(F.arrays_zip("fields", "names")).alias("x"))
    return own.select("file_id", "series_id", "exported_at", "place", F.col("x.fields.name").alias("name"), F.col("x.names").alias("field"), F.col("x.fields.type").alias("type"))


def fused_schema(files: DataFrame) -> DataFrame:
    """Per series and field every alternative type: series_id, field, type, names, files, first_file, first_at, alternative.

    ``alternative`` numbers a field's types from 1 in the order in which they came up; a column that is empty in a file
    has no type there. names are the spellings and former names under which the type stood.
    """
    typed = _columns(compare(files)).where(F.col("type").isNotNull())
    first = F.min(F.struct("place", "file_id", "exported_at"))
    one = typed.groupBy("series_id", "field", "type").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count(F.lit(1)).alias("files"), first.alias("_first"))
    # at most one row for each type there is
    number = F.row_number().over(W.partitionBy("series_id", "field").orderBy("_first", "type"))
    return one.select("series_id", "field", "type", "names", "files", F.col("_first.file_id").alias("first_file"), F.col("_first.exported_at").alias("first_at"), number.alias("alternative"))


_BRANCHES = {
    "integer": lambda v: v.try_cast("decimal(38,0)"),
    "decimal": lambda v: v.try_cast("double"),
    "boolean": lambda v: F.lower(v) == "true",
    "timestamp": lambda v: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(v, "Z$", ""), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")),
    "text": lambda v: v,
}


def unified(files: DataFrame) -> DataFrame:
    """All files as one table, one row per record: file_id, series_id, exported_at, row_no and ``record``.

    ``record`` is a struct of all fields that any file has, renamed columns in one field (``field_names``). A field that has
    had one type is of that type (integer: decimal(38,0), decimal: double, boolean, timestamp, text: string; text also
    where it was always empty). A field of several types is a struct of one branch for each of them, of which the one of
    the column's type in its file is set, and ``canonical``, the trimmed text. Empty cells and fields that a file lacks are
    null; records without any value keep their row. The list of fields and types goes to the driver, as it is the schema
    of the table.
    """
    c = compare(files)
    columns = written(_columns(c), "columns")
    types: dict[str, set[str]] = {}
    for r in columns.select("field", "type").distinct().collect():
        types.setdefault(r["field"], set()).update([r["type"]] if r["type"] else [])
    renamed = columns.where(F.col("field") != F.col("name")).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "field"))).alias("fields"))
    own = files.select("file_id", "series_id", "exported_at", "body").dropDuplicates(["file_id"]).join(renamed, "file_id", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, s, t, body, fields in zip(batch["file_id"], batch["series_id"], batch["exported_at"], batch["body"], batch["fields"]):
                data, field = _by_column(body), dict(fields or {})
                tags = {field.get(n, n): type_of(v) for n, v in data.items()}
                rows = [{field.get(n, n): x.strip() for n, x in zip(data, cells) if x.strip()} for cells in zip(*data.values())]
                for a in range(0, len(rows), 10_000):  # long files leave in parts
                    part = rows[a : a + 10_000]
                    yield pd.DataFrame({"file_id": f, "series_id": s, "exported_at": t, "row_no": range(a + 1, a + 1 + len(part)), "values": part, "tags": [tags] * len(part)})

    flat = own.mapInPandas(read, "file_id string, series_id string, exported_at timestamp, row_no int, values map<string,string>, tags map<string,string>")
    record = []
    for field in sorted(types):
        kinds = [k for k in _BRANCHES if k in types[field]]
        text, tag = F.element_at("values", F.lit(field)), F.element_at("tags", F.lit(field))
        if len(kinds) > 1:
            branches = [F.when(tag == k, _BRANCHES[k](text)).alias(k) for k in kinds]
            record.append(F.when(text.isNotNull(), F.struct(*branches, text.alias("canonical"))).alias(field))
        else:
            record.append(_BRANCHES[kinds[0] if kinds else "text"](text).alias(field))
    return flat.select("file_id", "series_id", "exported_at", "row_no", (F.struct(*record) if record else F.lit(None).cast("struct<column:string>")).alias("record"))
