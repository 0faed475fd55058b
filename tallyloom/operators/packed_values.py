"""Several values packed in one cell, split into one row per value.

Dictionary-guided segmentation: the whole values known from quoted stretches that hold a delimiter make a multi-pattern
automaton; it finds them in the unquoted parts of each cell, and dynamic programming picks the cover with the fewest
unknown pieces, so that a delimiter inside a known value doesn't split it.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

#: The characters that separate values outside quotes.
SEPARATORS = ",;|\t\n\r•，；、·¦"
#: Whole cells that hold no value, in lower case.
NO_VALUE = ("", "null", "none", "n/a", "[]")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\(.)|\"\"")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.|"")*)"(?=\s*(?:[' + re.escape(SEPARATORS) + r"]|$))", re.S)
_PLAIN = re.compile("[^" + re.escape(SEPARATORS) + "]+")


def _unescape(s: str) -> str:
    if "\\" not in s and '""' not in s:
        return s
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else (m[2] if m[2] else '"'), s)


def _listed(text: str) -> list[str] | None:
    """The values of a JSON list, or None."""
    if not (text.startswith("[") and text.endswith("]")):
        return None
    try:
        values = json.loads(text)
    except ValueError:
        return None
    return [x if isinstance(x, str) else json.dumps(x) for x in values if x is not None]


def _stretches(text: str) -> Iterator[tuple[bool, int, int, str]]:
    """(quoted, start, end, value): the quoted stretches and, between them, the parts that separators may split."""
    at, plain = 0, 0
    while at < len(text):
        if text[at] == '"' and (m := _QUOTED.match(text, at)):
            if plain < at:
                yield False, plain, at, text[plain:at]
            yield True, at, m.end(), _unescape(m[1])
            at = plain = m.end()
        elif text[at] in SEPARATORS or text[at].isspace():
            at += 1
        else:  # a mark inside a value that doesn't begin with one is text
            at = m.end() if (m := _PLAIN.match(text, at)) else at + 1
    if plain < len(text):
        yield False, plain, len(text), text[plain:]


def _cover(part: str, found: list[tuple[int, int]]) -> list[str]:
    """The part in pieces; ``found`` are the known values in it, as (start, end)."""
    pieces = [(m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())) for m in _PLAIN.finditer(part)]
    pieces = [(a, b) for a, b in pieces if a < b]
    if not found:
        return [part[a:b] for a, b in pieces]
    first, last, known = {a: i for i, (a, _) in enumerate(pieces)}, {b: i for i, (_, b) in enumerate(pieces)}, {}
    for a, b in found:
        if a in first and b in last:
            known.setdefault(last[b], []).append(first[a])
    best: list[tuple[int, int]] = [(0, 0)]  # cost up to a piece, and where its last segment begins
    for j in range(len(pieces)):
        options = [(best[j][0] + 2, j)] + [(best[i][0] + 1, i) for i in known.get(j, ())]
        best.append(min(options))
    out, j = [], len(pieces)
    while j:
        i = best[j][1]
        out.append(part[pieces[i][0] : pieces[j - 1][1]])
        j = i
    return out[::-1]


def split_cell(text: str | None, automaton=None) -> list[str]:
    """The values of a cell in order, without outer space, quotes and escapes; empty values are left out."""
    text = (text or "").strip()
    if text.lower() in NO_VALUE:
        return []
    values = _listed(text)
    if values is None:
        if text.startswith("[") and text.endswith("]"):
            text = text[1:-1].strip()
        values = []
        for quoted, _, _, part in _stretches(text):
            if quoted:
                values.append(part)
            else:
                found = [(e - n + 1, e + 1) for e, n in automaton.iter(part)] if automaton is not None else []
                values += _cover(part, found)
    return [v for x in values if (v := x.strip())]


def _automaton(words: list[str]):
    if not words:
        return None
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def known_values(rows: DataFrame, text: str) -> DataFrame:
    """The distinct quoted values that hold a separator, and how many cells have each quoted: value, cells.

    A single cell is enough, as a quoted stretch is one value by definition; ``cells`` tells which of them are weakly backed.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for cell in batch[text]:
                cell = (cell or "").strip()
                values = {x.strip() for x in _listed(cell) or [p for q, _, _, p in _stretches(cell) if q]}
                seen.update(v for v in values if any(c in SEPARATORS for c in v))
            yield pd.DataFrame(sorted(seen.items()), columns=["value", "cells"]).astype({"value": "object", "cells": "int64"})

    quoted = rows.where(F.col(text).contains('"')).select(text)
    return written(quoted.mapInPandas(learn, "value string, cells long").groupBy("value").agg(F.sum("cells").alias("cells")), "known-values")


def split_values(rows: DataFrame, text: str, block: int = 200_000) -> DataFrame:
    """``rows`` without ``text``, one row per value, with position_no (from 1 over the non-empty values) and tag_value.

    Cells that are null, blank, NULL, none, n/a or an empty list give no row. Equal cells with equal other columns are
    split once. The known values come from all rows; they are sent to the tasks ``block`` at a time, so no more than
    that is ever held at once, however many there are: with several blocks each cell collects its matches block by block
    before the cover is picked.
    """
    keep = [c for c in rows.columns if c != text]
    rows = rows.where(F.trim(F.lower(text)).isNotNull() & ~F.trim(F.lower(text)).isin(*NO_VALUE))
    values = known_values(rows, text)  # from the rows as they are: no exchange but that of the values
    rows = rows.distinct()
    n = values.count()
    blocks = max(1, -(-n // block))
    if blocks == 1:
        words = [r[0] for r in values.collect()]

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(words)
            for batch in batches:
                yield batch[keep].assign(tag_values=[split_cell(x, automaton) for x in batch[text]])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
        out = rows.select(*keep, text).mapInPandas(split, f"{schema}, tag_values array<string>")
    else:
        out = _split_in_blocks(rows, keep, text, values, blocks)
    return out.select(*keep, F.posexplode("tag_values").alias("position_no", "tag_value")).withColumn("position_no", (F.col("position_no") + 1).cast("int"))


class _Found:
    """Stands in for an automaton with the known values of one cell."""

    def __init__(self, words: list[str]):
        self.words = words

    def iter(self, part: str) -> Iterator[tuple[int, int]]:
        for w in self.words:
            at = part.find(w)
            while at >= 0:
                yield at + len(w) - 1, len(w)
                at = part.find(w, at + 1)


def _split_in_blocks(rows: DataFrame, keep: list[str], text: str, values: DataFrame, blocks: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    at = rows.select(*keep, text, F.array().cast("array<string>").alias("_words"))
    for b in range(blocks):
        words = [r[0] for r in values.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == b).collect()]

        def collect(batches: Iterator[pd.DataFrame], words: list[str] = words) -> Iterator[pd.DataFrame]:
            automaton = _automaton(words)
            for batch in batches:
                if automaton is not None:
                    batch["_words"] = [list(old) + sorted({cell[e - n + 1 : e + 1] for e, n in automaton.iter(cell)}) for old, cell in zip(batch["_words"], batch[text])]
                yield batch

        at = at.mapInPandas(collect, f"{schema}, `{text}` string, _words array<string>")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keep].assign(tag_values=[split_cell(x, _Found(list(w))) for x, w in zip(batch[text], batch["_words"])])

    return at.mapInPandas(split, f"{schema}, tag_values array<string>")
