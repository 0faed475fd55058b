"""Evaluation texts that leak into training text, found with one Aho-Corasick automaton over the items' words.

Of ``words`` consecutive words of an item, one whole block of words // 2 always begins at a multiple of that number. So the
automaton has these blocks only, as sequences of word numbers: about one state for each word of the items. A text is
scanned once; where a block stands, the words on either side tell how far the item goes on.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import spread

_DROP = regex.compile(r"[\p{M}\p{Cf}]")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_GAP = regex.compile(r"[^\p{L}\p{N}]+")
_PLAIN_GAP = regex.compile(r"[^a-z0-9]+")


def normalised(text: str) -> str:
    """The words of a text, each between single spaces: without format characters, accents, case and width variants."""
    if text.isascii():
        return f" {_PLAIN_GAP.sub(' ', text.lower()).strip()} "
    # folding can bring back marks (the dotted capital i), so they go after it
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return f" {_GAP.sub(' ', _DROP.sub('', t)).strip()} "


def _with_places(text: str) -> list[tuple[str, int, int]]:
    """The words of a text with their place in it: (normalised word, start, end)."""
    out: list[tuple[str, int, int]] = []
    word, start, end = "", 0, 0
    for i, c in enumerate(text):
        for x in _DROP.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold())):
            if _WORD.fullmatch(x):
                start, word = (start, word + x) if word else (i, x)
                end = i + 1
            elif word:
                out.append((word, start, end))
                word = ""
    return [*out, (word, start, end)] if word else out


class Items:
    """The automaton over items (id, text), and the search with it."""

    def __init__(self, items: list[tuple[int, str | None]], words: int):
        import ahocorasick

        self.words, self.block = words, max(1, words // 2)
        self.number: dict[str, int] = {}  # from 1; words of no item are 0
        self.items = []
        blocks: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            own = tuple(self.number.setdefault(w, len(self.number) + 1) for w in normalised(text or "").split())
            if len(own) >= words:
                for at in range(0, len(own) - self.block + 1, self.block):
                    blocks.setdefault(own[at : at + self.block], []).append((len(self.items), at))
                self.items.append((item, own))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for b, owners in blocks.items():
            self.automaton.add_word(b, owners)
        if blocks:
            self.automaton.make_automaton()

    def find(self, text: str | None, first_only: bool = False) -> dict[int, set[tuple[int, int]]]:
        """item id -> (first word in the text, number of words) of its passages there; with ``first_only`` one passage each."""
        out: dict[int, set[tuple[int, int]]] = {}
        if not text or not self.items:
            return out
        there = tuple(self.number.get(w, 0) for w in normalised(text).split())
        reached: dict[tuple[int, int], int] = {}  # (item, shift) -> first word after what has been compared
        for end, owners in self.automaton.iter(there) if len(there) >= self.words else ():
            start = end - self.block + 1
            for k, at in owners:
                item, own = self.items[k]
                if first_only and item in out or reached.get((k, start - at), 0) > start:
                    continue
                a, b = start, end + 1
                while a > 0 and a - start + at > 0 and there[a - 1] == own[a - 1 - start + at]:
                    a -= 1
                while b < len(there) and b - start + at < len(own) and there[b] == own[b - start + at]:
                    b += 1
                reached[k, start - at] = b
                if b - a >= self.words:
                    out.setdefault(item, set()).add((a, b - a))
        return out


def find_leaks(documents: DataFrame, items: DataFrame, words: int = 12, bound: int = 8_000_000, places: bool = False) -> DataFrame:
    """doc_id and item_id wherever ``words`` consecutive words of the item occur consecutively in the document.

    With ``places`` also first_char and last_char, the place in the original text of each maximal leaked passage.
    Items with fewer words, null and blank texts have no case; equal rows count once. Each text is scanned once, whole,
    and by the task that reads it: no shuffle but the final distinct (and that of ``spread``). The tasks get the items'
    texts, whose size is measured first: up to ``bound`` characters (some 100 000 test questions, about 300 MB of
    automaton) go at once. Beyond it the items are cut by a hash into parts of that size, with one scan for each part.
    """
    items = items.select("item_id", "item_text").where("item_text is not null").distinct()
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    parts = -(-size // bound) or 1
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long" + ", first_char int, last_char int" * places
    columns = ["doc_id", "item_id", "first_char", "last_char"][: 4 if places else 2]
    out = None
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == part)
        texts = [(r["item_id"], r["item_text"]) for r in own.collect()]

        def scan(batches: Iterator[pd.DataFrame], texts: list = texts) -> Iterator[pd.DataFrame]:
            search = Items(texts, words)
            for b in batches:
                rows: list[tuple] = []
                for doc, text in zip(b["doc_id"], b["text"]):
                    found = search.find(text, not places)
                    if found and places:
                        rows += [(doc, i, a, z) for i, a, z in _spans(text, found, words)]
                    else:
                        rows += [(doc, i) for i in found]
                yield pd.DataFrame(rows, columns=columns)

        one = spread(documents.select("doc_id", "text")).mapInPandas(scan, schema)
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _spans(text: str, found: dict[int, set[tuple[int, int]]], words: int) -> Iterator[tuple[int, int, int]]:
    """Maximal passages as (item, first character, last character) of the original."""
    at = _with_places(text)
    for item, passages in found.items():
        starts = sorted({k for a, n in passages for k in range(a, a + n - words + 1)})
        first = starts[0]
        for a, b in zip(starts, [*starts[1:], None]):
            if b != a + 1:
                yield item, at[first][1], at[a + words - 1][2] - 1
                first = b
