"""Encoding of a corpus with a byte-level BPE vocabulary, in constant memory per text.

A streaming transducer. A text is read in windows; the pre-tokenizer's pieces that no later character can change leave
the window, and the bytes of each piece run through the merges. A token leaves as soon as its end lies the merge list's
sufficient lookahead behind the last byte read: no byte after that can change it. Every piece of every text goes this way.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..plans.shared import spread

DEFAULT_FOLDER = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are read at a time, and bytes of a piece that are merged at a time.
WINDOW, STEP = 1 << 16, 1 << 12
#: Pieces whose ids a task remembers, and the characters of the longest of them.
REMEMBERED, SHORT = 1 << 17, 64
#: Ids that a task holds before they leave it.
TOKENS = 1 << 20
_SHIFT, _NONE = 20, 1 << 40


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_list(table: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merges of a vocabulary in their order: each token of two bytes and more is the two parts that the merges before
    it leave of its bytes."""
    merges: dict[tuple[bytes, bytes], int] = {}
    for token, rank in sorted(table.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        splits = [(token[:i], token[i:]) for i in range(1, len(token)) if max(table.get(token[:i], rank), table.get(token[i:], rank)) < rank]
        if len(splits) == 1:
            parts = list(splits[0])
        while len(parts) > 2:
            best, at = min((merges.get(x, _NONE), i) for i, x in enumerate(zip(parts, parts[1:])))
            if best == _NONE:
                raise ValueError(f"token {rank} isn't made by the merges before it")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        merges[parts[0], parts[1]] = rank
    return list(merges)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """How many bytes before the end of what is read the tokens can still change, whatever follows.

    Bytes that follow change a boundary only by a merge (u, v) across it; the tokens agree from then on only up to the
    start of u. What stands there in either case is u or a token that was built from u on its left. So a later merge that
    moves the boundary on has such a token as its right part: the largest sum of len(u) along such chains, in the order
    of the merges, is the lookahead.
    """
    first = {u + v: u for u, v in merges}
    moved: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        before, x = 0, v
        while x is not None:
            before, x = max(before, moved.get(x, 0)), first.get(x)
        own = len(u) + before
        moved[u] = max(moved.get(u, 0), own)
        most = max(most, own)
    return most


class Transducer:
    """Bytes of one piece in (``feed``), final ids out; ``end`` gives the rest and is ready for the next piece.

    It holds at most the lookahead, STEP bytes and the longest token.
    """

    def __init__(self, table: dict[bytes, int]):
        merges = merge_list(table)
        self.lookahead = sufficient_lookahead(merges)
        self.single = [table[bytes([i])] for i in range(256)]
        self.pairs = {table[u] << _SHIFT | table[v]: table[u + v] for u, v in merges}
        self.size = {i: len(t) for t, i in table.items()}
        self.held = bytearray()
        self.known: dict[str, list[int]] = {}

    def _merged(self, raw: bytes | bytearray) -> list[int]:
        """The ids of the bytes: the least merge first, from the left."""
        ids, get = [self.single[b] for b in raw], self.pairs.get
        n = len(ids)
        rank = [get(a << _SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
        queue = [r << _SHIFT | i for i, r in enumerate(rank) if r < _NONE]
        if not queue:
            return ids
        heapify(queue)
        rank.append(_NONE)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            x = heappop(queue)
            r, i = x >> _SHIFT, x & ((1 << _SHIFT) - 1)
            if rank[i] != r:
                continue  # merged away, or changed by another merge
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank[j], rank[i] = r, -1, -1, _NONE
            if k < n:
                before[k] = i
                if (new := get(r << _SHIFT | ids[k], _NONE)) < _NONE:
                    rank[i] = new
                    heappush(queue, new << _SHIFT | i)
            if (p := before[i]) >= 0:
                rank[p] = new = get(ids[p] << _SHIFT | r, _NONE)
                if new < _NONE:
                    heappush(queue, new << _SHIFT | p)
        return [i for i in ids if i >= 0]

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        for a in range(0, len(more), STEP):
            self.held += more[a : a + STEP]
            if len(self.held) < self.lookahead + STEP:
                continue
            final, stable = len(self.held) - self.lookahead, 0
            for i in self._merged(self.held):
                if stable + self.size[i] > final:
                    break
                stable += self.size[i]
                out.append(i)
            del self.held[:stable]
        return out

    def end(self) -> list[int]:
        out = self._merged(self.held) if self.held else []
        self.held.clear()
        return out

    def pieces(self, pieces: list[str]) -> list[int]:
        """The ids of whole pieces; those of short ones are remembered, as the same words come again and again."""
        out: list[int] = []
        for x in pieces:
            ids = self.known.get(x)
            if ids is None:
                ids = self.feed(x.encode()) + self.end()
                if len(x) <= SHORT:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[x] = ids
            out += ids
        return out


@cache
def transducer(path: str) -> Transducer:
    return Transducer(ranks(path))


_PIECE = regex.compile(PATTERN)
_SPACE = regex.compile(r"\s*")
_CLASSES = (regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), _SPACE, regex.compile(r"[^\s\p{L}\p{N}]*"))


def encode(text: str | None, path: str, window: int = WINDOW) -> list[int]:
    """The ids of a text without special tokens; [] for null and empty texts."""
    return [i for part in encode_stream(((text or "")[a : a + window] for a in range(0, len(text or ""), window)), path) for i in part]


def encode_stream(chunks: Iterable[str], path: str, long: int = STEP) -> Iterator[list[int]]:
    """Ids of a text that comes in chunks, each as soon as it is final.

    All but the last two pieces held are stable: a later character can lengthen the last piece, or make one of the last
    two. A last piece that outgrows ``long`` characters isn't held: it runs on through the transducer while characters of
    its class come. White space but its last character, which may belong to the next piece, does so too.
    """
    t, held, going, spare = transducer(path), "", None, ""
    for chunk in chunks:
        if going is not None:
            run = going.match(chunk).end()
            own, spare = spare + chunk[:run], ""
            if going is _SPACE:
                own, spare = own[:-1], own[-1:]
            yield t.feed(own.encode())
            if run == len(chunk):
                continue
            yield t.end()
            chunk, spare, going = spare + chunk[run:], "", None
        pieces = _PIECE.findall(held + chunk)
        if pieces and len(pieces[-1]) > long:
            yield t.pieces(pieces[:-1])
            own, held = pieces[-1], ""
            going = next(c for c in _CLASSES if c.fullmatch(own[-1]))
            if going is _SPACE:
                own, spare = own[:-1], own[-1]
            yield t.feed(own.encode())
        else:
            yield t.pieces(pieces[:-2])
            held = "".join(pieces[-2:])
    if going is not None:
        yield t.feed(spare.encode()) + t.end()
    yield t.pieces(_PIECE.findall(held))


def decode_stream(ids: Iterable[int], path: str) -> Iterator[str]:
    """The text of ids, as soon as its bytes are whole characters."""
    tokens = _tokens(path)
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if s := machine.decode(tokens[i]):
            yield s
    if s := machine.decode(b"", True):
        yield s


@cache
def _tokens(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks(path).items()}


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, decoded: bool = False) -> DataFrame:
    """key and ids array<int> of every row, an empty list for empty and null texts; no shuffle but that of ``spread``.

    With ``decoded`` also the column decoded, the text that the ids stand for. Ids leave a task TOKENS or so at a
    time. Repeated rows and keys, also null ones, come out as often as they come in; other columns are left out.
    """
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    def batch(keys: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
        flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
        columns = [keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        if decoded:
            columns.append(pa.array(["".join(decode_stream(x, path)) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(key), b.column(text)
            start, held, size = 0, [], 0
            for k in range(b.num_rows):
                held.append(encode(texts[k].as_py(), path))
                size += len(held[-1])
                if size >= TOKENS or k + 1 == b.num_rows:
                    yield batch(keys.slice(start, len(held)), held)
                    start, held, size = k + 1, [], 0

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded string" * decoded)
