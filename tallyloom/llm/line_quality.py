"""Per-document text quality: a hidden Markov model labels each line prose, list, table or junk.

The states are the four kinds. The emission of a line is a softmax over binned line statistics divided by the share of
the kind (a scaled likelihood), the transitions are counted over neighbouring lines; both are fitted to the documents of
a labelled sample, then fitted again to the lines' own posteriors, so that the list inside a prose document is learned as
list. A document's shares are the forward-backward posteriors of its lines, weighted by their words.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import spread

KINDS = ("prose", "list", "table", "junk")
#: Frequent function words of some languages.
COMMON = frozenset(
    "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can "
    "an your which their said if do will each about how up out them then she many some so these would other into has more her two him see "
    "could no than been its who now my over did only you our us because der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec mais nous vous ont cette ces aux été "
    "el los las del y con una su al lo como más pero sus ya o porque muy sin sobre también me hasta hay donde quien desde todo nos durante "
    "di che il per non sono della da dei una gli alla nel anche ma le si ha o e do não os no uma com na dos mais as foi ao ele das tem seu sua ou "
    "van het een en op te dat niet zijn voor met aan er maar om ook als bij nog i w na z się że jest nie do o jak och att det som på är av för inte".split()
)
_BULLET = regex.compile(r"^\s*(?:[-*•–—·▪◦‣o+]|\(?\d{1,3}[.):]|\(?[a-z][.)]|☐|☑|✓|✔|>)\s+")
_SENTENCE_END = tuple(".!?…。！？।؟\"”»'’)")
_STOPS = regex.compile(r"[.!?。！？।؟](?:\s|$)|[。！？]")
_BROKEN = regex.compile(r"[ÃÂâ�\u0080-\u009f]")
_GAPS = regex.compile(r"\S {2,}\S|\t")
_TAG = regex.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_VOWEL = regex.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüåæøãõ]", regex.I)
_ASCII = regex.compile(r"[\x00-\x7f]+")
_ASCII_LETTERS, _DIGIT, _EDGES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", re.compile(r"\d"), ".,;:!?()[]\"'«»„“”…*"
_SEGMENT = regex.compile(r"[,;|\t=#>•·:.!?，、。]+")
_LATIN = regex.compile(r"\p{Latin}")
_NO_SPACE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
NAMES = (
    "words", "mean_word_length", "letter_share", "digit_share", "symbol_share", "ends_sentence", "bullet", "comma_rate", "other_delimiter_rate", "capital_share",
    "common_share", "distinct_share", "vowel_share", "non_latin_share", "broken_share", "tag_rate", "longest_word", "gap_rate", "stop_rate", "number_word_share", "top_word_share", "lower_share", "segment_words", "lower_common_share",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_LETTERS, _DIGITS, _BLANKS, _VOWELS, _COMMAS, _BARS = map(_table, (_ASCII_LETTERS, b"0123456789", b" \t\x0b\x0c", b"aeiouyAEIOUY", b",", b"|;\t="))
_STOP_BYTES, _SPACE_BYTES, _CUT_BYTES = map(_table, (b".!?", b" \t\n\r\x0b\x0c", b"\n,;|\t=#>:.!?"))
_ANY_SPACE = _table(b" \t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_ENDS = frozenset(_SENTENCE_END)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _per_line(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive values."""
    total = np.r_[0, np.cumsum(values)]
    return total[ends] - total[starts]


def line_statistics(lines: list[str]) -> np.ndarray:
    """The statistics of each line, in the order of NAMES.

    Words are looked at once for each distinct one of all lines, ASCII characters in one array for all lines; only the
    other characters, and marks at certain places, are looked for line by line.
    """
    if not lines:
        return np.zeros((0, len(NAMES)))
    words = [x.split() for x in lines]
    n = np.fromiter(map(len, words), np.int64, len(lines))
    ends = np.cumsum(n)
    starts, number, m = ends - n, _Numbers(), np.maximum(n, 1)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, ends[-1])
    own = list(number)
    cut = [w if w.isalnum() else w.strip(_EDGES) for w in own]
    bare, bare_number = [w.lower() for w in cut], _Numbers()
    of_words = lambda values, kind=np.int64: np.fromiter(values, kind, len(own))[ids]
    share = lambda values: _per_line(of_words(values), starts, ends) / m
    sizes = of_words(map(len, own))
    longest, top, distinct = np.zeros(len(lines), np.int64), np.full(len(lines), 0.1), np.ones(len(lines))
    filled = n > 0
    if filled.any():
        longest[filled] = np.maximum.reduceat(sizes, starts[filled])
    long = n >= 8
    if long.any():
        line = np.repeat(np.arange(len(lines)), n)
        keep = long[line]
        key, count = np.unique(line[keep] << 32 | of_words(map(bare_number.__getitem__, bare))[keep], return_counts=True)
        at = np.flatnonzero(np.r_[True, key[1:] >> 32 != key[:-1] >> 32])
        where = key[at] >> 32
        top[where] = np.maximum.reduceat(count, at) / n[where]
        distinct[where] = np.diff(np.r_[at, len(key)]) / n[where]
    upper, alpha = share([w[:1].isupper() for w in cut]), share([w[:1].isalpha() for w in cut])

    raw = [x.encode("ascii", "ignore") for x in lines]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    last = np.cumsum(length + 1)
    first = last - length - 1
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    count = lambda table: np.add.reduceat(table[flat], first)  # the line end is in no table
    letters, digits, spaces, vowels = map(count, (_LETTERS, _DIGITS, _BLANKS, _VOWELS))
    stops = np.add.reduceat(_STOP_BYTES[flat] & np.r_[_SPACE_BYTES[flat[1:]], 0], first).astype(float)
    solid = flat[_ANY_SPACE[flat] - _CUT_BYTES[flat] < 1]  # tabs cut too
    begins = (1 - _CUT_BYTES[solid]) & np.r_[1, _CUT_BYTES[solid[:-1]]]
    breaks = np.flatnonzero(solid == 10)
    segments = _per_line(begins, np.r_[0, breaks[:-1] + 1], breaks)

    chars, running, latin = np.fromiter(map(len, lines), np.int64, len(lines)), n.astype(float), letters.copy()
    broken, other = np.zeros(len(lines)), np.zeros((3, len(lines)))
    for k in np.flatnonzero(length != chars):  # the characters that aren't ASCII one by one
        x = lines[k]
        rest = _ASCII.sub("", x)
        letters[k], digits[k], spaces[k] = letters[k] + sum(map(str.isalpha, rest)), digits[k] + sum(map(str.isnumeric, rest)), spaces[k] + sum(map(str.isspace, rest))
        latin[k], vowels[k], broken[k] = latin[k] + len(_LATIN.findall(rest)), vowels[k] + len(_VOWEL.findall(rest)), len(_BROKEN.findall(rest))
        running[k] = max(n[k], len(_NO_SPACE.findall(rest)) / 2)  # scripts without spaces
        stops[k] = len(_STOPS.findall(x))
        segments[k] = sum(not y.isspace() and y != "" for y in _SEGMENT.split(x))
    bullet, tags, gaps = other
    for k, x in enumerate(lines):
        bullet[k] = _BULLET.match(x) is not None
        if "<" in x:
            tags[k] = len(_TAG.findall(x))
        if "  " in x or "\t" in x:
            gaps[k] = len(_GAPS.findall(x))
    chars = np.maximum(chars, 1)
    shown = np.fromiter(map(len, lines), np.int64, len(lines))
    common = COMMON.__contains__
    return np.column_stack([
        np.log1p(running), _per_line(sizes, starts, ends) / m, letters / chars, digits / chars, (shown - letters - digits - spaces) / chars,
        [x.rstrip()[-1:] in _ENDS for x in lines], bullet, count(_COMMAS) / m, count(_BARS) / m,
        upper, share(map(common, bare)), distinct,
        np.where(latin >= 0.5 * letters, vowels / np.maximum(1, latin), 0.4), 1 - latin / np.maximum(1, letters), broken / chars, tags / m,
        np.log1p(longest), gaps / m, stops / np.maximum(1, running),
        share([not w.isalpha() and _DIGIT.search(w) is not None for w in own]),
        top, alpha - upper,
        np.log1p(running / np.maximum(1, segments)), share(map(common, own)),
    ])


def lines_of(text: str | None) -> list[str]:
    """The lines that are not blank."""
    return [x for x in (text or "").splitlines() if x.strip()]


class LineModel:
    """The hidden Markov model; a small pickle."""

    def __init__(self, bins: int = 10, ridge: float = 1e-3, steps: int = 300, rounds: int = 3):
        self.bins, self.ridge, self.steps, self.rounds = bins, ridge, steps, rounds

    def _encode(self, x: np.ndarray) -> np.ndarray:
        """One-hot bins of each statistic and a constant."""
        cells = [np.eye(len(e) + 1, dtype=np.float32)[np.searchsorted(e, x[:, j], side="left")] for j, e in enumerate(self.edges)]
        return np.hstack([*cells, np.ones((len(x), 1), np.float32)])

    def _softmax(self, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Weighted softmax regression by Nesterov's gradient steps."""
        wn, y = (w / w.sum())[:, None].astype(np.float32), y.astype(np.float32)  # all in single precision, as z is
        at = self.weights if hasattr(self, "weights") else np.zeros((z.shape[1], len(KINDS)), np.float32)
        ahead = at.copy()
        for k in range(self.steps):
            s = z @ ahead
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = ahead - np.float32(2) * (z.T @ (wn * (p - y)) + np.float32(self.ridge) * ahead)
            ahead, at = new + np.float32(k / (k + 3)) * (new - at), new
        self.weights = at

    def fit(self, docs: list[tuple[np.ndarray, int]]) -> LineModel:
        """docs: statistics of a document's lines, and its kind."""
        docs = [(x, k) for x, k in docs if len(x)]
        x = np.vstack([d for d, _ in docs])
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        z = self._encode(x)
        y = np.vstack([np.tile(np.eye(len(KINDS))[k], (len(d), 1)) for d, k in docs])
        w = np.concatenate([np.full(len(d), len(d) ** -0.5) for d, _ in docs])
        for r in range(self.rounds):
            self.prior = np.maximum((w[:, None] * y).sum(0) / w.sum(), 1e-3)
            self.prior /= self.prior.sum()
            self._softmax(z, y, w)
            moves, first = np.full((len(KINDS), len(KINDS)), 0.5), np.full(len(KINDS), 0.5)
            at = 0
            for d, _ in docs:
                own = y[at : at + len(d)]
                first += own[0]
                moves += own[:-1].T @ own[1:]
                at += len(d)
            self.moves, self.first = moves / moves.sum(1, keepdims=True), first / first.sum()
            if r + 1 < self.rounds:  # the lines' own posteriors, held near the document's kind
                new, at = [], 0
                every = self.posteriors(x, np.array([len(d) for d, _ in docs]))
                for d, k in docs:
                    p = every[at : at + len(d)]
                    p = p * np.where(np.arange(len(KINDS)) == k, 1.0, 0.5 if len(d) > 1 else 0.02)
                    new.append(p / p.sum(1, keepdims=True))
                    at += len(d)
                y = np.vstack(new)
        return self

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scaled likelihood of each line under each kind, from the weights of its bins."""
        s, at = np.tile(self.weights[-1].astype(np.float64), (len(x), 1)), 0
        for j, e in enumerate(self.edges):
            s += self.weights[at + np.searchsorted(e, x[:, j], side="left")]
            at += len(e) + 1
        p = np.exp(s - s.max(1, keepdims=True))
        return np.maximum(p / p.sum(1, keepdims=True), 1e-6) / self.prior

    def posteriors(self, x: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Share of each kind for each line, by the forward-backward recursion over each document.

        ``x`` has the lines of all documents, ``sizes`` says how many each has (one document if not given). The documents
        step together: step t is one product for all that have more than t lines.
        """
        emit = self.emissions(x)
        sizes = np.array([len(x)]) if sizes is None else np.asarray(sizes)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        longest = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[longest], sizes[longest]
        forward, backward = np.empty_like(emit), np.ones_like(emit)
        last = None
        for t in range(sizes[0] if len(sizes) else 0):
            n = np.searchsorted(-sizes, -t, side="left")  # documents with more than t lines
            f = (self.first if t == 0 else last[:n] @ self.moves) * emit[starts[:n] + t]
            last = f / f.sum(1, keepdims=True)
            forward[starts[:n] + t] = last
        for t in range((sizes[0] if len(sizes) else 0) - 2, -1, -1):
            n = np.searchsorted(-sizes, -(t + 1), side="left")
            at = starts[:n] + t
            b = (emit[at + 1] * backward[at + 1]) @ self.moves.T
            backward[at] = b / b.sum(1, keepdims=True)
        g = forward * backward
        return g / g.sum(1, keepdims=True)

    def shares(self, text: str | None) -> np.ndarray | None:
        """Share of each kind in a text, lines weighted by their words; None without a line that isn't blank."""
        lines = lines_of(text)
        if not lines:
            return None
        x = line_statistics(lines)
        w = np.expm1(x[:, 0])
        w = np.maximum(w, 1.0)
        return (w[:, None] * self.posteriors(x)).sum(0) / w.sum()


def fit_model(documents: DataFrame, labels: DataFrame, bound: int = 2_000, lines: int = 5_000) -> LineModel:
    """Fits the model to labelled documents, at most ``bound`` of them (a sample by hash if there are more), of a longer one
    to the ``lines`` lines in its middle.

    The statistics are made by the tasks; the driver gets numbers of that many documents and lines only. Labels of other kinds and
    of documents that are missing or have no text don't count; without any the model can't be fitted.
    """
    own = labels.where(F.col("kind").isin(*KINDS)).groupBy("doc_id").agg(F.min("kind").alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every = [lines_of(x) for x in b["text"]]
            middle = [x[max(0, (len(x) - lines) // 2) :][:lines] for x in every]
            rows = [(k, line_statistics(x).astype(np.float32).ravel().tolist()) for k, x in zip(b["kind"], middle)]
            yield pd.DataFrame(rows, columns=["kind", "x"])

    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(own, "doc_id").mapInPandas(run, "kind string, x array<float>").collect()
    docs = [(np.array(r["x"], np.float64).reshape(-1, len(NAMES)), KINDS.index(r["kind"])) for r in rows]
    # the order in which rows come back must not change the model
    docs.sort(key=lambda d: (d[1], d[0].shape[0], d[0].sum()))
    return LineModel().fit(docs)


def document_quality(documents: DataFrame, model: LineModel) -> DataFrame:
    """Per document: words, mean_word_length, symbol_share, punctuated_lines, common_words, and the share of each kind.

    Null and blank texts have 0 words and null elsewhere. Each text is read whole; no shuffle but that of
    ``spread``.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    blob = pickle.dumps(model)
    columns = ["doc_id", "words", "mean_word_length", "symbol_share", "punctuated_lines", "common_words", *KINDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(blob)
        for b in batches:
            every = [lines_of(t) for t in b["text"]]
            sizes = np.array([len(x) for x in every], int)
            x = line_statistics([t for lines in every for t in lines])
            p = m.posteriors(x, sizes[sizes > 0])
            chars = np.array([len(t) for lines in every for t in lines], float)
            counts = np.array([len(t.split()) for lines in every for t in lines], float)
            w = np.maximum(np.expm1(x[:, 0]), 1.0)
            rows, at = [], 0
            for doc, n in zip(b["doc_id"], sizes):
                if not n:
                    rows.append([doc, 0, *[None] * 8])
                    continue
                own = slice(at, at + n)
                at += n
                c, k = counts[own], max(1.0, counts[own].sum())
                rows.append([doc, int(c.sum()), float(x[own, 1] @ c / k), float(x[own, 4] @ chars[own] / chars[own].sum()), float(x[own, 5].mean()), float(x[own, 10] @ c / k), *map(float, w[own] @ p[own] / w[own].sum())])
            yield pd.DataFrame(rows, columns=columns)

    doubles = ", ".join(f"{c} double" for c in columns[2:])
    return spread(documents.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, words long, {doubles}")
