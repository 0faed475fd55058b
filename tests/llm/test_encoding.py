import json
import os
import random
from functools import cache

import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import encoding as E

PATH = os.path.join(E.DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@cache
def library():
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=E.ranks(PATH), special_tokens={})


def reference(x):
    return library().encode_ordinary(x)


TEXTS = [
    "", " ", "a", "It's  \n\n  we'll see\n\n\nx", "größe 東京 مرحبا 👍🏽 é", "<|endoftext|>", "​﻿", "x\r\n\t y  ", "''''ll 'd've", "12345678901234567890", "\n" * 50 + "a", "a" + " " * 90,
]


def windows(x, window, long=E.STEP):
    return [i for part in E.encode_stream((x[a : a + window] for a in range(0, len(x), window)), PATH, long) for i in part]


@pytest.mark.parametrize("window,long", [(1, 1), (3, 2), (7, 16), (50, 20), (1 << 16, 1 << 12)])
def test_streaming_gives_the_whole_texts_ids(window, long):
    for x in TEXTS:
        assert windows(x, window, long) == reference(x), repr(x)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab e'sltdrv \n\t1.-é東​　\x1c"), max_size=60), st.integers(1, 9), st.integers(1, 9))
def test_windows_never_matter(x, window, long):
    assert windows(x, window, long) == reference(x)


def test_merges_and_lookahead_come_from_the_vocabulary(monkeypatch):
    merges = E.merge_list(E.ranks(PATH))
    with open(PATH.replace(".tiktoken", ".json")) as f:
        given_merges = json.load(f)["model"]["merges"]
    assert len(merges) == len(given_merges) == 50_000
    letters = lambda x: x.decode("ascii").replace(" ", "Ġ")
    assert [[letters(u), letters(v)] for u, v in merges[:50]] == given_merges[:50]
    assert E.sufficient_lookahead([]) == 0
    assert E.sufficient_lookahead([(b"a", b"b"), (b"c", b"a")]) == 2  # b takes the a away from c
    assert E.sufficient_lookahead([(b"c", b"a"), (b"a", b"b")]) == 1
    assert E.sufficient_lookahead(merges) == E.transducer(PATH).lookahead < 1000


def test_tokens_that_left_never_change(monkeypatch):
    """Small steps, so that tokens leave as early as the lookahead lets them."""
    monkeypatch.setattr(E, "STEP", 1)
    r, t = random.Random(4), E.Transducer(E.ranks(PATH))
    tokens = [x for x in E.ranks(PATH) if x.isalpha()]
    for x in ["a" * 900, "".join(r.choices("aehinorst", k=900)), *["".join(x.decode() for x in r.choices(tokens, k=150)) for _ in range(5)]]:
        assert t.feed(x.encode()) + t.end() == reference(x)


def test_long_pieces_are_merged_incrementally():
    r = random.Random(1)
    for x in ("a" * 6000, "ab" * 3000, "=-" * 3000, "é" * 3000, "0123456789" * 600, "".join(r.choices("abcdefgh", k=6000)), " the" + "the" * 2000, "x" + " " * 6000 + "y", "\n" * 6000):
        assert E.encode(x, PATH, 700) == reference(x)


@pytest.mark.parametrize("letter", [" ", "a"])
def test_memory_stays_bounded_on_one_long_run(letter):
    t, n, most, size = E.transducer(PATH), 1 << 20, 0, 0
    for ids in E.encode_stream((letter * E.WINDOW for _ in range(n // E.WINDOW)), PATH):
        size += len(ids)
        most = max(most, len(t.held))
    assert most <= t.lookahead + 2 * E.STEP
    part = 1 << 12
    assert abs(size - len(reference(letter * part)) * (n // part)) <= n // part


def test_ids_of_a_whole_table_equal_the_librarys():
    table = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("no test data")
    for x in pq.read_table(table, columns=["text"])["text"].to_pylist():
        assert E.encode(x, PATH) == reference(x or "")


def test_decoding_is_incremental():
    for x in TEXTS:
        assert "".join(E.decode_stream(reference(x), PATH)) == x


def test_corpus(spark):
    d = spark.createDataFrame([(1, None, "clash"), (2, "", None), (3, "hello world", None), (3, "hello world", None)], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in E.encode_corpus(d).collect())
    assert got == [(1, []), (2, []), (3, reference("hello world")), (3, reference("hello world"))]
    assert E.encode_corpus(d.limit(0)).count() == 0
