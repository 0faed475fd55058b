import random
from collections import Counter
from itertools import combinations
from math import log

import pytest

from tallyloom.llm import cooccurrence as C
from tallyloom.operators import baskets as B

from ..conftest import rows

LINES = "basket long, item long, grp long, n string"


def brute(lines, least, lift):
    baskets, groups = {}, {}
    for b, i, g, _ in lines:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
            groups.setdefault(i, set()).update([g] if g is not None else [])
    n, total = Counter(i for s in baskets.values() for i in s), len(baskets)
    pairs = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b, k) for (a, b), k in pairs.items() if k >= least and k * total >= lift * n[a] * n[b] and not groups[a] & groups[b]}


def sample(seed=3):
    r = random.Random(seed)
    lines = []
    for b in range(900):
        own = r.sample(range(60), r.randint(0, 4)) + ([100 + 2 * (b % 7), 101 + 2 * (b % 7)] if r.random() < 0.5 else []) + ([999] if r.random() < 0.4 else [])
        lines += [(b, 7_000_000_000 + i, i // 2 if i < 100 else None, "x") for i in own]
    lines += [(5000 + k % 12, 7_000_000_000 + 300 + k // 12, 300 + k // 12, "x") for k in range(12 * 25)]  # 12 equal baskets
    lines += [(None, 1, 1, "x"), (3, None, 1, "x"), *lines[:200]]
    return lines


def test_against_brute_force(spark, monkeypatch):
    lines = sample()
    d = spark.createDataFrame(lines, LINES)
    want = brute(lines, 10, 5)
    assert want
    assert set(rows(C.item_pairs(d), "item_a", "item_b", "n")) == want
    monkeypatch.setattr(B, "CHUNK", 5)  # baskets of 25 items are spread over chunks
    assert set(rows(C.item_pairs(d), "item_a", "item_b", "n")) == want


def test_empty_and_odds(spark):
    d = spark.createDataFrame([], LINES)
    assert C.item_pairs(d).count() == 0
    few = spark.createDataFrame([(b, i, i, "x") for b in range(10) for i in (1, 2)] + [(b, b, None, "x") for b in range(100, 200)], LINES)
    got = C.item_pairs(few).collect()
    assert [(r["item_a"], r["item_b"], r["n"], r["baskets"], r["lift"]) for r in got] == [(1, 2, 10, 110, 11.0)]
    assert abs(got[0]["log_odds"] - log(10.5 * 100.5 / 0.25)) < 1e-9


def test_pairs_are_counted_once_each(spark):
    d = spark.createDataFrame([(b, c) for b in range(4) for c in range(b + 1)], "basket long, code long")
    got = {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): r["n"] for r in C.count_pairs(d, None).collect()}
    assert got == Counter(p for b in range(4) for p in combinations(range(b + 1), 2))


def test_a_large_baskets_blocks_lie_on_several_tasks(spark):
    n = 6000
    d = spark.range(n).selectExpr("0L AS basket", "id AS code").unionByName(spark.range(4000).selectExpr("id + 1 AS basket", "id AS code"))
    total, large = B.large_baskets(d, "basket")
    assert total == 4001 and large.count() == 1
    blocks = B.basket_blocks(d, "basket", "code", large)
    sizes = blocks.selectExpr("size(left) AS l", "coalesce(size(right), 0) AS r", "spark_partition_id() AS task").collect()
    assert len(sizes) == 12 * 13 // 2 and max(max(x["l"], x["r"]) for x in sizes) < 2 * B.CHUNK
    assert len({x["task"] for x in sizes}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(x["l"] * x["r"] or x["l"] * (x["l"] - 1) // 2 for x in sizes) == n * (n - 1) // 2


def test_runs_leave_when_they_are_full(monkeypatch):
    monkeypatch.setattr(C, "RUN", 100)
    import numpy as np

    sizes = [len(x) for x in C._within(np.arange(4000), np.arange(0, 4001, 10))]
    assert max(sizes) <= 100 and sum(sizes) == 400 * 45


def test_codes_beyond_31_bits_fail(spark):
    d = spark.createDataFrame([(1, 1), (1, 1 << 31)], "basket long, code long")
    with pytest.raises(Exception, match="31 bits"):
        C.count_pairs(d, None).collect()
