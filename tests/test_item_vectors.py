import heapq
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from tallyloom.operators import item_vectors as V
from tallyloom.plans.shared import _folder


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        w = heapq.heappop(heap) + heapq.heappop(heap)
        cost += w
        heapq.heappush(heap, w)
    return cost


def test_code_lengths_are_huffmans():
    random.seed(1)
    for counts in ([7], [3, 3], [1] * 13, [50, 20, 20, 5, 5, 5, 1], [random.randint(1, 9) for _ in range(200)], [int(1000 / (i + 1)) + 1 for i in range(300)]):
        n, k = (np.array(c) for c in zip(*sorted(Counter(counts).items(), reverse=True)))
        leaves = V._lengths(n, k)
        lengths = [d for d, m in enumerate(leaves) for _ in range(m)]
        assert len(lengths) == len(counts) and sum(c * d for c, d in zip(sorted(counts, reverse=True), lengths)) == huffman_cost(counts)
        cuts = V._cuts(n, k, 4)
        assert cuts[0] == 0 and cuts[-1] == len(counts) and (np.diff(cuts) > 0).all()
        tree = V._Tree(leaves, cuts)
        codes = [format(int(tree.prefix(np.array([r]), np.array([d]))[0]), f"0{d}b") if d else "" for r, d in enumerate(lengths)]
        assert len(counts) == 1 or all(not y.startswith(x) for x in codes for y in codes if x is not y)
        nodes = {c[:d] for c in codes for d in range(len(c))}
        assert len(nodes) == len(counts) - 1
        for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert tree.nodes[q] == len({c[:d] for c in codes[a:b] for d in range(len(c))})


def test_lines_and_pairs_of_orders_cut_into_rows(monkeypatch):
    random.seed(2)
    orders = [[random.randint(0, 40) for _ in range(random.choice([1, 1, 2, 3, 5, 200]))] for _ in range(60)]
    lines = [(o, x) for o, items in enumerate(orders) for x in items]
    batches = [pa.record_batch({"order_id": pa.array([o for o, _ in lines[i : i + 7]]), "item": pa.array([x for _, x in lines[i : i + 7]])}) for i in range(0, len(lines), 7)]
    for at_once in (1 << 20, 320):  # with the second an order of 200 lines goes into several rows
        monkeypatch.setattr(V, "AT_ONCE", at_once)
        monkeypatch.setattr(V, "ROW", 16)
        kept, found = [], Counter()
        for b in V._sequences(3)(iter(batches)):
            for r in b.to_pylist():
                kept += r["items"][r["seen"] :]
                at = 0
                for m in r["sizes"]:
                    found.update((x, y, d) for d in (1, 2, 3) for i, (x, y) in enumerate(zip(r["items"][at : at + m], r["items"][at + d : at + m])) if at + i + d >= r["seen"])
                    at += m
                assert at == len(r["items"])
        assert kept == [x for items in orders if len(items) > 1 for x in items]
        assert found == Counter((x, y, d) for o in orders for d in (1, 2, 3) for x, y in zip(o, o[d:]))


def test_a_run_of_pairs_comes_back():
    x, y, d = np.array([0, 3, 3, 70000]), np.array([9, 1 << 29, 0, 5]), np.array([1, 2, 3, 1])
    assert [c.tolist() for c in V._unpacked(pa.scalar(V._packed(x, y, d), pa.binary()))] == [x.tolist(), y.tolist(), d.tolist()]


def test_tiles_take_word2vecs_step():
    counts = [9, 7, 7, 4, 4, 4, 2, 2, 1, 1, 1]
    n, k = (np.array(c) for c in zip(*sorted(Counter(counts).items(), reverse=True)))
    leaves = V._lengths(n, k)
    lengths = [d for d, m in enumerate(leaves) for _ in range(m)]
    tree = V._Tree(leaves, np.array([0, len(counts)]))
    rng = np.random.default_rng(3)
    for word in range(len(counts)):  # a step by itself
        x, y = rng.normal(0, 0.3, (5, 8)).astype(np.float32), rng.normal(0, 0.3, (tree.nodes[0], 8)).astype(np.float32)
        want_x, want_y = x.copy(), y.copy()
        code = int(tree.prefix(np.array([word]), np.array([lengths[word]]))[0])
        for d in range(lengths[word]):
            row = tree.base[0][d] + (code >> (lengths[word] - d)) - tree.low[0][d]
            g = 0.025 * (1 - (code >> (lengths[word] - d - 1) & 1) - 1 / (1 + np.exp(-float(x[2] @ y[row]))))
            want_x[2] += g * y[row]
            want_y[row] += g * x[2]
        V._train(x, y, np.array([2]), np.array([word]), tree.before, tree.first, tree.low[0], tree.high[0], tree.base[0], 0.025, rng)
        assert np.allclose(x, want_x, atol=1e-6) and np.allclose(y, want_y, atol=1e-6)
    x, y = rng.normal(0, 0.3, (5, 8)).astype(np.float32), rng.normal(0, 0.3, (tree.nodes[0], 8)).astype(np.float32)
    context, word = np.repeat(np.arange(5), len(counts)), np.tile(np.arange(len(counts)), 5)  # each with each in one tile or several
    want = np.zeros_like(x)
    for c, w in zip(context, word):
        code = int(tree.prefix(np.array([w]), np.array([lengths[w]]))[0])
        for d in range(lengths[w]):
            row = tree.base[0][d] + (code >> (lengths[w] - d)) - tree.low[0][d]
            want[c] += 1e-4 * (1 - (code >> (lengths[w] - d - 1) & 1) - 1 / (1 + np.exp(-float(x[c] @ y[row])))) * y[row]
    before = x.copy()
    V._train(x, y, context, word, tree.before, tree.first, tree.low[0], tree.high[0], tree.base[0], 1e-4, rng)
    assert np.abs(x - before - want).max() < 0.02 * np.abs(want).max()


def test_vectors_of_items_bought_together(spark, monkeypatch):
    random.seed(4)
    monkeypatch.setattr(V, "ROWS", 16)  # five parts at least, none with more than 16 vectors
    lines = [(o, i, f"{(g := o % 8)}-{random.randint(0, 9)}") for o in range(3000) for i in range(random.randint(1, 6))]
    lines += [(9000, 0, "alone"), (None, 0, "lost"), (None, 1, "lost"), (9001, 0, "pair"), (9001, None, "pair"), (9001, 2, None)]
    d = spark.createDataFrame(lines, "order_id long, line int, item string")
    got = V.item_vectors(d, "item", "line", size=16, epochs=5, rate=0.1)
    assert got.dtypes == [("item", "string"), ("vector", "array<double>")]
    v = {r["item"]: np.array(r["vector"]) for r in got.collect()}
    sizes = Counter(o for o, _, x in lines if o is not None and x is not None)
    assert v.keys() == {x for o, _, x in lines if x is not None and sizes[o] > 1} and "pair" in v and "alone" not in v
    assert all(len(x) == 16 and np.isfinite(x).all() for x in v.values())
    names = sorted(v.keys() - {"pair"})
    m = np.array([v[x] / np.linalg.norm(v[x]) for x in names])
    near, same = m @ m.T, np.array([[x[0] == y[0] for y in names] for x in names])
    assert near[same & ~np.eye(len(names), dtype=bool)].mean() > near[~same].mean() + 0.3
    files = [p for p in Path(_folder(spark).removeprefix("file://")).glob("item-vectors-*/*") if "." not in p.name]
    assert len(files) >= 5 and all(p.name.startswith("x-") and p.stat().st_size <= 16 * 16 * 4 for p in files)
    again = {r["item"]: np.array(r["vector"]) for r in V.item_vectors(d, "item", "line", size=16, epochs=5, rate=0.1).collect()}
    assert all((again[x] == v[x]).all() for x in v)


def test_no_orders_no_vectors(spark):
    d = spark.createDataFrame([(1, 0, 5), (2, 0, 6), (None, 1, 7)], "order_id long, line int, item long")
    got = V.item_vectors(d, "item", "line", size=4)
    assert got.dtypes == [("item", "bigint"), ("vector", "array<double>")] and got.count() == 0
    one = V.item_vectors(spark.createDataFrame([(1, 0, 5), (1, 1, 5)], "order_id long, line int, item long"), "item", "line", size=4)
    assert [(r["item"], len(r["vector"])) for r in one.collect()] == [(5, 4)]
