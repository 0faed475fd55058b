import random
from itertools import combinations

from pyspark.sql import functions as F

from tallyloom.operators import baskets as B
from tallyloom.operators import covisitation as C
from tallyloom.operators import mining as M

from .conftest import rows

LINES = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "a"), (None, "a"), (5, None), (6, "b"), (6, "c"), (6, "a")]


def frame(spark, lines=LINES):
    return spark.createDataFrame(lines, "order_id int, item string")


def test_pairs_and_measures(spark):
    items = B.distinct_items(frame(spark))
    assert rows(B.pair_counts(items)) == [("a", "b", 3), ("a", "c", 2), ("b", "c", 1)]
    assert rows(B.pair_counts(items, 2)) == [("a", "b", 3), ("a", "c", 2)]
    total = items.agg(F.count_distinct("order_id").alias("total"))
    got = {(r["item_a"], r["item_b"]): r for r in B.pair_measures(B.pair_counts(items), B.item_counts(items), total).collect()}
    assert got["a", "b"]["confidence"] == 1.0 and got["a", "b"]["support"] == 0.6 and abs(got["a", "b"]["lift"] - 3 * 5 / (5 * 3)) < 1e-12
    assert B.pair_counts(B.distinct_items(frame(spark, []))).count() == 0


def test_smoothed_pairs_have_those_that_never_meet(spark):
    orders = [["a", "b"], ["a", "c"], ["a"], ["d"], ["a", "b", "c"]]
    d = spark.createDataFrame([(o, x) for o, items in enumerate(orders) for x in items], "order_id int, item string")
    for least in (0.0, 0.2, 0.3):
        want = []
        for x in "abcd":
            for y in "abcd":
                score = (sum(x in o and y in o for o in orders) + 1) / (sum(x in o for o in orders) + 2)
                want += [(x, y, score)] * (x != y and score >= least)
        assert rows(B.smoothed_pairs(d, least)) == want


def test_sequences_keep_repeats(spark):
    d = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, "x", 3), (2, "x", 1)], "order_id int, item string, at int")
    assert rows(B.purchase_sequences(d, "item", "at")) == [(1, ["y", "x", "x"])]


def test_sets_and_rules_against_brute_force(spark):
    import random

    r = random.Random(7)
    lines = [(o, x) for o in range(80) for x in r.sample("abcdefg", r.randint(1, 5))]
    orders: dict = {}
    for o, x in lines:
        orders.setdefault(o, set()).add(x)
    big = [s for s in orders.values() if len(s) >= 2]
    count = {}
    for s in big:
        for k in (1, 2, 3, 4):
            for c in combinations(sorted(s), k):
                count[c] = count.get(c, 0) + 1
    sets = M.frequent_sets(M.in_large_orders(B.distinct_items(frame(spark, lines))), 6, 4)
    assert {(tuple(i), n) for _, i, n in rows(sets)} == {(c, n) for c, n in count.items() if n >= 6}
    got = {(tuple(x["antecedent"]), tuple(x["consequent"])): (x["confidence"], x["lift"]) for x in M.rules(sets, len(big), 0.3).collect()}
    for (a, c), (confidence, lift) in got.items():
        both = count[tuple(sorted(a + c))]
        assert abs(confidence - both / count[a]) < 1e-12 and abs(lift - both * len(big) / count[a] / count[c]) < 1e-12
    assert any(len(c) > 1 for _, c in got)


def test_vectors_have_length_one_and_cosines_are_symmetric(spark):
    v = C.covisit_vectors(frame(spark), weighting="raw")
    norms = v.groupBy("item").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"))
    assert all(abs(r["n"] - 1) < 1e-12 for r in norms.collect())
    cos = C.cosine_pairs(v)
    assert all(0 <= r["cosine"] <= 1 + 1e-12 for r in cos.collect())
    s = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "zz"])], "set_id int, items array<string>")
    got = {r["set_id"]: r for r in C.set_coherence(s, cos).collect()}
    assert got[2]["mean"] == 0 and got[1]["least"] <= got[1]["mean"] <= got[1]["most"]
    assert C.covisit_vectors(frame(spark, [])).count() == 0


def test_pairs_of_large_orders_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 5)
    orders = {0: range(40), 1: range(10, 23), 2: range(3), 3: [7]}
    d = spark.createDataFrame([(o, x) for o, items in orders.items() for x in items], "order_id int, item int")
    want = {}
    for items in orders.values():
        for p in combinations(sorted(items), 2):
            want[p] = want.get(p, 0) + 1
    assert {(a, b): n for a, b, n in rows(B.pair_counts(d), "item_a", "item_b", "n")} == want
    vectors = d.select(F.col("order_id").alias("neighbour"), "item", (F.col("item") + 1.0).alias("weight"))
    cos = {(r["item_a"], r["item_b"]): r["cosine"] for r in C.cosine_pairs(vectors).collect()}
    assert cos == {(a, b): n * (a + 1.0) * (b + 1.0) for (a, b), n in want.items()}


def test_close_pairs_are_the_cosine_pairs_above_the_bound(spark):
    """More items than a bucket has, and an order of over CHUNK items; no pair or product crosses as a row."""
    r = random.Random(8)
    orders = [[*{r.randrange(30) if r.random() < 0.2 else r.randrange(C.BUCKET * 2) for _ in range(r.randint(1, 9))}] for _ in range(9000)] + [r.sample(range(100, 3000), B.CHUNK + 60)]
    d = spark.createDataFrame([(o, x, x % 3) for o, items in enumerate(orders) for x in items] + [(1, None, 0), (None, 1, 0)], "order_id int, item int, n int")
    assert d.select("item").distinct().count() > C.BUCKET + 1
    want = {(a, b): x for a, b, x in rows(C.cosine_pairs(C.covisit_vectors(d, neighbours=7)).where("cosine >= 0.2"))}
    close = C.close_pairs(d, 0.2, neighbours=7)
    assert "Generate" not in close._jdf.queryExecution().optimizedPlan().toString()
    got = {(a, b): x for a, b, x in rows(close, "item_a", "item_b", "cosine")}
    both = want.keys() & got.keys()
    assert len(both) > 1000 and all(abs(got[p] - want[p]) < 1e-9 for p in both)
    assert all(abs((want | got)[p] - 0.2) < 1e-12 for p in want.keys() ^ got.keys())  # at the bound itself the order of a sum decides
    assert C.close_pairs(d.limit(0), 0.2).count() == 0


def test_relaxed_rules_and_bayes(spark):
    d = spark.createDataFrame([("a", "b", 3, 0.03, 0.2), ("a", "c", 2, 0.02, 0.9), ("a", "d", 30, 0.3, 0.1), ("b", "d", 4, 0.001, 0.9)], "item_a string, item_b string, n long, support double, confidence double")
    assert rows(B.relaxed_rules(d), "item_a", "item_b") == [("a", "b")]
    score = lambda n, k, m: spark.range(1).select(B.bayesian_score(F.lit(n), F.lit(k), F.lit(m))).first()[0]
    assert abs(score(3, 4, 10) - (4 / 14 - 0.3 / 4)) < 1e-12 and score(0, 9, 10**6) == 0.0 and score(0, 0, 1) == 1.0
