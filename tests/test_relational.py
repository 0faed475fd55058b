import os
import random
from math import comb, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import relational as R
from tallyloom.operators import selection as S
from tallyloom.operators import similarity as Z
from tallyloom.operators import statistics as T
from tallyloom.sources import keyed as K

from .conftest import rows


def test_upsert_keeps_the_first_of_a_key_and_drops_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, None), (None, "z")], "k int, v string")
    assert rows(R.upsert(old, new, ["k"], [F.desc("v")])) == [(1, "a"), (2, "y"), (3, None)]
    assert rows(R.upsert(old.limit(0), new.limit(0), ["k"])) == []
    once = R.upsert(old, new, ["k"], [F.desc("v")])
    assert rows(R.upsert(once, new, ["k"], [F.desc("v")])) == rows(once)


def test_backfill_only_blanks(spark):
    d = spark.createDataFrame([(1, " "), (2, None), (3, "keep"), (4, ""), (None, None)], "k int, v string")
    s = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k int, v string")
    assert rows(R.backfill(d, s, "k", "v")) == sorted([(1, "one"), (2, "two"), (3, "keep"), (4, ""), (None, None)], key=repr)


def test_groups_sides_and_either_key(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, v string")
    assert rows(R.replace_groups(old, spark.createDataFrame([(1, "z")], "g int, v string"), ["g"])) == [(1, "z"), (2, "c")]
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(R.symmetric_difference(a.where("k is not null"), b, "k", ("l", "r"))) == [(1, "l"), (3, "r")]
    lines = spark.createDataFrame([(1, 5, 7), (2, 7, 9), (3, 8, 8)], "n int, x int, y int")
    assert rows(R.either_key_join(lines, spark.createDataFrame([(7,), (8,)], "w int"), [("x", "w"), ("y", "w")], ["n", "w"]), "n", "w") == [(1, 7), (2, 7), (3, 8)]


def test_tiered_fill_counts_a_key_in_its_first_tier(spark):
    one = spark.createDataFrame([(1, 5), (2, 9)], "k int, s int")
    two = spark.createDataFrame([(2, 99), (3, 1), (4, 2)], "k int, s int")
    assert [tuple(r) for r in R.tiered_fill([one, two], "k", [F.desc("s"), F.col("k")], 3).select("k", "tier").collect()] == [(2, 1), (1, 1), (4, 2)]


def test_percentile_definitions_differ(spark):
    d = spark.createDataFrame([("g", x) for x in (1, 2, 3, 4, None)] + [("h", 7)], "g string, x int")
    assert rows(T.ranked_percentiles(d, ["g"], "x", {"a": 0.5, "b": 0.75}, "before")) == [("g", 2, 3), ("h", 7, 7)]
    assert rows(T.ranked_percentiles(d, ["g"], "x", {"a": 0.5, "b": 0.75}, "floor")) == [("g", 3, 4), ("h", 7, 7)]


def test_linear_percentiles_of_a_hot_and_a_null_group(spark):
    r = random.Random(6)
    data = [(g, r.choice([None, r.random(), float(r.randint(0, 5))])) for g in ["hot"] * 2000 + [None] * 30 + ["one"]]
    d = spark.createDataFrame(data, "g string, x double")
    got = {x["g"]: (x["a"], x["b"], x["c"]) for x in T.ranked_percentiles(d, ["g"], "x", {"a": 0.0, "b": 0.37, "c": 1.0}, "linear").collect()}
    for g in {g for g, x in data if x is not None}:
        assert np.allclose(got[g], np.quantile([x for h, x in data if h == g and x is not None], [0.0, 0.37, 1.0]))
    assert T.ranked_percentiles(d.limit(0), ["g"], "x", {"a": 0.5}, "linear").count() == 0


def test_merged_candidates(spark):
    schema = "products array<string>, kind string, source string, score double, confidence double, lift double, support double, fit double"
    c = spark.createDataFrame([(["b", "a"], "k", "x", 1.0, 0.9, 1.0, 0.1, 0.2), (["a", "b"], "k", "y", 3.0, 0.1, 2.0, 0.3, 0.4), (["a", "b"], "other", "y", 3.0, 0.1, 2.0, 0.3, 0.4), (["c"], "k", "x", 2.0, None, 1.0, 0.0, None)], schema)
    known = spark.createDataFrame([(["c"], "k")], "signature array<string>, kind string")
    got = {(tuple(r["signature"]), r["kind"]): r for r in S.merge_candidates(c, known).collect()}
    assert set(got) == {(("a", "b"), "k"), (("a", "b"), "other")}
    one = got[("a", "b"), "k"]
    assert (one["score"], one["confidence"], one["lift"], one["support"], round(one["fit"], 6), one["sources"], one["products"]) == (3.0, 0.9, 2.0, 0.3, 0.3, ["x", "y"], ["a", "b"])


def test_scaling_of_flat_columns(spark):
    d = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "k int, a double, b double")
    assert rows(T.min_max(d, ["a", "b"]), "a_norm", "b_norm") == [(0.0, 0.5), (1.0, 0.5)]
    assert rows(T.robust_scale(d, "b"), "b_robust") == [(0.5,), (0.5,)]
    assert rows(T.z_sigmoid_without_outliers(d, "b"), "b_z") == [(0.5,), (0.5,)]
    assert T.min_max(d.limit(0), ["a"]).count() == 0


def test_forecast_of_a_line(spark):
    d = spark.createDataFrame([(i, 10.0 + 2 * i) for i in range(20)], "d int, v double")
    got = T.forecast(d, "d", "v", 2).collect()
    assert [round(r["linear"], 6) for r in got] == [50.0, 52.0] and got[0]["last"] == 48.0 and got[0]["moving_average"] == 42.0
    assert all(r["low"] <= r["mean"] <= r["high"] for r in got)


def test_merge_matching_and_fronts(spark):
    c = spark.createDataFrame([(["b", "a"], "x", 1), (["a", "b", "a"], "y", 3), (["c"], "x", 2)], "products array<string>, source string, score int")
    assert rows(S.merge_by_set(c)) == [(["a", "b"], 3, ["x", "y"], "y"), (["c"], 2, ["x"], "x")]
    p = spark.createDataFrame([("a", "b", 9), ("b", "c", 8), ("c", "d", 7), ("d", "e", 7)], "a string, b string, n int")
    order = [-F.col("n"), F.col("a")]
    assert rows(S.greedy_matching(p, "a", "b", order), "a", "b") == [("a", "b"), ("c", "d")]
    assert rows(S.greedy_matching(p.limit(0), "a", "b", order)) == []
    f = spark.createDataFrame([("g", 1, 3, 1), ("g", 2, 2, 2), ("g", 3, 1, 3), ("g", 4, 2, 1), ("g", 5, 1, 1), ("g", 6, 3, 1)], "g string, k int, x int, y int")
    assert rows(S.pareto_fronts(f, ["g"], "x", "y", 2), "k", "front") == [(1, 1), (2, 1), (3, 1), (4, 2), (6, 1)]


def test_pareto_search_fills_up_front_after_front(spark):
    r = random.Random(5)
    data = [("chain", i, float(i), float(i)) for i in range(9)] + [("few", 1, 1.0, 1.0), ("few", 2, 1.0, 1.0), ("few", 3, 0.0, 2.0)]
    data += [("line", i, float(i % 10), 10.0 - i % 10) for i in range(30)] + [("cloud", i, float(r.randint(0, 12)), float(r.randint(0, 12))) for i in range(150)]
    front, rest, n = {}, data, 0
    while rest:
        n += 1
        on = [a for a in rest if not any(b[0] == a[0] and b[2] >= a[2] and b[3] >= a[3] and b[2:] != a[2:] for b in rest)]
        front |= {a[:2]: n for a in on}
        rest = [a for a in rest if a not in on]
    d = spark.createDataFrame([*data, ("few", 9, None, 1.0)], "g string, k int, x double, y double")
    assert rows(S.front_numbers(d, ["g"], "x", "y"), "g", "k", "front") == sorted(((*a, f) for a, f in front.items()), key=repr)
    got = S.pareto_search(d, "g", "k", ["x", "y"], keep=6, seed=1)
    assert got.columns == ["g", "k", "x", "y", "front"]
    taken = rows(got, "g", "k", "front")
    for g in ("chain", "few", "line", "cloud"):
        own = [f for a, _, f in taken if a == g]
        assert sorted(own) == sorted(f for (a, _), f in front.items() if a == g)[:6]
    assert all(front[a, k] == f for a, k, f in taken) and len({(a, k) for a, k, _ in taken}) == len(taken)
    assert taken == rows(S.pareto_search(d.repartition(3), "g", "k", ["x", "y"], keep=6, seed=1), "g", "k", "front")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_front_counts_have_every_row_of_the_catalogue(spark):
    from tallyloom.queries.ranking import QUERIES

    folder = "/root/testdata/sf0.001"
    n = rows(QUERIES["r16_front_counts"][0](spark, folder), "product_type", "front", "n")
    assert sum(x for *_, x in n) == spark.read.parquet(f"{folder}/part.parquet").count()
    assert [(g, x) for g, f, x in n if f == 1] == rows(QUERIES["r16_all_fronts"][0](spark, folder), "product_type", "n")
    assert all((g, f - 1) in {y[:2] for y in n} for g, f, _ in n if f > 1)


def test_similarity(spark):
    s = spark.createDataFrame([(1, ["a", "b", "b", None]), (2, ["b", "c"]), (3, []), (4, None)], "key int, words array<string>")
    assert rows(Z.jaccard_pairs(s)) == [(1, 2, 1 / 3)]
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 0.0], 2), (4, None, 2)], "vec_id long, embedding array<float>, label int")
    for block in (1, 10):
        got = Z.nearest(v, v.where("vec_id < 2"), 2, block=block)
        assert rows(got.select("query", "other", F.round("cosine", 6))) == [(0, 1, 1.0), (0, 2, 0.0), (1, 0, 1.0), (1, 2, 0.0)]
    assert Z.nearest(v, v.limit(0), 2).count() == 0
    mean = {r["label"]: r["mean_cosine"] for r in Z.set_similarity(v.where("vec_id < 3"), "label").collect()}
    assert abs(mean[1] - 1 / 3) < 1e-9


def test_nearest_in_block_with_shared_close_and_missing_values(spark):
    """By brute force; more than 2k rows share a value, or differ by less than the rounding of the gap."""
    r = random.Random(3)
    prices = [lambda: r.randint(0, 4) / 100, lambda: 1 + r.randint(0, 500) / 1e6, lambda: r.choice([None, None, 0.25, 0.75])]
    data = [(r.choice(["x", "y", None]), key, prices[key % 3]()) for key in r.sample(range(1000), 240)]
    want = []
    for g, a, v in data:
        gaps = [(None if v is None or u is None else round(abs(v - u), 4), b) for h, b, u in data if g and g == h and a != b]
        want += [(a, b) for _, b in sorted(gaps, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:3]]
    assert rows(Z.nearest_in_block(spark.createDataFrame(data, "g string, k int, v double"), ["g"], "k", "v", 3), "a", "b") == sorted(want, key=repr)


def test_near_duplicate_sets_lose_no_link(spark):
    r = random.Random(2)
    base = [sorted(r.sample(range(40), 10)) for _ in range(12)]
    sets = [(i, x) for i, x in enumerate(base)] + [(100 + i, x) for i, x in enumerate(base)] + [(200 + i, x[:-1]) for i, x in enumerate(base)] + [(300 + i, [*x[1:], 41]) for i, x in enumerate(base)] + [(999, [])]
    d = spark.createDataFrame(sets, "k int, items array<int>")
    classes: dict = {}
    for k, x in sorted(sets):
        classes.setdefault(tuple(sorted(x)), k)
    near = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-9
    want = {(k, classes[tuple(sorted(x))], sum(c != classes[tuple(sorted(x))] and len(x) > 0 and near(x, y) for y, c in classes.items())) for k, x in sets}
    assert set(rows(Z.near_duplicate_sets(d, "k", "items", 0.8))) == want


def test_near_duplicate_sets_of_few_items_meet_by_combinations(spark):
    """Sets of 25 items: single items are shared by thousands, so marks of several are chosen; no link is lost by any choice."""
    counts = {5: 15000, 6: 12000, 7: 8000, 8: 4000, 9: 1500}
    few = Z._meeting_plan(counts, 25.0, 0.8)
    assert {(a, b) for a, b, _, _ in few} == {(5, 6), (6, 7), (7, 8), (8, 9), (9, 9)} and all(n > 2 for _, _, _, n in few)
    choose = comb
    assert sum(counts[a] * counts[b] * choose(a - o + n, n) * choose(b - o + n, n) / choose(25, n) for a, b, o, n in few) < 10**7
    assert {n for _, _, _, n in Z._meeting_plan({40: 100, 50: 100}, 1e6, 0.8)} == {1}
    r = random.Random(5)
    for universe, sizes, least in ((14, (1, 12), 0.8), (60, (8, 30), 0.6), (9, (1, 6), 0.5)):
        sets = [(i, r.sample(range(universe), r.randint(*sizes))) for i in range(250)]
        sets += [(1000 + i, [*x[1:], r.randrange(universe)]) for i, x in sets[:120]]
        classes: dict = {}
        for k, x in sets:
            classes.setdefault(frozenset(x), k)
        near = lambda a, b: len(a & b) >= least * len(a | b) - 1e-9
        want = {(k, classes[frozenset(x)], sum(y != frozenset(x) and near(y, frozenset(x)) for y in classes)) for k, x in sets}
        assert set(rows(Z.near_duplicate_sets(spark.createDataFrame(sets, "k long, items array<int>"), "k", "items", least))) == want


def test_matching_is_the_greedy_walk(spark):
    r = random.Random(2)
    pairs = sorted({(f"x{r.randint(0, 60)}", f"y{r.randint(0, 60)}", r.randint(1, 9)) for _ in range(400)})
    taken, want = set(), []
    for a, b, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in taken and b not in taken:
            taken |= {a, b}
            want.append((a, b, n))
    d = spark.createDataFrame([*pairs, *pairs[:5], (None, "y", 99)], "a string, b string, n int")
    assert rows(S.greedy_matching(d, "a", "b", [-F.col("n"), F.col("a"), F.col("b")]), "a", "b", "n") == sorted(want)


def test_metadata_similarity_of_levels_brands_and_titles(spark):
    d = spark.createDataFrame(
        [(1, "Home > Chairs", "Oak & Co", 60.0, "The red chair"), (2, "home > chairs", "oak co", 70.0, "red chair for home"), (3, "Home > Tables", "Oak Co North", 700.0, "table"), (4, None, None, None, None), (5, "", "", 0.0, "")],
        "id long, c string, v string, p double, t string",
    )
    got = {(r["query"], r["other"]): round(r["score"], 6) for r in Z.similar_by_metadata(d, d, "id", "c", "v", "p", "t", (25, 50, 100), least=0.0).collect()}
    assert got[1, 2] == round(0.35 + 0.25 * 0.7 + 0.2 + 0.15 * 2 / 3, 6)
    assert got[1, 3] == round(0.35 * 0.7 + 0.25 * 0.7 + 0.2 * 0.5, 6)
    assert not any(4 in k or 5 in k for k in got)
    assert Z.similar_by_metadata(d, d.limit(0), "id", "c", "v", "p", "t", (25,)).count() == 0


def test_metadata_similarity_compares_each_kind_once(spark, monkeypatch):
    """Many rows with the same metadata, some keys twice: as by pairs of rows, but from the kinds of rows."""
    r = random.Random(6)
    data = [(i % 290, r.choice(["x", "x > y", "x > z", None]), r.choice(["Oak", "Oak Co", ""]), r.choice([10.0, 60.0, None]), r.choice(["red chair", "chair RED", "big table"])) for i in range(300)]
    kept = {}
    real = Z.written
    monkeypatch.setattr(Z, "written", lambda d, name: kept.setdefault(name, real(d, name)))
    d = spark.createDataFrame(data, "id long, c string, v string, p double, t string")
    got = [(x["query"], x["rank"], x["other"], round(x["score"], 6)) for x in Z.similar_by_metadata(d, d.where("id % 7 = 0").dropDuplicates(["id"]), "id", "c", "v", "p", "t", (25, 50), 4, block=5).collect()]
    asked = {x["id"]: x for x in d.where("id % 7 = 0").dropDuplicates(["id"]).collect()}

    def score(a, b):
        x, y = (a["c"] or "", b[1] or "")
        s = 0.35 * (1.0 if x and x == y else 0.0 if not x or not y else 0.7 if "x" in (x, y) else 0.7)
        s += 0.25 * (0.0 if not a["v"] or not b[2] else 1.0 if a["v"] == b[2] else 0.7)
        s += 0.2 * (0.0 if a["p"] is None or b[3] is None else 1.0 if a["p"] == b[3] else 0.2)
        u, w = set(a["t"].lower().split()), set(b[4].lower().split())
        return s + 0.15 * len(u & w) / len(u | w) + 0.05 * (a["v"] == b[2])

    want = []
    for q, a in asked.items():
        best = sorted((-round(score(a, b), 9), b[0]) for b in data if b[0] != q and score(a, b) > 0.2)[:4]
        want += [(q, i + 1, o, round(-s, 6)) for i, (s, o) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert kept["row-kinds"].count() <= 4 * 3 * 3 * 2 and kept["query-kinds"].count() <= len(asked)


def test_metadata_similarity_query_asks_for_every_variant(spark, tmp_path):
    """As its SQL, by pairs of rows; titles decide between classes, and no class is left out that can hold a result."""
    import duckdb

    from tallyloom.queries import registry

    r = random.Random(11)
    part = [(i, r.choice(["red chair", "red table", "old table", "big old chair"]), r.choice(["Brand#1", "Brand#11", "Brand#2"]), r.choice(["LARGE", "SMALL"]), 1, r.choice([10.0, 30.0, 60.0, 700.0, 960.0])) for i in range(1, 181)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    run, sql = registry.all_queries()["m23_metadata_similarity"]
    got = rows(run(spark, str(tmp_path)), "query", "other", "score")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(f"select query, other, score from ({sql})").fetchall(), key=repr)
    assert {x[0] for x in got} == {x[0] for x in part} and len(got) == 10 * len(part)


def test_metadata_similarity_of_a_key_with_two_rows(spark):
    """Both rows of a key are asked for and share its k; neither is in its own result."""
    d = spark.createDataFrame([(1, "x", "Oak", 10.0, "red chair"), (1, "y", "Elm", 60.0, "big table"), (2, "x", "Oak", 10.0, "red chair"), (3, "y", "Elm", 60.0, "table"), (4, "x", "Oak", 10.0, "chair")], "id long, c string, v string, p double, t string")
    got = [(x["rank"], x["other"], round(x["score"], 6)) for x in Z.similar_by_metadata(d, d, "id", "c", "v", "p", "t", (25, 50), 2).where("query = 1").collect()]
    assert sorted(got) == [(1, 2, 1.0), (2, 3, 0.925)]


def test_attribute_similarity_against_all_pairs(spark):
    r = random.Random(3)
    items = [(i, r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.choice([None, 0.0, 1.0, 2.0, 2.0, 3.0, 9.0])) for i in range(40)]
    want = []
    for a, ca, ma, pa in items:
        best = []
        for b, cb, mb, pb in items:
            c, m = ca is not None and ca == cb, ma is not None and ma == mb
            full = bool(pa and pb)
            score = 0.5 * c + 0.3 * m + (0.2 * min(pa, pb) / max(pa, pb) if full else 0.0)
            if a != b and (c or m) and score > 0.4:
                best.append((not c, not m, round(abs(log(pa) - log(pb)), 4) if full else 99.0, b))
        want += [(a, x[3]) for x in sorted(best)[:4]]
    d = spark.createDataFrame(items, "i long, c string, m string, p double")
    assert rows(Z.similar_by_attributes(d, "i", "c", "m", "p", 4), "a", "b") == sorted(want, key=repr)


def test_keyed_table(spark, tmp_path):
    k = K.Keyed(spark, f"file://{tmp_path}/t", ["id"], buckets=3)
    new = lambda x: spark.createDataFrame(x, "id long, v string")
    k.upsert(new([(1, "a"), (2, "b"), (None, "z")]))
    k.upsert(new([(2, "c"), (2, "d"), (3, "e")]), [F.desc("v")])
    assert rows(k.read(), "id", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert k.update(F.col("id") > 1, {"v": F.lit("u")}) == 2 and k.update(F.col("id") > 9, {"v": F.lit("u")}) == 0
    assert k.delete(F.col("id") == 3) == 1 and k.delete(F.col("v").isNull()) == 0
    assert rows(K.Keyed(spark, f"file://{tmp_path}/t", ["id"], buckets=3).read(), "id", "v") == [(1, "a"), (2, "u")]
    assert k.delete(F.lit(True)) == 2 and k.read().count() == 0
    k.upsert(new([(5, "n")]))
    assert rows(k.read(), "id", "v") == [(5, "n")]
