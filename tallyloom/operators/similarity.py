"""Set and vector similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.codes import dense_codes
from ..plans.shared import once, spread, written
from .baskets import basket_pairs


def jaccard_pairs(sets: DataFrame, least: float = 0.0) -> DataFrame:
    """a < b and the Jaccard similarity of their word sets, for keys that share a word.

    sets: key, words (array; repeats and nulls don't count). A word is handled as a basket of the keys that have it, so a
    word that a third of all keys share is split into blocks on all partitions; only counts cross. The words are written
    once.
    """
    words = once(sets.select("key", F.explode(F.array_distinct(F.array_compact("words"))).alias("w")), "words")
    sizes = words.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    shared = basket_pairs(words, "w", "key").groupBy(F.col("item_a").alias("a"), F.col("item_b").alias("b")).agg(F.count(F.lit(1)).alias("s"))
    side = lambda x: sizes.select(F.col("key").alias(x), F.col("k").alias(f"k_{x}"))
    j = F.col("s") / (F.col("k_a") + F.col("k_b") - F.col("s"))
    return shared.join(side("a"), "a").join(side("b"), "b").select("a", "b", j.alias("jaccard")).where(F.col("jaccard") >= least)


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """The k rows of highest cosine for every query, exact: query, other, cosine, rank. A row isn't its own neighbour.

    The queries go to the tasks ``block`` at a time; each task keeps the best k of each of its batches, so only
    k rows per query and batch are shuffled. Vectors without length have cosine 0. Ties go to the lower key.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
        got = part.select(key, vector).collect()
        ids = np.array([r[0] for r in got], np.int64)
        unit = _unit([r[1] for r in got])

        def search(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, unit: np.ndarray = unit) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(ids):
                    others = b[key].to_numpy()
                    s = unit @ _unit(list(b[vector])).T
                    s[ids[:, None] == others] = -2
                    r = np.round(s, 9)
                    best = np.lexsort((np.broadcast_to(others, s.shape), -r))[:, :k]
                    q, c = np.repeat(ids, best.shape[1]), np.take_along_axis(s, best, 1).ravel()
                    d = pd.DataFrame({"query": q, "other": others[best].ravel(), "cosine": c})
                    yield d[d["cosine"] > -2]

        one = rows.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(search, "query long, other long, cosine double")
        out = one if out is None else out.unionByName(one)
    first = W.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "other")
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, np.float64).reshape(len(vectors), len(vectors[0]) if vectors else 0)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def set_similarity(members: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean cosine over all pairs of each group, from the sum of unit vectors: |sum|^2 = n + 2 * (sum over pairs).

    No pair is made. Groups of one member have null. Vectors without length or null don't count.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = members.where(F.col(vector).isNotNull()).select(group, F.posexplode(F.transform(vector, lambda x: x.cast("double") / norm)).alias("i", "x"))
    sums = unit.groupBy(group, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    square = F.sum(F.col("s") * F.col("s"))
    n = F.max("n")
    return sums.groupBy(group).agg(n.alias("n"), F.when(n > 1, (square - n) / (n * (n - 1))).alias("mean_cosine"))


def nearest_in_block(df: DataFrame, block: list[str], key: str, value: str, k: int) -> DataFrame:
    """For each row the k rows of its block whose value is nearest: a, b, gap; exact, and equal gaps are ranked by key.

    Gaps are rounded to 4 places; where a row or its partner has no value the gap is null and comes last. Rows without a
    block have no partners. Rows with the same value differ by key only, so each value keeps its k + 1 lowest keys. The k
    nearest lie within k distinct values on either side, or tie with the last of them by rounding, thus are within 1e-4
    of it. What is found for a value holds for all its rows; no pair of rows is made. Only values that lie closer
    than the rounding make longer lists.
    """
    d = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(block)], F.col(key).alias("b"), F.col(value).cast("double").alias("v")).dropna(subset=[f"_g{i}" for i in range(len(block))])
    g = [f"_g{i}" for i in range(len(block))]
    low = F.row_number().over(W.partitionBy(*g).orderBy("b")) <= k + 1
    few = d.withColumn("_r", F.row_number().over(W.partitionBy(*g, "v").orderBy("b"))).where(F.col("_r") <= k + 1).withColumn("_low", low)
    of = few.groupBy(*g, "v").agg(F.collect_list(F.struct("b", "v")).alias("m"), F.collect_list(F.when(F.col("_low"), F.struct("b", "v"))).alias("_low"))
    w, whole = W.partitionBy(*g).orderBy("v"), W.partitionBy(*g)
    close = F.expr(f"flatten(collect_list(m) OVER (PARTITION BY {', '.join(g)} ORDER BY v RANGE BETWEEN 2e-4D PRECEDING AND 2e-4D FOLLOWING))")
    around = F.flatten(F.collect_list("m").over(w.rowsBetween(-k, k)))
    none = F.flatten(F.collect_list(F.when(F.col("v").isNull(), F.col("m"))).over(whole))
    first = F.flatten(F.collect_list(F.when(F.size("_low") > 0, F.col("_low"))).over(whole))
    edge = lambda f: F.coalesce(f("_close", k).over(w), F.array().cast(of.schema["m"].dataType))
    near = F.when(F.col("v").isNull(), F.col("_first")).otherwise(F.concat("_around", edge(F.lag), edge(F.lead), "_none"))
    gap = lambda x: F.round(F.abs(F.col("v") - x["v"]), 4)
    ranked = F.array_sort(F.array_distinct(F.transform("_near", lambda x: F.struct(gap(x).isNull().alias("n"), gap(x).alias("gap"), x["b"].alias("b")))))
    lists = of.withColumns({"_around": around, "_close": close, "_none": none, "_first": first}).withColumn("_near", near).select(*g, "v", F.slice(ranked, 1, k + 1).alias("x"))
    own = lists.select(*[F.col(c).alias(f"{c}_") for c in g], F.col("v").alias("v_"), "x")
    same = F.col("v").eqNullSafe(F.col("v_"))
    for c in g:
        same = same & (F.col(c) == F.col(f"{c}_"))
    best = F.slice(F.filter("x", lambda x: x["b"] != F.col("b")), 1, k)
    return d.join(own, same).select(F.col("b").alias("a"), F.explode(best).alias("x")).select("a", "x.b", "x.gap")


def similar_by_attributes(df: DataFrame, key: str, category: str, brand: str, price: str, k: int, least: float = 0.4) -> DataFrame:
    """For each row the k rows most alike: a, b, score = 0.5 (same category) + 0.3 (same brand) + 0.2 (lower over higher price).

    Only scores above ``least`` (0.3 or more) count; a null category or brand equals none, and without two positive prices
    that part is 0. What is shared weighs more than any price, so the k best are among the k nearest prices of the row's
    (category, brand), of its category and of its brand: no block is paired with itself. Gaps of the logarithm of the
    price are ranked to 4 places, then by key.
    """
    d = df.select(F.col(key).alias("key"), F.col(category).alias("c"), F.col(brand).alias("m"), F.when(F.col(price) > 0, F.col(price).cast("double")).alias("p")).dropDuplicates(["key"])
    d = d.withColumn("l", F.log("p"))
    near = None
    for block in (["c", "m"], ["c"], ["m"]):
        one = nearest_in_block(d, block, "key", "l", k).select("a", "b", "gap")
        near = one if near is None else near.unionByName(one)
    side = lambda x: d.select(F.col("key").alias(x), *[F.col(n).alias(f"{n}_{x}") for n in ("c", "m", "p")])
    both = near.dropDuplicates(["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    same = lambda n: F.coalesce(F.col(f"{n}_a") == F.col(f"{n}_b"), F.lit(False)).cast("int")
    ratio = F.coalesce(F.least("p_a", "p_b") / F.greatest("p_a", "p_b"), F.lit(0.0))
    ratio = F.when(F.col("p_a").isNotNull() & F.col("p_b").isNotNull(), ratio).otherwise(0.0)
    both = both.withColumns({"_c": same("c"), "_m": same("m")}).withColumn("score", 0.5 * F.col("_c") + 0.3 * F.col("_m") + 0.2 * ratio).where(F.col("score") > least)
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("_c"), F.desc("_m"), F.asc_nulls_last("gap"), "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "score", "rank")


#: Words of a title that don't count, and the weights of what two records share.
_SMALL_WORDS = ("and", "or", "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "by")
_WEIGHTS = {"category": 0.35, "brand": 0.25, "price": 0.20, "title": 0.15, "vendor": 0.05}
_CLASS = ["c", "v", "m", "bare", "p"]


def similar_by_metadata(rows: DataFrame, queries: DataFrame, key: str, category: str, vendor: str, price: str, title: str, bounds: tuple[float, ...], k: int = 10, least: float = 0.2, block: int = 512) -> DataFrame:
    """For each query the k rows whose metadata are most alike: query, other, score (above ``least``); ties go to the lower key.

    The score sums category (1 if equal, 0.7 if one level apart, 0.4 if a level is shared; levels are parted by ' > '),
    brand (1, or 0.7 if one name holds the other), price band (``bounds``: 1, 0.5, 0.2 by distance), title (Jaccard of
    its words) and vendor, by fixed weights; null and empty values share nothing. Rows with the same metadata have the
    same score, so they are compared once and only their lowest keys can be in a result; so do queries. Kinds that differ
    in their title only are a class: classes are compared first, titles only between classes that can reach the result
    (``_class_pairs``), ``block`` by ``block`` kinds. All rows may be queries; the driver has none of them.
    """
    band = F.lit(0)
    for x in bounds:
        band = band + (F.col(price) >= x).cast("int")
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"(\w+)"), F.lit(1))), F.array(*map(F.lit, _SMALL_WORDS)))
    facts = [
        F.col(key).alias("key"),
        F.lower(category).alias("c"),
        F.col(vendor).alias("v"),
        F.lower(vendor).alias("m"),
        F.regexp_replace(F.lower(vendor), "[^a-z0-9]", "").alias("bare"),
        F.when(F.col(price) > 0, band).alias("p"),
        F.array_sort(words).alias("w"),
    ]
    own, asked = (x.select(*facts).where("key is not null") for x in (rows, queries))
    often = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    keep = k + often(own)  # a query's own rows go at the end
    lowest = own.withColumn("_r", F.row_number().over(W.partitionBy(*_CLASS, "w").orderBy("key"))).where(F.col("_r") <= keep)
    kinds = written(lowest.groupBy(*_CLASS, "w").agg(F.array_sort(F.collect_list("key")).alias("keys")), "row-kinds")
    wanted = written(asked.select(*_CLASS, "w").distinct().withColumn("id", F.monotonically_increasing_id()), "query-kinds")
    ours, our_kinds = _by_class(kinds, "row-classes", "b", F.size("keys"), ["keys", "w"], block)
    theirs, their_kinds = _by_class(wanted, "query-classes", "a", F.lit(1), ["id", "w"], block)
    merged = lambda d: d.hint("merge")  # noqa: E731 - lists of keys are no broadcasts: each would pass the driver
    units = _class_pairs(theirs, ours, keep, least).join(merged(their_kinds), "a").join(merged(our_kinds), "b")
    conf = rows.sparkSession.conf
    units = units.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), "a", "a_pack", "b", "b_pack")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_key = b.schema.field("b_kinds").type.value_type.field("keys").type.value_type
            for i in range(b.num_rows):
                ids, others, scores = _alike(**b.slice(i, 1).to_pylist()[0], keep=keep, least=least)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, of_key), pa.array(scores, pa.float64())], names=["id", "other", "score"])

    found = units.select("base", "same", "floor", "a_kinds", "b_kinds").mapInArrow(search, f"id long, other {kinds.schema['keys'].dataType.elementType.simpleString()}, score double")
    best = W.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "other")
    firsts = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep)
    lists = firsts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_r", "other", "score"))).alias("best")).join(merged(wanted), "id")
    ids = asked.alias("x").join(merged(lists).alias("y"), _equal("c", "v", "p", "w")).select(F.col("x.key").alias("query"), "y.best")
    others = F.slice(F.filter("best", lambda x: x["other"] != F.col("query")), 1, k)
    out = ids.select("query", F.posexplode(others).alias("_at", "_x")).select("query", "_x.other", "_x.score", (F.col("_at") + 1).alias("rank"))
    if often(asked) == 1:
        return out
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "other"))  # a key's rows share its k
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _equal(*columns: str) -> Column:
    """x and y have the same values, null or not."""
    return reduce(lambda a, b: a & b, (F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in columns))


def _by_class(kinds: DataFrame, name: str, of: str, rows: Column, values: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """The classes of these kinds, with an id ``of`` and their number of rows n, and their kinds in packs of about ``block``."""
    classes = kinds.groupBy(*_CLASS).agg(F.count(F.lit(1)).alias("_kinds"), F.sum(rows).alias("n"))
    classes = written(classes.withColumn(of, F.monotonically_increasing_id()), name)
    own = kinds.alias("x").join(classes.alias("y"), _equal("c", "v", "p")).select(of, F.pmod(F.xxhash64("w"), F.ceil(F.col("_kinds") / block)).alias(f"{of}_pack"), *values)
    return classes.drop("_kinds"), own.groupBy(of, f"{of}_pack").agg(F.collect_list(F.struct(*values)).alias(f"{of}_kinds"))


def _class_pairs(theirs: DataFrame, ours: DataFrame, keep: int, least: float) -> DataFrame:
    """a, b, base, same and floor of all classes b that can hold one of the first ``keep`` rows for a query of class a.

    Without its title a pair of classes has a score that a title can only raise, by its weight at most. So once classes
    with ``keep`` rows are at or above some score (the floor), a class from which the best title can't lead there is out.
    """
    x, y = (lambda n: F.col(f"x.{n}")), (lambda n: F.col(f"y.{n}"))
    filled = lambda n: F.coalesce((x(n) != "") & (y(n) != ""), F.lit(False))
    levels = [F.split(side("c"), " > ") for side in (x, y)]
    shared = lambda n, i: F.when((n == i) & (levels[0][i] == levels[1][i]), n + 1).otherwise(n)
    shared = F.aggregate(F.sequence(F.lit(0), F.least(*map(F.size, levels)) - 1), F.lit(0), shared)
    category = F.when(~filled("c"), 0.0).when(x("c") == y("c"), 1.0).when(levels[0][0] != levels[1][0], 0.0)
    category = category.when((shared == F.size(levels[0]) - 1) | (shared == F.size(levels[1]) - 1), 0.7).otherwise(0.4)
    brand = F.when(~filled("m"), 0.0).when(x("m") == y("m"), 1.0).when(F.contains(x("bare"), y("bare")) | F.contains(y("bare"), x("bare")), 0.7)
    apart = F.abs(x("p") - y("p"))
    near = F.when(apart == 0, 1.0).when(apart == 1, 0.5).when(apart == 2, 0.2)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = category * _WEIGHTS["category"] + zero(brand) * _WEIGHTS["brand"] + zero(near) * _WEIGHTS["price"]
    same = zero((x("v") == y("v")).cast("double")) * _WEIGHTS["vendor"]
    slack = 1e-8  # scores are compared to nine digits

    def pairs(asked: DataFrame, *more: str) -> DataFrame:
        d = spread(asked).alias("x").crossJoin(ours.alias("y")).select("a", "b", base.alias("base"), same.alias("same"), y("n"), *more)
        return d.withColumn("low", F.col("base") + F.col("same")).where(F.col("low") + _WEIGHTS["title"] + slack > least)

    by_score = pairs(theirs).groupBy("a", F.round("low", 9).alias("low")).agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(W.partitionBy("a").orderBy(F.desc("low")))
    floors = by_score.withColumn("_n", so_far).where(F.col("_n") >= keep).groupBy("a").agg(F.max("low").alias("floor"))
    asked = written(theirs.join(floors, "a", "left").withColumn("floor", zero(F.col("floor")) - slack), "query-floors")
    return pairs(asked, "floor").where(F.col("low") + _WEIGHTS["title"] >= F.col("floor")).drop("n", "low")


def _alike(base: float, same: float, floor: float, a_kinds: list[dict], b_kinds: list[dict], keep: int, least: float) -> tuple[list, list, list]:
    """id, other, score: for each kind a of one class the first ``keep`` rows of the kinds b of another."""
    b_kinds = sorted(b_kinds, key=lambda x: x["keys"][0])
    keys = [x["keys"] for x in b_kinds]
    likeness, i, j = _title_likeness([tuple(x["w"] or ()) for x in a_kinds], [tuple(x["w"] or ()) for x in b_kinds])
    s = (base + likeness * _WEIGHTS["title"] + same)[i][:, j]
    r = np.where((s > least) & (s >= floor), np.round(s, 9), -1.0)
    last = np.partition(r, -keep, axis=1)[:, -keep] if r.shape[1] > keep else np.full(len(r), -1.0)
    ids, others, scores = [], [], []
    for x, (score, rough) in enumerate(zip(s, r)):
        # a kind's lowest key is its first; with equal scores the kinds of the lowest keys come first
        first = np.flatnonzero(rough > last[x])
        if last[x] >= 0:
            first = np.concatenate([first, np.flatnonzero(rough == last[x])[:keep]])
        rows = sorted((-rough[c], key, c) for c in first.tolist() for key in keys[c])[:keep]
        ids += [a_kinds[x]["id"]] * len(rows)
        others += [key for _, key, _ in rows]
        scores += [score[c] for _, _, c in rows]
    return ids, others, scores


def _title_likeness(theirs: list[tuple], ours: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Jaccard of each two different titles, through the words that they share, and where the titles of either side are."""
    a, b = {x: i for i, x in enumerate(dict.fromkeys(theirs))}, {x: i for i, x in enumerate(dict.fromkeys(ours))}
    places: dict[str, list[int]] = {}
    for w, i in b.items():
        for x in w:
            places.setdefault(x, []).append(i)
    at = {x: np.array(p) for x, p in places.items()}
    lengths, out = np.array([len(w) for w in b]), np.zeros((len(a), len(b)))
    for w, i in a.items():
        for x in w:
            if x in at:
                out[i, at[x]] += 1
        out[i] /= np.maximum(len(w) + lengths - out[i], 1)
    return out, np.array([a[x] for x in theirs]), np.array([b[x] for x in ours])


def near_duplicate_sets(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """key, class_id (the lowest key with the same set) and links: how many other classes have a Jaccard of ``least``.

    Equal sets are one class. Two sizes that can reach the threshold need some number of items in common, ``o``. The first
    n of the common items, in an order by rarity, then lie among the first k - o + n of each set of size k, so classes
    meet through combinations of n of these. With n = 1 that is the usual prefix; with few items in all, n = o tells
    sets apart that share every single item with thousands of others. n is chosen for each pair of sizes by
    ``_meeting_plan``, which decides the cost only: the meeting pairs are then checked exactly.
    """
    s = once(sets.select(key, F.array_sort(F.array_distinct(items)).alias("_items")), "sets")
    classes = written(s.groupBy("_items").agg(F.min(key).alias("class_id")), "set-classes")
    rarity = dense_codes(classes.select(F.explode("_items").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("df")), ["df", "x"])
    ranked = classes.select("class_id", F.explode("_items").alias("x")).join(rarity.select("x", "code"), "x").groupBy("class_id").agg(F.array_sort(F.collect_list("code")).alias("ranked"))
    ordered = written(ranked.withColumn("k", F.size("ranked")), "ranked-sets")
    counts = {r["k"]: r["count"] for r in ordered.groupBy("k").count().collect()}
    spread_of = rarity.agg(F.sum("df").cast("double"), F.sum(F.col("df").cast("double") * F.col("df"))).first()
    plan = _meeting_plan(counts, spread_of[0] ** 2 / spread_of[1] if spread_of[1] else 1.0, least)

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, own in b.groupby("k"):
                ids, codes = own["class_id"].to_numpy(), np.stack(own["ranked"].to_list()).astype(np.uint64)
                for small, large, o, n in plan:
                    for role in (False, True):
                        if k != (large if role else small):
                            continue
                        length = k - o + n
                        picks = np.array(list(combinations(range(length), n)), np.int64)
                        at = max(1, 1_000_000 // picks.size)
                        for i in range(0, len(ids), at):
                            sums = _mixed(codes[i : i + at, :length])[:, picks].sum(2, dtype=np.uint64)
                            marks = _mixed(sums + np.uint64(small * 1_000_003 + large)).astype(np.int64).ravel()
                            yield pd.DataFrame({"class_id": np.repeat(ids[i : i + at], len(picks)), "large": role, "mark": marks})

    kind = ordered.schema["class_id"].dataType.simpleString()
    marks = written(spread(ordered).mapInPandas(signatures, f"class_id {kind}, large boolean, mark long"), "set-marks")
    left = marks.where("not large").select(F.col("class_id").alias("a"), "mark")
    right = marks.where("large").select(F.col("class_id").alias("b"), "mark")
    meet = left.join(right, "mark").where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: ordered.select(F.col("class_id").alias(n), F.col("ranked").alias(f"s{n}"))
    both = meet.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.where(common >= least * (F.size("sa") + F.size("sb") - common) - 1e-9).select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return s.join(classes, "_items").join(links, "class_id", "left").select(key, "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64 bits for each number."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _meeting_plan(counts: dict[int, int], items: float, least: float) -> list[tuple[int, int, int, int]]:
    """(small, large, o, n) for each pair of sizes that can reach ``least``: the common items needed and how many make a mark.

    counts: sets of each size; items: how many equally frequent items there would be. n is the one with the fewest marks
    and expected meetings.
    """

    def choices(m: float, n: int) -> float:
        """The logarithm of m over n."""
        return sum(math.log(max(m - i, 1.0) / (i + 1)) for i in range(n))

    def cost(a: int, b: int, o: int, n: int) -> float:
        marks = [math.log(counts[k]) + choices(k - o + n, n) for k in (a, b)]
        return np.logaddexp(np.logaddexp(*marks), sum(marks) - choices(items, n))

    out, sizes = [], sorted(k for k in counts if k > 0)
    for a in sizes:
        for b in (x for x in sizes if x >= a and a >= x * least - 1e-9):
            o = next((o for o in range(1, a + 1) if o >= least * (a + b - o) - 1e-9), None)
            if o and not a == b == o:  # that would be one class
                out.append((a, b, o, min({*range(1, min(o, 12) + 1), o}, key=lambda n: cost(a, b, o, n))))
    return out
