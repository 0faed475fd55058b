"""Co-visitation vectors and the similarities between them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.codes import dense_codes
from ..plans.shared import new_path, once, written
from .baskets import basket_blocks, basket_pairs, both_ways, distinct_items, item_counts, large_baskets, pair_counts

#: Items of a bucket, buckets that a task holds at once, pairs or products that are handled at once, bits of a hash.
BUCKET, HELD, AT_ONCE, BITS = 1 << 14, 8, 1 << 21, 22


def covisit_vectors(lines: DataFrame, item: str = "item", weighting: str = "lift", least: int = 1, min_lift: float = 0.0, neighbours: int = 50) -> DataFrame:
    """item, neighbour, weight: for each item its strongest neighbours, scaled to length one.

    weighting: raw (count), lift, or pmi (log of lift, at least log 0.001). Ties are cut by the neighbour's name.
    """
    own = written(distinct_items(lines, item=item), "visits")  # read for the items, the orders and the pairs
    counts = item_counts(own)
    total = own.agg(F.count_distinct("order_id").alias("total"))
    pairs = pair_counts(own, least)
    both = both_ways(pairs, "neighbour", "n")
    joined = both.join(counts, "item").join(counts.select(F.col("item").alias("neighbour"), F.col("n_item").alias("n_other")), "neighbour").join(F.broadcast(total))  # one row
    lift = F.col("n") * F.col("total") / (F.col("n_item") * F.col("n_other"))
    weight = {"raw": F.col("n").cast("double"), "lift": lift, "pmi": F.log(F.greatest(lift, F.lit(0.001)))}[weighting]
    first = W.partitionBy("item").orderBy(F.desc("weight"), "neighbour")
    kept = joined.where(lift >= min_lift).select("item", "neighbour", weight.alias("weight")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= neighbours)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("item")))
    return kept.select("item", "neighbour", F.when(norm > 0, F.col("weight") / norm).otherwise(0.0).alias("weight"))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """item_a < item_b and the cosine of their vectors, through the neighbours that they share.

    A neighbour is handled as a basket of the items that list it. A popular one may be in the lists of a third of all
    items; its pairs then come from blocks on all partitions, and none is left out. The vectors are written once.
    """
    lists = once(vectors.select("neighbour", F.struct("item", "weight").alias("entry")), "vectors")
    pairs = basket_pairs(lists, "neighbour", "entry")
    product = F.col("item_a.weight") * F.col("item_b.weight")
    return pairs.groupBy(F.col("item_a.item").alias("item_a"), F.col("item_b.item").alias("item_b")).agg(F.sum(product).alias("cosine"))


def close_pairs(lines: DataFrame, least: float, item: str = "item", neighbours: int = 50) -> DataFrame:
    """item_a < item_b and cosine (``least`` or more, above 0) of the lift vectors of ``covisit_vectors``: for many items.

    Same result as ``cosine_pairs`` over those vectors, but neither pairs of items nor products cross as rows. Items are
    dense codes; the tasks send sorted, counted and compressed runs of (item, neighbour) to the item's bucket, which makes
    the vectors. These are written by bucket, and each task multiplies some buckets with others straight from the shared
    folder, so only pairs that reach ``least`` leave it. Products are summed by a hash of their pair first, which is a
    bound for every pair in it; just those that may reach ``least`` are sorted and summed exactly.
    """
    own = written(distinct_items(lines, item=item), "visits")
    codes = dense_codes(item_counts(own), "item")  # codes and counts have 31 bits
    total, large = large_baskets(own, "order_id")
    coded = own.join(codes, "item").select("order_id", F.shiftleft("code", 32).bitwiseOR(F.col("n_item")).alias("entry"))
    runs = basket_blocks(coded, "order_id", "entry", large).mapInArrow(_runs, "bucket long, run binary")

    def vectors(table: pa.Table) -> pa.Table:
        return _vectors(table, total, neighbours)

    path = new_path(own.sparkSession, "vectors")
    made = runs.groupBy("bucket").applyInArrow(vectors, "bucket long, item long, neighbours array<int>, weights array<double>")
    made.write.partitionBy("bucket").parquet(path)
    spark = own.sparkSession
    blocks = sorted({r[0] // HELD for r in spark.read.schema("item long, bucket long").parquet(path).select("bucket").distinct().collect()})
    tasks = [(held, bucket) for held in blocks for bucket in range((held + 1) * HELD)]
    work = spark.createDataFrame(tasks or [(0, 0)], "held long, bucket long")
    parts = max(1, len({(h, b // HELD) for h, b in tasks}))
    spread_out = work.withColumn("_p", F.col("held") * (F.col("held") + 1) / 2 + F.floor(F.col("bucket") / HELD)).repartitionByRange(parts, "_p").sortWithinPartitions("_p", "bucket").drop("_p")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            for h, bucket in zip(b["held"].to_pylist(), b["bucket"].to_pylist()):
                if h != now:
                    now, held = h, _held(path, h)
                yield from _close(_bucket(path, bucket), held, bucket // HELD == h, least)

    near = spread_out.mapInArrow(products, "a long, b long, cosine double")
    side = lambda x: codes.select(F.col("code").alias(x), F.col("item").alias(f"item_{x}"))
    return near.join(side("a"), "a").join(side("b"), "b").select("item_a", "item_b", "cosine")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket and run: the (item, neighbour) of blocks from either side, sorted and counted, by the item's bucket."""
    kept: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        x, y, kx, ky = (np.concatenate(c) for c in zip(*kept))
        key = x << 32 | y
        order = np.argsort(key, kind="stable")
        key, kx, ky = key[order], kx[order], ky[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        key, kx, ky = key[first], kx[first], ky[first]
        bucket = (key >> 32) // BUCKET
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(key)]
        data = [_packed((key >> 32)[a:b], (key & 0xFFFFFFFF)[a:b], kx[a:b], ky[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.record_batch({"bucket": pa.array(bucket[cuts[:-1]], pa.int64()), "run": pa.array(data, pa.binary())})

    for batch in batches:
        left, right = batch["left"], batch["right"]
        lengths = np.diff(left.offsets.to_numpy())
        values = left.flatten().to_numpy()
        code, count = values >> 32, values & 0xFFFFFFFF
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        whole = right.is_null().to_numpy(zero_copy_only=False)
        for m in np.unique(lengths[whole]).tolist():
            if m > 1:
                at = starts[whole & (lengths == m)]
                pick = np.array(list(permutations(range(m), 2)), np.int64) if m <= 32 else np.argwhere(~np.eye(m, dtype=bool))
                step = max(1, AT_ONCE // len(pick))
                for i in range(0, len(at), step):
                    x, y = (at[i : i + step, None] + pick[:, 0]).ravel(), (at[i : i + step, None] + pick[:, 1]).ravel()
                    kept.append((code[x], code[y], count[x], count[y]))
                    size += len(x)
                    if size > AT_ONCE:
                        yield from flush()
                        kept.clear()
                        size = 0
        for i in np.flatnonzero(~whole).tolist():
            s, other = slice(starts[i], starts[i] + lengths[i]), right[i].values.to_numpy()
            c, k = other >> 32, other & 0xFFFFFFFF
            x, y, kx, ky = np.repeat(code[s], len(c)), np.tile(c, lengths[i]), np.repeat(count[s], len(c)), np.tile(k, lengths[i])
            kept += [(x, y, kx, ky), (y, x, ky, kx)]
            size += 2 * len(x)
            if size > AT_ONCE:
                yield from flush()
                kept.clear()
                size = 0
    if any(len(k[0]) for k in kept):
        yield from flush()


def _packed(x: np.ndarray, *columns: np.ndarray) -> bytes:
    data = np.concatenate([(x % BUCKET).astype(np.uint32), *(c.astype(np.uint32) for c in columns)])
    return len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def _vectors(table: pa.Table, total: int, neighbours: int) -> pa.Table:
    bucket = table["bucket"][0].as_py()
    runs = []
    for run in table["run"]:
        raw = run.as_buffer()
        n = int.from_bytes(raw[:8].to_pybytes(), "little")
        runs.append(np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd"), np.uint32).reshape(5, -1))
    x, y, kx, ky, n = np.concatenate(runs, axis=1).astype(np.int64)
    order = np.argsort(x << 32 | y, kind="stable")
    x, y, kx, ky, n = (c[order] for c in (x, y, kx, ky, n))
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    n = np.add.reduceat(n, first)
    x, y = x[first], y[first]
    lift = (n * total) / (kx[first] * ky[first])
    order = np.lexsort((y, -lift, x))
    start = np.searchsorted(x, x)
    order = order[np.arange(len(x)) - start < neighbours]  # x is sorted already, so each item keeps its places
    order.sort()
    x, y, lift = x[order], y[order], lift[order]
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    weight = lift / np.sqrt(np.repeat(np.add.reduceat(lift * lift, begin), np.diff(np.append(begin, len(x)))))
    offsets = pa.array(np.append(begin, len(x)), pa.int32())
    item = x[begin] + bucket * BUCKET
    return pa.table({"bucket": pa.array(np.full(len(begin), bucket), pa.int64()), "item": pa.array(item, pa.int64()), "neighbours": pa.ListArray.from_arrays(offsets, pa.array(y, pa.int32())), "weights": pa.ListArray.from_arrays(offsets, pa.array(weight, pa.float64()))})


def _bucket(path: str, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, neighbour and weight of a bucket's vectors, sorted by item."""
    store, at = fs.FileSystem.from_uri(f"{path}/bucket={bucket}")
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    tables = [pq.ParquetFile(store.open_input_file(f.path)).read() for f in found if f.path.endswith(".parquet")]
    if not tables:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
    t = pa.concat_tables(tables).sort_by("item").combine_chunks()
    lists = t["neighbours"].combine_chunks()
    return np.repeat(t["item"].to_numpy().astype(np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), t["weights"].combine_chunks().flatten().to_numpy()


def _held(path: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, neighbour and weight of a block's buckets, sorted by neighbour."""
    item, neighbour, weight = (np.concatenate(c) for c in zip(*(_bucket(path, block * HELD + i) for i in range(HELD))))
    order = np.argsort(neighbour, kind="stable")
    return item[order], neighbour[order], weight[order]


def _close(own: tuple, held: tuple, same: bool, least: float) -> Iterator[pa.RecordBatch]:
    """a < b and cosine of the items of a bucket and of a block."""
    item, neighbour, weight = own
    if not len(item) or not len(held[0]):
        return
    base, width = int(held[0].min()), int(held[0].max() - held[0].min()) + 1
    one, back = np.unique(neighbour, return_inverse=True)
    low = np.searchsorted(held[1], one)[back]
    many = np.searchsorted(held[1], one, side="right")[back] - low
    ends = np.flatnonzero(np.append(item[1:] != item[:-1], True)) + 1  # after each item
    done = np.cumsum(many)
    at = 0
    while at < len(item):
        before = done[at - 1] if at else 0
        k = np.searchsorted(done[ends - 1], before + AT_ONCE, side="right")
        to = int(max(ends[max(k - 1, 0)], ends[np.searchsorted(ends, at, side="right")]))
        n = many[at:to]
        size = int(n.sum())
        place = np.arange(size) + np.repeat(low[at:to] - (np.cumsum(n) - n), n)
        a, b = np.repeat(item[at:to], n), held[0][place]
        p = np.repeat(weight[at:to], n) * held[2][place]
        if same:
            after = b > a
            a, b, p = a[after], b[after], p[after]
        first = int(item[at])
        key = (a - first).astype(np.int64) * width + (b - base)
        h = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        may = np.bincount(h, p, 1 << BITS)[h] >= least - 1e-9
        key, p = key[may], p[may]
        if len(key):
            order = np.argsort(key, kind="stable")
            key, p = key[order], p[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            cosine = np.add.reduceat(p, new)
            yes = cosine >= least
            key = key[new][yes]
            if len(key):
                yield pa.record_batch({"a": pa.array(key // width + first, pa.int64()), "b": pa.array(key % width + base, pa.int64()), "cosine": pa.array(cosine[yes])})
        at = to


def complements(cosines: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """For each item its k most similar ones of at least ``least``: item, other, cosine, rank."""
    c = cosines.where(F.col("cosine") >= least)
    both = both_ways(c, "other", "cosine")
    return both.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc(F.round("cosine", 6)), "other"))).where(F.col("rank") <= k)


def set_coherence(sets: DataFrame, cosines: DataFrame, key: str = "set_id", items: str = "items") -> DataFrame:
    """Average, least and largest cosine over the pairs of each set; pairs without a common neighbour count 0."""
    one = sets.select(key, F.posexplode(items).alias("at", "x"), F.col(items).alias("_all"))
    pairs = one.select(key, "x", F.explode(F.slice("_all", F.col("at") + 2, F.greatest(F.size("_all") - F.col("at") - 1, F.lit(0)))).alias("y"))
    ordered = pairs.select(key, F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    c = F.coalesce("cosine", F.lit(0.0))
    return ordered.join(cosines, ["item_a", "item_b"], "left").groupBy(key).agg(F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))
