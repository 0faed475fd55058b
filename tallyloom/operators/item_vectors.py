"""Skip-gram vectors of items from ordered baskets, with no matrix in the driver or in any one task."""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.codes import dense_codes
from ..plans.shared import new_path, written

#: Vectors of a part; pairs sorted at once (of two parts there may be twice as many); lines of a row, and lines that are handled at once.
ROWS, PAIRS, ROW, AT_ONCE = 1 << 19, 1 << 22, 512, 1 << 20
#: Pairs of a batch of tiles, of a tile at most, how many a tile should have, and batches that pairs make if they can.
BATCH, TILE, FULL, BATCHES = 4096, 256, 96, 128


def item_vectors(lines: DataFrame, item: str, position: str, size: int = 64, window: int = 3, epochs: int = 5, seed: int = 42, rate: float = 0.025) -> DataFrame:
    """item and vector (array of doubles) for each item of an order with at least two lines.

    The model is Word2Vec's: skip-gram with hierarchical softmax over the Huffman tree of the items' counts; in each
    epoch a pair of lines at distance d counts with probability (window - d + 1) / window. Items are numbered by falling
    count, so both their canonical Huffman codes and the numbers of the tree's nodes follow from the histogram of counts,
    and items are cut into parts of equal weight and of ROWS at most. A task trains the pairs of two parts: it holds the
    vectors of one and the tree nodes above the items of the other. In one round no two tasks share a part; a round for
    each part is an epoch. The few nodes above several parts (a path or two for each) are averaged after each round.
    Vectors and nodes lie in the shared folder between rounds. Null orders and items are left out. Vectors depend on
    the seed and on the number of parts.
    """
    assert 1 <= window < 8, window
    spark = lines.sparkSession
    own = lines.where(F.col("order_id").isNotNull() & F.col(item).isNotNull()).select("order_id", F.col(position).alias("_at"), F.col(item).alias("item"))
    ordered = own.repartition("order_id").sortWithinPartitions("order_id", "_at", F.col("item").cast("string")).select("order_id", "item")
    kind = own.schema["item"].dataType.simpleString()
    rows = written(ordered.mapInArrow(_sequences(window), f"items array<{kind}>, sizes array<int>, seen int"), "sequences")
    new = rows.select(F.explode(F.slice("items", F.col("seen") + 1, F.size("items"))).alias("item"))
    counts = new.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).withColumn("_less", -F.col("n_item"))
    path = new_path(spark, "item-codes")
    dense_codes(counts, ["_less", "item"]).select("item", "code", "n_item").write.parquet(path)
    codes = spark.read.parquet(path)
    counted = sorted(((r["n_item"], r["count"]) for r in codes.groupBy("n_item").count().collect()), reverse=True)  # below the root of twice the lines
    if not counted:
        return codes.select("item", F.array().cast("array<double>").alias("vector"))
    n, k = (np.array(c, np.int64) for c in zip(*counted))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(k.sum() / ROWS), math.ceil(math.sqrt(window * (n * k).sum() / PAIRS)))
    cuts = _cuts(n, k, parts)
    pairs, at = new_path(spark, "item-pairs"), new_path(spark, "item-vectors")
    rows.select("items", "sizes", "seen").mapInArrow(_pairs(path, cuts, window), "bucket int, run binary").write.partitionBy("bucket").parquet(pairs)
    spark.sparkContext._jvm.System.gc()  # the shuffle files of what is written by now can go
    last = _rounds(spark, _Tree(_lengths(n, k), cuts), pairs, at, size, window, epochs, seed, rate)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b["code"].to_numpy()
            part = np.searchsorted(cuts, code, side="right") - 1
            out = np.empty((len(code), size), np.float64)
            for p in np.unique(part).tolist():
                mine = part == p
                place = code[mine] - cuts[p]
                out[mine] = _read(f"{at}/x-{p}-{last}", size, int(place.min()), int(place.max()) + 1)[place - place.min()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1) * size, pa.int32()), pa.array(out.ravel()))
            yield pa.record_batch({"item": b["item"], "vector": lists})

    return codes.select("item", "code").mapInArrow(vectors, f"item {kind}, vector array<double>")


def _sequences(window: int) -> Callable:
    """Lines in order of their orders, as rows of whole orders: items, the sizes of the orders, and how many items at the
    start an earlier row has already (the last ones of an order that is too long for one row). Single lines are dropped."""

    def flush(order: pa.Array, item: pa.Array, seen: int, end: bool) -> tuple[list[tuple], pa.Array, pa.Array, int]:
        new = pc.not_equal(order[1:], order[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1]).astype(np.int64)
        sizes = np.diff(np.append(starts, len(order)))
        rest, carried = len(order), 0
        if not end:
            if sizes[-1] < AT_ONCE // 16:
                rest, starts, sizes = int(starts[-1]), starts[:-1], sizes[:-1]
                carried = 0 if len(starts) else seen
            else:
                rest, carried = len(order) - window, window
        kept = sizes > 1
        if seen and len(sizes) and sizes[0] == seen:
            kept[0] = False
        rows, s, z = [], starts[kept], sizes[kept]
        at = 0
        done = np.cumsum(z)
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + ROW, side="right")))
            pick = np.arange(int(z[at:to].sum())) + np.repeat(s[at:to] - (done[at:to] - z[at:to] - (done[at - 1] if at else 0)), z[at:to])
            rows.append((pick, z[at:to], seen if at == 0 and s[0] == 0 else 0))
            at = to
        return rows, order[rest:], item[rest:], carried

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders: list[pa.Array] = []
        items: list[pa.Array] = []
        seen = size = 0

        def out(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal orders, items, seen, size
            order, item = pa.concat_arrays(orders), pa.concat_arrays(items)
            rows, o, i, seen = flush(order, item, seen, end)
            orders, items, size = [o], [i], len(o)
            if rows:
                picks, sizes, old = zip(*rows)
                lists = pa.ListArray.from_arrays(_offsets(picks), item.take(pa.array(np.concatenate(picks))))
                yield pa.record_batch({"items": lists, "sizes": pa.ListArray.from_arrays(_offsets(sizes), pa.array(np.concatenate(sizes), pa.int32())), "seen": pa.array(old, pa.int32())})

        for b in batches:
            orders.append(b["order_id"])
            items.append(b["item"])
            size += len(b)
            if size >= AT_ONCE // 4:
                yield from out(False)
        if size:
            yield from out(True)

    return run


def _offsets(lists: tuple) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())


def _cuts(n: np.ndarray, k: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts begin among the items by falling count (k items of count n each), with the end: equal weight, ROWS at most."""
    items, weight = np.cumsum(k), np.cumsum(n * k)
    goal = weight[-1] * np.arange(1, parts) / parts
    c = np.searchsorted(weight, goal)
    own = items[c] - np.floor((weight[c] - goal) / n[c]).astype(np.int64)
    own = np.unique(np.concatenate([[0], own, [items[-1]]]))
    return np.unique(np.concatenate([np.linspace(a, b, math.ceil((b - a) / ROWS) + 1).astype(np.int64) for a, b in zip(own, own[1:])]))


def _lengths(n: np.ndarray, k: np.ndarray) -> list[int]:
    """How many items have a Huffman code of 0, 1, 2, ... bits, where k items have the count n each.

    Equal nodes are merged together: the heap has (weight, node, how many of it).
    """
    heap = [(int(w), i, int(m)) for i, (w, m) in enumerate(zip(n, k))]
    heapq.heapify(heap)
    made: list[tuple[int, int]] = []
    while True:
        w, x, m = heapq.heappop(heap)
        if m > 1:
            heapq.heappush(heap, (2 * w, len(n) + len(made), m // 2))
            made.append((x, x))
            if m % 2:
                heapq.heappush(heap, (w, x, 1))
        elif heap:
            v, y, l = heapq.heappop(heap)
            heapq.heappush(heap, (w + v, len(n) + len(made), 1))
            made.append((x, y))
            if l > 1:
                heapq.heappush(heap, (v, y, l - 1))
        else:
            break
    depths: dict[int, Counter] = defaultdict(Counter, {x: Counter({0: 1})})
    for i in reversed(range(len(made))):
        for d, c in depths.pop(len(n) + i).items():
            for child in made[i]:
                depths[child][d + 1] += c
    total: Counter = sum((depths[i] for i in range(len(n))), Counter())
    return [total[d] for d in range(max(total) + 1)]


class _Tree:
    """The canonical Huffman tree of items by falling count, and the nodes above each part.

    At each depth the leaves come first, then the inner nodes, so a node is its depth and the first bits of a code. Above
    the items of a part lie, at each depth, the nodes ``low`` to ``high``; their rows in the part's matrix begin at ``base``.
    """

    def __init__(self, leaves: list[int], cuts: np.ndarray):
        self.cuts = cuts
        self.before = np.concatenate([[0], np.cumsum(leaves)])  # items with codes shorter than d bits
        first, here = [0], 1
        for d, m in enumerate(leaves):
            first.append(2 * (first[d] + m))
            here = 2 * (here - m)
        assert here == 0, leaves
        self.first = np.array(first, np.int64)  # the first code of d bits
        self.low, self.high, self.base, self.nodes = [], [], [], []
        above: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
            deepest = int(self.length(np.array([b - 1]))[0])
            d = np.arange(deepest)
            begin, end = np.maximum(a, self.before[d + 1]), np.full(deepest, b - 1)
            low, high = self.prefix(begin, d), self.prefix(end, d)
            base = np.concatenate([[0], np.cumsum(high - low + 1)])
            for x in {(int(i), int(p)) for ends in (low, high) for i, p in zip(d, ends)}:
                above[x].append((q, int(base[x[0]] + x[1] - low[x[0]])))
            self.low.append(low)
            self.high.append(high)
            self.base.append(base[:-1])
            self.nodes.append(int(base[-1]))
        #: Rows of a part's matrix that other parts have as well, and the numbers of those nodes.
        self.rows: list[list[int]] = [[] for _ in self.low]
        self.shared: list[list[int]] = [[] for _ in self.low]
        self.many = 0
        for _, places in sorted(above.items()):
            if len(places) > 1:
                for q, row in places:
                    self.rows[q].append(row)
                    self.shared[q].append(self.many)
                self.many += 1

    def length(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.before, rank, side="right") - 1

    def prefix(self, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
        length = self.length(rank)
        return (self.first[length] + rank - self.before[length]) >> (length - depth)


def _pairs(codes: str, cuts: np.ndarray, window: int) -> Callable:
    """Pairs of lines of an order at a distance up to ``window``, once each: packed runs for each pair of parts."""

    def numbers(items: pa.Array) -> np.ndarray:
        out = np.full(len(items), -1, np.int64)
        for file in _files(codes):  # the dictionary comes in the blocks that it was written in
            with pq.ParquetFile(file) as one:
                for g in range(one.num_row_groups):
                    t = one.read_row_group(g, ["item", "code"]).combine_chunks()
                    place = pc.index_in(items, value_set=t["item"].combine_chunks()).fill_null(-1).to_numpy()
                    out = np.where(place >= 0, t["code"].to_numpy()[place], out)
        assert (out >= 0).all()
        return out

    def packed(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items, sizes = b["items"], b["sizes"].flatten().to_numpy()
        code = numbers(items.flatten())
        order = np.repeat(np.arange(len(sizes)), sizes)
        lengths = pc.list_value_length(items).to_numpy()
        old = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat(b["seen"].to_numpy(), lengths)
        keys = []
        for d in range(1, window + 1):
            x, y = code[:-d], code[d:]
            yes = (order[:-d] == order[d:]) & ~old[d:]
            x, y = x[yes], y[yes]
            keys.append(np.minimum(x, y) << 33 | np.maximum(x, y) << 3 | d)
        key = np.sort(np.concatenate(keys))
        if not len(key):
            return
        x, y, d = key >> 33, key >> 3 & ((1 << 30) - 1), key & 7
        p, q = (np.searchsorted(cuts, c, side="right") - 1 for c in (x, y))
        x, y, bucket = x - cuts[p], y - cuts[q], p * (len(cuts) - 1) + q
        by = np.argsort(bucket, kind="stable")
        x, y, d, bucket = x[by], y[by], d[by], bucket[by]
        ends = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
        runs = [_packed(x[i:j], y[i:j], d[i:j]) for i, j in zip(ends, ends[1:])]
        yield pa.record_batch({"bucket": pa.array(bucket[ends[:-1]], pa.int32()), "run": pa.array(runs, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = np.cumsum(pc.list_value_length(b["items"]).to_numpy())
            at = 0
            while at < len(done):
                to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, side="right")))
                yield from packed(b.slice(at, to - at))
                at = to

    return run


def _packed(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> bytes:
    """x is sorted; bytes of the same weight lie together."""
    data = np.concatenate([np.diff(x, prepend=0), y]).astype(np.uint32).view(np.uint8).reshape(2, len(x), 4).transpose(0, 2, 1).tobytes() + d.astype(np.uint8).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(run: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = run.as_buffer()
    n = int.from_bytes(raw[:8].to_pybytes(), "little")
    data = np.frombuffer(pa.decompress(raw[8:], 9 * n, codec="zstd"), np.uint8)
    x, y = np.ascontiguousarray(data[: 8 * n].reshape(2, 4, n).transpose(0, 2, 1)).view(np.uint32).reshape(2, n)
    return np.cumsum(x, dtype=np.int64), y.astype(np.int64), data[8 * n :]


def _files(path: str) -> list:
    """Open files of a written frame or of a bucket of it, by name."""
    store, at = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return [store.open_input_file(p) for p in sorted(f.path for f in found) if p.endswith(".parquet")]


def _bucket(path: str, parts: int, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items of p, items of q and distances of their pairs, about PAIRS or fewer at once."""
    kept, size = [], 0
    for file in _files(f"{path}/bucket={min(p, q) * parts + max(p, q)}"):
        with pq.ParquetFile(file) as one:
            for b in one.iter_batches(16, columns=["run"]):
                for run in b["run"]:
                    x, y, d = _unpacked(run)
                    kept += [(x, y, d)] * (p <= q) + [(y, x, d)] * (p >= q)  # inside a part either item stands beside the other
                    size += len(x) * (1 + (p == q))
                    if size >= PAIRS:
                        yield tuple(np.concatenate(c) for c in zip(*kept))
                        kept, size = [], 0
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept))


def _read(path: str, size: int, start: int, end: int) -> np.ndarray:
    store, at = fs.FileSystem.from_uri(path)
    out = np.empty((end - start, size), np.float32)
    view, done = memoryview(out).cast("B") if out.size else b"", 0
    with store.open_input_file(at) as f:
        f.seek(start * size * 4)
        while done < len(view):
            got = f.readinto(view[done : done + (1 << 24)])
            if not got:
                raise EOFError(path)
            done += got
    return out


def _write(path: str, rows: np.ndarray) -> None:
    """Whole or not at all, so a task may run twice."""
    store, at = fs.FileSystem.from_uri(path)
    new = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(new) as f:
        f.write(memoryview(rows).cast("B") if rows.size else b"")
    store.move(new, at)


def _rounds(spark, tree: _Tree, pairs: str, at: str, size: int, window: int, epochs: int, seed: int, rate: float) -> int:
    """Trains all pairs in each epoch; the number of the last round, whose files ``x-part-round`` have the vectors."""
    parts = len(tree.low)
    store, folder = fs.FileSystem.from_uri(at)
    store.create_dir(folder, recursive=True)
    top = np.zeros((tree.many, size), np.float32)
    sent = spark.sparkContext.broadcast((tree.cuts, tree.before, tree.first))
    step = 0
    for epoch in range(epochs):
        for turn in np.random.default_rng([seed, epoch]).permutation(parts).tolist():
            alpha = rate * max(1 - step / (epochs * parts), 1e-4)
            plan = [(p, q, tree.low[q], tree.high[q], tree.base[q], tree.nodes[q], tree.rows[q], top[tree.shared[q]]) for p in range(parts) for q in [(p + turn) % parts]]

            def train(task: tuple, step: int = step, epoch: int = epoch, alpha: float = alpha) -> tuple[int, bytes]:
                p, q, low, high, base, nodes, rows, values = task
                cuts, before, first = sent.value
                n = int(cuts[p + 1] - cuts[p])
                if step:
                    x, y = _read(f"{at}/x-{p}-{step - 1}", size, 0, n), _read(f"{at}/y-{q}-{step - 1}", size, 0, nodes)
                else:
                    x, y = (np.random.default_rng([seed, p]).random((n, size), np.float32) - 0.5) / np.float32(size), np.zeros((nodes, size), np.float32)
                y[rows] = values
                random = np.random.default_rng([seed, epoch, p, q])
                for context, word, d in _bucket(pairs, parts, p, q):
                    drawn = random.random(len(d), np.float32) * window < window + 1 - d.astype(np.float32)
                    _train(x, y, context[drawn], word[drawn] + cuts[q], before, first, low, high, base, alpha, random)
                _write(f"{at}/x-{p}-{step}", x)
                _write(f"{at}/y-{q}-{step}", y)
                return q, y[rows].tobytes()

            # the values of the nodes above several parts: some paths of the tree
            back = spark.sparkContext.parallelize(plan, parts).map(train).collect()
            total, times = np.zeros(top.shape, np.float64), np.zeros(tree.many)
            for q, data in back:
                total[tree.shared[q]] += np.frombuffer(data, np.float32).reshape(-1, size)
                times[tree.shared[q]] += 1
            top = (total / times[:, None]).astype(np.float32)
            for p in range(parts if step else 0):
                store.delete_file(f"{folder}/x-{p}-{step - 1}")
                store.delete_file(f"{folder}/y-{p}-{step - 1}")
            step += 1
    for q in range(parts):
        store.delete_file(f"{folder}/y-{q}-{step - 1}")
    sent.unpersist()
    return step - 1


def _train(x: np.ndarray, y: np.ndarray, context: np.ndarray, word: np.ndarray, before: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray, alpha: float, random: np.random.Generator) -> None:
    """Changes the vectors x and the nodes y by pairs of a context's row and a word's number among all items.

    The pairs of neighbouring words, whose paths differ in their last bits only, make a tile: its contexts are multiplied
    with all the nodes of these paths at once, and nodes that aren't on a word's path count nothing.
    """
    if not len(word):
        return
    key = np.sort(word << 32 | context)
    word, context = key >> 32, key & 0xFFFFFFFF
    length = np.searchsorted(before, word, side="right") - 1
    code = first[length] + word - before[length]
    todo, batch = [], min(BATCH, max(FULL, len(word) // BATCHES))
    bounds = np.concatenate([[0], np.flatnonzero(length[1:] != length[:-1]) + 1, [len(length)]]).tolist()
    for a, b in zip(bounds, bounds[1:]):
        bits = int(length[a])
        if bits:
            words = 1 + int(np.count_nonzero(word[a + 1 : b] != word[a : b - 1]))
            s = min(max(round(math.log2(FULL * words / (b - a))), 0), 4, bits)
            group = code[a:b] >> s
            starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
            sizes = np.diff(np.append(starts, b - a))
            tiles = -(-sizes // TILE)
            nth = np.arange(int(tiles.sum())) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            start = np.repeat(starts, tiles) + nth * TILE + a
            many = np.minimum(np.repeat(sizes, tiles) - nth * TILE, TILE)
            order = random.permutation(len(start))
            order = order[np.argsort(many[order], kind="stable")]
            at = len(order)
            while at:
                to, at = at, max(0, at - max(1, batch // int(many[order[at - 1]])))
                todo.append((bits, s, start[order[at:to]], many[order[at:to]]))
    for i in random.permutation(len(todo)).tolist():
        bits, s, start, many = todo[i]
        _tiles(x, y, context, code, bits, s, start, many, low, high, base, alpha)


def _below(s: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the last s bits: which of the 2^s - 1 nodes over them are on its path, and whether the path goes left."""
    on, left = np.zeros((1 << s, (1 << s) - 1), np.float32), np.zeros((1 << s, (1 << s) - 1), np.float32)
    for v in range(1 << s):
        for j in range(s):
            node = (1 << j) - 1 + (v >> (s - j))
            on[v, node], left[v, node] = 1, 1 - (v >> (s - j - 1) & 1)
    return on, left


BELOW = [_below(s) for s in range(5)]


def _tiles(x: np.ndarray, y: np.ndarray, context: np.ndarray, code: np.ndarray, bits: int, s: int, start: np.ndarray, many: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray, alpha: float) -> None:
    k = np.arange(int(many.max()))
    there = k < many[:, None]
    at = np.where(there, start[:, None] + k, start[:, None])
    c = context[at]
    above = bits - s
    prefix = code[start] >> s
    depth = np.arange(above)
    node = base[:above] + (prefix[:, None] >> (above - depth)) - low[:above]
    left = (1 - (prefix[:, None] >> (above - depth - 1) & 1)).astype(np.float32)
    if s:
        j = np.repeat(np.arange(s), 1 << np.arange(s))
        h = np.arange((1 << s) - 1) - ((1 << j) - 1)
        d = above + j
        inner = np.clip((prefix[:, None] << j) + h, low[d], high[d])  # those outside are on no path
        node = np.concatenate([node, base[d] + inner - low[d]], axis=1)
        end = code[at] & ((1 << s) - 1)
        on, goes = (b.take(end, axis=0) for b in BELOW[s])
    v, u = x.take(c, axis=0), y.take(node, axis=0)
    g = v @ u.transpose(0, 2, 1)
    np.clip(g, -30, 30, out=g)
    np.negative(g, out=g)
    np.exp(g, out=g)
    g += 1
    np.reciprocal(g, out=g)
    np.subtract(left[:, None], g[:, :, :above], out=g[:, :, :above])
    if s:
        g[:, :, above:] *= on
        np.subtract(goes, g[:, :, above:], out=g[:, :, above:])
    whole = bool(there.all())
    if not whole:
        g *= there[:, :, None]
    vv = np.einsum("tkc,tkc->tk", v, v) * there
    uu = np.einsum("tnc,tnc->tn", u, u)
    bend_v, bend_u = np.repeat(uu[:, :above].sum(axis=1)[:, None], len(k), axis=1), np.repeat(vv.sum(axis=1)[:, None], above, axis=1)
    if s:
        bend_v = bend_v + (on @ uu[:, above:, None])[:, :, 0]
        bend_u = np.concatenate([bend_u, (vv[:, None] @ on)[:, 0]], axis=1)
    dv, du = g @ u, g.transpose(0, 2, 1) @ v
    size = x.shape[1]
    if whole:
        _add(x, c.ravel(), v.reshape(-1, size), dv.reshape(-1, size), bend_v.ravel(), alpha)
    else:
        _add(x, c[there], v[there], dv[there], bend_v[there], alpha)
    _add(y, node.ravel(), u.reshape(-1, size), du.reshape(-1, size), bend_u.ravel(), alpha)


def _add(m: np.ndarray, row: np.ndarray, now: np.ndarray, gradient: np.ndarray, bend: np.ndarray, alpha: float) -> None:
    """Adds alpha times the sum of the gradients of each row, less where a sum of so many would overshoot.

    now: the rows as they are; the gradients are changed. The loss of a row bends by a quarter of ``bend`` (squared
    lengths of the vectors it was multiplied with) at most; a step of four times its inverse never makes the loss larger.
    """
    order = np.argsort(row, kind="stable")
    own = row[order]
    starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    times = np.diff(np.append(starts, len(own)))
    step = np.minimum(np.float32(alpha), 4 / np.maximum(np.add.reduceat(bend[order], starts), np.float32(1e-9))).astype(np.float32)
    each = np.empty(len(row), np.float32)
    each[order] = np.repeat(step, times)
    gradient *= each[:, None]
    some = times > 1
    if some.any():
        rows, n = order[np.repeat(some, times)], times[some]
        if len(n) * len(rows) <= 1 << 18:
            sums = np.zeros((len(n), len(rows)), np.float32)
            sums[np.repeat(np.arange(len(n)), n), np.arange(len(rows))] = 1
            total = sums @ gradient[rows]
        else:
            total = np.add.reduceat(gradient[rows], np.cumsum(n) - n, axis=0)
    gradient += now
    whole = f"V{gradient.itemsize * m.shape[1]}"  # a row is moved as one value
    m.view(whole).ravel()[row] = gradient.view(whole).ravel()
    if some.any():
        m[own[starts[some]]] = now[order[starts[some]]] + total
