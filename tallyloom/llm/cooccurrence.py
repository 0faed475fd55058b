"""Items that appear together, counted by an external sort of packed 64-bit pair codes.

Items get dense 31-bit codes; a pair is one long, the smaller code above the larger. Each task turns baskets into pair
codes, sorts them and run-length-counts them (a sorted run); Spark's sorter spills and merges the runs by code, and a
stream over each sorted partition adds up the counts of equal codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.baskets import basket_blocks, large_baskets
from ..plans.codes import dense_codes
from ..plans.shared import written

#: Pair codes that a task holds before it sorts them into a run.
RUN = 1 << 21


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often each stands (or the sums of ``counts``)."""
    if counts is None:
        codes = np.sort(codes)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    n = np.diff(np.r_[starts, len(codes)]) if counts is None else np.add.reduceat(counts, starts) if len(codes) else counts
    return codes[starts], n


def _batch(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n.astype(np.int64), pa.int64())], ["pair", "n"])


def _within(flat: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Pair codes of all pairs inside each list, at most RUN or those of one list at a time; lists of one length are done
    at once."""
    sizes = np.diff(offsets)
    for k in np.unique(sizes):
        if k >= 2:
            at = offsets[:-1][sizes == k]
            i, j = np.triu_indices(k, 1)
            step = max(1, RUN // len(i))
            for a in range(0, len(at), step):
                rows = flat[at[a : a + step, None] + np.arange(k)]
                x, y = rows[:, i], rows[:, j]
                yield (np.minimum(x, y) << 32 | np.maximum(x, y)).ravel()


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Pair codes of the pairs inside ``left`` (where right is null) or between ``left`` and ``right``."""
    for b in batches:
        left, right = b.column("left"), b.column("right")
        inside = right.is_null().to_numpy(zero_copy_only=False)
        own = left.filter(pa.array(inside))
        yield from _within(own.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64))
        for k in np.flatnonzero(~inside):
            x, y = (np.asarray(c[int(k)].values, np.int64) for c in (left, right))
            yield (np.minimum(x[:, None], y) << 32 | np.maximum(x[:, None], y)).ravel()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs: each leaves the task when it has RUN codes."""
    held, size = [], 0
    for c in _codes(batches):
        held.append(c)
        size += len(c)
        if size >= RUN:
            yield _batch(*_runs(np.concatenate(held)))
            held, size = [], 0
    if size:
        yield _batch(*_runs(np.concatenate(held)))


def _merge(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up equal codes of a sorted stream; the last code of a batch waits for the next."""
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if b.num_rows:
                code, n = _runs(np.r_[code, b.column("pair").to_numpy()], np.r_[n, b.column("n").to_numpy()])
                done = n[:-1] >= least
                yield _batch(code[:-1][done], n[:-1][done])
                code, n = code[-1:], n[-1:]
        if len(n) and n[0] >= least:
            yield _batch(code, n)

    return merge


def count_pairs(baskets: DataFrame, large: DataFrame | None, least: int = 1) -> DataFrame:
    """pair (packed codes) and n, for the pairs that stand in at least ``least`` baskets.

    baskets: basket, code (below 2^31, else the job fails), each pair of them once; large: the baskets that
    ``large_baskets`` names. No task pairs up more than one block
    (two chunks) of a large basket at a time.
    """
    code = F.when(F.col("code").between(0, (1 << 31) - 1), F.col("code")).otherwise(F.raise_error(F.lit("code beyond 31 bits")).cast("long"))
    rows = basket_blocks(baskets.select("basket", code.alias("code")), "basket", "code", large)
    runs = rows.mapInArrow(_pairs, "pair long, n long")
    return runs.repartition(F.col("pair")).sortWithinPartitions("pair").mapInArrow(_merge(least), "pair long, n long")


def log_odds(n: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """Log odds ratio of a pair with half a basket added to each cell."""
    both, a, b = n + 0.5, n_a - n + 0.5, n_b - n + 0.5
    neither = total - n_a - n_b + n + 0.5
    return F.log(both * neither / (a * b))


def item_pairs(lines: DataFrame, least: int = 10, lift: float = 5.0, other_group: bool = True) -> DataFrame:
    """Pairs of items that stand together in at least ``least`` baskets and ``lift`` times as often as by chance.

    lines: basket, item, grp (any types; rows with a null basket or item don't count, repeated rows count once).
    Returns item_a < item_b, n, n_a, n_b, baskets, lift, log_odds. With ``other_group`` the two must belong to different
    groups: an item's groups are all that its lines name, an item without any differs from all.

    Two bounds leave out items that can't be in any such pair: n(a,b) <= n(x), so n(x) >= least; and
    n(a,b) * N >= lift * n(a) * n(b) with n(a,b) <= min, so max(n(a), n(b)) <= N / lift. No other item is left out, so an
    item that a third of all baskets hold costs nothing, and the result is exact.
    """
    own = lines.where(F.col("basket").isNotNull() & F.col("item").isNotNull())
    baskets = written(own.select("basket", "item").distinct(), "baskets")
    total, large = large_baskets(baskets, "basket")
    items = baskets.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where((F.col("n_item") >= least) & (F.col("n_item") * lift <= total))
    groups = own.where(F.col("grp").isNotNull()).select("item", "grp").distinct().groupBy("item").agg(F.collect_list("grp").alias("grps"))
    coded = written(dense_codes(items, "item").join(groups, "item", "left"), "items")
    pairs = count_pairs(baskets.join(coded.select("item", "code"), "item").select("basket", "code"), large, least)
    side = lambda x: coded.select(F.col("code").alias(f"code_{x}"), F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}"), F.col("grps").alias(f"grps_{x}"))
    joined = (
        pairs.select(F.shiftright("pair", 32).alias("code_a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("code_b"), "n")
        .join(side("a"), "code_a")
        .join(side("b"), "code_b")
        .where(F.col("n") * total >= lift * F.col("n_a") * F.col("n_b"))
    )
    if other_group:
        joined = joined.where(~F.coalesce(F.arrays_overlap("grps_a", "grps_b"), F.lit(False)))
    n = F.lit(total).cast("long")
    return joined.select("item_a", "item_b", "n", "n_a", "n_b", n.alias("baskets"), (F.col("n") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"), log_odds(F.col("n"), F.col("n_a"), F.col("n_b"), n).alias("log_odds"))
