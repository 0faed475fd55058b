from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tallyloom.functions.ids import id_number
from tallyloom.operators.orphans import RANGE, compressed, expanded, find_orphans, orphan_report

from .conftest import rows

REFS = "relation string, record_key string, key long, at timestamp"
PARENTS = "relation string, key long, deleted boolean, created_at timestamp, record_key string"


def test_ids_in_every_spelling(spark):
    cases = [("gid://shopify/Order/900001", 900001), (" gid://shopify/Order/7 ", 7), ("000074", 74), ("Z2lkOi8vc2hvcGlmeS9PcmRlci85MDAwOTM=", 900093), ("Z2lkOi8vc2hvcGlmeS9PcmRlci85MDAwOTM", 900093), (None, None), ("", None), ("unknown", None), ("9" * 30, None)]
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string")
    assert [r[0] for r in d.orderBy("i").select(id_number(F.col("x"))).collect()] == [b for _, b in cases]


def test_kinds_against_brute_force(spark):
    t = datetime
    parents = [("r", k, k % 7 == 0, t(2024, 1 + k % 6, 1 + k % 28, 3), "x") for k in range(0, 400, 3)] + [("r", 21, False, t(2024, 5, 30), "x"), ("r", 9, None, None, "x"), ("r", None, True, None, "x"), ("other", 1, False, None, "x")]
    refs = [("r", f"k{k}", k, t(2024, 1 + (k * 5) % 6, 1 + (k * 11) % 28, k % 24)) for k in range(200)] * 2
    refs += [("r", f"hot{i}", 1, t(2024, 3, 3)) for i in range(500)] + [("r", "no time", 3, None), ("r", "null", None, t(2024, 1, 1)), ("other", "k1", 1, None), ("empty", "z", 5, t(2024, 2, 2)), ("r", "edge", 6, t(2024, 1, 5, 3)), ("r", "minus", -70, t(2024, 2, 2))]
    facts: dict = {}
    for r, k, d, c, _ in parents:
        if k is not None:
            was = facts.get((r, k), (True, datetime.max))
            facts[r, k] = (was[0] and bool(d), min(was[1], c or datetime.min))
    want = set()
    for r, name, k, at in refs:
        if k is None:
            continue
        f = facts.get((r, k))
        kind = "missing" if f is None else "deleted" if f[0] else "late" if at is not None and f[1] > datetime.min and (f[1] - at).total_seconds() > 2 * 86400 else None
        if kind:
            want.add((r, name, kind))
    found = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert set(rows(found, "relation", "record_key", "kind")) == want
    assert {k for _, _, k in want} == {"missing", "deleted", "late"}
    report = orphan_report(found)
    assert report.agg(F.sum("orphans")).first()[0] == found.count()
    assert report.where("month = '2024-03'").count() > 0


def test_bitmaps_in_both_forms():
    r = np.random.default_rng(1)
    for share in (0.0, 0.001, 0.05, 0.5, 1.0):
        bits = r.random(RANGE) < share
        raw = np.packbits(bits, bitorder="little").tobytes()
        assert (expanded(compressed(raw)) == bits).all()
        assert len(compressed(raw)) <= min(2 * bits.sum() + (bits.sum() == 0), RANGE // 8 + 1) or share > 0.05


def test_texts_as_keys_over_several_ranges(spark):
    n = RANGE * 2 + 100
    refs = spark.range(n).selectExpr("'r' AS relation", "cast(id as string) AS record_key", "concat('key ', id) AS key", "timestamp'2024-01-05 00:00:00' AS at")
    parents = spark.range(n).where("id % 1000 <> 7").selectExpr("'r' AS relation", "concat('key ', id) AS key", "id % 1000 = 8 AS deleted", "cast(null as timestamp) AS created_at")
    found = {(r["record_key"], r["kind"]) for r in find_orphans(refs, parents).collect()}
    assert found == {(str(i), "missing") for i in range(7, n, 1000)} | {(str(i), "deleted") for i in range(8, n, 1000)}


def test_empty_tables(spark):
    none_r, none_p = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    assert find_orphans(none_r, none_p).count() == 0
    one = spark.createDataFrame([("r", "a", 64, None)], REFS)
    assert rows(find_orphans(one, none_p), "record_key", "kind") == [("a", "missing")]
