from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ingest as I
from tallyloom.sources import files
from tallyloom.streaming import windows as S

from .conftest import rows


def test_headers(spark):
    names = ["createdAt", "Published Scope", '"sku"', "inventory_policy.1", "productHTMLTitle", "Line/Item Name", "Line__Item", "Variant Price", "status", "ID"]
    want = ["created_at", "published_scope", '"sku"', "inventory_policy.1", "product_html_title", "line_item_name", "line_item", "price", "product_status", "id"]
    assert [I.canonical(n) for n in names] == want
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(I.canonical_column(F.col("n"))).collect()] == want
    d = spark.createDataFrame([tuple("abc")], ["createdAt", "x y", "CreatedAt"])
    assert I.with_canonical_headers(d).columns == ["created_at", "x_y", "created_at_2"]


def test_kinds_and_required_columns():
    assert I.detect_kind([" Inventory_Item_Id", "location_id", "available"]) == "inventory_levels" and I.detect_kind(["x"]) is None
    assert I.detect_kind(["order_id", "sku"]) == "orders" and I.detect_kind(["variant_id", "product_id", "product_title"]) == "catalog_joined"
    assert I.schema_errors("orders", ["createdAt"]) == (["lineItemQuantity", "originalUnitPrice"], [("order_id", "orderId", "name"), ("variantId", "variant_id", "sku")])
    assert I.schema_errors("orders", ["Created At", "line_item_quantity", "originalUnitPrice", "name", "variant id"]) == ([], [])
    I.validate_schema("inventory_levels", ["inventoryItemId", "location_id", "available", "updated at"])
    for kind, columns, said in (("orders", ["createdAt"], "one needed of: name, orderId, order_id"), ("nothing", [], "unknown kind")):
        with pytest.raises(ValueError, match=said):
            I.validate_schema(kind, columns)


def test_decimals_in_any_depth_become_doubles(spark):
    d = spark.sql("select 1.5BD as a, array(struct(2.5BD as x, 'k' as y)) as b, map('m', 3.5BD) as c, 4 as n")
    assert I.decimals_as_doubles(d).dtypes == [("a", "double"), ("b", "array<struct<x:double,y:string>>"), ("c", "map<string,double>"), ("n", "int")]
    assert I.known_columns(d, ["n", "zz", "a"]).columns == ["n", "a"]


def test_compatible_text(spark):
    d = spark.createDataFrame([(" ＡＢＣ ﬁne ², ",), (None,), ("",)], "x string")
    assert [r[0] for r in d.select(I.compatible_text(F.col("x"))).collect()] == ["ABC fine 2,", None, ""]


def test_coercions(spark):
    d = spark.createDataFrame([(None,), ("",), (" 7.9 ",), ("x",), ("1e3",)], "x string")
    assert [r[0] for r in d.select(I.lenient_int(F.col("x"))).collect()] == [0, 0, 7, 0, 1000]
    assert [r[0] for r in d.select(I.synthetic_sku(F.col("x"), F.lit("gid/1234567890123"))).collect()][:3] == ["no-sku-4567890123", "no-sku-4567890123", "no-sku-7.9"]
    assert d.select(I.title_words(F.lit("big-red  lamp of the sea"))).first()[0] == "Big Red Lamp Of"


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q", b', ["x", "y"]), (2, None, [])], "k int, s string, l array<string>")
    files.write_csv(d, f"{tmp_path}/c")
    assert rows(files.read_csv(spark, f"{tmp_path}/c", "k int, s string, l string")) == [(1, 'a "q", b', "x; y"), (2, None, None)]
    for v in (1, 2):
        files.overwrite_partitions(spark.createDataFrame([(g, v) for g in range(v)][: 3 - v], "g int, v int"), f"{tmp_path}/p", ["g"])
    assert rows(spark.read.parquet(f"{tmp_path}/p"), "g", "v") == [(0, 2)]
    made = []

    def make(keys):
        made.append(sorted(r[0] for r in keys.collect()))
        return keys.select("key", F.upper("key").alias("value"), F.lit("2024-02-01").cast("timestamp").alias("expires_at"))

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    files.cached(spark, f"{tmp_path}/k", keys("a", "b"), make, "2024-01-01")
    assert rows(files.cached(spark, f"{tmp_path}/k", keys("b", "c", "c"), make, "2024-01-02")) == [("b", "B"), ("c", "C")]
    files.cached(spark, f"{tmp_path}/k", keys("b"), make, "2024-03-01")
    assert made == [["a", "b"], ["c"], ["b"]]


def events(spark):
    start = datetime(2024, 1, 1)
    r = [(i, start + timedelta(minutes=7 * i), i % 3, "ab"[(i // 4) % 2], float(i), "{}") for i in range(40)]
    return spark.createDataFrame(r, S.SCHEMA)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    e = events(spark)
    e.write.parquet(f"{tmp_path}/events.parquet")
    stream = lambda: S.event_stream(spark, f"file://{tmp_path}")
    end = e.agg(F.max("ts")).first()[0] - timedelta(hours=1)  # windows are closed up to here
    hours = S.tumbling(e, "1 hour").where(F.col("window_start") + F.expr("interval 1 hour") <= F.lit(end))
    made = lambda at=None: S.run_available(S.tumbling(stream().withWatermark("ts", "1 hour"), "1 hour"), "t", at)
    assert rows(made()) == rows(hours) and hours.count() > 3
    kept = f"file://{tmp_path}/kept"
    assert rows(made(kept)) == rows(made(kept)) == rows(hours)  # the second run goes on from the end of the first
    closed = S.sessions(e, "20 minutes").where((F.col("session_start") <= F.lit(end - timedelta(minutes=20))) & (F.col("n") == 1))
    assert rows(S.run_available(S.sessions(stream().withWatermark("ts", "1 hour"), "20 minutes"), "s")) == rows(closed)
    assert rows(S.run_available(S.changes_stream(stream().withWatermark("ts", "1 hour"), "2 days"), "c"), "event_id", "user_id", "event_type") == rows(S.changes_batch(e))
    assert rows(S.run_available(S.changes_stream(stream()), "c"), "event_id", "user_id", "event_type") == rows(S.changes_batch(e))
    assert S.run_available(S.first_in_time(stream().union(stream()), ["event_id"], "30 days"), "f").count() == 40


def test_batch_event_operators(spark):
    e = events(spark)
    assert S.over_rate(e, 22 * 60, 2).count() == 37
    assert S.over_rate(e.limit(0), 60, 1).count() == 0
    assert rows(S.complete_groups(e, "user_id", "event_type", ["a", "b"]), "user_id") == [(0,), (1,), (2,)]
    assert rows(S.complete_groups(e, "user_id", "event_type", ["a", "z"])) == []


def test_state_that_is_forgotten(spark, tmp_path):
    """Files come one at a time; a user's type is forgotten when others' events are days ahead."""
    start = datetime(2024, 1, 1)
    files = [[(0, start, 1, "a")], [(1, start + timedelta(hours=1), 1, "a"), (2, start + timedelta(days=9), 2, "a")], [(3, start + timedelta(days=10), 2, "b")], [(4, start + timedelta(days=11), 1, "a")]]
    for i, part in enumerate(files):
        spark.createDataFrame([(*r, 0.0, "{}") for r in part], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = S.run_available(S.changes_stream(S.event_stream(spark, f"file://{tmp_path}", per_trigger=1).withWatermark("ts", "1 hour"), "2 days"), "f")
    assert [r["event_id"] for r in got.orderBy("event_id").collect()] == [0, 2, 3, 4]
    kept = S.run_available(S.changes_stream(S.event_stream(spark, f"file://{tmp_path}", per_trigger=1)), "k")
    assert [r["event_id"] for r in kept.orderBy("event_id").collect()] == [0, 2, 3]
