from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators import schema_drift as D
from tallyloom.operators.schema_drift import drift, field_names, file_schemas, fused_schema, in_order, type_of, unified

from .conftest import rows

COLUMNS = "file_id string, series_id string, exported_at timestamp, body string, place string"


def files(spark, *bodies, series="s", repeat=1):
    day = datetime(2024, 1, 1)
    return spark.createDataFrame([(f"f{i}", series, day + timedelta(days=20 * i), b, "clash") for i, b in enumerate(bodies)] * repeat, COLUMNS)


def test_types():
    assert [type_of(x) for x in (["1", "-2"], ["1.5", ""], ["1", "1.5"], ["TRUE", "false"], ["2024-01-01 10:00:00", "2024-01-01T10:00:00Z"], ["", " "], [], ["a"])] == ["integer", "decimal", "text", "boolean", "timestamp", None, None, "text"]


def test_changes(spark):
    d = files(
        spark,
        "sku,Qty,price,note\na,1,1.5,x\nb,2,2.5,y\n",
        "price ,sku,quantity,color\n1.5,a,1,red\n9.5,c,7,blue\n",  # Qty renamed, note removed, color added, order no change
        "sku,quantity,price,color\na,1,,\nc,x,,\n",  # quantity retyped; price and color have no type
        "sku,quantity,price,color\na,1,2,red\nc,x,3,\n",  # price retyped against the last file where it had a type
        repeat=2,
    )
    assert rows(drift(d)) == sorted(
        [
            ("f1", "renamed", "Qty", "quantity"), ("f1", "removed", "note", ""), ("f1", "added", "", "color"),
            ("f2", "retyped", "quantity", "quantity"), ("f3", "retyped", "price", "price"),
        ],
        key=repr,
    )


def test_kept_columns_are_compared_across_a_gap(spark):
    d = files(spark, "sku,a\nx,1\n", "sku\nx\n", "sku,a\nx,\n", "sku,a\nx,word\n", "sku,a\nx,word\n")
    assert rows(drift(d)) == [("f1", "removed", "a", ""), ("f2", "added", "", "a"), ("f3", "retyped", "a", "a")]
    # the first file after the gap has the column as added only
    d = files(spark, "sku,a\nx,1\n", "sku\nx\n", "sku,a\nx,word\n", "sku,a\nx,word\n")
    assert rows(drift(d)) == [("f1", "removed", "a", ""), ("f2", "added", "", "a")]


def test_all_empty_and_keyless_columns_are_no_renames(spark):
    assert rows(drift(files(spark, "sku,a\nx,\n", "sku,b\nx,\n"))) == [("f1", "added", "", "b"), ("f1", "removed", "a", "")]
    assert rows(drift(files(spark, "sku,a\nx,1\n", "sku,b\ny,1\n"))) == [("f1", "added", "", "b"), ("f1", "removed", "a", "")]


def test_null_blank_and_empty(spark):
    assert rows(drift(files(spark, None, "sku\nx\n", ""))) == [("f1", "added", "", "sku"), ("f2", "removed", "sku", "")]
    assert drift(files(spark, "x").limit(0)).count() == 0
    assert unified(files(spark, None, "")).count() == 0


def test_order_over_time_buckets_equals_a_plain_one(spark):
    d = files(spark, *["sku\n1\n"] * 12)
    got = {r["file_id"]: (r["place"], r["before"]) for r in in_order(file_schemas(d)).collect()}
    assert got == {f"f{i}": (i + 1, f"f{i - 1}" if i else None) for i in range(12)}


def test_files_without_a_time_come_first_and_without_a_series_stand_alone(spark):
    day = datetime(2024, 1, 1)
    data = [("f1", "s", day, "sku,b\nx,1\n"), ("f3", "s", None, "sku,a\ny,1\n"), ("f2", "s", None, "sku\nx\n"), ("f4", None, day, "sku,a\nx,1\n"), ("f5", None, day, "sku,a\nx,word\n"), ("f6", None, None, "sku\nx\n")]
    d = spark.createDataFrame([(*x, "") for x in data], COLUMNS)
    assert rows(in_order(file_schemas(d)), "file_id", "place", "before") == [("f1", 3, "f3"), ("f2", 1, None), ("f3", 2, "f2"), ("f4", 1, None), ("f5", 1, None), ("f6", 1, None)]
    assert rows(drift(d)) == [("f1", "added", "", "b"), ("f1", "removed", "a", ""), ("f3", "added", "", "a")]


def test_field_names():
    assert field_names(["sku", "Published Scope", "Qty", "qty", "QTY", ""], {"Qty": "amount"}) == ["sku", "published_scope", "amount", "qty", "qty_2", "column"]
    assert field_names(["a", "b"], {"b": "a"}) == ["a", "b"]  # the name came again beside the renamed column


def test_unified_is_one_row_per_record_with_renames_and_branches(spark):
    d = files(
        spark,
        'sku,title,Product Id,n\n"a,b",Lamp,7,\nq,Chair,8,\n',
        "sku,variant_title,product-id,n\nq,Chair,x,\n",  # title renamed; another spelling and type of the product id, as q has other texts
        "sku,name,product-id,n\nq,Chair,y,\n,,,\n",  # renamed once more
        "sku,name,product-id,n,title\nq,Chair,9,,again\n",  # the first name comes again, beside its heir
    )
    out = unified(d)
    got = sorted(out.select("file_id", "row_no", "record.*").collect(), key=lambda r: (r["file_id"], r["row_no"]))
    assert [(r["file_id"], r["row_no"], r["sku"], r["title"]) for r in got] == [("f0", 1, "a,b", "Lamp"), ("f0", 2, "q", "Chair"), ("f1", 1, "q", "Chair"), ("f2", 1, "q", "Chair"), ("f2", 2, None, None), ("f3", 1, "q", "Chair")]
    assert [r["product_id"] and r["product_id"].asDict() for r in got] == [
        {"integer": 7, "text": None, "canonical": "7"}, {"integer": 8, "text": None, "canonical": "8"}, {"integer": None, "text": "x", "canonical": "x"},
        {"integer": None, "text": "y", "canonical": "y"}, None, {"integer": 9, "text": None, "canonical": "9"},
    ]
    assert [r["title_2"] for r in got] == [None] * 5 + ["again"] and {r["n"] for r in got} == {None}
    assert out.schema["record"].dataType["sku"].dataType.typeName() == "string"
    alternatives = rows(fused_schema(d), "series_id", "field", "type", "files", "first_file", "alternative")
    assert ("s", "product_id", "integer", 2, "f0", 1) in alternatives and ("s", "product_id", "text", 2, "f1", 2) in alternatives
    assert [r["names"] for r in fused_schema(d).where("field = 'title'").collect()] == [["name", "title", "variant_title"]]


def test_long_series_go_through_blocks(spark, monkeypatch):
    """One series holds nearly all files; its types and renames are carried from block to block."""
    monkeypatch.setattr(D, "BLOCK", 4)
    bodies = [f"sku,a,c{i // 9}\nx,{i if i < 3 else ''},v\n" for i in range(37)] + ["sku,a,c4\nx,word,v\n"]
    d = files(spark, *bodies).unionByName(files(spark, "sku\n1\n", series="other").withColumn("file_id", F.lit("g")))
    found = rows(drift(d))
    assert found == sorted([(f"f{9 * k}", "renamed", f"c{k - 1}", f"c{k}") for k in (1, 2, 3, 4)] + [("f37", "retyped", "a", "a")], key=repr)
    record = unified(d).where("series_id = 's'")
    assert record.select("record.*").columns == ["a", "c0", "sku"] and record.where("record.c0 = 'v'").count() == 38
