from tallyloom.operators.csv_rows import explained, failed_rows, loaded_rows
from tallyloom.sources.csv_text import read_rows

from .conftest import rows

HEAD = "order_id,name,price,available,createdAt\n"


def broken(spark, *texts):
    d = spark.createDataFrame([(f"u{i}", t, "clash") for i, t in enumerate(texts)], "upload_id string, csv_data string, reason string")
    return rows(failed_rows(d), "upload_id", "line_no", "reason")


def test_reasons_in_order(spark):
    text = HEAD + (
        'gid/1,"a, b",1.5,3,2024-01-31\n'  # 2 fine
        'gid/2,"a" b,x,3,2024-01-31\n'  # 3 goes on after its mark
        "gid/3,a,1.5,3\n"  # 4 too few
        "\n   \n"  # 5, 6 no rows
        'gid/4,"two\nlines",1,NULL,2024-02-29T10:00:00Z\n'  # 7 spans lines
        'gid/5,"open,1,2,2024-01-01\n'  # 9 never closed in a whole row
        "gid/6,a,1 EUR,2,2024-01-01\n"  # 10
        "gid/7,a,1,2.5,2024-01-01\n"  # 11
        "gid/8,a,,None,2024-02-30\n"  # 12 no such day
        ",a,1,2,2024-01-01\n"  # 13 empty id
        'gid/9,8" pan, -1.50 ,+4,\n'  # 14 fine
        "gid/10,a,1,2,2024-01-01T25:00:00\n"  # 15
        "gid/x,a,1,2,2024-01-01\n"  # 16
    )
    want = [(3, "quoting"), (4, "column_count"), (9, "quoting"), (10, "invalid_value"), (11, "invalid_value"), (12, "invalid_value"), (13, "invalid_value"), (15, "invalid_value"), (16, "invalid_value")]
    assert broken(spark, text) == sorted((("u0", *w) for w in want), key=repr)


def test_delimiters_marks_and_line_ends(spark):
    assert broken(spark, "﻿order_id;price\r\ngid/1;2,5\r\ngid/2;2.5\r\n") == [("u0", 2, "invalid_value")]
    assert broken(spark, '"order_id"\t"price"\ngid/1\t2\ngid/2\n') == [("u0", 3, "column_count")]
    assert broken(spark, " order_id , price \ngid/a,1") == [("u0", 2, "invalid_value")]


def test_null_blank_empty_and_long(spark):
    assert broken(spark, None, "", "  \n ", "order_id,price\n") == []
    long = "order_id,price\n" + "\n".join(f"gid/{i},{i}" for i in range(50_000)) + '\n"never closed' + ",x" * 50_000
    assert broken(spark, long) == [("u0", 50_002, "quoting")]
    d = spark.createDataFrame([], "upload_id string, csv_data string")
    assert failed_rows(d).count() == 0 and loaded_rows(d).count() == 0


def test_valid_rows_are_typed(spark):
    d = spark.createDataFrame([("u", "orderx,order_id,price,available,createdAt,order_id\nz,gid/1, 2.50 ,NULL,2024-01-02 03:04:05,gid/1\nz,gid/2,x,1,,gid/2\n")], "upload_id string, csv_data string")
    got = loaded_rows(d).collect()
    assert len(got) == 1 and got[0]["order_id"] == "gid/1" and float(got[0]["price"]) == 2.5 and got[0]["available"] is None and got[0]["created_at"].year == 2024


def test_spanning_row_must_have_the_right_width():
    got = list(read_rows('a,b\n"x\ny",1\n"x\ny",1,2\nz,2'))
    assert [(r.line_no, r.row_no, r.raw, r.cells and len(r.cells)) for r in got] == [(1, 0, "a,b", 2), (2, 1, '"x\ny",1', 2), (4, 2, '"x', None), (5, 3, 'y",1,2', 3), (6, 4, "z,2", 2)]
    assert [r.cells for r in read_rows('a\r\n"x\r\ny"\r\n')] == [["a"], ["x\ny"]] and [r.cells for r in read_rows("a\r1\r")] == [["a"], ["1"]]


def test_raw_text_and_other_columns_are_kept(spark):
    text = 'Title,order_id,price,title,price\n"a ""b""",gid/1,1,x,\nt,gid/2,,y,7\nt,,1,y,\nt,gid/3,1\n"t" t,gid/4,1,y,\n'
    d = spark.createDataFrame([("u", text)], "upload_id string, csv_data string")
    assert rows(failed_rows(d), "line_no", "reason", "raw") == [(4, "invalid_value", "t,,1,y,"), (5, "column_count", "t,gid/3,1"), (6, "quoting", '"t" t,gid/4,1,y,')]
    assert [(r["order_id"], float(r["price"]), r["other"]) for r in loaded_rows(d).orderBy("line_no").collect()] == [("gid/1", 1.0, {"Title": 'a "b"', "title": "x"}), ("gid/2", 7.0, {"Title": "t", "title": "y"})]


def test_messages(spark):
    head = "order_id,price\n"
    d = spark.createDataFrame([("a", head + '"x" y,1\n'), ("b", head + "\n1,2\n1,x\n"), ("c", head + "1,2,3\n"), ("d", head + "1,2\n"), ("e", head + "1\n")], "upload_id string, csv_data string")
    u = spark.createDataFrame(
        [("a", "Row 1 has 3 columns, expected 2 | Unbalanced quotes near row 1", 1), ("b", "Row 9 has 1 columns, expected 2", 1), ("b", "Invalid numeric value in orders CSV, row 2, column 'price': 'x'.", 2), ("b", None, 3), ("c", "Unbalanced quotes near row 3…", 1), ("d", "see log", 1), (None, "x", 1), ("z", " ", 1)],
        "id string, error_message string, updated_at int",
    )
    got = rows(explained(failed_rows(d), u), "upload_id", "part", "said", "said_row", "agrees", "placed", "first_line")
    want = [("a", 1, "column_count", 1, False, False, 2), ("a", 2, "quoting", 1, True, True, 2), ("b", 1, "invalid_value", 2, True, True, 4), ("c", 1, "quoting", None, False, None, 2), ("d", 1, "vague", None, None, None, None), ("e", None, "none", None, None, None, 2)]
    assert got == want
