from tallyloom.operators.packed_values import known_values, split_cell, split_values

from .conftest import rows

CASES = [
    (None, []), ("", []), ("  ", []), ("NULL", []), ("n/a", []), ("[]", []), (" [ ] ", []),
    ("a, b ,c", ["a", "b", "c"]),
    (";a;;b; ;", ["a", "b"]),
    ("été\twide fit\nno. 7", ["été", "wide fit", "no. 7"]),
    ("tier 2，C#-craft • 50/50 blend|100% wool", ["tier 2", "C#-craft", "50/50 blend", "100% wool"]),
    ("mother's day & co: x+y, winter'25", ["mother's day & co: x+y", "winter'25"]),
    ('"mix, match; save"|clearance', ["mix, match; save", "clearance"]),
    ('"12"" frame",refill', ['12" frame', "refill"]),
    ('tier 1, "say \\"hello\\"", x', ["tier 1", 'say "hello"', "x"]),
    ('["\\u00e9t\\u00e9", "12\\" frame", "", " a "]', ["été", '12" frame', "a"]),
    ('12" frame, b', ['12" frame', "b"]),
    ('"open, b', ['"open', "b"]),
    ("a,a,A", ["a", "a", "A"]),
]


def test_cells():
    for cell, expected in CASES:
        assert split_cell(cell) == expected, cell


def test_known_values_protect_their_delimiters(spark):
    d = spark.createDataFrame([(1, '"red; blue",x', "p"), (2, "a;red; blue;b", "p"), (2, "a;red; blue;b", "p"), (3, "infrared; blue", "p"), (4, None, "p"), (5, "z," * 20_000 + "end", "p")], "id int, tags string, value string")
    for block in (200_000, 1):
        got = split_values(d, "tags", block)
        assert rows(got.where("id < 5"), "id", "position_no", "tag_value") == [
            (1, 1, "red; blue"), (1, 2, "x"), (2, 1, "a"), (2, 2, "red; blue"), (2, 3, "b"), (3, 1, "infrared"), (3, 2, "blue"),
        ]
        assert got.where("id = 5").count() == 20_001
        assert split_values(d.limit(0), "tags", block).count() == 0


def test_several_blocks_give_the_same(spark):
    d = spark.createDataFrame([(i, f'"v{i}, w{i}",u') for i in range(30)] + [(i + 100, f"k|v{i}, w{i}|l") for i in range(30)], "id int, tags string")
    assert rows(split_values(d, "tags")) == rows(split_values(d, "tags", 7))
    assert rows(split_values(d, "tags").where("id = 105"), "position_no", "tag_value") == [(1, "k"), (2, "v5, w5"), (3, "l")]


def test_known_values_are_counted_by_cell(spark):
    d = spark.createDataFrame([('"a, b",c,"a, b"',), ('x;"a, b"',), ('["a, b","p|q"]',), (None,), ('"plain",y',)], "tags string")
    assert rows(known_values(d, "tags"), "value", "cells") == [("a, b", 3), ("p|q", 1)]
