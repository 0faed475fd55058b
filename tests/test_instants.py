from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.instants import instant
from tallyloom.operators.instants import extend_dictionary, normalise_instants

from .conftest import rows

NY = "America/New_York"


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2024-06-05T00:51:41-00:00", NY, utc(2024, 6, 5, 0, 51, 41)),
    ("2024-06-05 10:39:19", NY, utc(2024, 6, 5, 14, 39, 19)),
    (" 2024-06-06T01:09:55.332Z ", NY, utc(2024, 6, 6, 1, 9, 55, 332000)),
    ("2024-06-05T01:37:08.004901Z", NY, utc(2024, 6, 5, 1, 37, 8, 4901)),
    ("2024-06-05 16:30:08-0400", NY, utc(2024, 6, 5, 20, 30, 8)),
    ("2024-06-05 16:30:08 -04:00", NY, utc(2024, 6, 5, 20, 30, 8)),
    ("06/07/2024 9:21 AM", NY, utc(2024, 6, 7, 13, 21)),
    ("06/06/2024 12:44 PM", NY, utc(2024, 6, 6, 16, 44)),
    ("06/06/2024 12:31 AM", NY, utc(2024, 6, 6, 4, 31)),
    ("11.06.2024 05:05", NY, utc(2024, 6, 11, 9, 5)),
    ("1717690419", NY, 1717690419 * 10**6),
    ("1717665093355", NY, 1717665093355 * 1000),
    ("2024-06-06 10:42:08 Europe/Berlin", NY, utc(2024, 6, 6, 8, 42, 8)),
    ("2024-11-03 01:30:00 EST", NY, utc(2024, 11, 3, 6, 30)),
    ("2024-11-03 01:30:00", NY, utc(2024, 11, 3, 5, 30)),  # twice: the earlier
    ("2025-03-09 02:30:00", NY, utc(2025, 3, 9, 7, 30)),  # skipped: forward by the gap
    ("03/09/2025 2:30 AM", NY, utc(2025, 3, 9, 7, 30)),
    ("20240608T210430Z", NY, utc(2024, 6, 8, 21, 4, 30)),
    ("Sat, 03 Aug 2024 16:42:51 -0400", NY, utc(2024, 8, 3, 20, 42, 51)),
    ("Sun, 04 Aug 2024 02:07:51 GMT", NY, utc(2024, 8, 4, 2, 7, 51)),
    ("2025-02-14T04:51Z", NY, utc(2025, 2, 14, 4, 51)),
    ("2024-07-01 01:17:58+0530", NY, utc(2024, 6, 30, 19, 47, 58)),
    ("2024-06-05", NY, utc(2024, 6, 5, 4)),
    ("2024-06-05 10:00:00", None, None),  # wall time of an unknown zone
    ("2024-06-05T10:00:00Z", None, utc(2024, 6, 5, 10)),
    *[(x, NY, None) for x in (None, "", "  ", "N/A", "pending", "2025-02-30T10:15:00Z", "2025-13-04 08:00:00", "2025-04-11T25:10:00Z", "0000-00-00 00:00:00", "13/06/2024 13:10 PM", "2024-06-05 10:00:00 Mars/Base", "2024-06-05 10:00:61", "x" * 100_000)],
]


def test_notations(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "i int, raw string, zone string")
    got = {r["i"]: r["m"] for r in df.select("i", F.unix_micros(instant(F.col("raw"), F.col("zone"))).alias("m")).collect()}
    for i, (raw, zone, expected) in enumerate(CASES):
        assert got[i] == expected, (raw and raw[:60], zone)


def test_dictionary_is_incremental_and_keeps_every_row(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    first = spark.createDataFrame([("a", NY, "2024-06-05 10:39:19", 1), ("a", NY, None, 2), ("a", NY, "junk", 3), ("a", NY, "junk", 3)], "source string, zone string, raw string, raw_no int")
    assert extend_dictionary(first, path).count() == 2
    second = spark.createDataFrame([("a", None, "1717690419", 4), ("a", NY, "junk", 5)], "source string, zone string, raw string, raw_no int")
    out = normalise_instants(second, path)
    assert rows(out, "raw_no", "utc_micros") == [(4, 1717690419 * 10**6), (5, None)]
    assert spark.read.parquet(path).count() == 3
    spark.read.parquet(path).write.mode("append").parquet(path)  # as two writers at the same time would
    assert spark.read.parquet(path).count() == 6 and extend_dictionary(second, path).count() == 3
    assert normalise_instants(first, path).count() == 4 and normalise_instants(second, path).count() == 2
    assert normalise_instants(first.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 3])
def test_columns_with_clashing_names_stay(spark, n):
    d = spark.createDataFrame([("a", NY, "1717690419", "x")] * n, "source string, zone string, raw string, utc_micros string")
    assert rows(normalise_instants(d), "utc_micros") == [(1717690419 * 10**6,)] * n
