import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SMOKE = "/root/testdata/sf0.001"


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)


def test_names_without_a_session():
    got = run("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))")
    assert got.returncode == 0, got.stderr
    assert all(int(x) > 100 for x in got.stdout.split())


def test_the_optional_subpackage_is_optional():
    got = run("import sys; sys.modules['tallyloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p5_found' not in q")
    assert got.returncode == 0, got.stderr


def test_nothing_imports_the_optional_subpackage():
    for p in (REPO / "tallyloom").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="no test tables")
def test_entry_and_a_sample_of_sql_twins(spark):
    import duckdb

    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    con = duckdb.connect()
    for p in Path(SMOKE).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    q, o = e.queries(), e.oracle_sql()
    for name in ("a10_order_analytics", "j09_enriched_lines", "m06_pair_measures", "n11_remainder_allocation", "w02_line_upsert", "u01_first_wins_union", "s06_order_lines", "t01_monotone_progress"):
        df = q[name](spark, SMOKE)
        got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
        rel = con.execute(o[name])
        cols = [x[0] for x in rel.description]
        want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rel.fetchall()), key=repr)
        assert sorted(cols) == sorted(df.columns) and got == want, name
