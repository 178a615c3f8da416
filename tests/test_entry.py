"""The entry module, with and without the optional subpackage, and every query against its SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quarry import catalog_queries
from quarry.session import TABLES

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_subpackage(tmp_path):
    for name in ("quarry", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quarry/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: x if x is None or isinstance(x, str) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query(spark, sf, duck, name):
    got = catalog_queries.queries()[name](spark, sf).toPandas()
    sql = catalog_queries.oracle_sql().get(name)
    if sql is None:
        assert len(got) >= 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    if name.endswith(("windows", "ranges")):
        got, want = got.astype(str).apply(lambda c: c.str[:10]), want.astype(str).apply(lambda c: c.str[:10])
    pd.testing.assert_frame_equal(shown(got), shown(want), check_dtype=False, rtol=1e-9, atol=1e-9)
