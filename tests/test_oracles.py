"""Every core query with a DuckDB counterpart gives the same rows at the smallest scale."""

import os
from pathlib import Path

import duckdb
import pytest

from fjordframe.plans.registry import core_oracle_sql, core_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_same_rows(spark, duck, name):
    df = core_queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    if name not in core_oracle_sql():
        assert got
        return
    result = duck.execute(core_oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = ordered(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6) if all(isinstance(v, int | float) for v in w) else g == w
