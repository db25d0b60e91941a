"""Every query that has SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from papyra import plans
from papyra.plans.relational import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def plain(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return f"{v:.6g}" if not v.is_integer() else str(int(v))
    return str(v)


def table(rows: list, names: list[str]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_others_give_rows(spark, name):
    df = plans.queries()[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_entry_has_no_query_without_a_function():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "bm25_topk" in e.queries()
