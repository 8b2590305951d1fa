"""Every registered query of the core against its SQL twin, over the small tables."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from corpuscle.plans.queries import QUERIES, SQL


def shown(v) -> str:
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(shown, v))}]"
    if isinstance(v, dict):
        return f"{{{','.join(map(shown, v.values()))}}}"
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    of = lambda names, table: sorted(tuple(shown(v) for _, v in sorted(zip(names, row, strict=True))) for row in table)
    assert of(df.columns, rows) == of(columns, got.fetchall()), order


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
