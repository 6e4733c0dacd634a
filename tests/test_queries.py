"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corvane.plans import registered

DATA = Path("/root/testdata/sf0.001")


def shown(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, duck, name):
    query, sql = registered()[name]
    df = query(spark, str(DATA))
    rows = df.collect()
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda cols: sorted(range(len(cols)), key=cols.__getitem__)
    mine = Counter(tuple(shown(r[i]) for i in order(df.columns)) for r in rows)
    assert mine == Counter(tuple(shown(r[i]) for i in order(names)) for r in found.fetchall())
