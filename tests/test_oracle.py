"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from rungfleet.jobs import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _text(v) -> str:
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_text, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted("|".join(map(_text, r)) for r in df.select(*cols).collect())
    if name not in SQL:
        return
    names = sorted(duck.sql(SQL[name]).columns)
    want = duck.sql("select " + ",".join(f'"{c}"' for c in names) + f" from ({SQL[name]}) q").fetchall()
    assert cols == names
    assert rows == sorted("|".join(map(_text, r)) for r in want)
