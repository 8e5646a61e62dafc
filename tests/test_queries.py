"""Each registered query against its SQL on the sample tables: rows, columns and values."""

from __future__ import annotations

import glob
import os
from pathlib import Path

import duckdb
import pytest

from catalume.queries import FLAGSHIP, QUERIES, SQL

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def shown(rows) -> list[str]:
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert rows, "a query that finds nothing shows nothing"
    if name not in SQL:  # tested against a plain version elsewhere
        assert name in {"components"}
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    theirs = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert len(rows) == len(theirs)
    assert shown(rows) == shown(theirs)


def test_flagship():
    assert FLAGSHIP in QUERIES
