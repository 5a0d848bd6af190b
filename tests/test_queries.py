"""Each registered query with SQL against DuckDB on the smallest tables; the others must run and keep their schema."""

from __future__ import annotations

import math
import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from visitlens.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(rows, order):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool):
            return str(x)
        return f"{round(float(x), 6):.6f}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def running(request, spark):
    """The selected queries, several at a time; each test waits for its own."""

    def run(name):
        df = QUERIES[name](spark, SF)
        return df.columns, [tuple(r) for r in df.collect()]

    names = [i.callspec.params["name"] for i in request.session.items if i.originalname == "test_query"]
    with ThreadPoolExecutor(6) as pool:
        futures = {n: pool.submit(run, n) for n in names}
        yield futures
        for f in futures.values():
            f.cancel()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(running, duck, name):
    columns, rows = running[name].result()
    assert len(set(columns)) == len(columns)
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(columns)
        order = lambda names: [names.index(c) for c in sorted(names)]
        assert plain(rows, order(columns)) == plain(found.fetchall(), order(found.columns))
