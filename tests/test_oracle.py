"""Every registered query against its DuckDB oracle (sf0.001: rows, columns, values)."""

import datetime as dt
import math

import duckdb
import pytest

from conftest import SF_SMOKE
from larder.plans.registry import ORACLE, QUERIES, load_all
from larder.sources.tables import TABLES

load_all()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return con


#: What SQL on views can't tell: files and their bytes.
WITHOUT_SQL = {"table_files"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE)
    assert len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMOKE)
    cols = sorted(df.columns)
    got = _rows([r.asDict(recursive=True) for r in df.collect()], cols)
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    want = _rows([dict(zip(dcols, r)) for r in res.fetchall()], cols)
    assert len(got) == len(want)
    assert got == want


def test_files_of_tables(spark):
    import os

    rows = {r.table_name: r for r in QUERIES["table_files"](spark, SF_SMOKE).collect()}
    assert set(rows) == set(TABLES)
    for name, r in rows.items():
        assert r.n_files == 1 and r.size_bytes == os.path.getsize(f"{SF_SMOKE}/{name}.parquet")


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["region", "total_amount"]
