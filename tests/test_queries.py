"""Every registered query of the library against its oracle, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from streetloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def _rows(columns, rows):
    return sorted((tuple(_norm(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = _rows(columns, [r.asDict() for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert got == _rows(columns, [dict(zip(names, r)) for r in cur.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
