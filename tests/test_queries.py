"""Every registered query against its oracle on the smallest tables; those without one run and return rows."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from corpuslens import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str, datetime.date)):
        return str(v)
    return round(float(v), 5) + 0.0


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([columns[k] for k in order]), sorted(repr([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in core.ORACLES:
        found = con.execute(core.ORACLES[name])
        assert got == rows([c[0] for c in found.description], found.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert core.entry(spark, SF).count() == 1
