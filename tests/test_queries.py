"""Every registered query against its SQL twin, with keys forced across order chunks."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import pytest

from fleetcast.operators.ordered import CHUNKS_CONF
from fleetcast.queries import oracles, registered

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, (str, dt.date)):
        return v
    return float(v)


def table(rows, names):
    cols = sorted(names)
    place = [list(names).index(c) for c in cols]
    return sorted([tuple(plain(r[i]) for i in place) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_matches_its_sql(spark, duck, name):
    spark.conf.set(CHUNKS_CONF, "3")
    try:
        df = registered()[name](spark, ROOT)
        got = table(df.collect(), df.columns)
    finally:
        spark.conf.unset(CHUNKS_CONF)
    cur = duck.execute(oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == table(cur.fetchall(), names)


def test_every_query_is_registered():
    assert set(oracles()) <= set(registered())
    assert len(registered()) >= 100
