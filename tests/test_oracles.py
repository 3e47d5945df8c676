"""Every registered panel query against its DuckDB counterpart, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest
from tidepanel.plans.registry import ORACLE_SQL, QUERIES

SOURCE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SOURCE}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SOURCE)
    names = sorted(df.columns)
    got = in_order([tuple(plain(v) for v in r) for r in df.select(*names).collect()])
    assert got
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        at = [c[0] for c in cur.description]
        assert sorted(at) == names
        assert got == in_order([tuple(plain(r[at.index(c)]) for c in names) for r in cur.fetchall()])
