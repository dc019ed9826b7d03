"""Every registered corpus query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
#: Empty on so few rows.
MAY_BE_EMPTY = {"f22_notifications", "search_pages", "t6_mentions"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(v, 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got or name in MAY_BE_EMPTY
    if name in catalog.ORACLE_SQL:
        cur = db.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
        assert got == want
