"""Every core query against its SQL on the smallest tables; queries without SQL must run and have a stable schema."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest

from cadenza.plans import catalog

DATA = Path(os.environ.get("CADENZA_TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return str({k: plain(x) for k, x in v.asDict().items()})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def sql_rows(sql):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in DATA.iterdir():
        con.execute(f"create view {f.stem} as select * from '{f}'")
    r = con.execute(sql)
    return [c[0] for c in r.description], r.fetchall()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, str(DATA))
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql:
        cols, want = sql_rows(sql)
        order = sorted(cols)
        assert sorted(df.columns) == order
        assert Counter(tuple(plain(r[c]) for c in order) for r in rows) == Counter(tuple(plain(r[cols.index(c)]) for c in order) for r in want)
