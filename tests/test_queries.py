"""Every registered query agrees with its SQL in DuckDB, or where SQL can't express it with a plain version, on every row of the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
from weftline.plans.catalog import QUERIES  # noqa: E402

from .plain import CHECKS, PLAIN  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    got = df.collect()
    if name in CHECKS:
        return CHECKS[name](got, con)
    if sql is None:
        pick, plain_rows = PLAIN[name]  # a query without SQL has a plain version
        assert sorted(map(repr, map(pick, got))) == sorted(map(repr, plain_rows(con)))
        return
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "page_type", "language", "pages", "mean_links", "thin_share"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
