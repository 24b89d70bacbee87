"""Every registered query runs, and equals its SQL where it has one."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from sitegauge.plans import registry
from sitegauge.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
# What the entry adds from elsewhere has its own tests.
QUERIES = {k: f for k, f in entry_module.queries().items() if k in registry.QUERIES}
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 10 and sum(r["n"] for r in rows) > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert ours == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


#: Columns that may say the same for all pages: every stored page was answered, over one scheme, with its charset.
PLAIN = {"fetch_error", "status", "charset_declared", "https", "mixed_content"}


@pytest.mark.parametrize("name", ["technology", "page_structure", "page_metadata", "declared_languages", "page_quality", "page_emails"])
def test_every_compared_column_varies(duck, name):
    rel = duck.sql(ORACLES[name])
    rows = rel.fetchall()
    for i, column in enumerate(rel.columns):
        assert len({r[i] for r in rows}) > 1 or column in PLAIN, column
