"""Every query that SQL can express gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from gleaner.plans import queries as base
from gleaner.plans import retrieval_queries  # noqa: F401
from jobs import queries as jobs

QUERIES, SQL = base.QUERIES | jobs.QUERIES, base.SQL | jobs.SQL


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, duck, name):
    made = QUERIES[name](spark, sf_dir)
    columns = sorted(made.columns)
    wanted = duck.sql(SQL[name])
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(wanted.columns) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in made.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


def test_all_others_have_tests_of_their_own():
    """What SQL can't express is tested by hand."""
    tested = "".join(open(path).read() for path in glob.glob(f"{os.path.dirname(__file__)}/test_*.py"))
    assert all(name in tested for name in set(QUERIES) - set(SQL)), set(QUERIES) - set(SQL)
