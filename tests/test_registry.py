"""The entry points, and every registered query of the reference's operators against DuckDB."""

import math
import os
from collections import Counter

import pytest

from roboframe import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "asDict"):
        return plain(tuple(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "is_finite") and not isinstance(v, int):
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    columns, rows = [d[0] for d in result.description], result.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    got = Counter(plain(tuple(r[c] for c in columns)) for r in frame.collect())
    assert got == Counter(plain(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
