"""Every registered query with an oracle equals DuckDB on the small scale factor (exact values)."""

import pytest

from tools.check_oracle import rows_of, to_py

import __spark_entry__ as entry

from .conftest import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "y_same_hour_30d_mean" in df.columns


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    rel = duck.sql(SQL[key])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for name, t in sdf.dtypes:
        assert SPARK_TO_DUCK.get(t, t) == duck_types.get(name), (name, t, duck_types.get(name))
    got = to_py(sdf.toPandas())
    exp = to_py(duck.execute(SQL[key]).df())
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(exp)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
