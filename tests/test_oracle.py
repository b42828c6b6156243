"""Every query with SQL gives what DuckDB gives for that SQL on the smallest tables."""

import math

import duckdb
import pytest

from touchline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spelled(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "[" + ",".join(map(spelled, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted("|".join(map(spelled, r)) for r in df.select(*columns).collect())
    expected = duck.sql(catalog.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    assert got == sorted("|".join(map(spelled, r)) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys() - {"feature_assembly"}))
def test_runs(spark, small, name):
    # the smallest tables have too few suppliers for a fixture
    rows = catalog.queries()[name](spark, small.replace("0.001", "0.01") if name == "export_nested_json" else small).collect()
    assert rows
    if name.startswith("check_"):
        assert all(v == 0 for r in rows for k, v in r.asDict().items() if k.endswith("mismatches"))
