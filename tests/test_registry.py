"""Every registered query against its DuckDB SQL on the small tables, and the driver's contract."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 8) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(smoke):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{smoke}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smoke}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, smoke, duck, name):
    df = registry.queries()[name](spark, smoke)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        want = duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert rows == sorted((tuple(plain(x) for x in r) for r in want), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_access_filter_reaches_the_scan(spark, smoke):
    from quern.plans import q_retrieval

    plan = q_retrieval._visible(spark, smoke)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line and "text" in line]
    assert scan and "embedding" not in plan
