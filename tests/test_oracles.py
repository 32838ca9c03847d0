"""Every registered query against its DuckDB oracle on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as ent
from lakeward.plans.registry import QUERIES
from check_oracles import TABLES, value_hash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert df.columns == ["model_id", "model_name", "model_space", "view_id", "view_name", "view_space"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = ent.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = ent.oracle_sql().get(name)
    assert sql is not None, "every query of the registry has SQL"
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert value_hash(rows, df.columns)[0] == value_hash(orows, ocols)[0]
