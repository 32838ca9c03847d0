"""Every query of the subpackage: its SQL on the smallest tables, or rows for all of a table."""

import duckdb
import pytest

import __spark_entry__ as ent
from check_oracles import TABLES, value_hash
from tests.llm.helpers import SMALL


@pytest.mark.parametrize("name", sorted(ent.LLM_ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = ent.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ent.oracle_sql()[name])
    cols, want = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert value_hash(rows, df.columns)[0] == value_hash(want, cols)[0]
