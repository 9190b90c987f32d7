"""The registered queries: whole tables, and their SQL where there is one."""

import duckdb
import pytest

from tamarack.llm import queries
from tests.test_catalogue import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toArrow()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        assert rows(got) == rows(con.sql(queries.ORACLES[name]).to_arrow_table())
    else:
        assert got.num_rows > 0
