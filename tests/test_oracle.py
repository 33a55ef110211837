"""Every query with a SQL twin, on Spark and on DuckDB, value by value."""

import duckdb
import pytest

from tabloom.queries import registry
from tools.compare import TABLES, compare

CHECKED = {name: pair for name, pair in registry().items() if pair[1]}


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_same_values(name, spark, sf_dir, connection):
    run, sql = CHECKED[name]
    status, _, _, detail = compare(spark, connection, run, sql, sf_dir)
    assert status.startswith("ok"), (status, detail)


def test_entry_contract(spark):
    from tools.compare import entry_module

    module = entry_module()
    assert set(module.oracle_sql()) <= set(module.queries())
    rows = module.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["accuracy"] > 0.8
