"""The driver contract: entry(), queries(), oracle_sql()."""

import duckdb

import __spark_entry__ as entry
from corpusgraph.sources.tables import TABLES
from tests.conftest import SF_SMALL


def test_registry_shape():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 70
    assert set(sqls) <= set(qs)
    assert all(callable(f) for f in qs.values())


def test_every_oracle_sql_plans_in_duckdb():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        con.execute("EXPLAIN " + sql)  # raises on a syntax or binding error


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:7] == ["community", "size", "internal_edges", "external_edges", "total_edges",
                              "cohesion", "coupling"]
    assert df.count() > 0
