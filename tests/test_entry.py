"""The registry: every query has SQL or is known to have none, and a few agree with it."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["filter_af", "filter_array_rhs", "split_number_g", "normalize_stats", "liftover_stats", "normalize_liftover_filter"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{DIR}/lineitem.parquet'")
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = lambda got: sorted([tuple(None if x is None else str(x) for x in r) for r in got], key=str)
    assert rows(df.select(*columns).collect()) == rows(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_every_variant_query_has_sql():
    names = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert names <= set(entry.oracle_sql())
