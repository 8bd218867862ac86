"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = con.execute(ORACLES[name])
    order = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in order]
    assert sorted(got.columns) == order
    plain = lambda x: None if x is None else float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    want = sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=str)
    rows = sorted(([plain(r[c]) for c in order] for r in got.collect()), key=str)
    assert rows == want


def test_two_formulations_agree(spark):
    row = QUERIES["two_formulations"](spark, SF).first()
    assert row["agrees"] and row["shared"] > 5


def test_entry_has_rows_and_queries_are_named(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
