"""Every registered query of the engine runs; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

from gaussmill import likelihood_queries, queries

QUERIES, ORACLES = queries.QUERIES | likelihood_queries.QUERIES, queries.ORACLES | likelihood_queries.ORACLES
SLOW = {"cg_solve", "stochastic_traceinv", "stochastic_traceinv_bc", "slq_logdet"}  # covered by test_process


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table):
    names = sorted(table.columns)
    return names, sorted(table[names].astype(object).itertuples(index=False, name=None), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf, sql, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    (names, mine), (theirs_names, theirs) = rows(got), rows(sql.sql(ORACLES[name]).df())
    assert names == theirs_names and len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-6, nan_ok=True)


def test_entry_without_the_text_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 9
