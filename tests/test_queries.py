"""Every query runs on the smallest tables and agrees with its SQL."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(k for k in QUERIES if not (k[0] == "p" and k[1].isdigit() and k.split("_")[0] not in ("p5", "p6")))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, name):
    if name in SQL:
        assert oracle.compare(spark, name, QUERIES[name], SQL[name], sf) is None
    else:
        df = QUERIES[name](spark, sf)
        assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
