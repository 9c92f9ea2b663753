"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect("sf0.001")


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k.startswith("p3_") or not (k[0] == "p" and k[1].isdigit())))
def test_query(spark, con, name):
    columns, got = oracle.spark_rows(QUERIES[name](spark, f"{oracle.DATA}/sf0.001"))
    if name in SQL:
        assert (columns, got) == oracle.sql_rows(con, SQL[name])
