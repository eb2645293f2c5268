"""Every registered query beside its SQL on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not here")
def test_every_query_equals_its_sql(spark):
    result = check_oracle.compare(spark, SF)
    assert {k: v for k, v in result.items() if v not in ("ok", "rows only")} == {}


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
