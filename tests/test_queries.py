"""Every query of the catalogue against its DuckDB equivalent."""

import pytest

import __spark_entry__
from quern.plans import dialect_queries, operator_queries, procedure_queries
from quern.plans.oracle_check import difference
from quern.session import engine_for


@pytest.mark.parametrize("name", dialect_queries.ORACLE)
def test_dialect(spark, small, name):
    engine = engine_for(spark, small)
    assert difference(spark, small, lambda s, d: engine.sql(dialect_queries.ORACLE[name]), dialect_queries.DUCKDB[name]) is None


@pytest.mark.parametrize("name", operator_queries.QUERIES)
def test_operator(spark, small, name):
    assert difference(spark, small, operator_queries.QUERIES[name], operator_queries.DUCKDB[name]) is None


@pytest.mark.parametrize("name", procedure_queries.QUERIES)
def test_procedure(spark, small, name):
    assert difference(spark, small, procedure_queries.QUERIES[name], procedure_queries.DUCKDB[name]) is None


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert df.columns == ["n_name", "area", "customers", "revenue", "place"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
