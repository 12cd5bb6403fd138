"""Queries whose feature is no selection return every row."""

import pytest

import __spark_entry__

ROWS = {
    "connect_by_level": "part",
    "plus_multi_column": "lineitem",
    "window_null_order": "part",
    "arithmetic": "lineitem",
    "instr_forms": "customer",
    "order_nulls_default_desc": "part",
    "order_nulls_default_asc": "part",
    "order_nulls_explicit": "part",
    "transfer_cleaning": "orders",
}


@pytest.mark.parametrize("name", ROWS)
def test_every_row(spark, name):
    folder = "/root/testdata/sf0.01"
    assert __spark_entry__.queries()[name](spark, folder).count() >= spark.read.parquet(f"{folder}/{ROWS[name]}.parquet").count()
