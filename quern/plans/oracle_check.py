"""Hold queries against DuckDB over one folder of tables."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 5)
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def spark_rows(df: DataFrame) -> tuple[list[str], list[str], Counter]:
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i].lower())
    kinds = [df.dtypes[i][1] for i in order]
    return [df.columns[i].lower() for i in order], kinds, Counter(tuple(normal(r[i]) for i in order) for r in df.collect())


def duckdb_rows(sql: str, folder: str) -> tuple[list[str], list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute(sql)
    names, types = [d[0] for d in con.description], [str(d[1]) for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return [names[i].lower() for i in order], [types[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in con.fetchall())


#: Types that count as the same.
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE", "smallint": "SMALLINT", "binary": "BLOB", "float": "FLOAT"}


def difference(spark: SparkSession, folder: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> str | None:
    """What differs between a query's rows and its SQL's; None if nothing does."""
    names, kinds, rows = spark_rows(query(spark, folder))
    other_names, other_kinds, other = duckdb_rows(sql, folder)
    if names != other_names:
        return f"columns {names} and {other_names}"
    if rows != other:
        return f"{sum(rows.values())} and {sum(other.values())} rows; only here {list((rows - other).items())[:3]}, only there {list((other - rows).items())[:3]}"
    if typed := [(n, a, b) for n, a, b in zip(names, kinds, other_kinds, strict=True) if KINDS.get(a, a.upper()) != b and not (a.startswith("decimal") and b.startswith("DECIMAL"))]:
        return f"types {typed}"
    return None
