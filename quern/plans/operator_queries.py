"""Queries over the operators that have no SQL syntax, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Constraint
from ..engine import Engine
from ..functions import columns as C

from ..operators import dml, integrity
from ..operators.hierarchy import connect_by
from ..operators.numbering import with_rownum
from ..session import engine_for
from ..sources.transfer import copy_table, reconcile, serialised, staged, transferable, unstaged
from ..streaming.windows import sessions, windowed
from ..storage import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DUCKDB: dict[str, str] = {}


def registrar(queries: dict[str, Query], duckdb: dict[str, str]) -> Callable[[str], Callable[[Query], Query]]:
    """A decorator that registers a query with its equivalent."""

    def against(sql: str) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            duckdb[f.__name__] = sql
            return f

        return keep

    return against


against = registrar(QUERIES, DUCKDB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@against("SELECT t AS table_name, s AS source_rows, g AS target_rows, s = g AS equal FROM (SELECT 'orders' AS t, (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS g UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer) UNION ALL SELECT 'part', (SELECT count(*) FROM part), -1)")
def row_count_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Tables against their targets: one as it should be, one short of rows, one missing."""
    source = {n: table(spark, folder, n) for n in ("orders", "customer", "part")}
    return reconcile(spark, source, {"orders": source["orders"].filter("o_orderstatus <> 'F'"), "customer": source["customer"]})


@against("SELECT action, source_rows, target_rows, CASE action WHEN 'read' THEN (SELECT CAST(sum(l_orderkey) AS BIGINT) FROM lineitem) END AS checked FROM (SELECT unnest(['copied', 'equal', 'read']) AS action), (SELECT count(*) AS source_rows, count(*) AS target_rows FROM lineitem)")
def table_transfer(spark: SparkSession, folder: str) -> DataFrame:
    """A table copied to an empty target, found equal the second time, and read back."""
    source, path = table(spark, folder, "lineitem"), shared_path(spark, "transfer")
    done = [copy_table(spark, "lineitem", source, path) for _ in range(2)]
    rows = spark.createDataFrame([(o.action, o.source_rows, o.target_rows, None) for o in done], "action string, source_rows long, target_rows long, checked long")
    n = F.count(F.lit(1))
    return rows.unionByName(spark.read.parquet(path).agg(F.lit("read").alias("action"), n.alias("source_rows"), n.alias("target_rows"), F.sum("l_orderkey").cast("long").alias("checked")))


@against("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def pk_violations(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.key_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@against("SELECT p_size, COUNT(*) AS n FROM (SELECT NULLIF(p_size, 11) AS p_size FROM part) WHERE p_size IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1")
def unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.expr("nullif(p_size, 11)").alias("p_size"))
    return integrity.key_violations(part, ["p_size"], allow_null=True)


@against("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return integrity.orphans(orders, ["o_custkey"], table(spark, folder, "customer").filter("c_acctbal > 0"), ["c_custkey"])


@against("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0)")
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    return integrity.validate(e, Constraint("positive", "customer", "C", condition="NVL(c_acctbal, 0) >= 0")).select("c_custkey", "c_acctbal")


@against("SELECT p_partkey, COALESCE(NULLIF(p_size, 11), 99) AS p_size FROM part")
def apply_default(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.expr("nullif(p_size, 11)").alias("p_size"))
    return dml.apply_defaults(part, {"p_size": "99"})


@against("SELECT p_partkey, upper(hex(encode(p_name))) AS h, p_name AS back FROM part")
def lob_hex_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    h = C.lob_to_hex("p_name")
    return table(spark, folder, "part").select("p_partkey", h.alias("h"), C.lob_from_hex(h).cast("string").alias("back"))


@against("""SELECT p_partkey, '{"oracleType":"SYS.NUMBER","value":"' || p_size || '"}' AS a FROM part""")
def anydata_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", C.to_anydata("p_size", "SYS.NUMBER").alias("a"))


@against("""SELECT o_orderkey, o_orderstatus || 'b' AS t, '[' || o_custkey || ',2]' AS a, '{"s":"' || o_orderstatus || '"}' AS o FROM orders""")
def transfer_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit("\u0000b")).alias("t"), F.array("o_custkey", F.lit(2)).alias("a"), F.struct(F.col("o_orderstatus").alias("s")).alias("o"))
    return transferable(rows)


@against(
    r'''SELECT c_custkey, '("' || c_name || ' (x)",' || c_nationkey || ',,"(' || c_mktsegment || ',""a """"b"""""")")' AS obj,
        '{"oracleType":"MDSYS.SDO_POINT_TYPE","value":{"x":' || c_nationkey || ',"y":1}}' AS geo, '{"oracleType":"SYS.AQ$_JMS_TEXT_MESSAGE","value":{"text":"' || c_mktsegment || '"}}' AS msg,
        '<c>' || c_custkey || '</c>' AS doc, '{"oracleType":"SYS.NUMBER","value":"' || c_nationkey || '"}' AS anything FROM customer'''
)
def object_serialisation(spark: SparkSession, folder: str) -> DataFrame:
    """Object, spatial, queue, XML and self-describing columns as text."""
    inner = F.struct(F.col("c_mktsegment").alias("seg"), F.lit('a "b"').alias("note"))
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        F.struct(F.concat("c_name", F.lit(" (x)")).alias("name"), F.col("c_nationkey").alias("k"), F.lit(None).cast("string").alias("none"), inner.alias("place")).alias("obj"),
        F.struct(F.col("c_nationkey").alias("x"), F.lit(1).alias("y")).alias("geo"),
        F.struct(F.col("c_mktsegment").alias("text")).alias("msg"),
        F.concat(F.lit("<c>"), "c_custkey", F.lit("</c>\u0000")).alias("doc"),
        F.struct(F.lit("SYS.NUMBER").alias("type"), F.col("c_nationkey").alias("value")).alias("anything"),
    )
    return serialised(rows, {"obj": "HR.PERSON", "geo": "SDO_POINT_TYPE", "msg": "AQ$_JMS_TEXT_MESSAGE", "doc": "XMLTYPE", "anything": "ANYDATA"})


@against("SELECT c_custkey, c_name AS b, CASE WHEN c_nationkey > 5 THEN c_mktsegment END AS t FROM customer")
def lob_staging(spark: SparkSession, folder: str) -> DataFrame:
    """LOB columns by way of staging columns, one of them declared NOT NULL."""
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("b"), F.expr("CASE WHEN c_nationkey > 5 THEN c_mktsegment END").alias("t"))
    lobs = {"b": "BLOB", "t": "CLOB"}
    path = shared_path(spark, "staged")
    staged(rows, lobs).write.parquet(path)
    return unstaged(spark.read.parquet(path), lobs, ["b"]).select("c_custkey", F.col("b").cast("string").alias("b"), F.col("t").cast("string").alias("t"))


@against("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.readers import read_files, write_files

    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = shared_path(spark, "csv")
    write_files(customer, path, "csv")
    return read_files(spark, path, "csv", customer.schema)


@against("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, CAST(n_regionkey AS DOUBLE) AS area FROM nation")
def view_cast_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    return e.create_view("nation_view", "SELECT n_nationkey, n_name, n_regionkey FROM nation", {"id": "INTEGER", "label": "VARCHAR2(25)", "area": "FLOAT"})


@against("SELECT 1 AS a, 'x' AS b LIMIT 0")
def view_stub(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark).create_view_stub("stub_view", {"a": "PLS_INTEGER", "b": "VARCHAR2(1)"})


@against("SELECT n_name FROM nation WHERE n_nationkey < 4")
def synonym_view(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.catalog.schema = "app"
    e.catalog.add_synonym("lands", "nation")
    e.catalog.add_synonym("countries", "lands", "app")
    return e.sql("SELECT n_name FROM countries WHERE n_nationkey < 4")


@against("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 999, 'new'")
def insert_select(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.register("region_copy", table(spark, folder, "region"))
    e.sql("INSERT INTO region_copy (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
    e.sql("INSERT INTO region_copy VALUES (999, 'new')")
    return spark.table("region_copy")


@against("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal * -1 + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_expr(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.register("customer_copy", table(spark, folder, "customer"))
    e.sql("UPDATE customer_copy SET c_acctbal = c_acctbal * -1 + 1, c_mktsegment = 'DEBT' WHERE c_acctbal < 0")
    return spark.table("customer_copy")


@against("SELECT n_nationkey, (SELECT r_name FROM region r WHERE r.r_regionkey = n.n_regionkey) AS n_name, n_regionkey FROM nation n")
def update_from_subquery(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.register("nation_copy", table(spark, folder, "nation"))
    e.sql("UPDATE nation_copy n SET n_name = (SELECT r.r_name FROM region r WHERE r.r_regionkey = n.n_regionkey)")
    return spark.table("nation_copy")


@against("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderstatus = 'F')")
def delete_where(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.register("orders_copy", table(spark, folder, "orders"))
    e.sql("DELETE FROM orders_copy WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
    return spark.table("orders_copy").select("o_orderkey")


@against("SELECT p_partkey FROM part WHERE p_size <> 11 OR p_type = 'PROMO'")
def delete_keeps_unknown(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("p_size", F.expr("nullif(p_size, 12)"))
    return dml.delete_rows(part, "p_size = 11 AND p_type <> 'PROMO'").select("p_partkey")


@against("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'x' || n_nationkey ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'x100'")
def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    keys = spark.createDataFrame([(k, f"x{k}") for k in (0, 1, 2, 3, 4, 100)], "n_nationkey int, n_name string")
    return dml.merge_rows(nation, keys, ["n_nationkey"])


@against("SELECT CAST(100 + 5 * (row_number() OVER (ORDER BY r_regionkey) - 1) AS BIGINT) AS id, r_name FROM region")
def sequence_nextval(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.catalog.add_sequence("region_seq", 100, 5)
    return e.sql("SELECT region_seq.NEXTVAL AS id, r_name FROM (SELECT r_name FROM region ORDER BY r_regionkey)").select(F.col("id").cast("long").alias("id"), "r_name")


@against("SELECT CAST(1 AS BIGINT) AS lo, COUNT(*) AS hi, COUNT(*) AS n FROM lineitem")
def dense_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    numbered = with_rownum(table(spark, folder, "lineitem").select("l_orderkey"), "rn")
    return numbered.agg(F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.countDistinct("rn").alias("n"))


@against("WITH RECURSIVE t AS (SELECT c_custkey AS id, (c_custkey - 1) // 4 AS up FROM customer), h AS (SELECT id, 1 AS lvl FROM t WHERE id = 0 UNION ALL SELECT t.id, h.lvl + 1 FROM t JOIN h ON t.up = h.id WHERE t.id > 0) SELECT id, CAST(lvl AS BIGINT) AS lvl FROM h")
def connect_by_operator(spark: SparkSession, folder: str) -> DataFrame:
    tree = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey > 0 THEN floor((c_custkey - 1) / 4) END").alias("up"))
    return connect_by(tree, "id = 0", [("id", "up")]).select("id", F.col("_level").alias("lvl"))


@against("SELECT n_nationkey, n_nationkey * 2 + 1 AS v FROM nation")
def udf_call(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.create_function("calc.twice_plus", {"x": "PLS_INTEGER", "y": "PLS_INTEGER"}, "PLS_INTEGER", "x * 2 + y")
    return e.sql("SELECT n_nationkey, calc.twice_plus(n_nationkey, 1) AS v FROM nation")


@against("SELECT c_custkey, c_name AS nm, c_nationkey AS nk FROM customer")
def struct_field(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    e.register("objects", table(spark, folder, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("key")).alias("place")).alias("obj")))
    return e.sql("SELECT o.c_custkey, o.obj.name AS nm, o.obj.place.key AS nk FROM objects o")


@against("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last, 64 AS n FROM embeddings")
def array_element_1based(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder)
    return e.sql("SELECT vec_id, CAST(ELEMENT(embedding, 1) AS BINARY_DOUBLE) AS first, CAST(ELEMENT(embedding, 64) AS BINARY_DOUBLE) AS last, CARDINALITY(embedding) AS n FROM embeddings")


@against("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def map_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))


@against("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, (time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR)::TIMESTAMP AS window_end, COUNT(*) AS n, ROUND(SUM(value), 2) AS v FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, folder: str) -> DataFrame:
    return windowed(table(spark, folder, "events"), "ts", "1 hour", {"n": F.count("*"), "v": F.round(F.sum("value"), 2)}, ["event_type"])


@against("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 1 HOUR AS session_end, COUNT(*) AS n FROM s GROUP BY user_id, g")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(table(spark, folder, "events"), "ts", "1 hour", {"n": F.count("*")}, ["user_id"])


@against("SELECT 'customer' AS table_name, 'c_phone' AS column_name, 'missing' AS state UNION ALL SELECT 'customer', 'c_mktsegment', 'extra' UNION ALL SELECT 'customer', 'c_acctbal', 'different'")
def catalog_verification(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.readers import session_columns

    table(spark, folder, "customer").createOrReplaceTempView("customer")
    actual = session_columns(spark, ["customer"])
    changed = actual.filter("column_name <> 'c_mktsegment'").withColumn("data_type", F.when(F.col("column_name") == "c_acctbal", "decimal(12,2)").otherwise(F.col("data_type")))
    expected = changed.unionByName(changed.limit(1).withColumn("column_name", F.lit("c_phone")))
    return integrity.catalog_difference(expected, actual, ["table_name", "column_name"], ["data_type"])


@against("SELECT p_partkey, CAST(sign(p_retailprice) * floor(p_retailprice / 100) * 100 AS DOUBLE) AS t, p_type || '-' AS c, round(p_retailprice / SUM(p_retailprice) OVER (PARTITION BY p_type), 8) AS r FROM part")
def column_functions(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("p_type")
    return table(spark, folder, "part").select("p_partkey", C.trunc_number("p_retailprice", -2).alias("t"), C.concat_null_safe("p_type", F.lit("-"), F.lit(None)).alias("c"), F.round(C.ratio_to_report("p_retailprice", w), 8).alias("r"))
