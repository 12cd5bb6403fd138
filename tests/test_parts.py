"""Types, catalog, functions, transfer, integrity, data changes, streams."""

import datetime
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.catalog import Catalog, Constraint, Sequence
from quern.engine import Engine
from quern.errors import QuernError, UnsupportedFeature
from quern.functions import columns as C
from quern.operators import dml, integrity
from quern.operators.numbering import with_rownum
from quern.sources import readers, transfer
from quern.streaming.windows import windowed
from quern.types import spark_type


@pytest.mark.parametrize(
    ("oracle", "spark_text"),
    [
        ("NUMBER(10,2)", "decimal(10,2)"), ("NUMBER", "decimal(38,10)"), ("number(5)", "decimal(5,0)"), ("NUMBER(5,-2)", "decimal(7,0)"), ("VARCHAR2(20 BYTE)", "string"), ("CLOB", "string"),
        ("DATE", "timestamp_ntz"), ("TIMESTAMP(6)", "timestamp_ntz"), ("TIMESTAMP(6) WITH TIME ZONE", "timestamp"), ("RAW(16)", "binary"), ("BLOB", "binary"), ("BOOLEAN", "boolean"),
        ("BINARY_DOUBLE", "double"), ("PLS_INTEGER", "int"), ("SMALLINT", "smallint"), ("INTERVAL DAY(2) TO SECOND(6)", "interval day to second"), ("INTERVAL YEAR TO MONTH", "interval year to month"), ("XMLTYPE", "string"),
    ],
)
def test_types(oracle, spark_text):
    assert spark_type(oracle).simpleString() == spark_text


def test_unknown_type():
    with pytest.raises(UnsupportedFeature):
        spark_type("FANCY_TYPE")


def test_object_types():
    catalog = Catalog()
    order = catalog.add_types({"person": {"name": "VARCHAR2(10)", "home": "address"}, "address": {"street": "VARCHAR2(10)", "zip": "NUMBER(5)"}})
    assert order == ["address", "person"]
    assert catalog.types["person"]["home"].dataType == catalog.types["address"]
    with pytest.raises(QuernError):
        Catalog().add_types({"a": {"x": "b"}, "b": {"y": "a"}})


def test_synonyms_and_sequences():
    catalog = Catalog(schema="app")
    catalog.add_synonym("t", "public_t")
    catalog.add_synonym("t", "own_t", "app")
    assert catalog.synonym("t") == "own_t"
    assert catalog.synonym("none") is None
    s = Sequence("s", 10, 5, maximum=20)
    assert [s.nextval(), s.nextval(), s.current(), s.nextval()] == [10, 15, 15, 20]
    with pytest.raises(QuernError):
        s.nextval()


@pytest.mark.parametrize(("start", "step", "low", "high"), [(1, 1, None, 10), (4, 3, 2, 10), (7, -2, 1, 9), (-1, -1, -3, None), (5, 5, 5, 5)])
def test_cycling_sequences(start, step, low, high):
    """Every number lies within the range, and a batch has the numbers that single ones would have."""
    one, many = (Sequence("s", start, step, minimum=low, maximum=high, cycle=True) for _ in range(2))
    want, value = [], start
    for _ in range(40):
        want.append(value)
        value += step
        if step > 0 and value > high or step < 0 and value < low:
            value = (1 if low is None else low) if step > 0 else (-1 if high is None else high)
    assert [one.nextval() for _ in range(40)] == want
    got = []
    for n in (1, 25, 0, 14):
        numbers = many.reserve(n)
        got += [numbers.at(k) for k in range(n)]
    assert got == want and many.current() == want[-1]


def test_cycling_in_a_query(spark):
    engine = Engine(spark)
    engine.catalog.add_sequence("s", 4, 3, minimum=2, maximum=10, cycle=True)
    spark.range(0, 7, 1, 3).createOrReplaceTempView("seven")
    assert sorted(int(r.n) for r in engine.sql("SELECT s.NEXTVAL AS n, s.NEXTVAL AS m FROM seven").collect() if r.n == r.m) == [2, 2, 4, 5, 7, 8, 10]


def test_constraint_order():
    catalog = Catalog(constraints=[Constraint("c1", "a", "C"), Constraint("r1", "b", "R", references="a"), Constraint("r2", "c", "R", references="b"), Constraint("p", "a", "P"), Constraint("u", "a", "U")])
    assert [c.name for c in catalog.constraint_order()] == ["p", "u", "r1", "r2", "c1"]


def test_column_functions(spark):
    df = spark.createDataFrame([("banana", datetime.datetime(2024, 2, 29, 6), None)], "s string, d timestamp_ntz, n int")
    row = df.select(
        C.instr("s", "an", 1, 2).alias("a"), C.instr("s", "a", -1).alias("b"), C.concat_null_safe("s", "n").alias("c"), C.initcap(F.lit("a b-c")).alias("e"), C.add_months("d", 1).alias("f"),
        C.date_diff_days("d", F.lit(datetime.datetime(2024, 2, 28, 18))).alias("g"), C.least_strict("n", F.lit(1)).alias("h"), C.decode("n", F.lit(None), F.lit("null"), F.lit("x")).alias("i"), C.substr("s", -3, 2).alias("j"),
        C.round_date("d", "MONTH").alias("k"), C.strip_nul(F.lit("a\0b")).alias("l"), C.plus_days("d", 0.25).alias("m"), C.nvl2("n", F.lit(1), F.lit(2)).alias("o"),
    ).first()
    assert tuple(row) == (4, 6, "banana", "A B-C", datetime.datetime(2024, 3, 31, 6), 0.5, None, "null", "an", datetime.datetime(2024, 3, 1), "ab", datetime.datetime(2024, 2, 29, 12), 2)


def test_transfer(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\0", bytearray(b"\x01"), [1])], "i int, s string, b binary, a array<int>")
    target = str(tmp_path / "t")
    assert transfer.copy_table(spark, "t", df, target).action == "copied"
    assert transfer.copy_table(spark, "t", df, target).action == "equal"
    assert tuple(spark.read.parquet(target).first()) == (1, "a", bytearray(b"\x01"), "[1]")
    assert transfer.copy_table(spark, "t", df.limit(0), target).action == "empty"
    assert transfer.copy_table(spark, "t", df.union(df), target).target_rows == 2
    outcomes = transfer.copy_tables(spark, {"x": df, "y": df}, str(tmp_path / "many"))
    assert [o.action for o in outcomes] == ["copied", "copied"]
    got = transfer.reconcile(spark, {"x": df, "z": df}, {"x": df}).orderBy("table_name").collect()
    assert [tuple(r) for r in got] == [("x", 1, 1, True), ("z", 1, -1, False)]


def test_unreadable_target(spark, tmp_path):
    """A target that is there but cannot be read is no missing one: it is not overwritten."""
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no parquet")
    outcome = transfer.copy_tables(spark, {"bad": spark.range(3)}, str(tmp_path))[0]
    assert outcome.action == "failed" and (tmp_path / "bad" / "part.parquet").read_text() == "no parquet"


def test_merge_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (3, "y"), (3, "z"), (None, "n")], "k int, v string")
    got = sorted((tuple(r) for r in dml.merge_rows(target, source, ["k"]).collect()), key=repr)
    assert got == sorted([(1, "x"), (2, "b"), (None, "c"), (3, "y"), (3, "z"), (None, "n")], key=repr)
    twice = source.union(source.limit(1))
    with pytest.raises(Exception, match="several rows"):
        dml.merge_rows(target, twice.filter("k = 1"), ["k"]).collect()


def test_many_rownums(spark, monkeypatch):
    """Beyond the bound for one task, ROWNUM numbers rows in their partitions and lets through as many."""
    from quern.sql import lowering

    spark.range(0, 1000, 1, 8).createOrReplaceTempView("thousand")
    monkeypatch.setattr(lowering, "FEW_ROWS", 10)
    engine = Engine(spark)
    assert engine.sql("SELECT id FROM thousand WHERE ROWNUM <= 700").count() == 700
    rows = engine.sql("SELECT id, ROWNUM AS r FROM thousand WHERE ROWNUM <= 700").collect()
    assert sorted(r.r for r in rows) == list(range(1, 701)) and len({r.id for r in rows}) == 700
    assert engine.sql("SELECT COUNT(*) AS n FROM thousand WHERE ROWNUM <= 700").first().n == 700


def test_batch_size_and_dictionary():
    assert readers.batch_size(T.StructType([T.StructField("b", T.BinaryType())])) == 50
    assert readers.batch_size(T.StructType([T.StructField("i", T.IntegerType())])) == 50_000
    assert readers.batch_size(T.StructType([T.StructField("s", T.StringType())])) == 10_000
    assert readers.dictionary_query("views", ["hr"]) == "(SELECT owner, view_name, text FROM all_views WHERE owner IN ('HR')) t"
    assert readers.dictionary_query("schemas", ["o'hare"]) == "(SELECT username FROM all_users WHERE username IN ('O''HARE')) t"


def test_jdbc(spark, tmp_path):
    """Writing, reading in ranges and reading a dictionary, against the database among Spark's own jars."""
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    base = readers.Jdbc(f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    df = spark.createDataFrame([(i, f"n'{i}", None if i % 7 == 0 else i / 2) for i in range(100)], "id int, label string, amount double")
    base.write(df, "things", mode="overwrite")
    base.write(df.limit(3), "things")
    got = base.read(spark, "things", "id", (0, 100), 4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 103
    assert sorted(tuple(r) for r in got.dropDuplicates().filter("amount is not null").collect()) == sorted(tuple(r) for r in df.filter("amount is not null").collect())
    assert base.read(spark, '(SELECT COUNT(*) AS n FROM things WHERE "amount" IS NULL) t').first()[0] == 15 + 1
    narrow = readers.Jdbc(base.url, driver=base.driver, options={"createTableColumnTypes": "OWNER VARCHAR(30), VIEW_NAME VARCHAR(30), TEXT VARCHAR(99)"})
    narrow.write(spark.createDataFrame([("HR", "V", "SELECT 1"), ("O'HARE", "W", "SELECT 2")], "OWNER string, VIEW_NAME string, TEXT string"), "all_views", mode="overwrite")
    assert [tuple(r) for r in readers.read_dictionary(spark, base, "views", ["o'hare"]).collect()] == [("O'HARE", "W", "SELECT 2")]


def test_derby(spark, tmp_path):
    """A database of one process: what the driver has written, whole and in batches, as others may read it."""
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    base = readers.Derby(f"{tmp_path}/db")
    df = spark.createDataFrame([(i, f"n'{i}" if i % 5 else "", None if i % 7 == 0 else i / 3) for i in range(100)], "id int, label string, amount double")
    base.write(df.repartition(3), "things", mode="overwrite", batch=8)
    base.write(df.limit(0), "things")
    base.write(df.limit(3).select("amount", "id", "label"), "things")
    read = base.readable(spark, f"{tmp_path}/packed")
    assert sorted(map(str, read.read(spark, "things", "id", (0, 100), 4).collect())) == sorted(map(str, df.collect() + df.limit(3).collect()))
    base.write(df.filter("id < 5"), "things", mode="overwrite")
    assert read.read(spark, "things").count() == 103
    assert base.readable(spark, f"{tmp_path}/packed-again").read(spark, "things").count() == 5


def test_derby_in_a_cluster(tmp_path):
    """The round trip where the executors are processes of their own."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # a home whose folder of work may be written
        if p.name != "work":
            (home / p.name).symlink_to(p)
    program = f"""
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.config(map={{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.sql.warehouse.dir": "{tmp_path}/warehouse"}}).getOrCreate()
got = __spark_entry__.queries()["jdbc_round_trip"](spark, "/root/testdata/sf0.001").collect()
want = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey", "c_name", "c_acctbal").collect()
assert sorted(got) == sorted(want) and want
print("alike")
spark.stop()
"""
    root = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"PYTHONPATH": root, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    ran = subprocess.run([sys.executable, "-c", program], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "alike" in ran.stdout, ran.stderr[-3000:]


def test_integrity(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 3)], "a int, b int")
    assert {tuple(r) for r in integrity.key_violations(df, ["a"]).collect()} == {(1, 2), (None, 1)}
    assert {tuple(r) for r in integrity.key_violations(df, ["a"], True).collect()} == {(1, 2)}
    assert integrity.orphans(df, ["b"], df, ["a"]).count() == 1
    assert integrity.check_violations(df, "b < 3").count() == 1
    assert integrity.null_violations(df, ["a", "b"]).count() == 2


def test_data_changes(spark):
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame([(1, 10), (2, None)], "id int, v int"))
    assert engine.sql("UPDATE t SET v = NVL(v, 0) + 1 WHERE id IN (SELECT id FROM t WHERE v IS NULL)").first()[0] == 1
    assert engine.sql("INSERT INTO t (id) VALUES (3)").first()[0] == 1
    assert engine.sql("DELETE FROM t WHERE v > 5").first()[0] == 1
    assert sorted((r[0], r[1]) for r in spark.table("t").collect()) == [(2, 1), (3, None)]
    with pytest.raises(QuernError):
        engine.sql("INSERT INTO t (nope) VALUES (1)")
    merged = dml.merge_rows(spark.table("t"), spark.createDataFrame([(3, 30), (4, 40)], "id int, v int"), ["id"])
    assert sorted(tuple(r) for r in merged.collect()) == [(2, 1), (3, 30), (4, 40)]


def test_row_numbers_are_dense(spark):
    got = sorted(r.n for r in with_rownum(spark.range(0, 1000, 1, 7), "n", 10, 2).select("n").collect())
    assert got == list(range(10, 2010, 2))


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    aggregates = {"n": F.count("*"), "v": F.round(F.sum("value"), 2)}
    batch = windowed(events, "ts", "6 hours", aggregates, ["event_type"])
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "6 hours", aggregates, ["event_type"], late="1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(batch) == key(spark.table("windows"))
