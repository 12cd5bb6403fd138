"""Queries over the procedural surface: routines, cursors, exceptions, packages, triggers; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..proc import Runtime
from ..session import engine_for
from ..sources.readers import Derby
from ..storage import local_file, shared_path
from .migration import ColumnSpec, Migration, Schema
from .operator_queries import Query, registrar, table

QUERIES: dict[str, Query] = {}
DUCKDB: dict[str, str] = {}
against = registrar(QUERIES, DUCKDB)


def _runtime(spark: SparkSession, folder: str, *names: str) -> Runtime:
    return Runtime(engine_for(spark, folder, names or ("region", "nation")))


def _copy(engine: Engine, folder: str, name: str, *columns: str) -> str:
    df = table(engine.spark, folder, name)
    engine.register(f"{name}_copy", df.select(*columns) if columns else df)
    return f"{name}_copy"


@against("SELECT r_regionkey, CAST(coalesce(sum(n_nationkey), 0) + count(n_nationkey) AS BIGINT) AS total FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def proc_cursor_loop(spark: SparkSession, folder: str) -> DataFrame:
    """A function with a cursor that takes a parameter, called for each region."""
    run = _runtime(spark, folder)
    run.run(
        """CREATE FUNCTION total(p NUMBER) RETURN NUMBER IS
             v NUMBER := 0;
             CURSOR c(d NUMBER) IS SELECT n_nationkey FROM nation WHERE n_regionkey = d;
           BEGIN
             FOR r IN c(p) LOOP v := v + r.n_nationkey + 1; END LOOP;
             RETURN v;
           END;"""
    )
    keys = [r[0] for r in run.engine.sql("SELECT r_regionkey FROM region ORDER BY r_regionkey").toLocalIterator()]
    return spark.createDataFrame([(k, int(run.call("total", k))) for k in keys], "r_regionkey int, total long")


@against("SELECT 1 + (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) AS place, c_custkey FROM customer QUALIFY place <= 10")
def proc_cursor_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """OPEN, FETCH, %NOTFOUND, %ROWCOUNT, %ISOPEN and CLOSE: the first ten of an ordered cursor."""
    run = _runtime(spark, folder, "customer")
    run.run(
        """DECLARE
             CURSOR c IS SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey;
             r c%ROWTYPE;
           BEGIN
             OPEN c;
             LOOP FETCH c INTO r; EXIT WHEN c%NOTFOUND OR c%ROWCOUNT > 10; DBMS_OUTPUT.PUT_LINE(c%ROWCOUNT || ' ' || r.c_custkey); END LOOP;
             IF c%ISOPEN THEN CLOSE c; END IF;
           END;"""
    )
    return spark.createDataFrame([tuple(map(int, line.split())) for line in run.output], "place long, c_custkey long")


@against("SELECT k, CASE WHEN n = 1 THEN first ELSE CASE WHEN n IS NULL THEN 'none' ELSE 'many' END END AS found FROM (SELECT unnest(range(-1, 26)) AS k) LEFT JOIN (SELECT n_nationkey AS b, count(*) AS n, min(n_name) AS first FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 3, 'again') GROUP BY 1) ON k = b")
def proc_select_into(spark: SparkSession, folder: str) -> DataFrame:
    """SELECT INTO with exactly one row, none, and several."""
    run = _runtime(spark, folder)
    run.run(
        """CREATE FUNCTION name_of(k NUMBER) RETURN VARCHAR2 IS v VARCHAR2(50);
           BEGIN SELECT n_name INTO v FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 3, 'again' FROM dual) WHERE n_nationkey = k; RETURN v;
           EXCEPTION WHEN NO_DATA_FOUND THEN RETURN 'none'; WHEN TOO_MANY_ROWS THEN RETURN 'many'; END;"""
    )
    return spark.createDataFrame([(k, run.call("name_of", k)) for k in range(-1, 26)], "k long, found string")


@against("SELECT * FROM (VALUES (1, 'zero'), (2, 'ORA-20010: own -20010'), (3, 'value'), (4, 'others'), (5, 'inner outer')) t(line, said)")
def proc_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    """Predefined and own exceptions, EXCEPTION_INIT, SQLERRM, SQLCODE, RAISE again."""
    run = _runtime(spark, folder)
    run.run(
        """DECLARE
             e_own EXCEPTION; PRAGMA EXCEPTION_INIT(e_own, -20010); v NUMBER; said VARCHAR2(20) := 'inner';
           BEGIN
             BEGIN v := 1 / 0; EXCEPTION WHEN ZERO_DIVIDE THEN DBMS_OUTPUT.PUT_LINE('zero'); END;
             BEGIN RAISE_APPLICATION_ERROR(-20010, 'own'); EXCEPTION WHEN e_own THEN DBMS_OUTPUT.PUT_LINE(SQLERRM || ' ' || SQLCODE); END;
             BEGIN v := 'abc' + 1; EXCEPTION WHEN VALUE_ERROR THEN DBMS_OUTPUT.PUT_LINE('value'); END;
             BEGIN RAISE e_own; EXCEPTION WHEN OTHERS THEN DBMS_OUTPUT.PUT_LINE('others'); END;
             BEGIN
               BEGIN RAISE NO_DATA_FOUND; EXCEPTION WHEN NO_DATA_FOUND THEN RAISE; END;
             EXCEPTION WHEN NO_DATA_FOUND THEN DBMS_OUTPUT.PUT_LINE(said || ' outer'); END;
           END;"""
    )
    return spark.createDataFrame([(k, said) for k, said in enumerate(run.output, 1)], "line int, said string")


@against("SELECT r_regionkey, CAST(5 + sum(r_regionkey + 1) OVER (ORDER BY r_regionkey) AS BIGINT) AS state FROM region")
def proc_package_state(spark: SparkSession, folder: str) -> DataFrame:
    """A package's variable lives from call to call; members have defaults and call each other."""
    run = _runtime(spark, folder)
    run.run(
        """CREATE PACKAGE BODY pk AS
             g NUMBER := 4;
             PROCEDURE bump(n NUMBER DEFAULT 1) IS BEGIN g := g + n; END;
             FUNCTION state RETURN NUMBER IS BEGIN bump; RETURN g; END;
           BEGIN bump; END pk;"""
    )
    out = []
    for r in run.engine.sql("SELECT r_regionkey FROM region ORDER BY r_regionkey").toLocalIterator():
        run.call("pk.bump", int(r[0]))
        out.append((r[0], int(run.call("pk.state"))))
    return spark.createDataFrame(out, "r_regionkey int, state long")


@against("SELECT x, CAST(sum(i) AS BIGINT) AS odd, CAST(max(i) AS BIGINT) AS last, CASE WHEN x > 5 THEN 'big' WHEN x = 5 THEN 'five' ELSE 'small' END AS size FROM (SELECT unnest(range(1, 9)) AS x), (SELECT unnest(range(1, 9)) AS i) WHERE i <= x AND i % 2 = 1 GROUP BY x")
def proc_control_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Loops with labels, EXIT, CONTINUE, WHILE, CASE, IF, and OUT parameters."""
    run = _runtime(spark, folder)
    run.run(
        """CREATE FUNCTION f(x NUMBER, odd OUT NUMBER, last OUT NUMBER) RETURN VARCHAR2 AS
             i NUMBER := 0;
           BEGIN
             odd := 0;
             <<outer>> FOR k IN 1..100 LOOP
               EXIT outer WHEN k > x;
               CONTINUE WHEN MOD(k, 2) = 0;
               odd := odd + k;
             END LOOP;
             WHILE i < x LOOP i := i + 1; END LOOP;
             LOOP EXIT WHEN MOD(i, 2) = 1; i := i - 1; END LOOP;
             last := i;
             CASE WHEN x > 5 THEN RETURN 'big'; ELSE NULL; END CASE;
             IF x = 5 THEN RETURN 'five'; ELSIF x < 5 THEN RETURN 'small'; ELSE RETURN 'never'; END IF;
           END;"""
    )
    got = [(x, run.call("f", x)) for x in range(1, 9)]
    return spark.createDataFrame([(x, int(v["odd"]), int(v["last"]), v["return"]) for x, v in got], "x long, odd long, last long, size string")


@against("SELECT * FROM (VALUES (CAST(4 AS BIGINT), CAST(15 AS BIGINT), CAST(107 AS BIGINT), 'z')) t(n, total, mapped, label)")
def proc_collections(spark: SparkSession, folder: str) -> DataFrame:
    """Nested tables, associative arrays, records."""
    run = _runtime(spark, folder)
    run.run(
        """CREATE PROCEDURE p(n OUT NUMBER, total OUT NUMBER, mapped OUT NUMBER, label OUT VARCHAR2) IS
             TYPE t_list IS TABLE OF NUMBER; TYPE t_map IS TABLE OF NUMBER INDEX BY VARCHAR2(10); TYPE t_rec IS RECORD (a NUMBER := 7, b VARCHAR2(5));
             v t_list := t_list(1, 2, 3); m t_map; r t_rec;
           BEGIN
             v.EXTEND(2); v(4) := 10; v(5) := 0; v.DELETE(1); total := 0;
             FOR i IN 1..v.COUNT LOOP total := total + v(i); END LOOP;
             n := v.COUNT; m('x') := 100;
             IF m.EXISTS('x') AND NOT m.EXISTS('y') THEN mapped := m('x') + r.a; END IF;
             r.b := 'z'; label := r.b;
           END;"""
    )
    got = run.call("p")
    return spark.createDataFrame([(int(got["n"]), int(got["total"]), int(got["mapped"]), got["label"])], "n long, total long, mapped long, label string")


@against("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal < 0 THEN 'debt' ELSE 'low' END AS grade FROM customer")
def proc_udf(spark: SparkSession, folder: str) -> DataFrame:
    """A procedural function over every row of a table, on the executors."""
    run = _runtime(spark, folder, "customer")
    run.run("CREATE FUNCTION grade(x NUMBER) RETURN VARCHAR2 IS BEGIN IF x > 5000 THEN RETURN 'high'; ELSIF x < 0 THEN RETURN 'debt'; END IF; RETURN 'low'; END;")
    return table(spark, folder, "customer").select("c_custkey", run.udf("grade", "string")("c_acctbal").alias("grade"))


@against("SELECT CAST(count(*) AS BIGINT) AS updated, CAST((SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS BIGINT) AS deleted FROM supplier WHERE s_acctbal > 1000")
def proc_sql_rowcount(spark: SparkSession, folder: str) -> DataFrame:
    """Data changes inside a block, with variables, and SQL%ROWCOUNT."""
    run = _runtime(spark, folder, "supplier")
    _copy(run.engine, folder, "supplier")
    run.run(
        """DECLARE floor_ NUMBER := 1000; BEGIN
             UPDATE supplier_copy SET s_acctbal = s_acctbal + floor_ WHERE s_acctbal > floor_; DBMS_OUTPUT.PUT_LINE(SQL%ROWCOUNT);
             DELETE FROM supplier_copy WHERE s_acctbal < 0; DBMS_OUTPUT.PUT_LINE(SQL%ROWCOUNT);
           END;"""
    )
    return spark.createDataFrame([tuple(map(int, run.output))], "updated long, deleted long")


@against("SELECT * FROM (VALUES ('ab', CAST(5 AS BIGINT), 'cde', 'page', true)) t(said, length, part, page, timed)")
def proc_builtins(spark: SparkSession, folder: str) -> DataFrame:
    """DBMS_OUTPUT, DBMS_LOB, DBMS_UTILITY and the page buffer."""
    run = _runtime(spark, folder)
    run.run(
        """CREATE PROCEDURE p(n OUT NUMBER, part OUT VARCHAR2, timed OUT VARCHAR2) IS v VARCHAR2(10) := 'abcde'; BEGIN
             DBMS_OUTPUT.ENABLE; DBMS_OUTPUT.PUT('a'); DBMS_OUTPUT.PUT('b'); DBMS_OUTPUT.NEW_LINE;
             n := DBMS_LOB.GETLENGTH(v); part := DBMS_LOB.SUBSTR(v, 3, 3); HTP.PRN('page');
             IF DBMS_UTILITY.GET_TIME >= 0 THEN timed := 'Y'; END IF;
           END;"""
    )
    got = run.call("p")
    return spark.createDataFrame([(run.output[0], int(got["n"]), got["part"], "".join(run.page), got["timed"] == "Y")], "said string, length long, part string, page string, timed boolean")


@against("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'NEW', 1.0")
def trigger_before_row(spark: SparkSession, folder: str) -> DataFrame:
    """A BEFORE trigger whose body sets columns of :NEW, as column expressions over all changed rows."""
    run = _runtime(spark, folder, "customer")
    _copy(run.engine, folder, "customer", "c_custkey", "c_name", "c_acctbal")
    run.run("CREATE TRIGGER names BEFORE INSERT OR UPDATE ON customer_copy FOR EACH ROW BEGIN :NEW.c_name := UPPER(:NEW.c_name); :NEW.c_name := :NEW.c_name || CASE WHEN UPDATING THEN '!' END; :NEW.c_acctbal := NVL(:NEW.c_acctbal, 1); END;")
    run.engine.sql("UPDATE customer_copy SET c_acctbal = 0 WHERE c_acctbal < 0")
    run.engine.sql("INSERT INTO customer_copy (c_custkey, c_name) VALUES (-1, 'new')")
    return spark.table("customer_copy")


@against("SELECT 'U' AS what, c_custkey, c_acctbal AS old_balance, c_acctbal * 2 AS new_balance FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'D', c_custkey, c_acctbal, NULL FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'I', -1, NULL, 5.0")
def trigger_after_row(spark: SparkSession, folder: str) -> DataFrame:
    """An AFTER trigger that logs inserts, updates and deletes, as one statement over the changed rows."""
    run = _runtime(spark, folder, "customer")
    _copy(run.engine, folder, "customer")
    run.engine.register("balance_log", spark.createDataFrame([], "what string, c_custkey long, old_balance double, new_balance double"))
    run.run(
        """CREATE TRIGGER log_balance AFTER INSERT OR UPDATE OR DELETE ON customer_copy FOR EACH ROW
           BEGIN
             INSERT INTO balance_log VALUES (CASE WHEN INSERTING THEN 'I' WHEN UPDATING THEN 'U' ELSE 'D' END, NVL(:NEW.c_custkey, :OLD.c_custkey), :OLD.c_acctbal, :NEW.c_acctbal);
           END;"""
    )
    run.engine.sql("UPDATE customer_copy SET c_acctbal = c_acctbal * 2 WHERE c_acctbal > 9000")
    run.engine.sql("DELETE FROM customer_copy WHERE c_acctbal < -500")
    run.engine.sql("INSERT INTO customer_copy (c_custkey, c_acctbal) VALUES (-1, 5)")
    return spark.table("balance_log")


@against("SELECT c_custkey FROM customer")
def trigger_before_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A BEFORE DELETE trigger that raises keeps the rows."""
    run = _runtime(spark, folder, "customer")
    _copy(run.engine, folder, "customer", "c_custkey", "c_acctbal")
    run.run("CREATE TRIGGER keep BEFORE DELETE ON customer_copy FOR EACH ROW BEGIN IF :OLD.c_acctbal > 0 THEN RAISE_APPLICATION_ERROR(-20003, 'kept'); END IF; END;")
    try:
        run.engine.sql("DELETE FROM customer_copy")
    except Exception as e:  # noqa: BLE001  Spark wraps what the executors raise
        if "kept" not in str(e):
            raise
    return spark.table("customer_copy").select("c_custkey")


@against("SELECT CAST(1 AS BIGINT) AS updates, CAST(1 AS BIGINT) AS deletes, CAST((SELECT count(*) FROM supplier WHERE s_acctbal <= 0) AS BIGINT) AS left_over")
def trigger_statement(spark: SparkSession, folder: str) -> DataFrame:
    """Statement triggers fire once, however many rows change."""
    run = _runtime(spark, folder, "supplier")
    _copy(run.engine, folder, "supplier")
    run.run("CREATE PACKAGE BODY seen AS u NUMBER := 0; d NUMBER := 0; END;")
    run.run("CREATE TRIGGER counted AFTER UPDATE OR DELETE ON supplier_copy BEGIN IF UPDATING THEN seen.u := seen.u + 1; ELSE seen.d := seen.d + 1; END IF; END;")
    run.engine.sql("UPDATE supplier_copy SET s_name = 'x'")
    run.engine.sql("DELETE FROM supplier_copy WHERE s_acctbal > 0")
    counts = run.packages["seen"].values
    return spark.table("supplier_copy").agg(F.lit(int(counts["u"])).cast("long").alias("updates"), F.lit(int(counts["d"])).cast("long").alias("deletes"), F.count(F.lit(1)).alias("left_over"))


@against(
    "SELECT c_custkey, CASE WHEN s THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM (SELECT c_custkey, c_acctbal, c_custkey % 3 = 0 AS s FROM customer) WHERE NOT (s AND c_acctbal + 1 < 0)"
    " UNION ALL SELECT 1000000 + c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 1 AND c_acctbal > 0"
)
def merge_statement(spark: SparkSession, folder: str) -> DataFrame:
    """MERGE with UPDATE, DELETE WHERE and INSERT WHERE."""
    e = engine_for(spark, folder, ("customer",))
    _copy(e, folder, "customer", "c_custkey", "c_acctbal")
    e.register("changes", table(spark, folder, "customer").selectExpr("CASE c_custkey % 3 WHEN 0 THEN c_custkey ELSE 1000000 + c_custkey END AS k", "c_acctbal AS b", "c_custkey % 3 AS third"))
    e.sql(
        """MERGE INTO customer_copy c USING (SELECT k, b, third FROM changes WHERE third < 2) s ON (c.c_custkey = s.k)
           WHEN MATCHED THEN UPDATE SET c_acctbal = s.b + 1 DELETE WHERE c.c_acctbal < 0
           WHEN NOT MATCHED THEN INSERT (c_custkey, c_acctbal) VALUES (s.k, s.b) WHERE s.b > 0"""
    )
    return spark.table("customer_copy")


@against("SELECT CAST(4 + 3 * ((rn - 1) % 3) AS BIGINT) AS id, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)")
def sequence_cycles(spark: SparkSession, folder: str) -> DataFrame:
    e = engine_for(spark, folder, ("customer",))
    e.catalog.add_sequence("ring", 4, 3, minimum=4, maximum=12, cycle=True)
    return e.sql("SELECT ring.NEXTVAL AS id, c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey)").select(F.col("id").cast("long").alias("id"), "c_custkey")


@against("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jdbc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Written to and read from a database by JDBC, in ranges of the key; the database is the one among Spark's jars."""
    path, packed, log = (local_file(shared_path(spark, name)) for name in ("jdbc", "jdbc-packed", "jdbc-log"))
    spark._jvm.System.setProperty("derby.stream.error.file", log)
    base = Derby(path)
    base.write(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), "customer_sink", mode="overwrite")
    read = base.readable(spark, packed)
    most = read.read(spark, '(SELECT MAX("c_custkey") AS m FROM customer_sink) t').first()[0]
    return read.read(spark, "customer_sink", "c_custkey", (0, max(int(most or 0), 0) + 1), 4)


def _schema(spark: SparkSession, folder: str) -> Schema:
    return Schema(
        "hr",
        tables={"lands": {"k": ColumnSpec("NUMBER(10)", False), "label": ColumnSpec("VARCHAR2(25)")}},
        data={"lands": table(spark, folder, "nation").selectExpr("n_nationkey AS k", "n_name AS label")},
        object_types={"place": {"k": "NUMBER(10)"}},
        sequences={"land_seq": (100, 1)},
        synonyms={"countries": "hr.lands"},
        views={"land_view": ("SELECT k, label FROM countries WHERE k < 5", {"k": "NUMBER(10)", "label": "VARCHAR2(25)"})},
        methods=[("place", "doubled", {}, "NUMBER", "self.k * 2")],
        code=["CREATE FUNCTION twice(x NUMBER) RETURN NUMBER IS BEGIN RETURN x * 2; END;", "CREATE PACKAGE BODY calc AS FUNCTION thrice(x NUMBER) RETURN NUMBER IS BEGIN RETURN x * 3; END; END;", "CREATE TRIGGER up BEFORE INSERT ON hr.lands FOR EACH ROW BEGIN :NEW.label := UPPER(:NEW.label); END;"],
    )


_OBJECTS = "('schema', 'hr'), ('synonym', 'countries'), ('type', 'place'), ('sequence', 'land_seq'), ('table', 'lands'), ('view', 'land_view'), ('method', 'place.doubled'), ('function', 'twice'), ('function', 'calc.thrice'), ('trigger', 'up')"


@against(f"SELECT kind, name, 'ok' AS state FROM (VALUES {_OBJECTS}) t(kind, name)")
def verify_migration(spark: SparkSession, folder: str) -> DataFrame:
    """Every object of a moved schema, as verification finds it."""
    m = Migration(spark, shared_path(spark, "moved"))
    schema = _schema(spark, folder)
    m.run(schema)
    return m.verify(schema)


@against(f"SELECT kind, name, CASE WHEN kind IN ('view', 'method', 'function') THEN 'stub' WHEN kind = 'trigger' THEN 'missing' ELSE 'ok' END AS state FROM (VALUES {_OBJECTS}) t(kind, name)")
def verify_stubs(spark: SparkSession, folder: str) -> DataFrame:
    """The same before views and code are implemented: their stubs stand in for them."""
    m = Migration(spark, shared_path(spark, "stubbed"))
    schema = _schema(spark, folder)
    m.steps = [s for s in m.steps if s[0] not in ("views", "code", "methods", "triggers")]
    m.run(schema)
    return m.verify(schema)
