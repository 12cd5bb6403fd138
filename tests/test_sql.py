"""Parsing, lowering, and what must be refused rather than dropped."""

import datetime

import pytest

from quern.engine import Engine
from quern.errors import QuernError, SqlSyntaxError, UnsupportedFeature
from quern.operators.hierarchy import ConnectByLoop
from quern.session import engine_for
from quern.sql.lexer import tokens
from quern.sql.parser import parse


@pytest.fixture
def engine(spark, small):
    return engine_for(spark, small)


def one(engine, expression, **binds):
    return engine.sql(f"SELECT {expression} AS v FROM dual", binds).first()[0]


def test_lexer():
    got = [(t.kind, t.text) for t in tokens("a.\"B c\" q'[it's]' 'x''y' 1.5e3 :b1 -- end\n /* c */ (+) <>")]
    assert got == [("name", "a"), ("op", "."), ("quoted", "B c"), ("string", "it's"), ("string", "x'y"), ("number", "1.5e3"), ("bind", ":b1"), ("op", "(+)"), ("op", "<>"), ("end", "")]
    with pytest.raises(SqlSyntaxError):
        tokens("select 'open")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a COLLATE x FROM nation",
        "SELECT * FROM TABLE(f(1))",
        "SELECT * FROM nation@remote",
        "SELECT n_name FROM nation MODEL x",
        "SELECT MAX(n_name) OVER (ORDER BY n_name GROUPS 1 PRECEDING) FROM nation",
        "SELECT f(a => 1) FROM nation",
        "SELECT XMLELEMENT(\"a\") FROM nation",
        "SELECT n_name FROM nation WHERE CURRENT OF c",
        "SELECT n_name FROM nation FETCH FIRST 3 PERCENT ROWS ONLY",
        "SELECT * FROM nation UNPIVOT ((a, b) FOR c IN ((n_name, n_nationkey)))",
        "INSERT ALL INTO a VALUES (1) SELECT 1 FROM dual",
        "WITH FUNCTION f RETURN NUMBER IS BEGIN RETURN 1; END; SELECT f FROM dual",
        "SELECT nosuchfunction(1) FROM dual",
        "SELECT n.n_name FROM nation n, region r WHERE n.n_regionkey(+) = r.r_regionkey(+)",
        "SELECT n.n_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey(+) OR n.n_nationkey = r.r_regionkey(+)",
        "SELECT n_name FROM nation WHERE ROWNUM + 1 < 3",
        "SELECT TO_CHAR(DATE '2024-01-01', 'CC') FROM dual",
    ],
)
def test_refused(engine, text):
    with pytest.raises(UnsupportedFeature):
        engine.sql(text)


@pytest.mark.parametrize("text", ["SELECT FROM nation", "SELECT n_name nation", "SELECT nope FROM nation", "SELECT LEVEL FROM nation", "SELECT PRIOR n_name FROM nation", "SELECT 1 FROM dual extra words here"])
def test_wrong(engine, text):
    with pytest.raises(SqlSyntaxError):
        engine.sql(text)


def test_null_semantics(engine):
    assert one(engine, "'a' || NULL || 'b'") == "ab"
    assert one(engine, "DECODE(NULL, NULL, 'same', 'other')") == "same"
    assert one(engine, "GREATEST(1, NULL, 3)") is None
    assert one(engine, "NVL2(NULL, 'a', 'b')") == "b"
    assert one(engine, "CASE WHEN NULL = NULL THEN 1 ELSE 0 END") == 0


def test_three_valued_quantifiers(engine):
    sub = "(SELECT NULLIF(r_regionkey, {}) FROM region)"
    some = lambda op, which, n: engine.sql(f"SELECT COUNT(*) AS v FROM dual WHERE {n} {op} {which} {sub.format(4)}").first()[0]
    assert some(">", "ANY", 1) == 1
    assert some(">", "ANY", 0) == 0  # unknown
    assert some("<", "ALL", 0) == 0
    assert some("<>", "ALL", 9) == 0  # unknown
    assert some("=", "ANY", 3) == 1
    assert engine.sql("SELECT COUNT(*) AS v FROM dual WHERE NOT (9 > ALL (SELECT NULLIF(r_regionkey, 4) FROM region))").first()[0] == 0
    assert engine.sql("SELECT COUNT(*) AS v FROM dual WHERE NOT (1 > ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 9))").first()[0] == 1


def test_strings(engine):
    assert one(engine, "SUBSTR('hello', 0, 2)") == "he"
    assert one(engine, "SUBSTR('hello', -2)") == "lo"
    assert one(engine, "INSTR('banana', 'an', 1, 2)") == 4
    assert one(engine, "INSTR('banana', 'a', -1, 2)") == 4
    assert one(engine, "INSTR('banana', 'x', -1)") == 0
    assert one(engine, "INSTR('aaa', 'aa', 1, 2)") == 2
    assert one(engine, "INITCAP('o''neil mac-donald')") == "O'Neil Mac-Donald"
    assert one(engine, "TRIM(LEADING 'x' FROM 'xxyx')") == "yx"
    assert one(engine, "REPLACE('abc', 'b')") == "ac"
    assert one(engine, "q'[it's]'") == "it's"
    assert one(engine, "'back\\slash'") == "back\\slash"


def test_regular_expressions(engine):
    assert one(engine, "REGEXP_REPLACE('a1b2', '[0-9]', '#')") == "a#b#"
    assert one(engine, "REGEXP_REPLACE('a1b2c3', '[0-9]', '#', 1, 2)") == "a1b#c3"
    assert one(engine, "REGEXP_REPLACE('x1y', '(x)(1)', '\\2\\1')") == "1xy"
    assert one(engine, "REGEXP_SUBSTR('a,b,c', '[^,]+', 1, 3)") == "c"
    assert one(engine, "REGEXP_INSTR('abcabc', 'b', 1, 2)") == 5
    assert one(engine, "REGEXP_INSTR('abcabc', 'bc', 1, 1, 1)") == 4
    assert one(engine, "REGEXP_COUNT('Banana', 'A', 1, 'i')") == 3


def test_dates(engine):
    d = datetime.datetime
    assert one(engine, "ADD_MONTHS(DATE '2024-02-29', 1)") == d(2024, 3, 31)
    assert one(engine, "ADD_MONTHS(DATE '2024-01-31', 1)") == d(2024, 2, 29)
    assert one(engine, "ADD_MONTHS(TIMESTAMP '2024-01-15 10:30:00', 1)") == d(2024, 2, 15, 10, 30)
    assert one(engine, "DATE '2024-01-01' + 0.5") == d(2024, 1, 1, 12)
    assert one(engine, "DATE '2024-03-01' - DATE '2024-02-01'") == 29
    assert one(engine, "TRUNC(TIMESTAMP '2024-05-17 13:45:10', 'HH24')") == d(2024, 5, 17, 13)
    assert one(engine, "TRUNC(DATE '2024-05-17', 'DAY')") == d(2024, 5, 12)
    assert one(engine, "ROUND(DATE '2024-05-16', 'MM')") == d(2024, 6, 1)
    assert one(engine, "ROUND(DATE '2024-08-15', 'Q')") == d(2024, 7, 1)
    assert one(engine, "ROUND(DATE '2024-08-16', 'Q')") == d(2024, 10, 1)
    assert one(engine, "TO_CHAR(DATE '2024-02-05', 'DD \"of\" MONTH YYYY')") == "05 of FEBRUARY  2024"
    assert one(engine, "TO_CHAR(DATE '2024-02-05', 'FMDD Mon')") == "5 Feb"
    assert one(engine, "TO_CHAR(DATE '2024-02-05', 'J')") == "2460346"
    assert one(engine, "TO_DATE('05-02-2024 23:59', 'DD-MM-YYYY HH24:MI')") == d(2024, 2, 5, 23, 59)
    assert one(engine, "LAST_DAY(TIMESTAMP '2024-02-05 01:00:00')") == d(2024, 2, 29, 1)


def test_numbers(engine):
    assert one(engine, "TRUNC(1.159, 2)") == 1.15
    assert one(engine, "TRUNC(-7.9)") == -7
    assert one(engine, "TRUNC(1234, -2)") == 1200
    assert one(engine, "7 / 2") == 3.5
    assert one(engine, "2 ** 10") == 1024
    assert one(engine, "MOD(-7, 3)") == -1
    assert one(engine, "TO_CHAR(1234567.891, '9,999,999.99')") == " 1,234,567.89"
    assert one(engine, "TO_CHAR(-5, 'S99')") == " -5"
    assert one(engine, "TO_CHAR(0, 'FM990.00')") == "0.00"
    assert one(engine, "TO_CHAR(12, '$999')") == "  $12"


def test_binds(engine):
    assert one(engine, ":a || :b", a="x", b=3) == "x3"
    assert engine.sql("SELECT n_name AS v FROM nation WHERE n_nationkey = :k", {"k": 4}).count() == 1
    assert one(engine, ":d + 1", d=datetime.date(2024, 1, 1)) == datetime.datetime(2024, 1, 2)
    with pytest.raises(SqlSyntaxError):
        one(engine, ":missing")


def test_rownum_modes(spark, small):
    text = "SELECT o_orderkey AS k FROM orders WHERE ROWNUM <= 3 ORDER BY o_totalprice DESC"
    top = [r[0] for r in engine_for(spark, small).sql("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC FETCH FIRST 3 ROWS ONLY").collect()]
    engine = engine_for(spark, small)
    engine.rownum_mode = "topn"
    assert [r[0] for r in engine.sql(text).collect()] == top
    engine.rownum_mode = "oracle"
    assert engine.sql(text).count() == 3


def test_connect_by_loop(spark):
    engine = Engine(spark)
    engine.register("ring", spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, nxt int"))
    with pytest.raises(ConnectByLoop):
        engine.sql("SELECT id FROM ring START WITH id = 1 CONNECT BY PRIOR nxt = id")
    rows = engine.sql("SELECT id, CONNECT_BY_ISCYCLE AS c FROM ring START WITH id = 1 CONNECT BY NOCYCLE PRIOR nxt = id ORDER BY LEVEL").collect()
    assert [tuple(r) for r in rows] == [(1, 0), (2, 0), (3, 1)]


def test_hierarchy_fixture(spark):
    """The seven employees of the reference's hierarchy tests."""
    rows = [(1, "CEO", None, 200000), (2, "VP Sales", 1, 150000), (3, "VP Engineering", 1, 160000), (4, "Sales Manager", 2, 100000), (5, "Engineer 1", 3, 90000), (6, "Engineer 2", 3, 95000), (7, "Sales Rep", 4, 60000)]
    engine = Engine(spark)
    engine.register("hr.employees", spark.createDataFrame(rows, "emp_id int, name string, manager_id int, salary int"))
    got = engine.sql("SELECT emp_id, LEVEL, SYS_CONNECT_BY_PATH(name, '>') AS p FROM hr.employees START WITH manager_id IS NULL CONNECT BY PRIOR emp_id = manager_id ORDER SIBLINGS BY emp_id").collect()
    assert [(r[0], r[1]) for r in got] == [(1, 1), (2, 2), (4, 3), (7, 4), (3, 2), (5, 3), (6, 3)]
    assert got[3][2] == ">CEO>VP Sales>Sales Manager>Sales Rep"
    pruned = engine.sql("SELECT emp_id FROM hr.employees WHERE salary < 155000 START WITH manager_id IS NULL CONNECT BY PRIOR emp_id = manager_id AND salary > 90000").collect()
    assert sorted(r[0] for r in pruned) == [2, 4, 6]
    none = engine.sql("SELECT emp_id FROM hr.employees CONNECT BY PRIOR emp_id = manager_id").count()
    assert none == 7 + 6 + 4 + 1


def test_explain_lowering(engine):
    text = engine.explain_lowering("SELECT c.c_name FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND o.o_orderkey IS NULL ORDER BY c.c_name DESC")
    assert "LEFT JOIN" in text and "DESC NULLS FIRST" in text and "IS NULL" in text


def test_unknown_table(engine):
    with pytest.raises(QuernError):
        engine.sql("SELECT 1 FROM nowhere")


def test_pushdown(engine):
    plan = engine.sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


@pytest.mark.parametrize("condition", ["o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", "NOT (o_orderkey IN (SELECT l_orderkey FROM lineitem) OR o_custkey = 1)", "o_orderkey <> ALL (SELECT l_orderkey FROM lineitem)"])
def test_not_in_broadcasts_nothing(spark, engine, condition):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = engine.sql(f"SELECT o_orderkey FROM orders WHERE {condition}")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize(
    ("values", "true", "unknown"),
    [([1, 4, 7], [2, 5], [3]), ([1, None], [], [2, 3, 4, 5]), ([None], [], [1, 2, 3, 4, 5]), ([], [1, 2, 3, 4, 5], [])],
)
@pytest.mark.parametrize("form", ["x NOT IN (SELECT v FROM s)", "NOT x IN (SELECT v FROM s)", "x <> ALL (SELECT v FROM s)", "NOT (x = ANY (SELECT v FROM s))", "x NOT IN (SELECT v FROM s ORDER BY v FETCH FIRST 9 ROWS ONLY)"])
def test_not_in_nulls(spark, values, true, unknown, form):
    engine = Engine(spark)
    engine.register("a", spark.createDataFrame([(i, None if i == 3 else i) for i in range(1, 6)], "id int, x int"))
    engine.register("s", spark.createDataFrame([(v,) for v in values], "v int"))
    ids = lambda text: sorted(r[0] for r in engine.sql(f"SELECT id FROM a WHERE {text}").collect())
    assert (ids(form), ids(f"({form}) IS NULL")) == (true, unknown)
    assert ids(f"NOT ({form})") == sorted({1, 2, 3, 4, 5} - {*true, *unknown})
    assert engine.sql(f"DELETE FROM a WHERE {form}").first()[0] == len(true)
    assert sorted(r[0] for r in spark.table("a").collect()) == sorted({1, 2, 3, 4, 5} - {*true})


def test_parse_keeps_precedence():
    a = parse("SELECT 1 FROM t WHERE NOT a = 1 AND b = 2 OR c = 3").body.where
    assert a.op == "OR" and a.left.op == "AND" and a.left.left.op == "NOT"


def test_member_methods(spark):
    engine = Engine(spark)
    engine.catalog.add_types({"point": {"x": "NUMBER(5)", "y": "NUMBER(5)"}})
    engine.create_method("point", "norm1", {"k": "NUMBER(5)"}, "NUMBER(10)", "(ABS(self.x) + ABS(self.y)) * k")
    engine.register("shapes", spark.sql("SELECT 1 AS id, named_struct('x', cast(-3 as decimal(5,0)), 'y', cast(4 as decimal(5,0))) AS p"))
    assert engine.sql("SELECT s.p.norm1(10) AS n FROM shapes s").first()[0] == 70


def test_merge(spark):
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, v int"))
    engine.register("s", spark.createDataFrame([(2, 5), (3, 0), (4, 7), (5, None)], "id int, w int"))
    n = engine.sql(
        """MERGE INTO t d USING (SELECT id, w FROM s) n ON (d.id = n.id)
           WHEN MATCHED THEN UPDATE SET d.v = d.v + n.w DELETE WHERE d.v > 29
           WHEN NOT MATCHED THEN INSERT (id, v) VALUES (n.id, n.w * 2) WHERE n.w IS NOT NULL"""
    ).first()[0]
    assert n == 3 and sorted(tuple(r) for r in spark.table("t").collect()) == [(1, 10), (2, 25), (4, 14)]
    engine.register("s", spark.createDataFrame([(1, 1), (1, 2)], "id int, w int"))
    with pytest.raises(QuernError):
        engine.sql("MERGE INTO t USING s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET v = w")
