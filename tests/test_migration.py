"""The whole move of a schema on the constraint data set of two departments and two employees."""

import pytest

from quern.catalog import Constraint
from quern.errors import QuernError
from quern.plans.migration import ColumnSpec, Migration, Schema, default_expression


def test_move(spark, tmp_path):
    schema = Schema(
        "hr",
        tables={
            "departments": {"dept_id": ColumnSpec("NUMBER(10)", False), "dept_name": ColumnSpec("VARCHAR2(100)", False), "budget": ColumnSpec("NUMBER(12,2)"), "active_flag": ColumnSpec("CHAR(1)", True, "'Y'")},
            "employees": {"emp_id": ColumnSpec("NUMBER(10)", False), "emp_name": ColumnSpec("VARCHAR2(100)"), "dept_id": ColumnSpec("NUMBER(10)"), "salary": ColumnSpec("NUMBER(10,2)"), "hire_date": ColumnSpec("DATE", True, "SYSDATE")},
            "broken": {"x": ColumnSpec("NO_SUCH_TYPE")},
        },
        data={
            "departments": spark.sql("SELECT * FROM VALUES (1, 'Sales', 100.5, 'Y'), (2, 'IT', 5.0, 'N') AS t(dept_id, dept_name, budget, active_flag)"),
            "employees": spark.sql("SELECT * FROM VALUES (1, 'A', 1, 10.0, timestamp_ntz'2024-01-01 00:00:00'), (2, 'B', 9, 20.0, null) AS t(emp_id, emp_name, dept_id, salary, hire_date)"),
        },
        object_types={"address": {"street": "VARCHAR2(50)"}},
        sequences={"emp_seq": (10, 1)},
        synonyms={"staff": "hr.employees"},
        constraints=[
            Constraint("pk_d", "hr.departments", "P", ("dept_id",)), Constraint("pk_e", "hr.employees", "P", ("emp_id",)),
            Constraint("fk", "hr.employees", "R", ("dept_id",), "hr.departments", ("dept_id",)), Constraint("ck", "hr.departments", "C", condition="budget >= 0 AND active_flag IN ('Y', 'N')"),
        ],
        views={"top_view": ("SELECT emp_id, label FROM emp_view WHERE emp_id < 2", {"id": "NUMBER(10)", "label": "VARCHAR2(60)"}), "emp_view": ("SELECT e.emp_id, e.emp_name || ':' || d.dept_name FROM staff e, departments d WHERE e.dept_id = d.dept_id(+)", {"emp_id": "NUMBER(10)", "label": "VARCHAR2(60)"})},
        code=["CREATE FUNCTION hr.raise_of(s NUMBER) RETURN NUMBER IS BEGIN RETURN s * 2; END;", "CREATE FUNCTION bad IS"],
        triggers=[("employees", ["INSERT"], {"salary": "NVL(:NEW.salary, 1)"})],
    )
    m = Migration(spark, str(tmp_path))
    reports = {r.step: r for r in m.run(schema)}
    assert reports["tables"].created == ["departments", "employees"] and "broken" in reports["tables"].failed
    assert reports["data"].created == ["departments", "employees"] and not reports["row_counts"].failed
    assert reports["constraints"].created == ["pk_d", "pk_e", "ck"] and reports["constraints"].failed == {"fk": "1 violations"}
    assert reports["views"].created == ["emp_view", "top_view"] and list(reports["code"].failed) == ["bad"]
    assert [tuple(r) for r in m.engine.sql("SELECT * FROM top_view").collect()] == [(1, "A:Sales")]
    assert m.runtime.call("raise_of", 4) == 8
    m.engine.sql("INSERT INTO staff (emp_id, emp_name) SELECT emp_seq.NEXTVAL, 'new' FROM dual")
    assert m.engine.sql("SELECT salary FROM employees WHERE emp_id = 10").first()[0] == 1
    again = {r.step: r for r in m.run(schema)}
    assert again["data"].skipped == ["departments", "employees"] and again["sequences"].skipped == ["emp_seq"]


def test_verification(spark, tmp_path):
    """What is missing, different, violated or only a stub is told apart."""
    schema = Schema(
        "vf",
        tables={"t": {"k": ColumnSpec("NUMBER(10)", False), "s": ColumnSpec("VARCHAR2(5)")}, "u": {"x": ColumnSpec("NUMBER(3)")}},
        data={"t": spark.sql("SELECT 1 AS k, 'a' AS s UNION ALL SELECT 1, 'b'")},
        sequences={"q": (1, 1)},
        constraints=[Constraint("pk_t", "vf.t", "P", ("k",)), Constraint("ck_t", "vf.t", "C", condition="k > 0")],
        views={"v": ("SELECT k FROM t", {"k": "NUMBER(10)"})},
        code=["CREATE FUNCTION first(x NUMBER) RETURN NUMBER IS BEGIN RETURN second(x) + 1; END;", "CREATE FUNCTION second(x NUMBER) RETURN NUMBER IS BEGIN RETURN x * 2; END;"],
    )
    m = Migration(spark, str(tmp_path))
    states = lambda: {(r.kind, r.name): r.state for r in m.verify(schema).collect()}
    assert set(states().values()) == {"missing"}
    m.runtime.stub(schema.code[0])
    assert m.runtime.state("first") == "stub" and m.runtime.state("second") == "missing"
    with pytest.raises(QuernError, match="no body"):
        m.runtime.call("first", 1)
    m.run(schema)
    assert m.runtime.call("first", 4) == 9
    m.engine.register("vf.u", spark.range(1))
    m.engine.catalog.sequences["q"].increment = 2
    got = states()
    assert {k: v for k, v in got.items() if v != "ok"} == {("table", "u"): "different", ("sequence", "q"): "different", ("constraint", "pk_t"): "violated"}
    m.engine.create_view_stub("vf.v", {"k": "NUMBER(10)"})
    assert states()["view", "v"] == "stub"


def test_defaults(spark):
    engine = Migration(spark, "/nowhere").engine
    assert default_expression(engine, "''") == "NULL"
    assert default_expression(engine, "SYSDATE") == "localtimestamp()"
    assert default_expression(engine, "1 + 1") == "(1 + 1)"
    assert default_expression(engine, "s.nextval") is None
