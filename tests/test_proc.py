"""The procedural runtime on the reference's small fixtures."""

import pytest

from quern.engine import Engine
from quern.errors import UnsupportedFeature
from quern.proc import Runtime
from quern.proc.runtime import Raised


@pytest.fixture
def run(spark):
    engine = Engine(spark)
    rows = [(1, "John Doe", 50000.0, 10), (2, "Jane Smith", 60000.0, 20), (3, "Bob Johnson", 75000.0, 10), (4, "Alice Brown", 80000.0, 30), (5, "Charlie Wilson", 55000.0, 20)]
    engine.register("hr.employees", spark.createDataFrame(rows, "employee_id int, employee_name string, salary double, department_id int"))
    return Runtime(engine)


def test_cursor_loop(run):
    run.run(
        """CREATE OR REPLACE FUNCTION total(p_dept NUMBER) RETURN NUMBER IS
             v NUMBER := 0;
             CURSOR c(d NUMBER) IS SELECT employee_name, salary FROM hr.employees WHERE department_id = d ORDER BY employee_id;
           BEGIN
             FOR r IN c(p_dept) LOOP v := v + r.salary; DBMS_OUTPUT.PUT_LINE(r.employee_name); END LOOP;
             FOR r IN (SELECT salary FROM hr.employees WHERE department_id = p_dept) LOOP v := v + 1; END LOOP;
             RETURN v;
           END total;"""
    )
    assert run.call("total", 10) == 125002
    assert run.output == ["John Doe", "Bob Johnson"]


def test_select_into(run):
    run.run(
        """CREATE FUNCTION name_of(k NUMBER) RETURN VARCHAR2 IS v VARCHAR2(50);
           BEGIN SELECT employee_name INTO v FROM hr.employees WHERE department_id = k; RETURN v;
           EXCEPTION WHEN NO_DATA_FOUND THEN RETURN 'none'; WHEN TOO_MANY_ROWS THEN RETURN 'many'; END;"""
    )
    assert [run.call("name_of", k) for k in (30, 99, 10)] == ["Alice Brown", "none", "many"]


def test_rowtype_and_cursor_attributes(run):
    run.run(
        """DECLARE
             CURSOR c IS SELECT employee_id, salary FROM hr.employees ORDER BY salary DESC;
             r c%ROWTYPE; e hr.employees%ROWTYPE;
           BEGIN
             OPEN c;
             LOOP FETCH c INTO r; EXIT WHEN c%NOTFOUND OR c%ROWCOUNT > 2; DBMS_OUTPUT.PUT_LINE(c%ROWCOUNT || '-' || r.employee_id); END LOOP;
             IF c%ISOPEN THEN CLOSE c; END IF;
             SELECT * INTO e FROM hr.employees WHERE employee_id = 2;
             DBMS_OUTPUT.PUT_LINE(e.employee_name);
             UPDATE hr.employees SET salary = salary * 2 WHERE department_id = 20;
             DBMS_OUTPUT.PUT_LINE(SQL%ROWCOUNT);
           END;"""
    )
    assert run.output == ["1-4", "2-3", "Jane Smith", "2"]


def test_control_flow(run):
    run.run(
        """CREATE FUNCTION f(x NUMBER, y OUT NUMBER) RETURN VARCHAR2 AS
           BEGIN
             y := 0;
             <<outer>> FOR i IN REVERSE 1..5 LOOP
               FOR j IN 1..5 LOOP EXIT outer WHEN i * j = 8; CONTINUE WHEN MOD(j, 2) = 0; y := y + 1; END LOOP;
             END LOOP;
             WHILE y < 100 LOOP y := y * 10; END LOOP;
             CASE x WHEN 1 THEN RETURN 'one'; WHEN 2 THEN NULL; END CASE;
             IF x = 2 THEN RETURN 'two'; END IF;
           END;"""
    )
    assert run.call("f", 1) == {"y": 400, "return": "one"}
    assert run.call("f", 2) == {"y": 400, "return": "two"}
    with pytest.raises(Raised, match="case not found"):
        run.call("f", 3)


def test_exceptions(run):
    run.run(
        """DECLARE
             e_own EXCEPTION; PRAGMA EXCEPTION_INIT(e_own, -20010); v NUMBER;
           BEGIN
             BEGIN v := 1 / 0; EXCEPTION WHEN ZERO_DIVIDE THEN DBMS_OUTPUT.PUT_LINE('zero'); END;
             BEGIN RAISE_APPLICATION_ERROR(-20010, 'own'); EXCEPTION WHEN e_own THEN DBMS_OUTPUT.PUT_LINE(SQLERRM || SQLCODE); END;
             BEGIN v := 'abc' + 1; EXCEPTION WHEN VALUE_ERROR THEN DBMS_OUTPUT.PUT_LINE('value'); END;
             BEGIN RAISE e_own; EXCEPTION WHEN OTHERS THEN DBMS_OUTPUT.PUT_LINE('others'); END;
           END;"""
    )
    assert run.output == ["zero", "ORA-20010: own-20010", "value", "others"]
    with pytest.raises(Raised) as e:
        run.run("BEGIN RAISE_APPLICATION_ERROR(-20001, 'out'); END;")
    assert e.value.code == -20001


def test_packages_and_collections(run):
    run.run(
        """CREATE PACKAGE BODY pk AS
             g NUMBER := 5; TYPE t_list IS TABLE OF NUMBER; TYPE t_map IS TABLE OF NUMBER INDEX BY VARCHAR2(10); TYPE t_rec IS RECORD (a NUMBER := 1, b VARCHAR2(5));
             PROCEDURE bump(n NUMBER DEFAULT 1) IS BEGIN g := g + n; END;
             FUNCTION total RETURN NUMBER IS v t_list := t_list(1, 2, 3); m t_map; r t_rec; s NUMBER := 0; BEGIN
               v.EXTEND; v(4) := 10; v.DELETE(1);
               FOR i IN 1..v.COUNT LOOP s := s + v(i); END LOOP;
               m('x') := 100; IF m.EXISTS('x') AND NOT m.EXISTS('y') THEN s := s + m('x'); END IF;
               r.b := 'z'; RETURN s + g + r.a; END;
           BEGIN bump(2); END pk;"""
    )
    run.run("BEGIN pk.bump; pk.bump(10); pk.g := pk.g + 100; END;")
    assert run.call("pk.total") == 15 + 100 + 118 + 1
    with pytest.raises(Raised):
        run.run("DECLARE TYPE t IS TABLE OF NUMBER; v t := t(); BEGIN v(3) := 1; END;")


def test_variables_in_sql(run, spark):
    run.run("DECLARE d NUMBER := 20; n NUMBER; BEGIN SELECT COUNT(*) INTO n FROM hr.employees WHERE department_id = d; DBMS_OUTPUT.PUT_LINE(n); INSERT INTO hr.employees (employee_id, salary) VALUES (9, d * 2); END;")
    assert run.output == ["2"]
    assert spark.table("hr__employees").filter("employee_id = 9").first().salary == 40


def test_udf(run, spark):
    run.run("CREATE FUNCTION grade(x NUMBER) RETURN VARCHAR2 IS BEGIN IF x > 1 THEN RETURN 'high'; END IF; RETURN 'low'; END;")
    assert [r[0] for r in spark.range(4).select(run.udf("grade", "string")("id")).collect()] == ["low", "low", "high", "high"]


def test_trigger(run, spark):
    run.add_trigger("hr.employees", ["INSERT"], {"salary": "NVL(:NEW.salary, 1000)", "employee_name": "UPPER(:NEW.employee_name)"}, ":NEW.employee_id > 10")
    run.engine.sql("INSERT INTO hr.employees (employee_id, employee_name) VALUES (11, 'new')")
    row = spark.table("hr__employees").filter("employee_id = 11").first()
    assert (row.salary, row.employee_name) == (1000, "NEW")


def test_files(run, tmp_path):
    run.run(f"DECLARE f NUMBER; BEGIN f := UTL_FILE.FOPEN('{tmp_path}', 'o.txt', 'w'); UTL_FILE.PUT_LINE(f, 'hi'); UTL_FILE.FCLOSE(f); END;")
    assert (tmp_path / "o.txt").read_text() == "hi\n"


def test_refused(run):
    for body in ("FORALL i IN 1..2 DELETE FROM t;", "EXECUTE IMMEDIATE 'x';", "SELECT a BULK COLLECT INTO b FROM t;"):
        with pytest.raises(UnsupportedFeature):
            run.run(f"BEGIN {body} END;")


def test_trigger_body(run, spark):
    run.run(
        """CREATE OR REPLACE TRIGGER t BEFORE INSERT OR UPDATE ON hr.employees FOR EACH ROW
           BEGIN
             IF INSERTING THEN :NEW.employee_name := UPPER(:NEW.employee_name); :NEW.salary := NVL(:NEW.salary, 7); END IF;
             IF UPDATING AND :NEW.salary < :OLD.salary THEN RAISE_APPLICATION_ERROR(-20002, 'no cuts'); END IF;
           END;"""
    )
    run.engine.sql("INSERT INTO hr.employees (employee_id, employee_name) VALUES (12, 'new')")
    assert tuple(spark.table("hr__employees").filter("employee_id = 12").select("employee_name", "salary").first()) == ("NEW", 7)
    run.engine.sql("UPDATE hr.employees SET salary = salary + 1 WHERE employee_id = 1")
    assert spark.table("hr__employees").filter("employee_id = 1").first().salary == 50001
    with pytest.raises(Exception, match="no cuts"):
        run.engine.sql("UPDATE hr.employees SET salary = 1 WHERE employee_id = 1")


def test_page_buffer(run):
    run.run("BEGIN HTP.P('a'); HTP.PRN('b'); END;")
    assert "".join(run.page) == "a\nb"


def test_date_variable_in_sql(run):
    run.run("DECLARE d DATE := DATE '2024-01-31'; v DATE; BEGIN SELECT ADD_MONTHS(d, 1) + 1 INTO v FROM dual; DBMS_OUTPUT.PUT_LINE(TO_CHAR(v, 'YYYY-MM-DD')); END;")
    assert run.output == ["2024-03-01"]


def test_delete_trigger(run, spark):
    run.run("CREATE TRIGGER keep BEFORE DELETE ON hr.employees FOR EACH ROW BEGIN IF :OLD.department_id = 10 THEN RAISE_APPLICATION_ERROR(-20003, 'kept'); END IF; END;")
    with pytest.raises(Exception, match="kept"):
        run.engine.sql("DELETE FROM hr.employees WHERE salary > 70000")
    assert spark.table("hr__employees").count() == 5
    run.engine.sql("DELETE FROM hr.employees WHERE department_id = 20")
    assert spark.table("hr__employees").count() == 3


def test_after_triggers(run, spark):
    """Row triggers that insert values log every change as one statement; statement triggers fire once."""
    run.engine.register("log", spark.createDataFrame([], "what string, id int, old_salary double, new_salary double"))
    run.run("CREATE PACKAGE BODY seen AS n NUMBER := 0; END;")
    run.run("CREATE TRIGGER audit_row AFTER INSERT OR UPDATE OR DELETE ON hr.employees FOR EACH ROW WHEN (NVL(:NEW.salary, 0) <> NVL(:OLD.salary, 0)) BEGIN INSERT INTO log VALUES (CASE WHEN INSERTING THEN 'I' WHEN UPDATING THEN 'U' ELSE 'D' END, NVL(:NEW.employee_id, :OLD.employee_id), :OLD.salary, :NEW.salary); END;")
    run.run("CREATE TRIGGER count_it AFTER UPDATE OR DELETE ON hr.employees BEGIN seen.n := seen.n + 1; IF DELETING THEN seen.n := seen.n + 10; END IF; END;")
    run.engine.sql("INSERT INTO hr.employees (employee_id, salary) VALUES (7, 5)")
    run.engine.sql("UPDATE hr.employees SET salary = salary * 2 WHERE department_id = 20 OR salary IS NULL")
    run.engine.sql("DELETE FROM hr.employees WHERE employee_id = 7")
    assert sorted(tuple(r) for r in spark.table("log").collect()) == sorted([("I", 7, None, 5.0), ("U", 2, 60000.0, 120000.0), ("U", 5, 55000.0, 110000.0), ("D", 7, 5.0, None)], key=lambda r: (r[0], r[1]))
    assert run.packages["seen"].values["n"] == 12


def test_failed_after_trigger(run, spark):
    """A trigger that fails after the change takes the change back."""
    run.run("CREATE TRIGGER low AFTER UPDATE ON hr.employees FOR EACH ROW BEGIN IF :NEW.salary < 0 THEN RAISE_APPLICATION_ERROR(-20004, 'negative'); END IF; END;")
    run.run("CREATE TRIGGER none AFTER DELETE ON hr.employees BEGIN RAISE_APPLICATION_ERROR(-20005, 'no deletes'); END;")
    with pytest.raises(Exception, match="negative"):
        run.engine.sql("UPDATE hr.employees SET salary = -1 WHERE employee_id = 1")
    with pytest.raises(Exception, match="no deletes"):
        run.engine.sql("DELETE FROM hr.employees")
    assert spark.table("hr__employees").filter("salary > 0").count() == 5


def test_set_based_trigger(run, spark):
    """A body of plain assignments runs as column expressions, later ones over earlier ones."""
    run.run("CREATE TRIGGER names BEFORE INSERT OR UPDATE ON hr.employees FOR EACH ROW WHEN (:NEW.employee_id > 3) BEGIN :NEW.employee_name := UPPER(:NEW.employee_name); :NEW.employee_name := :NEW.employee_name || CASE WHEN UPDATING THEN '!' ELSE '?' END; END;")
    assert "mapInPandas" not in str(run.engine.triggers["hr__employees"][0].run.__code__.co_names)
    run.engine.sql("UPDATE hr.employees SET salary = salary + 1")
    run.engine.sql("INSERT INTO hr.employees (employee_id, employee_name) VALUES (8, 'x')")
    assert {r.employee_id: r.employee_name for r in spark.table("hr__employees").collect()} == {1: "John Doe", 2: "Jane Smith", 3: "Bob Johnson", 4: "ALICE BROWN!", 5: "CHARLIE WILSON!", 8: "X?"}


def test_merge_fires_triggers(run, spark):
    run.run("CREATE TRIGGER m BEFORE INSERT OR UPDATE ON hr.employees FOR EACH ROW BEGIN :NEW.employee_name := CASE WHEN INSERTING THEN 'in' ELSE 'up' END; END;")
    spark.createDataFrame([(1, 10.0), (77, 20.0)], "id int, pay double").createOrReplaceTempView("pay")
    run.engine.sql("MERGE INTO hr.employees e USING pay p ON (e.employee_id = p.id) WHEN MATCHED THEN UPDATE SET salary = p.pay WHEN NOT MATCHED THEN INSERT (employee_id, salary) VALUES (p.id, p.pay)")
    got = {r.employee_id: (r.employee_name, r.salary) for r in spark.table("hr__employees").filter("employee_id in (1, 2, 77)").collect()}
    assert got == {1: ("up", 10.0), 2: ("Jane Smith", 60000.0), 77: ("in", 20.0)}
