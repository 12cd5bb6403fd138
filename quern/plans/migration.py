"""The whole move of a schema, step by step: names, types, sequences, tables, data, constraints, views, code.

The steps run in the order in which one needs the other.  A step reports what it created, what was
there already and what failed; a failure of one object does not stop the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..catalog import Constraint
from ..engine import Engine
from ..errors import QuernError
from ..operators.integrity import validate
from ..proc import Runtime
from ..proc import ast as P
from ..proc.parser import parse_unit
from ..sources.transfer import copy_tables, count_or_minus_one
from ..types import spark_type

#: Users whose objects belong to the database itself.
SYSTEM_USERS = ("SYS", "SYSTEM", "OUTLN", "DBSNMP", "XDB", "CTXSYS", "MDSYS", "WMSYS", "ORDSYS", "ORDDATA", "APPQOSSYS", "GSMADMIN_INTERNAL", "AUDSYS", "DVSYS", "LBACSYS", "OLAPSYS", "OJVMSYS", "ANONYMOUS", "PUBLIC")


@dataclass(frozen=True)
class ColumnSpec:
    type: str
    nullable: bool = True
    default: str | None = None


@dataclass
class Schema:
    """What is to be moved."""

    name: str
    tables: dict[str, dict[str, ColumnSpec]] = field(default_factory=dict)
    data: dict[str, DataFrame] = field(default_factory=dict)
    object_types: dict[str, dict[str, str]] = field(default_factory=dict)
    sequences: dict[str, tuple[int, int]] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)
    constraints: list[Constraint] = field(default_factory=list)
    views: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)  # (query, declared column types)
    methods: list[tuple[str, str, dict[str, str], str, str]] = field(default_factory=list)  # (type, method, parameters, result, body)
    code: list[str] = field(default_factory=list)
    triggers: list[tuple[str, list[str], dict[str, str]]] = field(default_factory=list)


@dataclass
class Report:
    step: str
    created: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


#: Defaults that Spark spells otherwise.
DEFAULTS = {"SYSDATE": "localtimestamp()", "SYSTIMESTAMP": "current_timestamp()", "CURRENT_TIMESTAMP": "current_timestamp()", "USER": "current_user()", "NULL": "NULL", "''": "NULL"}


def default_expression(engine: Engine, text: str) -> str | None:
    """A column default as a Spark SQL expression; the empty string is null; sequences' values are left to the insert."""
    plain = text.strip()
    if plain.upper() in DEFAULTS:
        return DEFAULTS[plain.upper()]
    if re.search(r"\.\s*NEXTVAL\b", plain, re.IGNORECASE):
        return None
    from ..sql.lowering import Frame
    from ..sql.parser import parse_expression

    low = engine._lowering(None)
    low.frames.append(Frame())
    return low.emit(parse_expression(plain))


def table_schema(engine: Engine, columns: dict[str, ColumnSpec]) -> T.StructType:
    return T.StructType([T.StructField(c.lower(), spark_type(s.type, engine.catalog.types), s.nullable) for c, s in columns.items()])


class Migration:
    def __init__(self, spark: SparkSession, target: str, engine: Engine | None = None):
        self.engine = engine or Engine(spark)
        self.spark = spark
        self.target = target.rstrip("/")
        self.runtime = Runtime(self.engine)
        self.steps: list[tuple[str, Callable[[Schema, Report], None]]] = [
            ("schema", self._schema), ("synonyms", self._synonyms), ("object_types", self._types), ("sequences", self._sequences), ("tables", self._tables),
            ("data", self._data), ("constraints", self._constraints), ("view_stubs", self._view_stubs), ("method_stubs", self._method_stubs), ("code_stubs", self._code_stubs), ("methods", self._methods), ("code", self._code), ("views", self._views), ("triggers", self._triggers), ("row_counts", self._counts),
        ]

    def run(self, schema: Schema) -> list[Report]:
        """All steps in order."""
        out = []
        for name, step in self.steps:
            report = Report(name)
            step(schema, report)
            out.append(report)
        return out

    @staticmethod
    def _each(report: Report, items: dict[str, Callable[[], object]]) -> None:
        for name, make in items.items():
            try:
                made = make()
                (report.skipped if made == "skipped" else report.created).append(name)
            except Exception as e:  # noqa: BLE001  reported with the object
                report.failed[name] = str(e)[:500]

    def _schema(self, s: Schema, report: Report) -> None:
        def make() -> str | None:
            if s.name.upper() in SYSTEM_USERS:
                raise QuernError("a system user")
            known = self.engine.catalog.schema == s.name.lower()
            self.engine.catalog.schema = s.name.lower()
            return "skipped" if known else None

        self._each(report, {s.name: make})

    def _synonyms(self, s: Schema, report: Report) -> None:
        self._each(report, {n: (lambda n=n, t=t: self.engine.catalog.add_synonym(n, t, s.name)) for n, t in s.synonyms.items()})

    def _types(self, s: Schema, report: Report) -> None:
        if s.object_types:
            self._each(report, {", ".join(sorted(s.object_types)): lambda: self.engine.catalog.add_types(s.object_types) and None})

    def _sequences(self, s: Schema, report: Report) -> None:
        def make(n: str, start: int, step: int) -> str | None:
            if n.lower() in self.engine.catalog.sequences:
                return "skipped"
            self.engine.catalog.add_sequence(n, start, step)
            return None

        self._each(report, {n: (lambda n=n, v=v: make(n, *v)) for n, v in s.sequences.items()})

    def _key(self, s: Schema, table: str) -> str:
        return f"{s.name}.{table}".lower()

    def _tables(self, s: Schema, report: Report) -> None:
        self._each(report, {t: (lambda t=t, c=c: self.engine.register(self._key(s, t), self.spark.createDataFrame([], table_schema(self.engine, c)))) for t, c in s.tables.items()})

    def _data(self, s: Schema, report: Report) -> None:
        shaped = {}
        for t, df in s.data.items():
            kinds = {f.name: f.dataType for f in table_schema(self.engine, s.tables[t])}
            have = {c.lower(): c for c in df.columns}
            try:
                shaped[t] = df.selectExpr(*[f"cast(`{have[c]}` as {k.simpleString()}) AS `{c}`" if not isinstance(k, T.StructType) else f"`{have[c]}` AS `{c}`" for c, k in kinds.items()])
            except KeyError as e:
                report.failed[t] = f"no column {e}"
        for o in copy_tables(self.spark, shaped, self.target):
            if o.action == "failed":
                report.failed[o.table] = o.error or ""
                continue
            (report.created if o.action == "copied" else report.skipped).append(o.table)
            if o.source_rows:
                self.engine.register(self._key(s, o.table), self.spark.read.parquet(f"{self.target}/{o.table}"))

    def _constraints(self, s: Schema, report: Report) -> None:
        self.engine.catalog.constraints = list(s.constraints)

        def make(c: Constraint) -> None:
            if n := validate(self.engine, c).count():
                raise QuernError(f"{n} violations")

        self._each(report, {c.name: (lambda c=c: make(c)) for c in self.engine.catalog.constraint_order()})

    def _view_stubs(self, s: Schema, report: Report) -> None:
        self._each(report, {v: (lambda v=v, t=t: self.engine.create_view_stub(self._key(s, v), t) and None) for v, (_, t) in s.views.items()})

    def _views(self, s: Schema, report: Report) -> None:
        """Views that read other views come after them."""
        left, done = dict(s.views), set()
        order = []
        while left:
            ready = [v for v, (q, _) in left.items() if not any(re.search(rf"\b{re.escape(o)}\b", q, re.IGNORECASE) for o in left if o != v)] or list(left)
            order += ready
            for v in ready:
                left.pop(v)
            done.update(ready)
        self._each(report, {v: (lambda v=v: self.engine.create_view(self._key(s, v), s.views[v][0], s.views[v][1]) and None) for v in order})

    def _method_stubs(self, s: Schema, report: Report) -> None:
        self._each(report, {f"{t}.{m}": (lambda t=t, m=m, p=p, r=r: self.engine.create_method_stub(t, m, p, r)) for t, m, p, r, _ in s.methods})

    def _methods(self, s: Schema, report: Report) -> None:
        self._each(report, {f"{t}.{m}": (lambda t=t, m=m, p=p, r=r, b=b: self.engine.create_method(t, m, p, r, b)) for t, m, p, r, b in s.methods})

    def _code_stubs(self, s: Schema, report: Report) -> None:
        """Routines are declared before any body, so that bodies may refer to each other in any order."""
        for k, text in enumerate(s.code):
            try:
                report.created += self.runtime.stub(text)
            except Exception as e:  # noqa: BLE001  reported with the unit
                report.failed[f"unit {k + 1}"] = str(e)[:500]

    def _code(self, s: Schema, report: Report) -> None:
        self._each(report, {(re.search(r"(?:FUNCTION|PROCEDURE|BODY|PACKAGE)\s+([\w.$#]+)", c, re.IGNORECASE) or [c[:30]] * 2)[1]: (lambda c=c: self.runtime.run(c)) for c in s.code})

    def _triggers(self, s: Schema, report: Report) -> None:
        self._each(report, {f"{t}: {', '.join(e)}": (lambda t=t, e=e, x=x: self.runtime.add_trigger(self._key(s, t), e, x)) for t, e, x in s.triggers})

    def _counts(self, s: Schema, report: Report) -> None:
        def make(t: str) -> None:
            source, target = count_or_minus_one(lambda: s.data[t]), count_or_minus_one(lambda: self.spark.table(self.engine.view_name((s.name, t))))
            if source != target:
                raise QuernError(f"{source} rows in the source, {target} in the target")

        self._each(report, {t: (lambda t=t: make(t)) for t in s.data})

    # verification

    def verify(self, s: Schema) -> DataFrame:
        """(kind, name, state) of every object of ``s``: ok, stub, missing, different, or violated.

        States are compared with what the session has now, whatever the steps reported.
        """
        found: list[tuple[str, str, str]] = []
        catalog = self.engine.catalog

        def state(kind: str, name: str, value: str | bool) -> None:
            found.append((kind, name.lower(), value if isinstance(value, str) else "ok" if value else "missing"))

        def shape(key: str, want: T.StructType) -> str:
            try:
                have = self.spark.table(self.engine.view_name(tuple(key.split(".")))).schema
            except QuernError:
                return "missing"
            same = [(f.name.lower(), f.dataType) for f in have] == [(f.name.lower(), f.dataType) for f in want]
            return "ok" if same else "different"

        state("schema", s.name, catalog.schema == s.name.lower())
        for n, target in s.synonyms.items():
            have = catalog.synonyms.get((s.name.lower(), n.lower()))
            state("synonym", n, "missing" if have is None else "ok" if have == target.lower() else "different")
        for n, attributes in s.object_types.items():
            have = catalog.types.get(n)
            want = None if have is None else T.StructType([T.StructField(a, spark_type(k, catalog.types)) for a, k in attributes.items()])
            state("type", n, "missing" if have is None else "ok" if have == want else "different")
        for n, (_, step) in s.sequences.items():
            have = catalog.sequences.get(n.lower())
            state("sequence", n, "missing" if have is None else "ok" if have.increment == step else "different")
        for t, columns in s.tables.items():
            state("table", t, shape(self._key(s, t), table_schema(self.engine, columns)))
        for c in s.constraints:
            if c not in catalog.constraints:
                state("constraint", c.name, "missing")
                continue
            try:
                state("constraint", c.name, "ok" if validate(self.engine, c).isEmpty() else "violated")
            except QuernError:
                state("constraint", c.name, "missing")
        for v, (_, types) in s.views.items():
            want = T.StructType([T.StructField(c, spark_type(k, catalog.types)) for c, k in types.items()])
            have = shape(self._key(s, v), want)
            state("view", v, "stub" if have == "ok" and self._key(s, v) in self.engine.stubs else have)
        for t, m, *_ in s.methods:
            key = f"{t}__{m}"
            state("method", f"{t}.{m}", "stub" if key.lower() in self.engine.stubs else self.engine.methods.get(m.upper()) == key.upper())
        for text in s.code:
            unit = parse_unit(text)
            routines = [unit] if isinstance(unit, P.Routine) else unit.routines if isinstance(unit, P.Package) else []
            for r in routines:
                name = r.name if isinstance(unit, P.Routine) else f"{unit.name}.{r.name}"
                state("function", name, self.runtime.state(name))
            if isinstance(unit, P.Trigger):
                state("trigger", unit.name, any(h.name == unit.name.lower() for hooks in self.engine.triggers.values() for h in hooks))
        for t, _, sets in s.triggers:
            name = f"{self._key(s, t)}: {', '.join(c.lower() for c in sets)}"
            state("trigger", name, any(h.name == name for hooks in self.engine.triggers.values() for h in hooks))
        return self.spark.createDataFrame(found, "kind string, name string, state string")
