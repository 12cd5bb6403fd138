"""The engine: Oracle-dialect statements in, DataFrames out."""

from __future__ import annotations

import datetime
import decimal
import itertools
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog, Numbers
from .errors import QuernError, UnsupportedFeature
from .operators.hierarchy import connect_by
from .operators.numbering import with_rownum
from .sql import ast as A
from .sql.formats import quote
from .sql.lowering import Columns, Lowering, name
from .sql.parser import parse
from .storage import materialize
from .types import kind, spark_type

_numbers = itertools.count()


class Engine:
    """Runs statements against the session's tables and views.

    Tables are temporary views or catalog tables of the session; data changes replace a table's view
    by the changed DataFrame, so earlier readers keep what they have.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, rownum_mode: str = "oracle"):
        self.spark = spark
        self.catalog = catalog or Catalog()
        self.rownum_mode = rownum_mode
        self.functions: dict[str, tuple[str, str | None]] = {}
        self.methods: dict[str, str] = {}
        self.variables: list[Callable[[tuple[str, ...]], str | None]] = []
        self.known_views: dict[str, dict[str, str | None]] = {}
        self.triggers: dict[str, list] = {}
        self.stubs: set[str] = set()  # views and functions that are declared but not implemented yet
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # dates have no zone: where one is needed in passing, it must not shift them
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "10000")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    # statements

    def sql(self, text: str, binds: dict[str, object] | None = None) -> DataFrame:
        """The result of a query, or of a data change: one row with ``rows_changed``."""
        statement = parse(text)
        if isinstance(statement, A.Query):
            return self.spark.sql(self._lowering(binds).query(statement)[0])
        from .operators.dml import change

        return self.spark.createDataFrame([(change(self, statement, binds),)], "rows_changed long")

    def explain_lowering(self, text: str, binds: dict[str, object] | None = None) -> str:
        """The Spark SQL that a query becomes."""
        statement = parse(text)
        if not isinstance(statement, A.Query):
            raise UnsupportedFeature("lowering of anything but a query")
        return self._lowering(binds).query(statement)[0]

    def query(self, q: A.Query, binds: dict[str, object] | None = None) -> tuple[DataFrame, Columns]:
        text, columns = self._lowering(binds).query(q)
        return self.spark.sql(text), columns

    def _lowering(self, binds: dict[str, object] | None) -> Lowering:
        return Lowering(self, binds, self.rownum_mode)

    # names

    def view_name(self, parts: tuple[str, ...]) -> str:
        """The session's name of a table: a synonym's target, schema.table as schema__table or in its database."""
        key = ".".join(p.lower() for p in parts)
        if parts[-1].lower() == "dual" and not self.spark.catalog.tableExists("dual"):
            self.register("dual", self.spark.sql("SELECT 'X' AS dummy"))
        tried = [key]
        if len(parts) == 1:
            if target := self.catalog.synonym(key):
                tried = [target, key]
            if self.catalog.schema:
                tried.insert(len(tried) - 1, f"{self.catalog.schema.lower()}.{key}")
        for t in tried:
            for candidate in (t.replace(".", "__"), t, t.split(".")[-1]):
                if candidate in self.known_views or self.spark.catalog.tableExists(candidate):
                    return candidate
        raise QuernError(f"unknown table {key}")

    def resolve(self, parts: tuple[str, ...]) -> tuple[str, dict[str, str | None]]:
        view = self.view_name(parts)
        columns = self.known_views.get(view)
        if columns is None:
            columns = {f.name.lower(): kind(f.dataType) for f in self.spark.table(view).schema}
        return ".".join(map(name, view.split("."))), columns

    def register(self, table: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(table.lower().replace(".", "__"))

    def create_view(self, view: str, text: str, types: dict[str, str] | None = None) -> DataFrame:
        """A view by a query; ``types`` casts its columns to declared ones, in order."""
        df = self.sql(text)
        if types:
            if len(types) != len(df.columns):
                raise QuernError(f"{view} has {len(df.columns)} columns, {len(types)} are declared")
            inner = df.toDF(*[f"c{i}" for i in range(len(types))])
            df = inner.selectExpr(*[f"cast(c{i} as {spark_type(t, self.catalog.types).simpleString()}) AS {name(c)}" for i, (c, t) in enumerate(types.items())])
        self.register(view, df)
        self.catalog.views[view.lower()] = text
        self.stubs.discard(view.lower())
        return df

    def create_view_stub(self, view: str, types: dict[str, str]) -> DataFrame:
        """An empty view with its declared columns, so that others can refer to it before it is implemented."""
        schema = ", ".join(f"{name(c)} {spark_type(t, self.catalog.types).simpleString()}" for c, t in types.items())
        df = self.spark.createDataFrame([], schema)
        self.register(view, df)
        self.stubs.add(view.lower())
        return df

    # functions

    def register_function(self, function: str, spark_name: str | None = None, returns: str | None = None) -> None:
        """Make a session function (SQL or pandas) callable; packages' members are package__member."""
        key = function.upper()
        self.functions[key] = (spark_name or key.lower().replace(".", "__"), kind(spark_type(returns)) if returns else None)

    def create_function(self, function: str, params: dict[str, str], returns: str, body: str) -> None:
        """A scalar function with an expression for its body, inlined by Catalyst."""
        from .sql.lowering import Frame
        from .sql.parser import parse_expression

        low = self._lowering(None)
        low.frames.append(Frame([("", {p.lower(): kind(spark_type(t, self.catalog.types)) for p, t in params.items()})]))
        text = low.emit(parse_expression(body))
        target = function.lower().replace(".", "__")
        args = ", ".join(f"{name(p.lower())} {spark_type(t, self.catalog.types).simpleString()}" for p, t in params.items())
        out = spark_type(returns, self.catalog.types).simpleString()
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name(target)}({args}) RETURNS {out} RETURN cast({text} as {out})")
        self.register_function(function, target, returns)
        self.stubs.discard(function.lower())

    def create_function_stub(self, function: str, params: dict[str, str], returns: str) -> None:
        """A function of the declared shape that returns null, so that views and code can refer to it before it is implemented."""
        self.create_function(function, params, returns, "NULL")
        self.stubs.add(function.lower())

    def create_method_stub(self, type_name: str, method: str, params: dict[str, str], returns: str) -> None:
        self.create_method(type_name, method, params, returns, "NULL")
        self.stubs.add(f"{type_name}__{method}".lower())

    def create_method(self, type_name: str, method: str, params: dict[str, str], returns: str, body: str) -> None:
        """A member function of an object type: type__method(self, ...), called as value.method(...)."""
        function = f"{type_name}__{method}"
        self.create_function(function, {"self": type_name} | params, returns, body)
        self.methods[method.upper()] = function.upper()

    def function_kind(self, function: str) -> str | None:
        return self.functions.get(function, (None, None))[1]

    def call_text(self, function: str, args: list[str]) -> str:
        for key in (function, f"{self.catalog.schema or ''}.{function}".upper(), ".".join(function.split(".")[1:])):
            if key in self.functions:
                return f"{name(self.functions[key][0])}({', '.join(args)})"
        raise UnsupportedFeature(f"function {function}")

    # values

    @staticmethod
    def literal(value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (int, decimal.Decimal)):
            return str(value) if value >= 0 else f"({value})"
        if isinstance(value, float):
            return f"double('{value!r}')"
        if isinstance(value, datetime.datetime):
            return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
        if isinstance(value, datetime.date):
            return f"TIMESTAMP_NTZ'{value.isoformat()} 00:00:00'"
        return quote(str(value))

    def variable(self, parts: tuple[str, ...]) -> str | None:
        for look in reversed(self.variables):
            if (got := look(parts)) is not None:
                return got
        return None

    # what lowering hands to DataFrames

    def _view(self, df: DataFrame, kinds: dict[str, str | None] | None = None) -> str:
        view = f"_quern_{next(_numbers)}"
        df.createOrReplaceTempView(view)
        if kinds is not None:
            self.known_views[view] = kinds
        return view

    def numbered_view(self, text: str) -> str:
        return self._view(with_rownum(self.spark.sql(text), "_rownum"))

    def written_view(self, text: str) -> str:
        """The rows of a query with one column, written, so that every use sees the same."""
        df = self.spark.sql(text).toDF("v")
        return self._view(df if df.dtypes[0][1] == "void" else materialize(df, "subquery"))

    def reserve(self, parts: tuple[str, ...], text: str) -> Numbers:
        """As many numbers of a sequence as a written table has rows."""
        return self.catalog.sequence(parts).reserve(self.spark.sql(text).count())

    def hierarchy_view(self, base: str, alias: str, start: str, pairs: list, others: list, made: dict, nocycle: bool, flags: set[str], siblings: list) -> str:
        df = self.spark.sql(base).alias(alias)
        out = connect_by(df, start, pairs, others, made["paths"], made["roots"], made["priors"], nocycle, "CONNECT_BY_ISLEAF" in flags, "CONNECT_BY_ISCYCLE" in flags, siblings)
        return self._view(out)
