"""Data changes as DataFrames: a table's view is replaced by the changed rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QuernError, UnsupportedFeature
from ..sql import ast as A
from ..sql.lowering import Frame, name
from ..storage import materialize
from ..types import kind

if TYPE_CHECKING:
    from ..engine import Engine


def insert_rows(target: DataFrame, rows: DataFrame, columns: list[str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """``target`` with ``rows``; columns that are not given take their default (a Spark SQL expression) or null."""
    given = [c.lower() for c in columns or target.columns]
    if len(given) != len(rows.columns):
        raise QuernError(f"{len(rows.columns)} values for {len(given)} columns")
    if unknown := set(given) - {c.lower() for c in target.columns}:
        raise QuernError(f"unknown columns {sorted(unknown)}")
    rows = rows.toDF(*[f"v{i}" for i in range(len(given))])
    defaults = {k.lower(): v for k, v in (defaults or {}).items()}
    made = []
    for f in target.schema:
        value = F.col(f"v{given.index(f.name.lower())}") if f.name.lower() in given else F.expr(defaults.get(f.name.lower(), "NULL"))
        made.append(value.cast(f.dataType).alias(f.name))
    return target.unionByName(rows.select(*made))


def apply_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Nulls of columns replaced by their defaults (Spark SQL expressions)."""
    return df.select(*[F.coalesce(F.col(c), F.expr(defaults[c]).cast(df.schema[c].dataType)).alias(c) if c in defaults else F.col(c) for c in df.columns])


def update_rows(target: DataFrame, sets: dict[str, str], where: str | None = None) -> DataFrame:
    """``target`` with columns set (Spark SQL expressions over the old row) where the condition is true."""
    hit = F.expr(where) if where else F.lit(True)
    low = {k.lower(): v for k, v in sets.items()}
    return target.select(*[F.when(hit, F.expr(low[f.name.lower()]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in low else F.col(f.name) for f in target.schema])


def delete_rows(target: DataFrame, where: str | None = None) -> DataFrame:
    """``target`` without the rows for which the condition is true; false and null stay."""
    return target.filter(~F.coalesce(F.expr(where), F.lit(False))) if where else target.limit(0)


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None, insert: bool = True) -> DataFrame:
    """Rows of ``source`` replace columns of rows with equal keys; the others are added.

    A row of the target that matches several rows of the source fails the query that reads the result.
    """
    columns = update if update is not None else [c for c in source.columns if c not in keys]
    alike = F.count(F.lit(1)).over(Window.partitionBy(*(F.col(f"_s_{k}") for k in keys)))  # the join's own partitioning
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns], F.lit(True).alias("_hit")).withColumn("_alike", alike)
    on = None
    for k in keys:
        c = F.col(k) == F.col(f"_s_{k}")
        on = c if on is None else on & c
    joined = target.withColumn("_mine", F.lit(True)).join(s, on, "full" if insert else "left")
    several = F.col("_mine") & F.col("_hit") & (F.col("_alike") > 1)
    joined = joined.withColumn("_mine", F.when(several, F.raise_error(F.lit("MERGE: a row of the target matches several rows of the source")).cast("boolean")).otherwise(F.col("_mine")))
    out = []
    for f in target.schema:
        new = F.col(f"_s_{f.name}") if f.name in source.columns else F.lit(None)
        mine = F.when(F.col("_hit"), new).otherwise(F.col(f.name)) if f.name in columns else F.col(f.name)
        out.append(F.when(F.col("_mine"), mine).otherwise(new).cast(f.dataType).alias(f.name))
    return joined.select(*out)


@dataclass(frozen=True)
class Hook:
    """A trigger: ``run`` takes the event and the rows it concerns, old values in columns _old_<name>.

    Row triggers that come before return the rows as they are to be written; statement triggers get no rows.
    """

    name: str
    timing: str  # BEFORE, AFTER
    events: tuple[str, ...]
    each_row: bool
    run: Callable[[str, DataFrame | None], DataFrame | None]

    def fires(self, timing: str, event: str, each_row: bool) -> bool:
        return (self.timing, self.each_row) == (timing, each_row) and event in self.events


def _statement(hooks: list[Hook], timing: str, event: str) -> None:
    for h in hooks:
        if h.fires(timing, event, False):
            h.run(event, None)


def _fired(hooks: list[Hook], event: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` after the row triggers that come before; columns of old values are null where there are none.

    Written if any trigger sees the rows, so that each body runs once for a row and its errors show here.
    """
    missing = [c for c in columns if f"_old_{c.lower()}" not in rows.columns]
    rows = rows.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"_old_{c.lower()}") for c in missing])
    for h in hooks:
        if h.fires("BEFORE", event, True):
            rows = h.run(event, rows)
    return materialize(rows, "fired") if any(h.each_row and event in h.events for h in hooks) else rows


def _store(engine: Engine, view: str, out: DataFrame, hooks: list[Hook], events: list[tuple[str, DataFrame]]) -> None:
    """The view's new rows; then the triggers that come after.  If one of them fails, the view is as it was."""
    written = materialize(out, "changed")
    before = engine.spark.table(view)
    written.createOrReplaceTempView(view)
    try:
        for event, rows in events:
            for h in hooks:
                if h.fires("AFTER", event, True):
                    h.run(event, rows)
            _statement(hooks, "AFTER", event)
    except BaseException:
        before.createOrReplaceTempView(view)
        raise


def insert_into(engine: Engine, view: str, rows: DataFrame, columns: list[str] | None) -> int:
    """Add written ``rows`` to a table, with its triggers."""
    target = engine.spark.table(view)
    hooks = engine.triggers.get(view, [])
    _statement(hooks, "BEFORE", "INSERT")
    added = _fired(hooks, "INSERT", insert_rows(target.limit(0), rows, columns), target.columns)
    _store(engine, view, target.unionByName(added.select(*target.columns)), hooks, [("INSERT", added)])
    return rows.count()


def change(engine: Engine, statement: A.Node, binds: dict[str, object] | None = None) -> int:
    """Carry out INSERT, UPDATE, DELETE or MERGE; returns how many rows it concerned."""
    view = engine.view_name(statement.table)  # type: ignore[attr-defined]
    target = engine.spark.table(view)
    low = engine._lowering(binds)
    columns = {f.name.lower(): kind(f.dataType) for f in target.schema}
    hooks = engine.triggers.get(view, [])
    if isinstance(statement, A.Merge):
        return merge(engine, statement, view, binds)
    if isinstance(statement, A.Insert):
        if statement.query is not None:
            rows = engine.spark.sql(low.query(statement.query)[0])
        else:
            low.frames.append(Frame())
            rows = engine.spark.sql("SELECT " + ", ".join(f"{_value(engine, low, v)} AS v{i}" for i, v in enumerate(statement.values or [])))
        return insert_into(engine, view, materialize(rows.toDF(*[f"v{i}" for i in range(len(rows.columns))]), "insert"), statement.columns or None)
    event = "DELETE" if isinstance(statement, A.Delete) else "UPDATE"
    _statement(hooks, "BEFORE", event)
    alias = statement.alias or statement.table[-1]  # type: ignore[attr-defined]
    low.frames.append(Frame([(alias, columns)]))
    where = low.emit(statement.where) if statement.where is not None else "true"  # type: ignore[attr-defined]
    source = f"{name(view)} AS {name(alias)}"
    n = engine.spark.sql(f"SELECT 1 FROM {source} WHERE {where}").count()
    old = [F.col(c).alias(f"_old_{c.lower()}") for c in target.columns]
    watched = any(event in h.events and h.each_row for h in hooks)
    fired: list[tuple[str, DataFrame]] = []
    if isinstance(statement, A.Delete):
        # subqueries are kept to plain conditions: what is not hit is what is false or unknown
        rest = f"NOT ({where}) OR ({where}) IS NULL" if _has_query(statement.where) else f"NOT coalesce({where}, false)"
        out = engine.spark.sql(f"SELECT * FROM {source} WHERE {rest}")
        gone = target.limit(0).select(*target.columns, *old)
        if watched:
            hit = engine.spark.sql(f"SELECT * FROM {source} WHERE {where}")
            gone = _fired(hooks, event, hit.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema], *old), target.columns)
        fired.append((event, gone))
    elif isinstance(statement, A.Update):
        sets: dict[str, str] = {}
        for names, value in statement.sets:
            if len(names) == 1:
                sets[names[0].lower()] = low.emit(value)
                continue
            if isinstance(value, A.Scalar):
                block = value.query.body
                if not isinstance(block, A.Block) or len(block.items) != len(names):
                    raise UnsupportedFeature("SET of several columns by this query")
                for c, item in zip(names, block.items, strict=True):
                    sets[c.lower()] = low.emit(A.Scalar(replace(value.query, body=replace(block, items=[item]))))
            elif isinstance(value, A.Tuple):
                sets.update({c.lower(): low.emit(v) for c, v in zip(names, value.items, strict=True)})
        flagged = engine.spark.sql(f"SELECT *, {', '.join(f'{v} AS `_set_{c}`' for c, v in sets.items())}, coalesce({where}, false) AS `_hit` FROM {source}")
        new = [F.when(F.col("_hit"), F.col(f"_set_{f.name.lower()}").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in sets else F.col(f.name) for f in target.schema]
        if watched:
            flagged = materialize(flagged, "update")
            changed = _fired(hooks, event, flagged.filter("_hit").select(*new, *old), target.columns)
            out = flagged.filter("NOT _hit").select(*target.columns).unionByName(changed.select(*target.columns))
            fired.append((event, changed))
        else:
            out = flagged.select(*new)
            fired.append((event, target.limit(0)))
    else:
        raise UnsupportedFeature(type(statement).__name__)
    _store(engine, view, out, hooks, fired)
    return n


def merge(engine: Engine, m: A.Merge, view: str, binds: dict[str, object] | None) -> int:
    """MERGE: a target row may match one source row only; what is updated may then be deleted, what is missing inserted."""
    target = engine.spark.table(view)
    hooks = engine.triggers.get(view, [])
    low = engine._lowering(binds)
    low.frames.append(Frame())
    source = low.source(m.source)
    alias = m.alias or m.table[-1]
    low.frames[-1].sources.append((alias, {f.name.lower(): kind(f.dataType) for f in target.schema}))
    numbered = materialize(target.withColumn("_row", F.monotonically_increasing_id()), "merge-target")
    numbered.createOrReplaceTempView(own := f"{view}__merging")
    mine = f"{name(own)} AS {name(alias)}"
    on = low.emit(m.on)
    columns = [f"{name(alias)}.{name(c)}" for c in target.columns]
    sets = {names[0].lower(): low.emit(v) for names, v in m.sets or []}
    hit = low.emit(m.update_where) if m.update_where is not None else "true"
    new = [f"{sets[c.lower()]} AS {name(f'_new_{c.lower()}')}" for c in target.columns if c.lower() in sets]
    matched = materialize(engine.spark.sql(f"SELECT {', '.join([f'{name(alias)}._row', *columns, *new, f'coalesce({hit}, false) AS _hit'])} FROM {mine} JOIN {source} ON {on}"), "merge-matched")
    if matched.groupBy("_row").count().filter("count > 1").limit(1).count():
        raise QuernError("MERGE: a row of the target matches several rows of the source")
    changed = matched.filter("_hit") if m.sets is not None else matched.limit(0)
    made = [(F.col(f"_new_{f.name.lower()}").cast(f.dataType) if f.name.lower() in sets else F.col(f.name)).alias(f.name) for f in target.schema]
    for event, used in (("UPDATE", m.sets), ("INSERT", m.values)):
        if used is not None:
            _statement(hooks, "BEFORE", event)
    updated = changed.select(*made, *[F.col(c).alias(f"_old_{c.lower()}") for c in target.columns])
    updated = after_update = _fired(hooks, "UPDATE", updated, target.columns)
    updated = updated.select(*target.columns)
    events = [("UPDATE", after_update)] if m.sets is not None else []
    if m.delete_where is not None:
        if any("DELETE" in h.events for h in hooks):
            raise UnsupportedFeature("DELETE triggers on a MERGE that deletes")
        updated.createOrReplaceTempView(gone := f"{view}__merged")
        low.frames[-1] = Frame([(alias, {f.name.lower(): kind(f.dataType) for f in target.schema})])
        updated = engine.spark.sql(f"SELECT * FROM {name(gone)} AS {name(alias)} WHERE NOT coalesce({low.emit(m.delete_where)}, false)")
    out = numbered.join(changed.select("_row"), "_row", "left_anti").select(*target.columns).unionByName(updated)
    n = changed.count()
    if m.values is not None:
        low.frames[-1] = Frame()
        source = low.source(m.source)
        values = [low.emit(v) for v in m.values]
        where = f" WHERE {low.emit(m.insert_where)}" if m.insert_where is not None else ""
        rows = engine.spark.sql(f"SELECT {', '.join(f'{v} AS v{i}' for i, v in enumerate(values))} FROM {source} LEFT ANTI JOIN {mine} ON {on}{where}")
        rows = materialize(rows, "merge-new")
        added = _fired(hooks, "INSERT", insert_rows(target.limit(0), rows, m.columns or None), target.columns)
        out = out.unionByName(added.select(*target.columns))
        events.append(("INSERT", added))
        n += rows.count()
    _store(engine, view, out, hooks, events)
    return n


def _value(engine: Engine, low, v: A.Node) -> str:
    if isinstance(v, A.Column) and v.name.upper() == "NEXTVAL" and len(v.parts) > 1:
        return str(engine.catalog.sequence(v.parts[:-1]).nextval())
    return low.emit(v)


def _has_query(e: A.Node | None) -> bool:
    return e is not None and any(isinstance(n, A.Query) for n in A.walk(e))
