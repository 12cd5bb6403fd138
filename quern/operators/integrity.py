"""Constraints as queries for their violations, and differences between expected and actual catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, columns: list[str], allow_null: bool = False) -> DataFrame:
    """Keys that are repeated (``n`` times) or, for primary keys, partly null."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    counted = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counted.filter((present & (F.col("n") > 1)) if allow_null else (~present | (F.col("n") > 1)))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is fully given but missing in ``parent``."""
    keys = parent.select(*[F.col(c).alias(f"_parent{i}") for i, c in enumerate(parent_columns)]).distinct()
    on, present = F.lit(True), F.lit(True)
    for i, c in enumerate(columns):
        on = (F.col(c) == F.col(f"_parent{i}")) if i == 0 else on & (F.col(c) == F.col(f"_parent{i}"))
        present = present & F.col(c).isNotNull()
    return child.filter(present).join(keys, on, "left_anti")


def check_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; an unknown one passes."""
    return df.filter(~F.coalesce(F.expr(condition), F.lit(True)))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def catalog_difference(expected: DataFrame, actual: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """(keys..., state) of entries that are missing, extra or different."""
    e = expected.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in compared], F.lit(True).alias("_e"))
    a = actual.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_a_{c}") for c in compared], F.lit(True).alias("_a"))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = c if on is None else on & c
    joined = e.join(a, on, "full")
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(differs, "different")
    return joined.select(*[F.coalesce(F.col(k), F.col(f"_k_{k}")).alias(k) for k in keys], state.alias("state")).filter("state is not null")


def validate(engine, constraint) -> DataFrame:
    """The violations of a catalog constraint among the session's tables."""
    table = engine.spark.table(engine.view_name(tuple(constraint.table.split("."))))
    if constraint.kind in ("P", "U"):
        return key_violations(table, list(constraint.columns), constraint.kind == "U")
    if constraint.kind == "R":
        parent = engine.spark.table(engine.view_name(tuple(constraint.references.split("."))))
        return orphans(table, list(constraint.columns), parent, list(constraint.referenced_columns))
    from ..sql.lowering import Frame
    from ..sql.parser import parse_expression
    from ..types import kind

    low = engine._lowering(None)
    low.frames.append(Frame([("", {f.name.lower(): kind(f.dataType) for f in table.schema})]))
    return check_violations(table, low.emit(parse_expression(constraint.condition)))
