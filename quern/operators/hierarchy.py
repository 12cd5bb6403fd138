"""CONNECT BY: level-wise traversal of parent-child rows."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import QuernError
from ..storage import shared_path

MOST_LEVELS = 100_000


class ConnectByLoop(QuernError):
    """A row is its own ancestor and NOCYCLE was not given."""


def connect_by(
    base: DataFrame,
    start: str,
    pairs: list[tuple[str, str]],
    others: list[str] | None = None,
    paths: dict[str, tuple[str, str]] | None = None,
    roots: dict[str, tuple[str]] | None = None,
    priors: dict[str, tuple[str]] | None = None,
    nocycle: bool = False,
    leaf: bool = False,
    iscycle: bool = False,
    siblings: list[tuple[str, bool, str | None]] | None = None,
) -> DataFrame:
    """Rows of ``base`` reached from those that meet ``start``, with ``_level`` and what is asked for.

    ``pairs`` are (expression of the parent, expression of the child) that must be equal, ``others``
    conditions that may use the parent's columns as ``_p_<column>``; ``paths`` are
    SYS_CONNECT_BY_PATH's (expression, separator), ``roots`` and ``priors`` expressions of the first
    row and the parent; ``_dfs`` orders depth first.  Each level is one join with ``base`` on the
    pairs, written to the shared folder, so neither the plan nor a task grows with the depth.
    """
    paths, roots, priors = paths or {}, roots or {}, priors or {}
    columns = base.columns
    generator = re.fullmatch(r"\(`_level` (<=?) (\d+)\)", others[0]) if others and len(others) == 1 and not (pairs or paths or roots or priors or leaf or iscycle) else None
    if generator and start == "true" and base.limit(2).count() == 1:  # one row repeated: levels need no traversal
        most = int(generator[2]) - (generator[1] == "<")
        return base.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(1, most)).cast("long"))).alias("_level"))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in columns])

    def ordering(parent=None):
        keys = []
        for k, (e, descending, kind) in enumerate(siblings or []):
            key = F.expr(e)
            if descending:
                if kind != "N":
                    raise QuernError("ORDER SIBLINGS BY DESC of anything but numbers")
                key = -key
            keys.append(key.isNull().alias(f"n{k}"))
            keys.append(key.alias(f"k{k}"))
        own = F.array(F.struct(*keys, row.alias("r")))
        return own if parent is None else F.concat(parent, own)

    linked = bool(pairs) or any("_p_" in o for o in others or [])  # without PRIOR (a generator of rows) nothing can be a loop
    keep_dfs = siblings is not None and len(siblings) > 0
    first = base.filter(F.expr(start)).select(
        *[f"`{c}`" for c in columns],
        F.lit(1).cast("long").alias("_level"),
        F.array(row).alias("_ancestors"),
        *[F.concat(F.lit(sep), F.coalesce(F.expr(e).cast("string"), F.lit(""))).alias(k) for k, (e, sep) in paths.items()],
        *[F.expr(e).alias(k) for k, (e,) in roots.items()],
        *[F.lit(None).cast(base.selectExpr(f"{e} AS x").schema[0].dataType).alias(k) for k, (e,) in priors.items()],
        *([ordering().alias("_dfs")] if keep_dfs else []),
    )
    spark = base.sparkSession
    schema = first.schema
    paths_written: list[str] = []

    def written(level: DataFrame) -> tuple[DataFrame, int, bool]:
        """A level as written, its number of rows, and whether any of them is its own ancestor."""
        paths_written.append(shared_path(spark, "level"))
        seen = Observation()
        looped = F.max("_loops" if "_loops" in level.columns else F.lit(False)).alias("looped")
        level.observe(seen, F.count(F.lit(1)).alias("rows"), looped).write.option("compression", "zstd").parquet(paths_written[-1])
        got = seen.get
        return spark.read.schema(level.schema).parquet(paths_written[-1]), got["rows"], bool(got["looped"])

    down = base.select(*[f"`{c}`" for c in columns], *[F.expr(c).alias(f"_c{i}") for i, (_, c) in enumerate(pairs)], row.alias("_row"), *[F.concat(F.lit(sep), F.coalesce(F.expr(e).cast("string"), F.lit(""))).alias(f"_own{k}") for k, (e, sep) in paths.items()], *([ordering().alias("_owndfs")] if keep_dfs else []))
    if pairs:
        down = down.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *[F.col(f"_c{i}") for i in range(len(pairs))]).persist(StorageLevel.DISK_ONLY)
    last, rows, _ = written(first)
    kept = ["_level", "_ancestors", *paths, *roots, *(["_dfs"] if keep_dfs else [])]
    for depth in range(MOST_LEVELS):
        up = last.select(
            *[F.col(c).alias(f"_p{c}") for c in kept],
            *[F.col(f"`{c}`").alias(f"_p_{c.lower()}") for c in columns],
            *[F.expr(p).alias(f"_k{i}") for i, (p, _) in enumerate(pairs)],
            *[F.expr(e).alias(k) for k, (e,) in priors.items()],
        )
        condition = None
        for i in range(len(pairs)):
            c = F.col(f"_k{i}") == F.col(f"_c{i}")
            condition = c if condition is None else condition & c
        joined = up.join(down, condition) if condition is not None else up.crossJoin(down)
        joined = joined.withColumn("_level", F.col("_p_level") + 1)
        for o in others or []:
            joined = joined.filter(F.expr(o))
        loops = F.array_contains("_p_ancestors", F.col("_row"))
        if nocycle and linked:
            joined = joined.filter(~loops)
        grown = joined.select(
            *[f"`{c}`" for c in columns],
            "_level",
            F.concat("_p_ancestors", F.array("_row")).alias("_ancestors"),
            *[F.concat(F.col(f"_p{k}"), F.col(f"_own{k}")).alias(k) for k in paths],
            *[F.col(f"_p{k}").alias(k) for k in roots],
            *priors,
            *([F.concat("_p_dfs", "_owndfs").alias("_dfs")] if keep_dfs else []),
            *([] if nocycle or not linked else [loops.alias("_loops")]),
        )
        last, rows, looped = written(grown)
        if looped:
            down.unpersist()
            raise ConnectByLoop("CONNECT BY runs in a loop")
        if not rows:
            break
    else:
        raise QuernError(f"more than {MOST_LEVELS} levels")
    down.unpersist()
    out = spark.read.schema(schema).parquet(*paths_written)  # one scan, however many levels there are
    if leaf:
        parents = out.filter("_level > 1").select(F.expr("slice(_ancestors, 1, size(_ancestors) - 1)").alias("_parent")).distinct()
        out = out.join(parents, out["_ancestors"] == parents["_parent"], "left").withColumn("_connect_by_isleaf", F.when(F.col("_parent").isNull(), 1).otherwise(0).cast("long")).drop("_parent")
    if iscycle:
        up = out.select("_ancestors", *[F.expr(p).alias(f"_k{i}") for i, (p, _) in enumerate(pairs)])
        down = base.select(*[F.expr(c).alias(f"_c{i}") for i, (_, c) in enumerate(pairs)], row.alias("_row"))
        condition = F.array_contains("_ancestors", F.col("_row"))
        for i in range(len(pairs)):
            condition = (F.col(f"_k{i}") == F.col(f"_c{i}")) & condition
        again = up.join(down, condition).select(F.col("_ancestors").alias("_again")).distinct()
        out = out.join(again, out["_ancestors"] == again["_again"], "left").withColumn("_connect_by_iscycle", F.when(F.col("_again").isNull(), 0).otherwise(1).cast("long")).drop("_again")
    return out.drop("_ancestors")
