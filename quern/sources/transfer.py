"""Table transfer: clean values, copy where counts differ, reconcile counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import lob_from_hex, lob_to_hex, row_literal, strip_nul, typed_json

LOB_LIMIT = 20 << 20


@dataclass(frozen=True)
class Outcome:
    table: str
    action: str  # empty, equal, copied, failed
    source_rows: int
    target_rows: int
    error: str | None = None


def transferable(df: DataFrame, nested: str = "json", lobs: str = "keep") -> DataFrame:
    """``df`` with values any sink takes: no NULs in text, LOBs within the limit, nested values as JSON if asked for."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = strip_nul(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = lob_to_hex(c, LOB_LIMIT) if lobs == "hex" else F.when(F.octet_length(c) <= LOB_LIMIT, c)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) and nested == "json":
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def serialised(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Columns of object types as text, by their declared Oracle types.

    ANYDATA (a struct of type and value), queue types (AQ$_...) and spatial types (SDO_...) become JSON with
    their type; XMLTYPE becomes its text; an object type of one's own a row literal.
    """
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), declared.get(f.name, "").upper()
        if kind == "ANYDATA":
            c = F.when(c.isNotNull(), F.to_json(F.struct(c["type"].alias("oracleType"), c["value"].cast("string").alias("value"))))
        elif kind.startswith("AQ$_"):
            c = typed_json(c, f"SYS.{kind}")
        elif kind.startswith("SDO_"):
            c = typed_json(c, f"MDSYS.{kind}")
        elif kind == "XMLTYPE":
            c = strip_nul(c.cast("string"))
        elif kind and isinstance(f.dataType, T.StructType):
            c = row_literal(c, f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def staged(df: DataFrame, lobs: dict[str, str]) -> DataFrame:
    """Each LOB column empty, and its content as text in a column <name>_staging: hex of binary LOBs, text of character LOBs."""
    more = [(lob_to_hex(c, LOB_LIMIT) if kind.upper() in ("BLOB", "BFILE") else strip_nul(F.col(c).cast("string"))).alias(f"{c}_staging") for c, kind in lobs.items()]
    return df.select(*[F.lit(None).cast("binary").alias(c) if c in lobs else F.col(f"`{c}`") for c in df.columns], *more)


def unstaged(df: DataFrame, lobs: dict[str, str], not_null: Iterable[str] = ()) -> DataFrame:
    """The LOB columns made from their staging columns, which go; a null in a column that may have none fails the query."""
    made = {}
    for c, kind in lobs.items():
        text = F.col(f"{c}_staging")
        value = lob_from_hex(text) if kind.upper() in ("BLOB", "BFILE") else F.encode(text, "UTF-8")
        made[c] = F.coalesce(value, F.raise_error(F.lit(f"{c} holds a null")).cast("binary")) if c in set(not_null) else value
    return df.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns if not (c.endswith("_staging") and c.removesuffix("_staging") in lobs)])


def count_or_minus_one(df: Callable[[], DataFrame]) -> int:
    """A row count; -1 where the table cannot be read."""
    try:
        return df().count()
    except Exception:  # noqa: BLE001  any failure of the source counts as unknown
        return -1


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def copy_table(spark: SparkSession, table: str, source: DataFrame, target_path: str, form: str = "parquet", **options: str) -> Outcome:
    """Nothing for an empty source or equal counts; otherwise the target is replaced.

    Only a target that is not there counts as missing; one that cannot be read raises, and stays.
    The rows that are written are counted as they are written.
    """
    there = spark.read.format(form).options(**options).load(target_path).count() if _exists(spark, target_path) else None
    if there is None and source.isEmpty():
        return Outcome(table, "empty", 0, 0)
    if there is not None:
        rows = source.count()
        if not rows or rows == there:
            return Outcome(table, "equal" if rows else "empty", rows, there)
    written = Observation()
    transferable(source).observe(written, F.count(F.lit(1)).alias("rows")).write.format(form).mode("overwrite").options(**options).save(target_path)
    return Outcome(table, "copied", written.get["rows"], written.get["rows"])


def copy_tables(spark: SparkSession, sources: dict[str, DataFrame], target: str, form: str = "parquet", at_once: int = 4) -> list[Outcome]:
    """Several tables at a time; one that fails does not stop the others."""

    def one(item: tuple[str, DataFrame]) -> Outcome:
        try:
            return copy_table(spark, item[0], item[1], f"{target}/{item[0]}", form)
        except Exception as e:  # noqa: BLE001  reported with the table
            return Outcome(item[0], "failed", -1, -1, str(e)[:500])

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, sources.items()))


def reconcile(spark: SparkSession, source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """(table_name, source_rows, target_rows, equal) of every table either side has; -1 where one is missing."""
    counts = lambda side, name: (
        side[name].select(F.lit(name).alias("t")).groupBy("t").agg(F.count("*").alias("n")) if name in side else None
    )
    parts = []
    for name in sorted(source.keys() | target.keys()):
        row = spark.createDataFrame([(name,)], "table_name string")
        for side, label in ((source, "source_rows"), (target, "target_rows")):
            got = counts(side, name)
            if got is None:
                row = row.withColumn(label, F.lit(-1).cast("long"))
            else:
                row = row.join(got.withColumnRenamed("n", label), F.col("table_name") == F.col("t"), "left").drop("t").withColumn(label, F.coalesce(F.col(label), F.lit(0).cast("long")))
        parts.append(row)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("equal", F.col("source_rows") == F.col("target_rows"))
