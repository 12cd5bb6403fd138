"""Dense row numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def with_rownum(df: DataFrame, column: str = "rownum", start: int = 1, step: int = 1) -> DataFrame:
    """``df`` with numbers start, start + step, ... in the order of its partitions.

    The rows are written once with their place (partition, row); partition totals, one row each,
    give the partitions' first numbers.  Both passes read the written rows, so they agree even if
    an executor is lost, and no task sees more than its own partition.
    """
    placed = materialize(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", _ROW_BITS)
    totals = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    firsts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = placed.withColumn("_part", part).join(firsts, "_part")
    return numbered.select(*df.columns, (F.lit(start) + (F.col("_first") + row) * F.lit(step)).cast("long").alias(column))
