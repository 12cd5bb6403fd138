"""What the operators share: the shared folder, bounded Arrow batches, block-wise Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import importable
from ..storage import discard, materialize, scratch, shared_path

__all__ = ["BATCH_ROWS", "blocks_of", "bounded_batches", "discard", "keyed_text", "map_arrow", "materialize", "one_each", "scratch", "shared_path", "shuffle_partitions", "text_hash", "tokenizer_path", "unused"]

#: Rows of one Arrow batch: long texts keep a batch small enough for a Python worker.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Prepare Python workers: this package within reach, and a bound on what one Arrow batch brings."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, text) with text never null; every other column of ``docs`` is left out, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def text_hash(text_col: str) -> Column:
    """The hash of a text; a null one counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def unused(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for columns of an operator's own."""
    prefix = "_q"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def one_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``: of rows that differ in other columns, the one whose columns have the least hash."""
    every = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    mark = unused(df)
    return df.groupBy(*(F.col(f"`{k}`").alias(f"{mark}{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*every), F.xxhash64(*plain)).alias(f"{mark}row")).select(f"{mark}row.*")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def blocks_of(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the incoming rows whose ``column`` has about ``most`` bytes together (one longer row stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start = 0
        for row, length in enumerate(lengths.tolist()):
            if size and size + length > most:
                if row > start:
                    held.append(batch.slice(start, row - start))
                yield held
                held, size, start = [], 0, row
            size += length
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield held


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; looked up where it is used, so executors may have it elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(name)
