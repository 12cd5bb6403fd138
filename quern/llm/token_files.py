"""Token-id files: ORC with run-length encoded integers, row indexes and Bloom filters on ids.

The texts are dealt by ranges of the id and sorted before they are encoded, so the files ascend in
id and the encoding happens once, behind the exchange.  A row keeps where it starts within its
range; where each range starts (a row per file) is written beside the files.  Readers take stripes in
parallel, prune them by the statistics of ``doc_id`` and use its Bloom filter for point look-ups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks_of, keyed_text, map_arrow, shared_path, shuffle_partitions, tokenizer_path
from .word_pieces import encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: The folder of the ranges' starts, which readers of the files pass over; so many may be broadcast (some 40 bytes each).
STARTS, BROADCAST_RANGES = "_starts", 100_000


def _encode(file: str, end_id: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path(file))
        part = TaskContext.get().partitionId()
        at = 0
        for held in blocks_of(batches, "text", 1_000_000):
            table = pa.Table.from_batches(held)
            ids, per = known.encode(table.column("text").to_pylist(), end_id)
            ends = np.cumsum(per)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(np.full(len(per), part, np.int32)), pa.array(at + ends - per), pa.array(per), lists], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
            at += int(ends[-1]) if len(ends) else 0

    return run


def write(docs: DataFrame, path: str, file: str = "word_bpe_49k.json", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> None:
    """Write the ids of every text, ``end_id`` behind each, in ascending order of the id (null first).

    Null and empty texts have the end id only.  Rows of one id stand together, ordered by the text's
    hash and then by place; rows repeated in full are equal, so their order shows nowhere.  An empty table writes no row.
    """
    spark = docs.sparkSession
    n = ranges or shuffle_partitions(spark)
    # rows that share an id, or have none, are dealt on by text and place, so that they need not fit one range
    rows = keyed_text(docs, id_col, text_col).select("*", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"))
    keys = (F.col("id").asc_nulls_first(), F.col("th"), F.col("row"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("id", "text")
    (
        map_arrow(ordered, _encode(file, end_id), SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(16 << 20))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    totals = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/{STARTS}")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ``doc_ids`` are looked up through statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    bases = spark.read.schema("part int, base long").parquet(f"{path}/{STARTS}")
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    if bases.count() <= BROADCAST_RANGES:
        bases = F.broadcast(bases)
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
        bounds = lists.offsets.to_pylist()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read`` returns."""
    return map_arrow(tokens.select("doc_id", "start", "n_tokens", "ids"), _crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, file: str = "word_bpe_49k.json", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write(docs, path, file, end_id, id_col, text_col)
    return read(spark, path)
