"""The shingle sets of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, map_arrow, materialize, text_hash

SEED = 42


def shingles(text: str, size: int, seed: int = SEED) -> np.ndarray:
    """The hashes (uint64) of a text's shingles, sorted, each once; a text of fewer words is one shingle, one of none has none."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and the six white-space bytes
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - size + 1].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches, "text", 1_000_000):
            table = pa.Table.from_batches(held)
            sets = [shingles(t, size).view(np.int64) for t in table.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([table.column("h").combine_chunks(), pa.array(sets, pa.list_(pa.int64()))], names=["h", "shingles"])

    return run


def shingle_sets(docs: DataFrame, hashes: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(h, shingles) of the texts whose hash is in ``hashes`` (h), written."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_hash(text_col).alias("h"))
    texts = texts.join(hashes, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    return materialize(map_arrow(texts, _sets(size), "h long, shingles array<long>"), "shingles")

