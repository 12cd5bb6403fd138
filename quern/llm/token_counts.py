"""Token counts without ids: count pieces once per distinct pre-token, join, and sum.

A map over the documents makes *blocks* (a bounded number of bytes of text): the block's distinct
pre-tokens, dealt into ``BUCKETS`` buckets by their hash, and for each of them its frequency in each
document.  The pre-tokens travel packed, one row per block and bucket, so a frequent pre-token costs
one entry per block and no bucket is hot.  A bucket of up to ``GROUP`` blocks goes to one task, which
counts every distinct pre-token once; more blocks make more groups, so that neither a task's rows nor
the rows of a block grow with the corpus.  The counts go back to their blocks (a byte each), where
frequency times count is summed per document.

Both the pre-tokens and the counts are in proportion to the input; no vocabulary is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, keyed_text, map_arrow, materialize, shuffle_partitions, tokenizer_path
from .word_pieces import coded, word_pieces

#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000
#: Buckets of a block, blocks whose buckets are counted together.
BUCKETS, GROUP = 128, 4096

BLOCKS = "block long, ids array<long>, n_bytes array<long>, words array<string>, spread binary, rows binary, freqs binary"


def _blocks(file: str, buckets: int, block_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(tokenizer_path(file))
        task = TaskContext.get().partitionId()
        for k, held in enumerate(blocks_of(batches, "text", block_bytes)):
            table = pa.Table.from_batches(held)
            text = table.column("text").combine_chunks()
            codes, lengths, words = coded(text.to_pylist(), pieces)
            n = len(lengths)
            bucket = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int64) if words else np.empty(0, np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            key, freq = np.unique(place[codes] * n + np.repeat(np.arange(n), lengths), return_counts=True) if len(codes) else (np.empty(0, np.int64), np.empty(0, np.int64))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            packed = ["\n".join(words[i] for i in order[a:b].tolist()) if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            spread = np.bincount(key // n, minlength=len(words)) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + k], pa.int64()),
                    pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([pc.binary_length(text).to_pylist()], pa.list_(pa.int64())),
                    pa.array([packed], pa.list_(pa.string())),
                    *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((spread, np.uint32), (key % max(n, 1), np.uint32 if n > 65_535 else np.uint16), (freq, np.uint32 if len(freq) and freq.max() > 65_535 else np.uint16))),
                ],
                names=["block", "ids", "n_bytes", "words", "spread", "rows", "freqs"],
            )

    return run


def _count(file: str):
    """Counts of each row's pre-tokens; each distinct one of the partition is counted once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(tokenizer_path(file))
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for packed in batch.column("packed").to_pylist():
                words = packed.split("\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, pieces.counts(new).tolist(), strict=True))
                counts = np.fromiter((known[w] for w in words), np.uint32, len(words))
                # four bytes only where a pre-token has over 255 pieces
                out.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\x00" + counts.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "counts"])

    return run


def _unpack(counts: bytes) -> np.ndarray:
    """A count is never zero, so a leading zero byte marks the wide form."""
    return np.frombuffer(counts[1:], np.uint32) if counts[0] == 0 else np.frombuffer(counts, np.uint8)


def _sum(limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["ids"])
                totals = np.zeros(n, np.int64)
                if r["counts"]:
                    per = np.concatenate([_unpack(x["counts"]) for x in sorted(r["counts"], key=lambda x: x["bucket"])]).astype(np.int64)
                    rows = np.frombuffer(r["rows"], np.uint32 if n > 65_535 else np.uint16)
                    freqs = np.frombuffer(r["freqs"], np.uint16 if len(r["freqs"]) == 2 * len(rows) else np.uint32)
                    spread = np.frombuffer(r["spread"], np.uint32)
                    np.add.at(totals, rows, np.repeat(per, spread) * freqs)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["n_bytes"], pa.int64()), pa.array(totals), pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, file: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``, as the tokenizers library counts.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids give a row each; an
    empty table gives no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    blocks = materialize(map_arrow(keyed_text(docs, id_col, text_col), _blocks(file, BUCKETS, block_bytes), BLOCKS), "token-blocks")
    groups = max(1, -(-blocks.count() // GROUP))
    packed = blocks.select("block", F.posexplode("words").alias("bucket", "packed")).filter(F.col("packed").isNotNull())
    dealt = packed.repartition(shuffle_partitions(spark), "bucket", F.pmod(F.xxhash64("block"), F.lit(groups)))
    counts = map_arrow(dealt, _count(file), "block long, bucket int, counts binary")
    per_block = counts.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("counts"))
    joined = blocks.drop("words").join(per_block, "block", "left")
    return map_arrow(joined, _sum(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
