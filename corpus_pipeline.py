"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``; its result is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, common, line_dedup, mixing, quality, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null columns count as absent, repeated rows fare alike; where the labels lack a class, or there
    is no document, nothing is rejected.  Rows that stay are unchanged, further columns included.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages of 50 words are cut from the texts; every row stays, even an emptied one.

    Null and empty texts stay as they are; rows repeated in id and text count as one document; a null
    id comes last; an empty table gives an empty one; further columns are unchanged.
    """
    return line_dedup.dedup_lines(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (similarity 0.8 of five-word shingles) stays.

    It is the one of the smallest id, a null id last, then of the smallest text hash.  Texts without
    words, null ones among them, are copies of each other; an empty table gives an empty one; the
    rows that stay are unchanged, further columns included.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix shows them: a row for each pass that takes words of one, with those words.

    Texts without words, null ones among them, are never shown; a null source is the last source;
    repeated rows are so many copies; an empty table gives an empty one; further columns are unchanged.
    """
    return mixing.mix_texts(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row; null and empty texts have no ids, further columns are left out."""
    return byte_bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: A classifier and hashes of 64 bits are out of SQL's reach; tests hold each stage of run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; what a stage wrote is deleted once its result is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        keep: list[DataFrame] = []
        with common.scratch(spark, keep):
            keep.append(common.materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        common.discard(docs)
        docs = keep[0]
    return STAGES[-1][1](spark, docs, sf_dir)
