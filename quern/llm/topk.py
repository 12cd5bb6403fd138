"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into *segments* of bounded size.  A segment is one row of a written table: its ids,
its components, and for each dimension the list of its rows by value, sorted once.  A query reads
all lists in step, from the top where its own component is positive and from the bottom where it is
negative, and scores what it meets for the first time.  What it has not met scores at most the sum
of the values read last; the search ends as soon as that is below the k-th score so far or below
the query's *floor*.  Nothing else ends it, and nothing is scored that the lists have not brought.

Queries go to segments, never vectors to queries: the rows of a partition are sorted so that a
segment comes first and its queries stream behind it, so a task holds one segment whatever the
number of queries.  There are two rounds.  In the first a query meets its own segment, whose k-th
score is its floor.  In the second it meets the segments whose list heads reach the floor.  The k
best of each are merged by a window over k rows a segment.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shuffle_partitions

#: Vectors in a segment, list entries read in the first step.
SEGMENT, STEP = 8192, 8
#: Heads of all lists are sent to the tasks up to so many bytes; beyond, every query visits every segment and stops at its heads there.
HEADS_BYTES = 32 << 20

PACKED = "segment int, width int, ids binary, x binary, lists binary, high array<long>, low array<long>"
FOUND = "query_id long, vec_id long, score long, segment long, scored long, held long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite components are left out."""
    c = F.col(vector_col)
    fine = c.isNotNull() & F.col(id_col).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))
    return rows.distinct()


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """Column d lists the rows by ascending value of dimension d."""
    return np.argsort(x, axis=0, kind="stable").astype(np.int32)


def threshold_search(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, own: int, k: int, floor: int | None = None, step: int = STEP) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) for ``q`` among the rows of ``x`` but those of id ``own``, and how many rows were scored.

    Ties go to the smaller id.  Rows below ``floor`` may be missing.  Steps double.
    """
    dims = np.flatnonzero(q)
    n = len(x)
    if not len(dims):  # all scores are zero
        return [(0, int(i)) for i in np.sort(ids[ids != own])[:k]], 0
    down, up = dims[q[dims] > 0], dims[q[dims] < 0]
    falling = lists[::-1]
    unseen = np.ones(n, bool)
    best_score, best_id = np.empty(0, x.dtype), np.empty(0, np.int64)
    scored, at = 0, 0
    # the heads of the lists bound every row
    bound = (x[falling[0, down], down] * q[down]).sum() + (x[lists[0, up], up] * q[up]).sum()
    while scored < n and not (floor is not None and bound < floor) and not (len(best_score) == k and bound < best_score.min()):
        mark = np.zeros(n, bool)
        mark[falling[at : at + step, down]] = True
        mark[lists[at : at + step, up]] = True
        met = np.flatnonzero(mark & unseen)
        unseen[met] = False
        scored += len(met)
        score = x[met] @ q
        other = ids[met] != own
        best_score, best_id = np.append(best_score, score[other]), np.append(best_id, ids[met][other])
        if len(best_score) > k:
            edge = np.partition(best_score, len(best_score) - k)[-k]
            best_score, best_id = best_score[best_score >= edge], best_id[best_score >= edge]
            keep = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[keep], best_id[keep]
        at, step = min(n, at + step), 2 * step
        bound = (x[falling[at - 1, down], down] * q[down]).sum() + (x[lists[at - 1, up], up] * q[up]).sum()
    keep = np.lexsort((best_id, -best_score))[:k]
    return [(int(s), int(i)) for s, i in zip(best_score[keep].tolist(), best_id[keep].tolist(), strict=True)], scored


def _pack(table: pa.Table) -> pa.Table:
    """One segment: a vector shorter than the others counts as zero beyond its end."""
    rows = table.column("v").to_pylist()
    x = np.zeros((len(rows), max(1, *map(len, rows))), np.int64)
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    return pa.table(
        {
            "segment": pa.array([table.column("segment")[0].as_py()], pa.int32()),
            "width": pa.array([x.shape[1]], pa.int32()),
            "ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "x": pa.array([x.tobytes()], pa.binary()),
            "lists": pa.array([sorted_lists(x).tobytes()], pa.binary()),
            "high": pa.array([x.max(axis=0).tolist()], pa.list_(pa.int64())),
            "low": pa.array([x.min(axis=0).tolist()], pa.list_(pa.int64())),
        }
    )


def segments(vectors: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``vectors`` (vec_id, v) as written segments with their sorted lists."""
    spark = vectors.sparkSession
    n = max(1, -(-vectors.count() // segment))
    dealt = vectors.withColumn("segment", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    dealt = dealt.repartition(min(n, shuffle_partitions(spark)), "segment")
    return materialize(dealt.groupBy("segment").applyInArrow(_pack, PACKED), "segments")


def _meet(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = x = whole = ids = lists = None
        largest = 0
        for batch in batches:
            out: list[tuple] = []
            packed, own, floors, which = (batch.column(c) for c in ("x", "query_id", "floor", "segment"))
            for i in range(batch.num_rows):
                if packed[i].is_valid:
                    held = which[i].as_py()
                    width = batch.column("width")[i].as_py()
                    whole = np.frombuffer(packed[i].as_py(), np.int64).reshape(-1, width)
                    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                    lists = np.frombuffer(batch.column("lists")[i].as_py(), np.int32).reshape(-1, width)
                    x, largest = whole.astype(float), max(1, int(np.abs(whole).max(initial=0)))
                    continue
                if held != which[i].as_py():
                    continue  # a segment without vectors
                q = np.zeros(whole.shape[1], np.int64)
                given = np.array(batch.column("v")[i].as_py(), np.int64)[: len(q)]
                q[: len(given)] = given
                bound = largest * max(1, int(np.abs(q).max(initial=0))) * max(1, len(q))
                if bound >= 1 << 63:
                    raise OverflowError("scores do not fit a long")
                exact = bound < 1 << 53  # products of doubles are exact, and faster
                best, scored = threshold_search(x if exact else whole, ids, lists, q.astype(float) if exact else q, own[i].as_py(), k, floors[i].as_py())
                out += [(own[i].as_py(), v, s, held, scored, len(ids)) for s, v in best] or [(own[i].as_py(), None, None, held, scored, len(ids))]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "segment", "scored", "held"])

    return run


def _visit(parts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best that each row of ``queries`` (query_id, v, floor, segment) finds in its segment, written."""
    left = parts.drop("high", "low").withColumn("query_id", F.lit(None).cast("long"))
    both = left.unionByName(queries.select("segment", "query_id", "v", "floor"), allowMissingColumns=True)
    # a segment's row sorts before its queries
    streams = both.repartition(shuffle_partitions(parts.sparkSession), "segment").sortWithinPartitions("segment", F.col("query_id").asc_nulls_first())
    return materialize(map_arrow(streams, _meet(k), FOUND), "found")


def _reach(which: np.ndarray, high: np.ndarray, low: np.ndarray):
    """Per query the segments, but its own, whose list heads reach its floor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, floor, own in zip(batch.column("v").to_pylist(), batch.column("floor").to_pylist(), batch.column("own").to_pylist(), strict=True):
                q = np.array(v[: high.shape[1]], float)
                heads = np.where(q > 0, high[:, : len(q)] * q, low[:, : len(q)] * q).sum(axis=1)
                # sums of doubles: a head within rounding of the floor counts as reaching it
                fine = (which != own) if floor is None else (which != own) & (heads >= floor - 1e-9 * (1 + abs(floor)) - 1e-9 * np.abs(heads))
                out.append(which[fine].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), batch.column("floor"), pa.array(out, pa.list_(pa.int32()))], names=["query_id", "v", "floor", "segments"])

    return run


def visits(vectors: DataFrame, queries: DataFrame, k: int = 5, segment: int = SEGMENT) -> DataFrame:
    """(query_id, vec_id, score, segment, scored, held): what each query finds in each segment it visits, scoring ``scored`` of its ``held`` rows."""
    parts = segments(vectors, segment)
    shape = parts.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w")).first()
    if not shape["n"]:
        return parts.sparkSession.createDataFrame([], FOUND)
    n = max(1, -(-vectors.count() // segment))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("own"))
    first = _visit(parts, asked.select("query_id", "v", F.lit(None).cast("long").alias("floor"), F.col("own").alias("segment")), k)
    floors = first.groupBy("query_id").agg(F.when(F.count("vec_id") >= k, F.min("score")).alias("floor"))
    floored = asked.join(floors, "query_id", "left").select("query_id", "v", "floor", "own")
    if shape["n"] * shape["w"] * 16 <= HEADS_BYTES:
        heads = parts.select("segment", "high", "low").collect()  # at most HEADS_BYTES
        high, low = np.zeros((2, len(heads), shape["w"]))
        for i, h in enumerate(heads):
            high[i, : len(h.high)], low[i, : len(h.low)] = h.high, h.low
        reach = map_arrow(floored, _reach(np.array([h.segment for h in heads], np.int32), high, low), "query_id long, v array<long>, floor long, segments array<int>")
        further = reach.select("query_id", "v", "floor", F.explode("segments").alias("segment"))
    else:
        further = floored.select("query_id", "v", "floor", "own", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("segment")).filter("segment <> own").drop("own")
    return first.unionByName(_visit(parts, further, k))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, segment: int = SEGMENT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each row of ``queries`` (both vec_id, v array<long>).

    A query never meets vectors of its own id; rows repeated in full count once; fewer candidates
    give fewer rows; no query or no vector gives none.
    """
    found = visits(vectors, queries, k, segment).filter("vec_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", segment: int = SEGMENT) -> DataFrame:
    """``top_k`` of the quantised vectors for those whose id is divisible by ``every``."""
    rows = materialize(quantised(vectors, id_col, vector_col), "quantised")
    return top_k(rows, rows.filter(F.pmod("vec_id", F.lit(every)) == 0), k, segment)
