"""Connected components of a link table, by alternating large and small stars.

Each round replaces every node's links by links to the smallest neighbour, once among its larger
neighbours and once among its smaller ones; the links of a component end as a star around its
smallest node after a number of rounds that grows with the logarithm of the component's size.  A
node's links are never gathered: minima are aggregated before the exchange, and the joins are
sort-merge joins that adaptive execution splits where one node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long), root being the smallest node reachable.

    Loops, repeated and reversed links change nothing; rows with a null end are left out; no links
    give no rows.
    """
    edges = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        old, edges = edges, materialize(small, "small-star")
        discard(old, large)
        before, state = state, _state(edges)
        if before == state:
            own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
