"""SimHash near copies: fingerprints, tiled exact comparison, components.

Every pair of distinct fingerprints is compared, exactly, unless their population counts alone rule
it out: fingerprints that differ in r bits differ by at most r in population count, and so does the
sum of the differences of their parts' counts.  Distinct fingerprints are grouped by these counts
into groups of bounded size, of which there are as many as it takes; a pair of groups within reach is
one unit of work, which compares tiles with exclusive-or and bit counts and skips tile pairs out of
reach.  The comparison is quadratic in the number of distinct fingerprints.  Copies of a text share
a fingerprint and are compared once.

``near_copies`` links by the radius alone: a unit returns a spanning forest of its links, not the
links themselves, so a group of thousands of near copies makes as many rows as it has members.

``keep_one`` links by similarity.  Its fingerprints have 128 bits over distinct five-word shingles, and
the same comparison within ``WIDE`` bits gives components of *candidates*.  Then each component is
compared on its own, by the same tiles: a pair within ``WIDE`` bits that is not yet connected is tested
by the texts' shingle sets, and only what passes is linked.  Every candidate pair is thus decided by
its similarity, and again only spanning forests leave a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, bounded_batches, keyed_text, map_arrow, materialize, one_each, shuffle_partitions, text_hash, unused
from .components import components
from .shingle_sets import shingle_sets

SHINGLE, SEED, RADIUS = 4, 42, 4
#: For similarity: words of a shingle, similarity, bits of 128 that may differ.
#: A pair of similarity 0.8 differs in 19.4 +- 4.1 of 128 bits, one of 0.85 in 16.5 +- 3.8, an unrelated one in 64 +- 5.7.
SIMILAR_SHINGLE, SIMILARITY, WIDE = 5, 0.8, 26
#: Shingles of the texts that one task compares on a side; a component with more is divided.
MOST_SHINGLES = 500_000
#: Fingerprints in a group at most; the number of groups below which they are smaller.
GROUP, LEAST_GROUPS = 65_536, 16
#: Rows of the two sides of a tile, shingles turned into bits at once.
TILE, AT_ONCE = (128, 512), 200_000


def _second(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash."""
    h = hashes ^ (hashes >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ones(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit; ``counts`` says how many of ``hashes`` belong to each text."""
    out = np.zeros((len(counts), 64), np.int64)
    ends = np.cumsum(counts)
    for lo in range(0, len(hashes), AT_ONCE):
        hi = min(len(hashes), lo + AT_ONCE)
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left")
        starts = np.maximum(ends[first : last + 1] - counts[first : last + 1], lo) - lo
        bits = np.unpackbits(np.ascontiguousarray(hashes[lo:hi], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return out


def fingerprint_block(texts: list[str], shingle: int = SHINGLE, seed: int = SEED, words: int = 1, distinct: bool = False) -> np.ndarray:
    """Fingerprints of texts: (n, words) uint64.  ``distinct`` counts repeated shingles of a text once."""
    digest = xxhash.xxh64_intdigest
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = text.encode().lower().split()  # on bytes: A-Z only, and the six white-space bytes
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= shingle:
            own = np.array([digest(joined, seed)], np.uint64)
        else:
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(size + 1) - 1
            starts = (ends - size)[: len(parts) - shingle + 1].tolist()
            own = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
            if distinct:
                own = np.unique(own)
        hashes.append(own)
        counts[i] = len(own)
    out = np.zeros((len(texts), words), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        every = np.concatenate(hashes)
        for k in range(words):
            every = every if k == 0 else _second(every)
            ones = _ones(every, counts[full])
            out[full, k] = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(shingle: int, seed: int, words: int, distinct: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches, "text", 1_000_000):
            table = pa.Table.from_batches(held)
            fp = fingerprint_block(table.column("text").to_pylist(), shingle, seed, words, distinct).view(np.int64)
            columns = {"id": table.column("id").combine_chunks(), "h": table.column("h").combine_chunks(), "fp": pa.array(np.ascontiguousarray(fp[:, 0]))}
            if words == 2:
                columns["fp2"] = pa.array(np.ascontiguousarray(fp[:, 1]))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, h, fp) of every row, and fp2 for two words; h is the text's hash.  Null and empty texts have fingerprint 0."""
    return map_arrow(keyed_text(docs, id_col, text_col, text_hash(text_col).alias("h")), _fingerprints(shingle, seed, words, distinct), "id long, h long, fp long" + (", fp2 long" if words == 2 else ""))


def _order(fp: np.ndarray) -> np.ndarray:
    """The order by the counts of the quarters, in which tiles are cut."""
    return np.lexsort(_parts(fp, 4).T[::-1])


def _tiles(fp: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each tile, its least and greatest counts by quarter) of ordered fingerprints."""
    starts, counts = np.arange(0, len(fp), rows), _parts(fp, 4)
    return starts, np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def _meetings(x: list[np.ndarray], y: list[np.ndarray], radius: int, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, distances) of all tile pairs within reach; of ``x`` with itself each pair of tiles once.

    ``x`` and ``y`` are the fingerprints by word, ordered by the first, whose counts say what is within reach.
    """
    i_start, i_low, i_high = _tiles(x[0], TILE[0])
    j_start, j_low, j_high = _tiles(y[0], TILE[1])
    for t, i in enumerate(i_start.tolist()):
        near = np.maximum(np.maximum(i_low[t] - j_high, j_low - i_high[t]), 0).sum(axis=1) <= radius
        if same:
            near &= j_start + TILE[1] > i
        for j in j_start[near].tolist():
            yield i, j, sum(np.bitwise_count(p[i : i + TILE[0], None] ^ q[j : j + TILE[1]]) for p, q in zip(x, y, strict=True))


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The roots of ``nodes``, whose paths are shortened."""
    top = parent[nodes]
    while (parent[top] != top).any():
        top = parent[parent[top]]
    parent[nodes] = top
    return top


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links among the rows of ``a`` (n, words), or of ``b`` (None: the same) with ``a``: (row, its root), rows of ``b`` counted on."""
    if not len(a) or (b is not None and not len(b)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = _order(a[:, 0])
    second = first if b is None else len(a) + _order(b[:, 0])
    every = a if b is None else np.concatenate((a, b))
    words = lambda rows: [np.ascontiguousarray(every[rows, k]) for k in range(a.shape[1])]
    parent = np.arange(len(every))
    for i, j, distance in _meetings(words(first), words(second), radius, b is None):
        near = distance <= radius
        if not near.any():
            continue
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            labels = np.unique(_roots(parent, np.append(second[j + np.flatnonzero(near[r])], first[i + r])))
            parent[labels] = labels[0]
    root = _roots(parent, np.arange(len(every)))
    linked = np.flatnonzero(root != np.arange(len(every)))
    return linked, root[linked]


def _unit(radius: int, words: list[str], node: str):
    def run(table: pa.Table) -> pa.Table:
        fp = np.column_stack([table.column(c).to_numpy() for c in words]).view(np.uint64)
        group, names = table.column("g").to_numpy(), table.column(node).to_numpy()
        first, last = table.column("ga")[0].as_py(), table.column("gb")[0].as_py()
        x, y = np.flatnonzero(group == first), np.flatnonzero(group == last)
        u, v = forest(fp[x], None if first == last else fp[y], radius)
        rows = x if first == last else np.append(x, y)
        return pa.table({"u": names[rows[u]], "v": names[rows[v]]})

    return run


def similar_forest(fp: np.ndarray, values: np.ndarray, ends: np.ndarray, side: np.ndarray, within: bool, similarity: float, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the rows whose fingerprints are within ``wide`` bits and whose sets are similar: (row, its root).

    Row i's set is the sorted ``values`` up to ``ends[i]``.  Unless ``within``, only rows of different
    sides are compared.  A pair that is connected already is not tested.
    """
    n = len(fp)
    size = np.diff(ends, prepend=0)
    begins = ends - size
    parent = np.arange(n)
    for i in range(0, n, TILE[0]):
        for j in range(i, n, 16 * TILE[1]):
            distance = sum(np.bitwise_count(fp[i : i + TILE[0], None, k] ^ fp[j : j + 16 * TILE[1], k]) for k in range(fp.shape[1]))
            close = distance <= wide
            if not close.any():
                continue
            for r in np.flatnonzero(close.any(axis=1)).tolist():
                row, others = i + r, j + np.flatnonzero(close[r])
                own = size[row]
                fine = (others > row) & (np.minimum(size[others], own) >= similarity * np.maximum(size[others], own))
                others = others[fine if within else fine & (side[others] != side[row])]
                top = _roots(parent, np.append(others, row))
                others = others[top[:-1] != top[-1]]
                if not len(others) or not own:
                    continue
                lengths = size[others]
                stops = np.cumsum(lengths)
                theirs = values[np.repeat(begins[others] - (stops - lengths), lengths) + np.arange(stops[-1])]
                mine = values[begins[row] : ends[row]]
                common = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, theirs), own - 1)] == theirs, stops - lengths, dtype=np.int64)
                similar = others[common >= similarity * (own + lengths - common)]
                if len(similar):
                    labels = np.unique(_roots(parent, np.append(similar, row)))
                    parent[labels] = labels[0]
    root = _roots(parent, np.arange(n))
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def _similar(similarity: float, wide: int):
    """Links of each unit (comp, sa, sb) of a sorted stream; a unit is held, never a partition."""

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        sets = table.column("shingles").combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        starts = sets.offsets.to_numpy()
        values = sets.values.to_numpy()[starts[0] : starts[-1]].view(np.uint64)
        fp = np.column_stack((column("fp"), column("fp2"))).view(np.uint64)
        node = column("node")
        u, v = similar_forest(fp, values, starts[1:].astype(np.int64) - starts[0], column("s"), column("sa")[0] == column("sb")[0], similarity, wide)
        return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("comp", "sa", "sb")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and key != tuple(keys[a]):
                    yield linked(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield linked(held)

    return run


def _parts(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of ``parts`` equal parts of each fingerprint, the highest part first."""
    kind = {1: "<u8", 2: "<u4", 4: "<u2"}[parts]
    return np.bitwise_count(np.ascontiguousarray(fp, "<u8").view(kind).reshape(-1, parts)[:, ::-1]).astype(np.int64)


def _cell(parts: int):
    """The same as one number per row: the counts as digits to the base of one more than their greatest value."""
    width = 64 // parts
    cell = F.lit(0)
    for k in range(parts):
        part = F.shiftrightunsigned("fp", 64 - width * (k + 1)).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        cell = cell * (width + 1) + F.bit_count(part).cast("int")
    return cell.cast("int")


def _groups(counts: dict[int, int], parts: int, size: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(cell, its first group, its number of groups) of each cell, and each group's least and greatest counts by part.

    Cells that differ in the last part only share a group as long as they have ``size`` fingerprints
    together; a larger cell is divided.
    """
    base = 64 // parts + 1
    digits = lambda cell: [cell // base**k % base for k in reversed(range(parts))]
    cells, low, high = [], [], []
    prefix, held = None, 0
    for cell in sorted(counts):
        n, d = counts[cell], digits(cell)
        if cells and prefix == d[:-1] and held + n <= size:
            held += n
            high[-1] = d
            cells.append((cell, len(low) - 1, 1))
            continue
        divided = max(1, -(-n // size))
        cells.append((cell, len(low), divided))
        low += [d] * divided
        high += [d] * divided
        prefix, held = (d[:-1], n) if divided == 1 else (None, 0)
    return cells, np.array(low, np.int64).reshape(-1, parts), np.array(high, np.int64).reshape(-1, parts)


def _reach(low: np.ndarray, high: np.ndarray, radius: int):
    """For each group the groups whose counts lie within reach, itself included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                gap = np.maximum(np.maximum(low - high[g], low[g] - high), 0).sum(axis=1)
                others = np.flatnonzero(gap <= radius).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), g, np.int32)), pa.array(others)], names=["g", "other"])

    return run


def _units(distinct: DataFrame, radius: int, group: int, parts: int | None) -> DataFrame | None:
    """The rows of ``distinct``, each once for every pair of groups (ga, gb) in which it is compared; None without rows.

    Few fingerprints are grouped by the population count of the whole, more by those of halves or
    quarters: the sum of the parts' differences bounds the distance from below, and finer parts rule
    out more pairs of groups.
    """
    spark = distinct.sparkSession
    bounded_batches(spark)
    total = distinct.count()
    if not total:
        return None
    parts = parts or (1 if total < 16 * group else 2 if total < 64 * group else 4)
    size = min(group, -(-total // LEAST_GROUPS))
    counts = dict(distinct.groupBy(_cell(parts).alias("cell")).count().collect())  # 65, 33^2 or 17^4 rows at most
    cells, low, high = _groups(counts, parts, size)
    placed = spark.createDataFrame(cells, "cell int, first int, divided int")
    # the pairs of groups grow with the square of their number, so they are made and joined by the tasks
    near = map_arrow(spark.range(0, len(low), 1, min(len(low), shuffle_partitions(spark))), _reach(low, high, radius), "g int, other int")
    dealt = distinct.withColumn("cell", _cell(parts)).join(F.broadcast(placed), "cell").withColumn("g", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("divided"))).cast("int"))
    dealt = dealt.drop("cell", "first", "divided").join(near, "g").withColumn("ga", F.least("g", "other")).withColumn("gb", F.greatest("g", "other")).drop("other")
    # a unit is much work on few bytes, so the units are spread by number, not put together by size
    return dealt.repartition(shuffle_partitions(spark), "ga", "gb")


def links(distinct: DataFrame, radius: int = RADIUS, group: int = GROUP, parts: int | None = None) -> DataFrame:
    """(u, v): spanning links of the distinct fingerprints ``fp`` within ``radius`` bits."""
    units = _units(distinct.select("fp"), radius, group, parts)
    if units is None:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    return units.groupBy("ga", "gb").applyInArrow(_unit(radius, ["fp"], "fp"), "u long, v long")


def near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id, root) of every row of ``docs``.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest id reachable and
    root the component's own fingerprint key.  Texts without words have fingerprint zero and are
    linked like any other; repeated rows give a row each; a null id is never the smallest unless
    its component has no other; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, radius))
    rooted = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.select("fp", "root").join(smallest, "root"), "classes")
    return prints.join(classes, "fp").select(F.col("id").alias("doc_id"), F.col("h").alias("text_hash"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def similar_links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, wide: int = WIDE, text_col: str = "text", group: int = GROUP, most_shingles: int = MOST_SHINGLES) -> DataFrame | None:
    """(u, v): spanning links of the ``nodes`` (fp, fp2, node) that are similar; None if no two are candidates.

    node is the hash of a text with these fingerprints.
    """
    units = _units(nodes.select("fp", "fp2", "node"), wide, group, None)
    if units is None:
        return None
    near = materialize(units.groupBy("ga", "gb").applyInArrow(_unit(wide, ["fp", "fp2"], "node"), "u long, v long"), "candidates")
    if near.isEmpty():
        return None
    members = materialize(components(near).withColumnRenamed("root", "comp"), "members")
    sets = shingle_sets(docs, members.select(F.col("node").alias("h")), shingle, text_col)
    rows = nodes.select("fp", "fp2", "node").join(members, "node").join(sets.withColumnRenamed("h", "node"), "node")
    rows = materialize(rows, "candidate-sets")
    weights = rows.groupBy("comp").agg(F.sum(F.size("shingles") + 1).alias("w")).select("comp", F.ceil(F.col("w") / most_shingles).cast("int").alias("parts"))
    # a component too large for a task meets itself part by part
    dealt = rows.join(weights, "comp").withColumn("s", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("comp", F.least("s", "o").alias("sa"), F.greatest("s", "o").alias("sb"), "s", "node", "fp", "fp2", "shingles")
    streams = dealt.repartition(shuffle_partitions(docs.sparkSession), "comp", "sa", "sb").sortWithinPartitions("comp", "sa", "sb")
    return map_arrow(streams, _similar(similarity, wide), "u long, v long")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one with the smallest id, then the smallest text hash.

    Null and empty texts, and those without words, are copies of each other; a null id comes last;
    of rows that repeat in id and text the one whose other columns have the least hash stays; an
    empty table gives no rows; other columns stay as they are, under whatever names.  Texts whose
    128 bits agree count as copies without a look at their shingles.
    """
    prints = materialize(fingerprints(docs, shingle, id_col=id_col, text_col=text_col, words=2, distinct=True), "fingerprints")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    nodes = materialize(prints.groupBy("fp", "fp2").agg(F.min("h").alias("node"), F.min(row).alias("least")), "nodes")
    least, links_ = nodes.select("node", "least"), similar_links(docs, nodes, similarity, shingle, text_col=text_col, group=group, most_shingles=most_shingles)
    if links_ is not None:
        least = least.join(components(links_), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    p = unused(docs)
    kept = materialize(least.select(F.col("least.id").alias(f"{p}id"), F.col("least.h").alias(f"{p}kept")), "kept")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}kept"))
    hashed = docs.withColumn(f"{p}hash", text_hash(text_col))
    return one_each(hashed.join(kept, same, "left_semi"), [id_col, f"{p}hash"]).drop(f"{p}hash")
