"""Dedup of repeated passages by winnowing: runs of words that occurred before are deleted.

A passage is a run of at least ``min_words`` words, wherever it begins and ends in its lines; white
space between words does not count.  What repeats an earlier place (smaller document id, then text
hash, then word number) is deleted.

1. Every ``GRAM`` consecutive words have a hash.  Of each window of hashes that a passage of
   ``min_words`` words spans, the least one is selected (the last one on ties), so every repeated
   passage has a selected hash in common with its earlier place, at the same words.
2. Selected positions are joined with the earliest place of the same hash; most hashes have one only.
3. A match is extended both ways, word by word, as far as ``min_words - GRAM`` words on each side.
   That tells whether it is long enough, and the next selected position of a longer match lies no
   further away.  No more than these words of an earlier place are sent to its later ones, of which
   there may be any number.
4. Where a match is too short, the earliest place has part of the passage only.  Such positions are
   compared among themselves, by all windows of ``min_words`` words that selected them.
5. Matches equally far apart in both documents become one; what they cover is cut from the text.

Whole copies of a text are found by its hash and cut altogether.  A document takes time in proportion
to its words.  Earliest places are aggregated before each exchange; joins on frequent hashes are
sort-merge joins that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, keyed_text, map_arrow, materialize, text_hash, unused

MIN_WORDS, GRAM, SEED = 50, 25, 9
#: Odd, so that it has an inverse modulo 2^64: a gram's hash is a polynomial of its words' hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

WORDS = "id long, th long, n int, words binary, at array<int>, grams array<long>"
#: Of grams that equal the one before (a word said again and again), one in so many may be selected.
STRIDE = 16
#: A token of the rebuilt text: a word and the white space before it.
TOKEN, SPACE, WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r"^[\x20\x09-\x0D]*", r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    if n > 1:
        out[1:] = base
        out = np.multiply.accumulate(out)
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """The hash (uint64) of every ``gram`` consecutive words along the last axis, words being given by their hashes."""
    size = words.shape[-1]
    n = size - gram + 1
    if n <= 0:
        return np.empty((*words.shape[:-1], 0), np.uint64)
    room = 1 << (size - 1).bit_length()  # few sizes of the tables of powers
    terms = _mixed(words.astype(np.uint64) + np.uint64(1)) * _powers(BASE, room)[:size]
    sums = np.cumsum(terms, axis=-1, dtype=np.uint64)
    runs = sums[..., gram - 1 :].copy()
    runs[..., 1:] -= sums[..., : n - 1]
    return _mixed(runs * _powers(INVERSE, room)[:n])


def selected(hashes: np.ndarray, window: int, valid: np.ndarray | None = None) -> np.ndarray:
    """The positions that winnowing selects: the last least one of each window (of those ``valid`` says, by their starts)."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64)
    most = np.uint64((1 << 64) - 1)
    at = np.arange(n, dtype=np.uint64) & np.uint64(4095)
    # the place in the low bits, later ones smaller, makes a window's least value tell where it is
    value = (hashes & ~np.uint64(4095)) | (np.uint64(4095) - at)
    again = np.zeros(n, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] % np.uint64(STRIDE) != 0)
    value[again] = most
    # the least of each window: up to the end of a block and from the start of the next
    padded = np.concatenate((value, np.full(-n % window, most))).reshape(-1, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()[:n]
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(back[: n - window + 1], ahead[window - 1 :])
    fine = least != most
    if valid is not None:
        fine &= valid
    start = np.flatnonzero(fine)
    place = start + ((4095 - (least[start] & np.uint64(4095)).astype(np.int64) - start) & 4095)
    chosen = np.zeros(n, bool)
    chosen[place] = True
    return np.flatnonzero(chosen)


#: Bytes whose words are hashed at once (one longer word is taken whole).
HASHED = 1 << 20
BYTES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, np.uint64)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text) of texts that lie on end in ``data`` (bytes) between ``bounds``.

    Words are runs of anything but the blank and bytes 9 to 13; a hash is a polynomial of its bytes.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin, last = ~space, ~space
    begin[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = np.flatnonzero(np.diff(bounds))  # words end where texts do
    begin[bounds[full]] = ~space[bounds[full]]
    last[bounds[full + 1] - 1] = ~space[bounds[full + 1] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint32)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, "right")))
        low, high = starts[at], ends[stop - 1]
        room = 1 << int(high - low - 1).bit_length()
        sums = np.cumsum(BYTES[data[low:high]] * _powers(BASE, room)[: high - low], dtype=np.uint64)
        own = sums[ends[at:stop] - low - 1]
        own[1:] -= sums[starts[at + 1 : stop] - low - 1]
        out[at:stop] = _mixed(own * _powers(INVERSE, room)[starts[at:stop] - low]).astype(np.uint32)
        at = stop
    return out, np.diff(np.searchsorted(starts, bounds))


def _texts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, on end, and where each begins and ends."""
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(array.type) else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _words(least: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches, "text", 1_000_000):
            table = pa.Table.from_batches(held)
            hashes, sizes = word_hashes(*_texts(table.column("text")))
            ends = np.cumsum(sizes)
            grams = gram_hashes(hashes, gram)
            # a window lies within one text
            room = np.repeat(ends, sizes) - np.arange(len(hashes))
            at = selected(grams, least - gram + 1, room[: max(0, len(grams) - least + gram)] >= least)
            cuts = np.searchsorted(at, np.concatenate(([0], ends))).astype(np.int32)
            begins = ends - sizes
            local = at - np.repeat(begins, np.diff(cuts))
            short = hashes.astype(np.uint16).tobytes()
            bounds = (2 * np.concatenate(([0], ends))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("id").combine_chunks(),
                    table.column("th").combine_chunks(),
                    pa.array(sizes, pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(short)]),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(local, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams[at].view(np.int64))),
                ],
                names=["id", "th", "n", "words", "at", "grams"],
            )

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)[: len(rows) + 1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The same back: words (uint16), ``width`` a row."""
    if not len(column):
        return np.empty((0, width), np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


AROUND = "h long, id long, th long, at int, back int, ahead int, around binary"


def _around(reach: int, gram: int):
    """Each met position with its gram's words and ``reach`` words on each side, of which ``back`` and ``ahead`` are in the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = batch.column("met")
            each, every = met.offsets.to_numpy(), met.values
            places, hashes = every.field("at").to_numpy().astype(np.int64), every.field("h")
            for k, (i, th, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "th", "words")), strict=True)):
                at, h = places[each[k] : each[k + 1]], hashes[each[k] : each[k + 1]]
                text = np.frombuffer(words, np.uint16)
                padded = np.pad(text, (reach, reach))
                around = padded[at[:, None] + np.arange(2 * reach + gram)]
                n = len(at)
                sides = (np.minimum(at, reach), np.minimum(len(text) - at - gram, reach))
                yield pa.RecordBatch.from_arrays([h, pa.array([i] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(at, pa.int32()), *(pa.array(x, pa.int32()) for x in sides), _binary(around)], names=["h", "id", "th", "at", "back", "ahead", "around"])

    return run


def _agreeing(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words the rows of two matrices have in common from the first on, ``most`` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


TRIED = "h long, id long, th long, at int, first struct<none:boolean,id:long,th:long,at:int>, lo int, hi int, back int, ahead int, around binary"


def _extend(least: int, gram: int):
    """The words [lo, hi] that each position repeats, from its own and its earlier place's words; hi < lo if these are too few."""
    reach, width = least - gram, 2 * least - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = _matrix(batch.column("around"), width), _matrix(batch.column("_around"), width)
            number = lambda c: batch.column(c).to_numpy()
            left = _agreeing(mine[:, :reach][:, ::-1], theirs[:, :reach][:, ::-1], np.minimum(number("back"), number("_back")))
            right = _agreeing(mine[:, reach + gram :], theirs[:, reach + gram :], np.minimum(number("ahead"), number("_ahead")))
            at, long = number("at"), left + gram + right >= least
            lo, hi = np.where(long, at - left, 0), np.where(long, at + gram + right - 1, -1)
            kept = pc.if_else(pa.array(long), pa.scalar(None, pa.binary()), batch.column("around"))  # the others are looked at again
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "id", "th", "at", "first")), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), batch.column("back"), batch.column("ahead"), kept], names=[f.split()[0] for f in ("h", "id", "th", "at", "first", "lo", "hi", "back", "ahead", "around")])

    return run


def _windows(least: int, gram: int):
    """(h, run, id, th, at) of each window around a position that may have selected it; run is its words' hash, at its first word."""
    reach, width = least - gram, 2 * least - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = gram_hashes(_matrix(batch.column("around"), width), least)  # of the windows from each of the words before the gram, and from its own
            number = lambda c: batch.column(c).to_numpy()
            start = np.arange(reach + 1)
            row, column = np.nonzero((start >= reach - number("back")[:, None]) & (start + least <= reach + gram + number("ahead")[:, None]))
            columns = [number("h")[row], runs[row, column].view(np.int64), batch.column("id").take(pa.array(row)), number("th")[row], number("at")[row] - reach + column]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, (*[pa.int64()] * 4, pa.int32()), strict=True)], names=["h", "run", "id", "th", "at"])

    return run


def merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs that the spans of each group cover, in order; row is the span that begins it."""
    order = np.lexsort((hi, lo, group))
    g, a = group[order].astype(np.int64) << 32, lo[order]
    reach = np.maximum.accumulate(g + hi[order])  # of the spans so far, those of earlier groups being lower
    fresh = np.ones(len(order), bool)
    fresh[1:] = g[1:] + a[1:] > np.maximum(reach[:-1], g[1:] - 1) + 1
    fresh[1:] |= g[1:] != g[:-1]
    starts = np.flatnonzero(fresh)
    stops = np.append(starts[1:], len(order)) - 1
    return order[starts], a[starts], (reach - g)[stops[: len(starts)]]


def between(cut: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first word, number of words, first word of the cut before; counted from 1) of the stretches around the cuts.

    The last one is as long as any; the first one has itself for the cut before.
    """
    starts, cuts = [1, *(b + 2 for _, b in cut)], [1, *(a + 1 for a, _ in cut)]
    return [(s, a + 1 - s, c) for s, (a, _), c in zip(starts, cut, cuts)] + [(starts[-1], 1 << 30, cuts[-1])]


SPAN, STRETCH = ([(c, pa.int32()) for c in names] for names in (("lo", "hi"), ("at", "n", "cut")))
MATCHES = "id long, th long, cut array<struct<lo:int,hi:int>>, kept array<struct<at:int,n:int,cut:int>>, matches array<struct<lo:int,hi:int,id:long,word:int>>"


def _lists(owner: np.ndarray, n: int, fields: dict[str, np.ndarray], kinds: list) -> pa.Array:
    """A list of structs for each of ``n`` owners, whose rows are in order."""
    bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(fields[c], t) if isinstance(fields[c], np.ndarray) else fields[c] for c, t in kinds], names=[c for c, _ in kinds]))


def _matches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, spans = batch.num_rows, batch.column("spans")
        owner = np.repeat(np.arange(n), np.diff(spans.offsets.to_numpy()))
        start, stop = spans.offsets[0].as_py(), spans.offsets[-1].as_py()
        every = spans.values.slice(start, stop - start)
        first = every.field("first")
        lo, hi, at, there, th = (x.to_numpy().astype(np.int64) for x in (every.field("lo"), every.field("hi"), every.field("at"), first.field("at"), first.field("th")))
        # spans equally far from the same text's words become one match
        _, place = np.unique(np.column_stack((owner, th, there - at)), axis=0, return_inverse=True)
        rows, a, b = merged(place.ravel(), lo, hi)
        order = np.lexsort((b, a, owner[rows]))
        rows, a, b = rows[order], a[order], b[order]
        ids = first.field("id").take(pa.array(rows))
        matches = _lists(owner[rows], n, {"lo": a, "hi": b, "id": ids, "word": there[rows] - at[rows] + a}, [*SPAN, ("id", pa.int64()), ("word", pa.int32())])
        rows, a, b = merged(owner, lo, hi)
        cut = _lists(owner[rows], n, {"lo": a, "hi": b}, SPAN)
        bounds = np.searchsorted(owner[rows], np.arange(n + 1)).tolist()
        # a whole copy keeps nothing
        copy = np.zeros(n, bool)
        copy[owner[(th == batch.column("th").to_numpy()[owner]) & (lo == 0)]] = True
        runs = list(zip(a.tolist(), b.tolist(), strict=True))
        kept = [[] if copy[k] else [dict(zip(("at", "n", "cut"), x, strict=True)) for x in between(runs[bounds[k] : bounds[k + 1]])] for k in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), cut, pa.array(kept, pa.list_(pa.struct(STRETCH))), matches], names=["id", "th", "cut", "kept", "matches"])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """(id, th, cut, kept, matches) of each document that repeats a passage; th is its text's hash.

    cut holds the words to delete, kept the stretches around them, matches the runs with the id and
    first word of the place they repeat.  Rows repeated in full (id and text) are one document;
    documents of one id are ordered by text hash; null ids come last; null and empty texts have no
    passage.  A place in the same document counts if the passage does not overlap it.
    """
    rows = map_arrow(keyed_text(docs, id_col, text_col, text_hash(text_col).alias("th")), _words(min_words, gram), WORDS)
    words = materialize(rows, "words")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"), F.col("at"))
    # of whole copies of a text only the first is looked into
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    origin = materialize(words.filter(F.col("n") >= min_words).groupBy("th").agg(F.min(own).alias("o")).select(F.col("th").alias("_th"), F.col("o.none").alias("_none"), F.col("o.id").alias("_id")), "origins")
    is_first = F.col("id").eqNullSafe(F.col("_id"))
    picked = words.select("id", "th", "at", "grams").join(origin, F.col("th") == F.col("_th")).filter(is_first).dropDuplicates(["th"])
    chosen = picked.select("id", "th", F.explode(F.arrays_zip("at", F.col("grams").alias("h"))).alias("x")).select("id", "th", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    # written tables on both sides of the joins: what an exchange deals out for a frequent hash can then be split
    chosen = materialize(chosen, "selected")
    shared = materialize(chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "shared-grams")
    met = materialize(chosen.join(shared, "h").select("id", "th", "at", "h"), "met").groupBy("th").agg(F.collect_list(F.struct("at", "h")).alias("met"))
    held = words.select("id", "th", "words").join(origin, F.col("th") == F.col("_th")).filter(is_first).drop("_th", "_none", "_id").join(met, "th").dropDuplicates(["th"])
    positions = materialize(map_arrow(held.select("id", "th", "words", "met"), _around(min_words - gram, gram), AROUND), "positions")
    least = positions.groupBy("h").agg(F.min(F.struct(place.alias("first"), F.col("back").alias("_back"), F.col("ahead").alias("_ahead"), F.col("around").alias("_around"))).alias("x")).select("h", "x.*")
    later = positions.join(materialize(least, "first-places"), "h").filter(place > F.col("first"))
    apart = (F.col("th") != F.col("first.th")) | (F.col("at") - F.col("first.at") >= min_words)
    tried = materialize(map_arrow(later.filter(apart), _extend(min_words, gram), TRIED), "tried")
    unsure = tried.filter("hi < lo").select("h", "id", "th", "at", "back", "ahead", "around")
    windows = materialize(map_arrow(unsure, _windows(min_words, gram), "h long, run long, id long, th long, at int"), "windows")
    earliest = windows.groupBy("h", "run").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").select("h", "run", "first")
    agreed = windows.join(materialize(earliest, "first-windows"), ["h", "run"]).filter((place > F.col("first")) & apart)
    span = F.struct("lo", "hi", "at", "first").alias("s")
    found = tried.filter("hi >= lo").select("id", "th", span)
    found = found.unionByName(agreed.select("id", "th", F.col("at").alias("lo"), (F.col("at") + F.lit(min_words - 1)).cast("int").alias("hi"), "at", "first").select("id", "th", span))
    copies = words.select("id", "th", "n").join(origin, F.col("th") == F.col("_th")).filter(~is_first)
    whole = F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"), F.lit(0).alias("at"), F.struct(F.col("_none").alias("none"), F.col("_id").alias("id"), F.col("th"), F.lit(0).alias("at")).alias("first"))
    # a copy's rows may repeat; its one span is the same in all of them
    found = found.unionByName(copies.select("id", "th", whole.alias("s")).distinct())
    spans = found.groupBy("id", "th").agg(F.collect_list("s").alias("spans"))
    return map_arrow(spans, _matches, MATCHES)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", details: bool = False, gram: int = GRAM) -> DataFrame:
    """``docs`` with later repeated passages deleted from their texts; rows stay, other texts are unchanged.

    Where a passage is cut, the white space before or behind it stays, the one with a line break if
    there is one; white space at the end of a cut text goes.  Null and empty texts stay as they are; rows repeated in id and text are one
    document and are cut alike; a null id comes last; an empty table gives no rows; other columns stay
    as they are, under whatever names.  ``details`` returns (doc_id, n_words, n_removed, removed,
    text) instead; removed is the deleted words as first-last, counted from 0, joined by commas.
    """
    p = unused(docs)
    runs = materialize(repeated_runs(docs, min_words, id_col, text_col, gram), "cut")
    runs = runs.select(F.col("id").alias(f"{p}id"), F.col("th").alias(f"{p}th"), F.col("cut").alias(f"{p}cut"), F.col("kept").alias(f"{p}kept"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}th"))
    # the cuts grow with the documents, so they are never broadcast: the plan is the same at every size
    joined = docs.withColumn(f"{p}hash", text_hash(text_col)).join(runs.hint("merge"), same, "left")
    cut, old = F.col(f"{p}cut"), F.col(text_col).cast("string")
    joined = joined.withColumn(f"{p}tokens", F.when(F.size(f"{p}kept") > 0, F.regexp_extract_all(old, F.lit(TOKEN), F.lit(0))))
    tokens = F.col(f"{p}tokens")

    def stretch(s):
        token = F.get(tokens, s["at"] - 1)
        behind, before = F.regexp_extract(token, SPACE, 0), F.regexp_extract(F.get(tokens, s["cut"] - 1), SPACE, 0)
        space = F.when((s["cut"] > 1) & F.contains(behind, F.lit("\n")), behind).otherwise(before)
        rest = F.slice(tokens, s["at"] + 1, F.greatest(s["n"] - 1, F.lit(0)))
        return F.concat(space, F.regexp_extract(token, WORD, 0), F.array_join(rest, ""))

    pieces = F.transform(F.filter(f"{p}kept", lambda s: (s["n"] > 0) & (s["at"] <= F.size(tokens))), stretch)
    joined = joined.withColumn(f"{p}text", F.when(cut.isNull(), F.col(text_col)).when(F.size(f"{p}kept") == 0, F.lit("")).otherwise(F.array_join(pieces, "")))
    text = F.col(f"{p}text")
    if details:
        removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda n, s: n + s["hi"] - s["lo"] + 1), F.lit(0))
        spans = F.coalesce(F.array_join(F.transform(cut, lambda s: F.concat(s["lo"].cast("string"), F.lit("-"), s["hi"].cast("string"))), ","), F.lit(""))
        n = F.coalesce(F.regexp_count(old, F.lit(WORD)), F.lit(0)).cast("long")
        return joined.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n_words"), removed.cast("long").alias("n_removed"), spans.alias("removed"), text.alias("text"))
    new = {text_col: text} | ({count_col: F.when(cut.isNull(), F.col(count_col)).otherwise(F.length(text).cast("long"))} if count_col and count_col in docs.columns else {})
    return joined.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
