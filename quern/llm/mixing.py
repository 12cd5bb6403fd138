"""Mixing sources to target weights, in DataFrame operations only.

Each source's texts form one stream of words, packed into *blocks* of a fixed number of words.  The
mix is a number of output *shards* of ``SHARD_SLOTS`` slots; a slot shows one block.

1. For every shard the numbers of slots that each source gets are a multinomial draw: each slot draws
   a source with the odds of the sources' target slots.  Only the counts (a row per shard and
   source) are kept.
2. Prefix sums of the counts over the shards number each source's slots.  What the draws take beyond a
   source's target is left out, what they leave short of it fills closing shards, so the targets are
   met to the word however few the shards are.
3. The j-th slot of a source shows block perm(j), perm being a pseudorandom permutation of the
   source's block indexes, a new one for each pass over the source; only the last slot of the last
   pass is cut to the word.  Slots are joined with blocks by index, and a document's words come
   from the slots that show its blocks.

Permutations are swap-or-not shuffles: bijections of [0, n) for any n, evaluated per row, so nothing
is sorted and no source is gathered.  Where a document starts in its source's stream comes from
prefix sums in two levels (chunks of a source, then documents in a chunk), so a source with a third
of all documents is spread over as many tasks as it has chunks.  Windows without a partition run
over a row per source only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, one_each, shuffle_partitions, text_hash, unused

BLOCK_WORDS, SHARD_SLOTS, CHUNKS, SEED, ROUNDS = 64, 4096, 1024, 42, 14
#: Equal parts of the odds by which a slot's draw finds its source.
CELLS = 4096
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Fixed value: words are runs of anything but the blank and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def _round(x: Column, r: Column, n: Column, key: Column) -> Column:
    partner = F.pmod(F.xxhash64(key, r, F.lit("k")) - x, n)
    return F.when(F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """The place of ``x`` under a pseudorandom permutation of [0, n) that ``key`` picks."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, x.cast("long"), lambda acc, r: _round(acc, r, n, key))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, h, source, size, chunk, n): one row for each distinct document; n is how often it is repeated."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "h", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.lit(CHUNKS)))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, sid, source_size, weight, target): a row per source, in code-point order, null last.

    The shares are weights of ``share`` times all words; a target stops at ``most`` times its
    source's words and the excess goes to the others by weight.  Sorted by words per weight, the
    sources that stop are a prefix, so one pass finds them.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    every = Window.partitionBy(F.lit(0))
    table = per.withColumn("sid", F.row_number().over(ordered) - 1)
    table = table.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("sid") % len(weights) + 1))
    table = table.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("_cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda c, total: total - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    table = table.withColumn("_level", rest("_cap", F.sum("source_size").over(every) * share) / rest("weight", F.sum("weight").over(every)))
    # the level rises as long as sources stop and falls behind the first that does not
    table = table.withColumn("_rate", F.max("_level").over(every))
    return table.select("source", "sid", "source_size", "weight", F.least(F.col("_cap"), F.col("weight") * F.col("_rate")).alias("target"))


def plan(goals: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Per source with words: blocks, whole passes, words of the last pass, slots, and its first slot."""
    size, length, rest = F.col("source_size"), F.lit(block_words), F.col("rest")
    p = goals.filter("source_size > 0").withColumn("words", F.round("target").cast("long"))
    p = p.withColumn("blocks", F.ceil(size / length).cast("long")).withColumn("short", F.col("blocks") * length - size)
    p = p.withColumn("passes", F.floor(F.col("words") / size).cast("long")).withColumn("rest", F.col("words") - F.col("passes") * size)
    p = p.withColumn("key", F.xxhash64(F.lit(seed), F.col("source")))
    p = p.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64("key", "passes"), inverse=True))
    whole = F.ceil(rest / length).cast("long")
    last = F.when(rest == 0, 0).when(F.col("short_at") < whole, F.least("blocks", F.ceil((rest + F.col("short")) / length))).otherwise(whole)
    p = p.withColumn("slots", F.col("passes") * F.col("blocks") + last)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    return p.withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0))))


def draws(planned: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, sid, drawn): the multinomial draw of each output shard; the last shard may be shorter."""
    spark = planned.sparkSession
    total = planned.agg(F.max("all_slots")).first()[0] or 0
    width = max(1, -(-total // CELLS))
    # each cell lists the sources whose share of the odds reaches into it
    cells = planned.filter("slots > 0").select("sid", F.col("first").alias("lo"), (F.col("first") + F.col("slots")).alias("hi"))
    cells = cells.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    shards = spark.range(0, -(-total // shard_slots), 1, shuffle_partitions(spark)).withColumnRenamed("id", "shard")
    slot = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("shard") * shard_slots) - 1))
    drawn = shards.select("shard", slot.alias("slot")).withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "slot"), F.lit(max(1, total))))
    found = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").filter("u >= lo and u < hi")
    return found.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("drawn"))


def shard_counts(planned: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, sid, n, j): how many slots of each source each output shard has, and the number of the first of them."""
    drawn = materialize(draws(planned, shard_slots, seed), "draws").withColumn("run", F.floor(F.col("shard") / 4096))
    # prefix sums in two levels: runs of shards, then shards in a run
    runs = drawn.groupBy("sid", "run").agg(F.sum("drawn").alias("all"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    here = Window.partitionBy("sid", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("within", F.coalesce(F.sum("drawn").over(here), F.lit(0))).join(runs, ["sid", "run"]).withColumn("j", F.col("base") + F.col("within"))
    goal = planned.select("sid", "slots", F.ceil(F.col("all_slots") / shard_slots).alias("shards"))
    counts = placed.join(goal, "sid").select("shard", "sid", F.least("drawn", F.col("slots") - F.col("j")).alias("n"), "j").filter("n > 0")
    totals = drawn.groupBy("sid").agg(F.sum("drawn").alias("got"))
    short = goal.join(totals, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    short = short.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - F.col("got") - 1) / shard_slots))))
    first = F.col("got") + F.col("k") * shard_slots
    closing = short.select((F.col("shards") + F.col("k")).cast("long").alias("shard"), "sid", F.least(F.lit(shard_slots), F.col("slots") - first).alias("n"), first.alias("j"))
    return counts.unionByName(closing)


def slots(planned: DataFrame, counts: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(shard, slot, sid, j, pass, block, words): the mix, a row per slot of the shards' ``counts``; words is how many of the block it shows."""
    j, b = F.col("j"), F.col("blocks")
    in_shard = Window.partitionBy("shard")
    before = in_shard.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("in_shard", F.sum("n").over(in_shard))
    # a number of partitions of its own: by their bytes, the rows before the explosion would be put into one task
    s = placed.join(planned.drop("first", "slots", "all_slots"), "sid").repartition(shuffle_partitions(planned.sparkSession), "shard", "sid")
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("j", j + F.col("i"))
    s = s.withColumn("pass", F.floor(j / b).cast("long")).withColumn("k", F.pmod(j, b))
    s = s.withColumn("block", permuted(F.col("k"), b, F.xxhash64("key", "pass")))
    slot = permuted(F.col("offset") + F.col("i"), F.col("in_shard"), F.xxhash64(F.lit(seed), "shard"))
    length = F.when(F.col("block") == b - 1, block_words - F.col("short")).otherwise(F.lit(block_words))
    before = F.col("k") * block_words - F.when(F.col("k") > F.col("short_at"), F.col("short")).otherwise(F.lit(0))
    words = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.greatest(F.col("rest") - before, F.lit(0))))
    return s.select("shard", slot.alias("slot"), "sid", "j", "pass", "block", words.cast("long").alias("words"))


def placed(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``sized`` with sid, source_size, target and the document's first word in its source's stream."""
    chunk = sized.groupBy("source", "chunk").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    g = goals.select(F.col("source").alias("_source"), "sid", "source_size", "target")
    chunk = chunk.join(g, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), "sid", "source_size", "target", "base")
    here = Window.partitionBy("source", "chunk").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_within", F.coalesce(F.sum(F.col("size") * F.col("n")).over(here), F.lit(0)))
    rows = rows.join(chunk, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
    return rows.select("doc_id", "h", "source", "size", "n", "sid", "source_size", "target", (F.col("base") + F.col("_within")).alias("first_word"))


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, h, source, copy, sid, block, lo, hi, at): the words [lo, hi) of each block that a copy of a document fills; at is lo's place in the document."""
    r = rows.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    r = r.withColumn("_a", F.col("first_word") + F.col("copy") * F.col("size")).withColumn("_z", F.col("_a") + F.col("size"))
    r = r.withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / block_words), F.floor((F.col("_z") - 1) / block_words))))
    start = F.col("block") * block_words
    lo, hi = F.greatest(F.col("_a") - start, F.lit(0)), F.least(F.col("_z") - start, F.lit(block_words))
    return r.select("doc_id", "h", "source", "copy", "sid", "block", lo.alias("lo"), hi.alias("hi"), (start + lo - F.col("_a")).alias("at"))


class Mix:
    """The mix of ``docs``: ``rows`` (a document each), ``counts`` of the shards, ``slots`` and ``taken`` pieces.

    Null texts and texts without words have size 0 and are never taken; rows repeated in full are so
    many copies of one document; documents without a source form the last source; an empty table
    makes an empty mix; other columns are ignored.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        sized = materialize(sizes(docs, id_col, text_col, source_col, seed), "sizes")
        goals = materialize(targets(sized, weights, share, most), "targets")
        self.rows = materialize(placed(sized, goals), "placed")
        self.plan = materialize(plan(goals, block_words, seed), "plan")
        self.counts = materialize(shard_counts(self.plan, shard_slots, seed), "shard-counts")
        self.slots = slots(self.plan, self.counts, block_words, seed)
        shown = self.slots.select(F.col("sid").alias("_sid"), F.col("block").alias("_block"), "shard", "slot", "pass", "words")
        # Spark takes an exploded table to be as small as its source; none of these sides is, so none may be broadcast
        joined = pieces(self.rows, block_words).join(shown.hint("merge"), (F.col("sid") == F.col("_sid")) & (F.col("block") == F.col("_block")))
        self.taken = joined.filter("words > lo").select("doc_id", "h", "source", "copy", "shard", "slot", "pass", "at", (F.least("hi", "words") - F.col("lo")).alias("words"))

    def per_document(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, first_shard) of every row of the documents; first_shard is the first that shows words of it."""
        took = self.taken.groupBy("doc_id", "h", "source", "copy").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
        took = took.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "h", "source", "copy")), "taken", "first_shard")
        every = self.rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("copy") == F.col("_copy"))
        return every.join(took.hint("merge"), same, "left").select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str | None = "n_chars", shard_col: str | None = None, slot_col: str | None = None, **options) -> DataFrame:
    """``docs`` as mixed: a row for each pass that takes words of a document, with the text it takes.

    A pass that takes the whole document has its text unchanged; otherwise the words taken, joined by
    blanks.  ``shard_col`` and ``slot_col`` name further columns for the first shard and slot that show
    the row's words.  Null texts and texts without words give no row, an empty table none; rows
    repeated in id, text and source are so many copies, whose other columns are those of the row
    whose columns have the least hash; other columns stay as they are, under whatever names.
    """
    mix = Mix(docs, id_col, text_col, source_col, **options)
    p = unused(docs)
    place = [F.min(F.struct("shard", "slot")).alias(f"{p}place")] if shard_col or slot_col else []
    took = mix.taken.groupBy("doc_id", "h", "source", "copy", "pass").agg(F.array_sort(F.collect_list(F.struct("at", F.col("words").alias("n")))).alias(f"{p}parts"), F.sum("words").alias(f"{p}taken"), *place)
    took = took.select(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h"), F.col("source").alias(f"{p}source"), f"{p}parts", f"{p}taken", *([f"{p}place"] if place else []))
    once = one_each(docs.withColumn(f"{p}hash", text_hash(text_col)), [id_col, f"{p}hash", source_col])
    same = F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}hash") == F.col(f"{p}h")) & F.col(source_col).cast("string").eqNullSafe(F.col(f"{p}source"))
    joined = once.join(took.hint("merge"), same).withColumn(f"{p}words", F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)))
    parts = F.transform(f"{p}parts", lambda x: F.array_join(F.slice(F.col(f"{p}words"), (x["at"] + 1).cast("int"), x["n"].cast("int")), " "))
    out = joined.withColumn(f"{p}text", F.when(F.col(f"{p}taken") == F.size(f"{p}words"), F.col(text_col)).otherwise(F.array_join(parts, " ")))
    new = {text_col: F.col(f"{p}text")} | ({count_col: F.length(f"{p}text").cast("long")} if count_col and count_col in docs.columns else {})
    more = [F.col(f"{p}place")[field].alias(name) for field, name in (("shard", shard_col), ("slot", slot_col)) if name]
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns), *more)
