"""The pipeline's near copies against brute-force similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from brute import components
from quern.llm import simhash


def corpus():
    """Pairs on both sides of the limit, one large group of variants, a chain, copies, empty and short texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(60):
        base = [word() for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), k % 12):
            other[at] = word()
        texts += [" ".join(base), " ".join(other)]
    base = [word() for _ in range(200)]
    for _ in range(60):
        other = list(base)
        for at in rng.sample(range(200), 2):
            other[at] = word()
        texts.append(" ".join(other))
    chain = [word() for _ in range(200)]
    for k in range(30):
        chain[7 * k % 200] = word()
        chain[(7 * k + 3) % 200] = word()
        texts.append(" ".join(chain))
    return [*texts, *texts[:5], "", "  \n", "one two", "One  two", "one three"]


def test_stage_keeps_one_of_each_component(spark):
    texts = corpus()
    want = {min(i for i, r in enumerate(root) if r == c) for root in [components(texts)] for c in root}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect())
    assert got == sorted(want)


def test_odd(odd, odd_rows, empty, clashing, unharmed, same_rows):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r[1] or "" for r in odd_rows]
    assert kept.count() == len(set(components(texts)))
    assert simhash.keep_one(empty).count() == 0
    assert same_rows(unharmed(simhash.keep_one(clashing)), kept)


def test_real_documents(documents):
    rows = sorted((r.doc_id, r.text or "") for r in documents.collect() if r.doc_id is not None)
    root = components([t for _, t in rows])
    assert simhash.keep_one(documents.filter("doc_id is not null")).count() == len(set(root))


def test_small_groups(spark):
    """Groups of a few fingerprints, and components divided into parts of a few texts, keep the same rows."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    key = lambda df: sorted(r.doc_id for r in df.collect())
    assert key(simhash.keep_one(docs, group=20, most_shingles=1500)) == key(simhash.keep_one(docs))


def test_similar_forest():
    """The components of pairs that are near and similar, by brute force, within one side and between two."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (20, 2), dtype=np.uint64)
    fp = np.repeat(base, 15, axis=0)
    for _ in range(6):
        fp[np.arange(300), rng.integers(0, 2, 300)] ^= np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)
    sets = [np.unique(rng.choice(np.arange(30 * (i // 15), 30 * (i // 15) + 30, dtype=np.uint64), rng.integers(20, 31))) for i in range(300)]
    sets[7] = np.empty(0, np.uint64)
    ends, values = np.cumsum([len(x) for x in sets]), np.concatenate(sets)
    every = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    side = rng.integers(0, 2, 300)
    for within in (True, False):
        root = list(range(300))
        for i in range(300):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if every[i, j] <= 12 and common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) and (within or side[i] != side[j]):
                    old, new = root[i], root[j]
                    root = [new if r == old else r for r in root]
        u, v = simhash.similar_forest(fp, values, ends, side, within, 0.8, 12)
        parent = dict(zip(u.tolist(), v.tolist(), strict=True))
        top = [parent.get(i, i) for i in range(300)]
        assert len(set(top)) == len(set(root)) and len(set(zip(top, root, strict=True))) == len(set(root)) < 300


def test_fingerprint_words():
    """Both words against counts of bits; a long text is counted in parts."""
    text = " ".join(f"w{k % 977}" for k in range(3000))
    old, simhash.AT_ONCE = simhash.AT_ONCE, 700
    small = simhash.fingerprint_block(["", "one two", text, text + " x", "One  two"], 5, 42, 2, True)
    simhash.AT_ONCE = old
    assert (small == simhash.fingerprint_block(["", "one two", text, text + " x", "One  two"], 5, 42, 2, True)).all()
    assert not small[0].any() and (small[1] == small[4]).all()
