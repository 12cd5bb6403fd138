"""SimHash, components and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from brute import places, without
from quern.llm import line_dedup, simhash
from quern.llm.common import text_hash
from quern.llm.components import components


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, smallest_reachable([d for d, _ in rows], prints), strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in simhash.near_copies(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_documents(documents):
    assert got(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd(odd, odd_rows, empty, clashing):
    rows = [(r[0], (r[1] or "")[:400_000]) for r in odd_rows]
    assert got(odd) == brute(rows)
    assert got(empty) == []
    assert got(clashing) == got(odd)


def test_forest_links_everything():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = np.array([b ^ np.uint64(1 << int(rng.integers(60))) ^ np.uint64(1 << int(rng.integers(60))) for b in rng.choice(base, 300)], np.uint64)
    values = np.unique(np.concatenate((base, near)))
    half = len(values) // 2
    for a, b in ((values, None), (values[:half], values[half:])):
        u, v = simhash.forest(a[:, None], None if b is None else b[:, None], 4)
        u, v = values[u], values[v]
        assert len(u) < len(values)
        parent = {int(x): int(x) for x in values}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            parent[find(x)] = find(y)
        for i in range(len(values)):
            for j in range(i):
                if b is not None and (i < half) == (j < half):
                    continue
                if (int(values[i]) ^ int(values[j])).bit_count() <= 4:
                    assert find(int(values[i])) == find(int(values[j]))


def test_many_groups(spark):
    """Groups of a few fingerprints each find the same links as one group."""
    rng = random.Random(4)
    values = [rng.getrandbits(63) for _ in range(120)]
    values += [v ^ (1 << rng.randrange(60)) for v in values[:60]]
    df = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")
    roots = lambda size, parts=None: {r.node: r.root for r in components(simhash.links(df, group=size, parts=parts)).collect()}
    whole = roots(10_000)
    assert len(whole) >= 100
    assert roots(8) == roots(8, 2) == roots(8, 4) == roots(1000, 4) == whole


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_cells(spark, parts):
    rng = random.Random(6)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(50)] + [0, -1, 1]
    got = {r.fp: r.cell for r in spark.createDataFrame([(v,) for v in values], "fp long").select("fp", simhash._cell(parts).alias("cell")).collect()}
    base = 64 // parts + 1
    for v in values:
        digits = simhash._parts(np.array([v], np.int64).view(np.uint64), parts)[0].tolist()
        assert got[v] == sum(d * base ** (parts - 1 - k) for k, d in enumerate(digits))


def test_components(spark):
    chain = [(i + 1, i) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (502, 500)]
    df = spark.createDataFrame([*chain, (None, 3)], "u long, v long")
    out = {r.node: r.root for r in components(df).collect()}
    assert out == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 502: 500}
    assert components(df.limit(0)).collect() == []


# passages


def hashed(spark, rows):
    """(id, text, hash of the text), the hash as the operator orders by it."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", text_hash("text"))
    return [tuple(r) for r in df.collect()]


def removed(r):
    return {i for part in r.removed.split(",") if part for i in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}


def held_against_windows(spark, df, rows):
    """Every word that goes is in a repeated window of 50 words; returns how many words of such windows go or are the same as a neighbour, and all of them."""
    docs, gone = places(hashed(spark, rows))
    want = dict(zip(docs, gone, strict=True))
    text_of = {}
    for d, t in rows:
        text_of.setdefault(d, t)
    got = total = 0
    for r in line_dedup.dedup_lines(df, details=True).collect():
        text = text_of[r.doc_id]
        cut = removed(r)
        assert cut <= want[r.doc_id, text] and r.n_removed == len(cut) and r.n_words == len((text or "").split())
        assert r.text == without(text, cut)
        words = (text or "").split()
        missed = want[r.doc_id, text] - cut
        # at the edges of one word said again and again, the selected positions lie further apart
        missed -= {i for i in missed if words[i] in words[max(0, i - 1) : i] + words[i + 1 : i + 2]}
        got, total = got - len(missed) + len(want[r.doc_id, text]) - len(cut), total
        got, total = got + len(cut), total + len(want[r.doc_id, text])
    return got, total


def test_passages_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got, total = held_against_windows(spark, documents, rows)
    assert total > 1000 and got >= 0.99 * total
    chars = {r.doc_id: (r.n_chars, r.text) for r in line_dedup.dedup_lines(documents).collect()}
    assert all(n == len(t) for n, t in chars.values() if t is not None)


def test_passages_anywhere(spark):
    """Passages of more than 50 words go wherever they begin and end, in whatever white space."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (51, 52, 60, 75, 200)]
    rows = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randint(0, 30))] for _ in range(3)]
        inside = [rng.choice(passages) for _ in range(2)]
        words = parts[0] + inside[0] + parts[1] + inside[1] + parts[2]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t", " \n\n"]) for w in words).strip()))
    got, total = held_against_windows(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert got == total > 5000


def test_earlier_parts_of_a_passage(spark):
    """The earliest place may have part of a passage only, or another part of it than others have."""
    rng = random.Random(12)
    p = [f"p{k}" for k in range(120)]
    filler = lambda: [f"f{rng.randrange(10**6)}" for _ in range(12)]
    rows = [(i, " ".join(filler() + p[a : a + n] + filler())) for i, (a, n) in enumerate([(20, 45), (0, 49), (30, 60), (40, 48), (10, 80), (0, 120), (35, 52), (60, 60), (0, 55)])]
    got, total = held_against_windows(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert got >= 0.9 * total > 200


def test_passages_odd(odd, odd_rows, empty, clashing, unharmed, same_rows):
    out = line_dedup.dedup_lines(odd).collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r.text for r in out if r.doc_id is not None}
    assert by[1] is None and by[2] == "" and by[12] == "other\nend" and by[3] == odd_rows[2][1]
    assert by[11] == next(r[1] for r in odd_rows if r[0] == 11)
    assert line_dedup.dedup_lines(empty).collect() == []
    assert same_rows(unharmed(line_dedup.dedup_lines(clashing)), line_dedup.dedup_lines(odd))
    details = {r.doc_id: r for r in line_dedup.dedup_lines(odd, details=True).collect()}
    assert (details[12].n_words, details[12].n_removed, details[12].removed) == (62, 60, "1-60")


def test_winnowing_by_brute_force():
    """Grams are hashed alike wherever they stand; each window's last least hash is selected."""
    rng = np.random.default_rng(9)
    texts = ["", "one two", "  \n", "one", "x" * 3_000_000, " two  one\ttwo\x0b", "é one", *(" ".join(f"{k}" for k in range(n)) for n in (1, 200_000))]
    data = [x.encode() for x in texts]
    hashes, sizes = line_dedup.word_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    words = [w for x in data for w in x.split()]
    assert sizes.tolist() == [len(x.split()) for x in data] and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words))
    assert len(set(hashes.tolist())) > 0.9999 * len(set(words))
    for n in (0, 5, 29, 30, 49, 50, 51, 300):
        words = rng.integers(0, 3, n).astype(np.uint32)
        grams = line_dedup.gram_hashes(words, 30)
        assert len(grams) == max(0, n - 29)
        by = {}
        for i, h in enumerate(grams.tolist()):
            by.setdefault(h, set()).add(tuple(words[i : i + 30].tolist()))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set().union(*by.values())) if by else True
    for n in (0, 20, 21, 22, 500):
        hashes = rng.integers(0, 60, n).astype(np.uint64) << np.uint64(12)
        hashes[1:][hashes[1:] == hashes[:-1]] += np.uint64(7 << 20)
        want = sorted({max(i for i in range(a, a + 21) if hashes[i] == hashes[a : a + 21].min()) for a in range(n - 20)})
        assert line_dedup.selected(hashes, 21).tolist() == want


def test_merged_spans():
    rng = np.random.default_rng(13)
    group, lo = rng.integers(0, 20, 300), rng.integers(0, 400, 300)
    hi = lo + rng.integers(0, 12, 300)
    rows, a, b = line_dedup.merged(group, lo, hi)
    got = sorted(zip(group[rows].tolist(), a.tolist(), b.tolist(), strict=True))
    want = []
    for g in range(20):
        inside = sorted({i for x, y in zip(lo[group == g], hi[group == g], strict=True) for i in range(x, y + 1)})
        for i in inside:
            if want and want[-1][0] == g and want[-1][2] == i - 1:
                want[-1][2] = i
            else:
                want.append([g, i, i])
    assert got == [tuple(x) for x in want]


def test_matches_extend(spark):
    """A match has its whole length and the place it repeats."""
    p = [f"y{j}" for j in range(300)]
    rows = [(1, " ".join(["head", *p])), (2, " ".join([*p[60:220], "tail", *p[:70], "end"])), (3, " ".join(p[120:175]))]
    found = {r.id: [tuple(m) for m in r.matches] for r in line_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {2: [(0, 159, 1, 61), (161, 230, 1, 1)], 3: [(0, 54, 1, 121)]}


def test_passages_many(spark):
    """A million blank lines, a word repeated a million times, and very many cuts take time in proportion."""
    import time

    passage = [" ".join(f"{k}z{j}" for j in range(60)) for k in range(2000)]
    mixed = "\n".join(x for k, y in enumerate(passage) for x in (y, f"own {k}"))
    rows = [(1, passage[0] + "\n" * 1_000_000), (2, "\n".join(passage[1:])), (3, passage[0] + "\n" * 1_000_000 + "end"), (4, mixed), (5, "and " * 1_000_000)]
    began = time.time()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and got[3] == "end"
    assert got[4] == "\n".join(f"own {k}" for k in range(2000))
    assert len(got[5].split()) < 300
