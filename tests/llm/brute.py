"""Brute-force versions that several tests share."""

import re


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def places(rows, least=50):
    """Documents in order, and for each the words in passages of ``least`` words that stand at an earlier place, not overlapping it."""
    docs = sorted({(d is None, d or 0, th, t) for d, t, th in rows}, key=lambda r: r[:3])
    first, gone = {}, []
    for order, (*_, text) in enumerate(docs):
        words, cut = (text or "").split(), set()
        for a in range(len(words) - least + 1):
            key = tuple(words[a : a + least])
            if key not in first:
                first[key] = (order, a)
            elif first[key][0] < order or a - first[key][1] >= least:
                cut.update(range(a, a + least))
        gone.append(cut)
    return [(None if none else d, t) for none, d, _, t in docs], gone


def without(text, cut):
    """``text`` without the words numbered in ``cut``: of the white space around a cut, what has a line break, else what is before it."""
    if text is None or not cut:
        return text
    out, before = "", None
    for k, m in enumerate(re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)):
        word = m[0].lstrip(" \t\n\x0b\f\r")
        space = m[0][: len(m[0]) - len(word)]
        if k in cut:
            if before is None:
                before = (k, space)
            continue
        if before is not None:
            space = space if before[0] > 0 and "\n" in space else before[1]
            before = None
        out += space + word
    return out
