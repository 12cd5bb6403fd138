"""Token counts, byte BPE and token files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import byte_bpe, token_counts, token_files
from quern.llm.common import tokenizer_path
from quern.llm.word_pieces import encoder, word_pieces

WORDS, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(WORDS))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pre_tokens_everywhere(library):
    """Every character below the surrogates, in a context that shows its class."""
    pieces = word_pieces(tokenizer_path(WORDS))
    step = 97
    for low in range(0, 0xD800, step):
        text = "".join(f"a{chr(c)}1{chr(c)}. " for c in range(low, min(low + step, 0xD800)))
        normal = library.normalizer.normalize_str(text)
        assert pieces.split(text) == [normal[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(normal)], hex(low)


def test_counts_odd(odd, odd_rows, library):
    want = sorted(((r[0], len((r[1] or "").encode()), len(ids_of(library, r[1])), len(ids_of(library, r[1])) > 2048) for r in odd_rows), key=repr)
    got = sorted((tuple(r) for r in token_counts.token_counts(odd, block_bytes=1000).collect()), key=repr)
    assert got == want


def test_counts_documents(documents, library):
    for r in token_counts.token_counts(documents, block_bytes=50_000).join(documents, "doc_id").collect():
        assert r.n_tokens == len(ids_of(library, r.text))


def test_counts_edges(empty, clashing, odd, same_rows):
    assert token_counts.token_counts(empty).collect() == []
    assert same_rows(token_counts.token_counts(clashing), token_counts.token_counts(odd))


def test_encoder_forgets(library, monkeypatch):
    from quern.llm import word_pieces as module

    monkeypatch.setattr(module, "KNOWN", 5)
    e = encoder(tokenizer_path(WORDS))
    for text in ("alpha beta gamma delta", "epsilon zeta eta theta iota", "alpha kappa<|endoftext|>", ""):
        ids, per = e.encode([text, text], 2)
        assert ids.tolist() == (ids_of(library, text) + [2]) * 2 and per.sum() == len(ids)


@pytest.fixture(scope="module")
def bpe():
    """Leaves so small that everything is joined."""
    return byte_bpe.ByteBpe(tokenizer_path(RANKS), 16, 8, 5)


def test_every_token_is_its_own_encoding(bpe):
    """What the test of outer pairs rests on."""
    assert all(bpe.library._encode_single_piece(b) == [i] for b, i in bpe.library._mergeable_ranks.items())


def test_joins_equal_library(bpe):
    rng = random.Random(3)
    parts = ["a", "b", "'", "l", "s", " ", "  ", "\n", "1", "é", "!", "ll", "the", "日", "́", " ", "abcdefghijklmnopqrstuvwxyz" * 3, "AAAA"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert bpe.encode(text) == bpe.library.encode_ordinary(text), text
        assert bpe.decode(bpe.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["x" * 5000, " " * 3000 + "y", "ab" * 4000, "'ll" * 500, "日本語" * 700, "a1" * 900, "\n\n  " * 800])
def test_long_runs(bpe, text):
    assert bpe.encode(text) == bpe.library.encode_ordinary(text)


def test_round_trip_odd(odd, odd_rows, bpe):
    want = []
    for r in odd_rows:
        ids = bpe.library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in byte_bpe.round_trip(odd).collect()), key=repr) == sorted(want, key=repr)


def test_encode_decode_columns(odd, odd_rows, empty, clashing):
    encoded = byte_bpe.encode(odd)
    got = sorted(((r.doc_id, bytes(r.bytes).decode()) for r in byte_bpe.decode(encoded).collect()), key=repr)
    assert got == sorted(((r[0], r[1] or "") for r in odd_rows), key=repr)
    assert byte_bpe.encode(empty).collect() == [] and byte_bpe.encode(clashing).count() == len(odd_rows)


def check_files(rows, got, library):
    at = 0
    for row, (doc_id, text) in zip(got, rows, strict=True):
        ids = ids_of(library, text) + [2]
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_documents(documents, library):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    check_files(rows, token_files.checksums(token_files.write_and_read(documents)).orderBy("start").collect(), library)


def test_files_odd(odd, odd_rows, library, empty, clashing, same_rows):
    got = token_files.checksums(token_files.write_and_read(odd)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i or 0))
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(library, r[1])) + 1 for r in odd_rows)
    assert token_files.checksums(token_files.write_and_read(empty)).collect() == []
    assert same_rows(token_files.checksums(token_files.write_and_read(clashing)), token_files.checksums(token_files.write_and_read(odd)))


def test_files_hot_id(spark, library):
    rows = [(5, f"text {k}") for k in range(60)] + [(5, "same")] * 40 + [(None, f"none {k}") for k in range(50)] + [(k, f"own {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = token_files.checksums(token_files.write_and_read(df)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    starts = [0]
    for r in got:
        assert r.start == starts[-1]
        starts.append(r.start + r.n_tokens)
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(library, t)) + 1 for _, t in rows)


def test_point_lookup_prunes(spark, documents, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write(documents, path)
    found = token_files.read(spark, path, [3, 77])
    assert sorted(r.doc_id for r in found.collect()) == [3, 77]
    assert "In(doc_id, [3,77])" in found._jdf.queryExecution().toString()
    whole = {r.doc_id: r.start for r in token_files.read(spark, path).collect()}
    assert {r.doc_id: r.start for r in found.collect()} == {k: whole[k] for k in (3, 77)}
