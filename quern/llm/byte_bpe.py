"""Byte-level BPE as a monoid: encode halves, join neighbours; decode by concatenation.

An element is an encoded stretch of text.  Joining two of them re-encodes a window around the
seam that grows until the tokens outside are proven final:

* *Between pre-tokens.*  The split pattern never puts a boundary-free match across a change from
  letter to non-letter, from digit to non-digit or from non-space to space.  Such a place is a
  boundary whatever stands around it, so tokens before the last such place on the left and behind
  the first one on the right stay as they are.
* *Inside one long pre-token.*  A token sequence is the encoding of its bytes exactly if each
  neighbouring pair is the encoding of the pair's bytes.  The window's outer pairs are tested and
  the failing side doubled.

Decoding is a homomorphism from id lists to bytes: leaves are decoded, results joined up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keyed_text, map_arrow, tokenizer_path

#: Characters in a leaf of the text tree, bytes in a leaf of the pre-token tree, ids in a leaf of the decoding tree.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 512, 1024, 512
FIRST_WINDOW, FIRST_TOKENS = 48, 4

SEAM = regex.compile(r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}|(?<=\S)\s")


class ByteBpe:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, leaf_ids: int = LEAF_IDS):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.size = {i: len(b) for b, i in ranks.items()}
        self.leaf_chars, self.leaf_bytes, self.leaf_ids = leaf_chars, leaf_bytes, leaf_ids

    # encoding

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.library.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a = self._last_seam(text, lo, mid)
        b = self._first_seam(text, mid, hi)
        cut = len(left) - self._tokens(reversed(left), len(text[a:mid].encode()))
        return left[:cut] + self._window(text[a:b]) + right[self._tokens(right, len(text[mid:b].encode())) :]

    @staticmethod
    def _last_seam(text: str, lo: int, mid: int) -> int:
        """The last proven boundary that the left element contains; its start if there is none."""
        width = FIRST_WINDOW
        while True:
            start = max(lo, mid - width)
            found = start
            for m in SEAM.finditer(text[start:mid]):
                found = start + m.start()
            if found > start or start == lo:
                return found
            width *= 2

    @staticmethod
    def _first_seam(text: str, mid: int, hi: int) -> int:
        width = FIRST_WINDOW
        while True:
            stop = min(hi, mid + width)
            if m := SEAM.search(text[mid:stop]):
                return mid + m.start()
            if stop == hi:
                return hi
            width *= 2

    def _tokens(self, ids: Iterable[int], size: int) -> int:
        """How many ids make up ``size`` bytes."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= self.size[i]
            n += 1
        return n

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.library.encode_ordinary(text)
        return [i for m in self.pattern.finditer(text) for i in self._piece(m[0].encode())]

    def _piece(self, piece: bytes) -> list[int]:
        """The encoding of one pre-token, by the same tree over its bytes."""
        if len(piece) <= self.leaf_bytes:
            return self.library._encode_single_piece(piece)
        mid = len(piece) // 2
        left, right = self._piece(piece[:mid]), self._piece(piece[mid:])
        a = b = FIRST_TOKENS
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            head, tail = left[: len(left) - a], right[b:]
            window = self.library._encode_single_piece(self.library.decode_bytes(left[len(left) - a :] + right[:b]))
            left_ok = not head or self._pair(head[-1], window[0])
            right_ok = not tail or self._pair(window[-1], tail[0])
            if left_ok and right_ok:
                return head + window + tail
            a, b = (a if left_ok else 2 * a), (b if right_ok else 2 * b)

    def _pair(self, x: int, y: int) -> bool:
        return self.library._encode_single_piece(self.library.decode_bytes([x, y])) == [x, y]

    # decoding

    def decode(self, ids: list[int]) -> bytes:
        return self._untree(ids, 0, len(ids))

    def _untree(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= self.leaf_ids:
            return self.library.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return self._untree(ids, lo, mid) + self._untree(ids, mid, hi)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _encoded(file: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path(file))
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _digests(file: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path(file))
        for batch in batches:
            n, hashed, back = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                hashed.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(hashed), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decoded(file: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path(file))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([bpe.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return run


DEFAULT = "byte_bpe_multi_50k.tiktoken"


def encode(docs: DataFrame, file: str = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row.

    Null and empty texts have no ids; repeated rows give a row each; other columns are ignored.
    A map without any shuffle, so a lost executor costs its running tasks only.
    """
    return map_arrow(keyed_text(docs, id_col, text_col), _encoded(file), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, file: str = DEFAULT, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) of every row; null ids decode to no bytes."""
    from pyspark.sql import functions as F

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")), _decoded(file), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, file: str = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, keeping digests only."""
    return map_arrow(keyed_text(docs, id_col, text_col), _digests(file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
