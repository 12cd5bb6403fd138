"""Pre-tokens of the word-level BPE file and ids of each distinct pre-token, as the tokenizers library has them."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: The split pattern of the vocabulary file, once per character class.
#: For Latin-1 texts the classes are written out; in general they are Unicode's.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t-\r\x85\xa0a-zA-ZªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+")
GENERAL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose class, lower case and composed form no Unicode version has changed.
UNSETTLED = re.compile("[^\u0000-ɏ‐-‧€]")
#: Fixed value: what the vocabulary puts behind a pre-token's last piece.
END = "</w>"
#: Pre-tokens that are encoded in one call; a worker forgets what it knows beyond KNOWN of them.
TOGETHER, KNOWN = 128, 500_000


class WordPieces:
    """Pre-tokens of texts, and piece counts or ids of pre-tokens, under one vocabulary file.

    Strings of special tokens inside a text become that token, as is the library's default; they
    stand among the pre-tokens as themselves, behind a blank (no pre-token contains white space).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in json.loads(self.whole.to_str())["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        bare = Tokenizer.from_file(path)  # the same merges without normaliser and split: pre-tokens go in as they are, many at once
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        bare.encode_special_tokens = True
        self.bare = bare
        vocabulary = bare.get_vocab(with_added_tokens=False)
        #: Whether an id ends its pre-token, as the vocabulary marks it.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(END)]] = True

    def _plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return LATIN.findall(text.lower())
        except UnicodeEncodeError:
            pass
        if UNSETTLED.search(text):
            text = self.whole.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return GENERAL.findall(text.lower())

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text in order."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out: list[str] = []
        at = 0
        for m in self.cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens on end, ids of each)."""
        plain = [w for w in words if w[0] != " "]
        joined = [" ".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
        got = [np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(got) if got else np.empty(0, np.int32)
        size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        if len(size) != len(plain):
            raise ValueError("a pre-token without an end")
        if len(plain) < len(words):
            special = [k for k, w in enumerate(words) if w[0] == " "]
            at = np.array(special) - np.arange(len(special))
            flat = np.insert(flat, np.concatenate(([0], np.cumsum(size)))[at], [self.special[words[k][1:]] for k in special]).astype(np.int32)
            size = np.insert(size, at, 1)
        return flat, size

    def counts(self, words: list[str]) -> np.ndarray:
        return self.ids(words)[1]


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """One per worker process and file."""
    return WordPieces(path)


def coded(texts: list[str], pieces: WordPieces) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of every pre-token of all texts, pre-tokens per text, the distinct pre-tokens)."""
    flat: list[str] = []
    lengths = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = pieces.split(text)
        lengths[i] = len(words)
        flat += words
    table = pa.array(flat, pa.string()).dictionary_encode()
    return table.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths, table.dictionary.to_pylist()


class Numbers(dict):
    """Numbers of words in the order they are first asked for; ``new`` collects those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Growing:
    """An array that doubles its room when it is full."""

    def __init__(self, kind: type):
        self.room = np.empty(1 << 16, kind)
        self.used = 0

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.used] = self.room[: self.used]
            self.room = room
        self.room[self.used : end] = values
        self.used = end


class Encoder:
    """Ids of whole texts; remembers the ids of pre-tokens it has met, up to a bound."""

    def __init__(self, pieces: WordPieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.flat, self.size, self.start = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, ids per text); ``end`` is put behind each text."""
        if len(self.number) > KNOWN:
            self._forget()
        words: list[str] = []
        lengths = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.pieces.split(text)
            lengths[i] = len(own)
            words += own
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            ids, size = self.pieces.ids(self.number.new)
            self.start.add(self.flat.used + np.cumsum(size) - size)
            self.size.add(size)
            self.flat.add(ids)
            self.number.new = []
        size = self.size.room[which]
        ends = np.cumsum(size)
        ids = self.flat.room[np.repeat(self.start.room[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        ends = np.concatenate(([0], ends))[np.cumsum(lengths)]
        per = np.diff(ends, prepend=0)
        if end is not None:
            ids = np.insert(ids, ends, np.int32(end))
            per = per + 1
        return ids, per


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process, so that its tasks share what it knows."""
    return Encoder(word_pieces(path))
