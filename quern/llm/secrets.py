"""Secret scans: single patterns, and multipart credentials linked by an interval join.

Base spans stand for themselves.  Weak candidates (account names, unlabelled keys, endpoints) say
nothing alone; they are reported only where complementary parts co-occur in a scope: the same
paragraph, at most ``RADIUS`` characters apart.  A key needs an identifier, an identifier needs a
secret, an endpoint needs both.  The join of the sorted intervals is a search for the first
interval that ends late enough, so no pairs are made, and all parts of a scope lie in one text, so
nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_text, map_arrow

#: The base patterns.  A run of 12 after AKIA makes 16 characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")

ACCOUNT = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]{3,})""", re.IGNORECASE | re.ASCII)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[+/_=-]*[A-Za-z0-9])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:jdbc:)?[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?(?![\d.])")
WEAK = ("account", "key", "endpoint")
RADIUS = 300
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each base kind, in code points."""
    low = text.lower()
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in WORDS) else [],
        "access": [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


class Intervals:
    """Disjoint intervals, sorted; a semi join asks whether any lies near a given one."""

    def __init__(self, spans: Iterable[Span], walls: list[int]):
        self.spans = sorted(spans)
        self.ends = [b for _, b in self.spans]
        self.walls = walls

    def near(self, span: Span) -> bool:
        a, b = span
        k = bisect_left(self.walls, a)
        low = max(a - RADIUS, self.walls[k - 1] if k else 0)
        high = min(b + RADIUS, self.walls[k] if k < len(self.walls) else b + RADIUS)
        i = bisect_left(self.ends, low + 1)
        while i < len(self.spans) and self.spans[i] == span:
            i += 1
        return i < len(self.spans) and self.spans[i][0] <= high


def _outside(spans: list[Span], taken: Intervals) -> list[Span]:
    """Those that overlap no interval of ``taken``."""
    out = []
    for a, b in spans:
        i = bisect_left(taken.ends, a + 1)
        if i == len(taken.spans) or taken.spans[i][0] >= b:
            out.append((a, b))
    return out


def _merged(spans: Iterable[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def linked_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Weak candidates whose complementary parts lie within their scope."""
    low = text.lower()
    accounts = [m.span() for m in ACCOUNT.finditer(text)] if any(w in low for w in ("user", "login", "account", "client", "access")) else []
    if not accounts and not base["access"]:
        return {}
    walls = [m.start() for m in PARAGRAPH.finditer(text)]
    strong = Intervals(_merged(x for v in base.values() for x in v), walls)
    accounts = _outside(accounts, strong)
    taken = Intervals(_merged([*strong.spans, *accounts]), walls)
    keys = _outside([m.span() for m in KEY.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])], taken)
    identifiers = Intervals(_merged([*base["access"], *accounts]), walls)
    secrets = Intervals(_merged([*base["assign"], *base["hex"], *keys]), walls)
    endpoints = [m.span() for m in ENDPOINT.finditer(text)] if "." in text or "://" in text else []
    return {
        "account": [s for s in accounts if secrets.near(s)],
        "key": [s for s in keys if identifiers.near(s)],
        "endpoint": [s for s in _outside(endpoints, strong) if identifiers.near(s) and secrets.near(s)],
    }


def _joined(found: dict[str, list[Span]]) -> str:
    order = {k: i for i, k in enumerate((*BASE, *WEAK))}
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, order[k], k, b) for k, v in found.items() for a, b in v))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in BASE}
        hashed, spans, linked = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            more = linked_spans(text, base)
            for k in BASE:
                counts[k].append(len(base[k]))
            joined = _joined(base)
            hashed.append(hashlib.sha256(joined.encode()).hexdigest())
            spans.append(_joined(base | more) if more else joined)
            linked.append(sum(map(len, more.values())))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(hashed), pa.array(spans), pa.array(linked, pa.int64())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_linked"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every row.

    spans is kind:start:end by start, then kind, joined by commas.  Null and empty texts have no
    spans; repeated rows give a row each; other columns are ignored; a map without any shuffle.
    """
    return map_arrow(keyed_text(docs, id_col, text_col), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
