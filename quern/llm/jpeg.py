"""Progressive JPEG files as a media column: lossless payloads in the coefficients, decoded to RGB.

The unit that JPEG keeps without loss is the quantised coefficient, so a payload byte is stored in
one coefficient of an 8x8 block.  The image has three components with chroma at half resolution
(4 + 1 + 1 blocks a unit) and these scans of each component: DC without its last bit, AC 1-5 and
6-63 without their last bits, the last bits of DC, the last bits of AC.

Bytes are shifted so that every magnitude has the same category (AC: 256-511; DC: alternating
offsets that make each difference a 10-bit one), so each Huffman table holds one code of one bit
and each scan's symbols have one width.  Encoder and decoder use that to work on whole arrays of
blocks of many documents.  Streams with other tables go through the general decoder below, symbol
by symbol; both accumulate the same coefficient arrays.

A file holds at most ``PAGE`` bytes of payload; a longer text is a sequence of files, its *pages*, in
one media value, and is worked on page by page.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, keyed_text, map_arrow, materialize

UNIT, PAD, WIDEST = 192, 32, 4095
#: Payload bytes of one file at most: a row of the widest image.
PAGE = WIDEST * 2 * UNIT
FACTORS = ((2, 2), (1, 1), (1, 1))
DC_EVEN, AC_SHIFT, DC_BITS, AC_BITS = 1280, 256, 10, 8
BANDS = ((1, 5), (6, 63))


def _zigzag() -> np.ndarray:
    """Row-major place of the k-th coefficient of a block."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
SCALE = 1 << 12


def _inverse_transform() -> np.ndarray:
    """Coefficients (row-major) times this are samples times SCALE; whole numbers, so sums in doubles are exact in any order."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1)[:, None] / 2
    return np.rint(np.kron(basis, basis) * SCALE)


INVERSE = _inverse_transform()

#: (component, first coefficient, last, high bit, low bit, what) of each scan, in order.
SCANS = [(c, 0, 0, 0, 1, "dc") for c in range(3)] + [(c, a, b, 0, 1, "ac") for a, b in BANDS for c in range(3)] + [(c, 0, 0, 1, 0, "dc_bit") for c in range(3)] + [(c, 1, 63, 1, 0, "ac_bit") for c in range(3)]
WIDTH = {"dc": 1 + DC_BITS, "dc_bit": 1, "ac_bit": 64}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, number: int, symbol: int) -> bytes:
    return bytes([kind << 4 | number, 1, *[0] * 15, symbol])


#: Tables: DC 0 has the category of all differences, AC 0 that of all magnitudes, AC 1 the end of a block.
TABLES = _segment(0xDB, bytes([0, *[1] * 64])) + _segment(0xC4, _one_code(0, 0, DC_BITS) + _one_code(1, 0, AC_BITS) + _one_code(1, 1, 0))


def _head(columns: int, rows: int, n_bytes: int, size: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(FACTORS))
    return b"\xff\xd8" + _segment(0xFE, f"payload {n_bytes} {size}".encode()) + TABLES + _segment(0xC2, frame)


SCAN_HEADS = [_segment(0xDA, bytes([1, c + 1, what == "ac_bit", a, b, hi << 4 | lo])) for c, a, b, hi, lo, what in SCANS]


def _grid(size: int) -> tuple[int, int]:
    """Columns and rows of units of 384 bytes."""
    units = -(-size // 384)
    columns = min(units, WIDEST)
    return columns, -(-units // columns)


def _parts(units: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """First block of each document, and for each component the blocks of all documents on end."""
    first = np.cumsum(6 * units) - 6 * units
    return first, [np.repeat(first + (0, 4, 5)[c] * units, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for c, n in ((c, units * (4, 1, 1)[c]) for c in range(3))]


def encode_batch(texts: list[bytes]) -> list[bytes]:
    """A JPEG file of each text, blanks behind it up to a multiple of UNIT bytes."""
    sizes = [max(UNIT, -(-len(t) // UNIT) * UNIT) for t in texts]
    grids = [_grid(s) for s in sizes]
    units = np.array([c * r for c, r in grids], np.int64)
    blocks = np.frombuffer(b"".join(t.ljust(384 * int(u), bytes([PAD])) for t, u in zip(texts, units, strict=True)), np.uint8).reshape(-1, 64)
    _, parts = _parts(units)
    files = [[_head(c, r, len(t), s)] for (c, r), t, s in zip(grids, texts, sizes, strict=True)]
    for (c, a, b, _, _, what), head in zip(SCANS, SCAN_HEADS, strict=True):
        own = blocks[parts[c]]
        counts = units * (4, 1, 1)[c]
        ends = np.cumsum(counts)
        if what == "dc":
            local = np.arange(len(own)) - np.repeat(ends - counts, counts)
            value = (own[:, 0].astype(np.int32) - np.where(local % 2, 0, DC_EVEN)) >> 1
            diff = value.copy()
            diff[1:] -= np.where(local[1:] == 0, 0, value[:-1])
            code = np.where(diff > 0, diff, diff + (1 << DC_BITS) - 1)
            bits = (code[:, None] >> np.arange(DC_BITS, -1, -1)) & 1
        elif what == "ac":
            bits = np.zeros((len(own), b - a + 1, 1 + AC_BITS), np.uint8)
            bits[:, :, 1:] = np.unpackbits((own[:, a : b + 1, None] >> 1) | 128, axis=2)
        elif what == "dc_bit":
            bits = own[:, :1] & 1
        else:
            bits = own & 1
            bits[:, 0] = 0
        bits = bits.astype(np.uint8, copy=False).reshape(len(own), -1)
        for k, (x, y) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            data = np.packbits(bits[x:y])
            if rest := (y - x) * bits.shape[1] % 8:
                data[-1] |= 0xFF >> rest
            files[k] += [head, data.tobytes().replace(b"\xff", b"\xff\x00")]
    return [b"".join([*x, b"\xff\xd9"]) for x in files]


# reading


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[int, int]]
    start: int
    end: int
    high: int
    low: int
    data: bytes
    codes: dict[tuple[int, int], dict[tuple[int, int], int]]  # the Huffman tables in force: (length, code) -> symbol


@dataclass
class Image:
    height: int = 0
    width: int = 0
    factors: list[tuple[int, int]] = field(default_factory=list)
    quant: list[int] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    def blocks(self, c: int) -> tuple[int, int]:
        """Rows and columns of blocks that component ``c`` has in whole units."""
        most = [max(f[i] for f in self.factors) for i in (0, 1)]
        return -(-self.height // (8 * most[1])) * self.factors[c][1], -(-self.width // (8 * most[0])) * self.factors[c][0]


DATA_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _codes(body: bytes) -> Iterator[tuple[tuple[int, int], dict[tuple[int, int], int]]]:
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        symbols, table, code, k = body[at + 17 : at + 17 + sum(counts)], {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        yield (kind >> 4, kind & 15), table
        at += 17 + sum(counts)


def parse(file: bytes) -> Image:
    """The segments of a progressive JPEG file."""
    image, codes, at, ids = Image(), {}, 2, []
    while True:
        marker = file[at + 1]
        if marker == 0xD9:
            return image
        size = int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            codes = codes | dict(_codes(body))
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            ids, image.factors, image.quant = [p[0] for p in parts], [(p[1] >> 4, p[1] & 15) for p in parts], [p[2] for p in parts]
        elif marker == 0xDA:
            n = body[0]
            stop = DATA_END.search(file, at).start()
            image.scans.append(Scan([ids.index(body[1 + 2 * k]) for k in range(n)], [(body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)], body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, file[at:stop], codes))
            at = stop
        elif marker in (0xC0, 0xC1, 0xC3, 0xDD):
            raise ValueError("only progressive files without restart intervals are read")


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def get(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = 2 * value + self.bits[self.at]
            self.at += 1
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = 2 * code + self.get(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        value = self.get(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def accumulate(image: Image) -> list[np.ndarray]:
    """Coefficients (blocks in raster order, zigzag) of each component, scan by scan, symbol by symbol."""
    shape = [image.blocks(c) for c in range(len(image.factors))]
    coefficients = [np.zeros((r * c, 64), np.int64) for r, c in shape]
    most = [max(f[i] for f in image.factors) for i in (0, 1)]
    for scan in image.scans:
        bits, run, before = _Bits(scan.data), 0, [0] * len(image.factors)
        if len(scan.components) > 1:
            v, h = shape[0][0] // image.factors[0][1], shape[0][1] // image.factors[0][0]
            order = [(k, c, (y * image.factors[c][1] + dy) * shape[c][1] + x * image.factors[c][0] + dx) for y in range(v) for x in range(h) for k, c in enumerate(scan.components) for dy in range(image.factors[c][1]) for dx in range(image.factors[c][0])]
        else:
            c = scan.components[0]
            rows, cols = -(-image.height * image.factors[c][1] // (8 * most[1])), -(-image.width * image.factors[c][0] // (8 * most[0]))
            order = [(0, c, y * shape[c][1] + x) for y in range(rows) for x in range(cols)]
        for k, c, b in order:
            block = coefficients[c][b]
            if scan.start == 0:
                if scan.high:
                    block[0] |= bits.get(1) << scan.low
                else:
                    before[c] += bits.signed(bits.symbol(scan.codes[0, scan.tables[k][0]]))
                    block[0] = before[c] << scan.low
                continue
            run = _ac(bits, scan, scan.codes[1, scan.tables[k][1]], block, run)
    return coefficients


def _ac(bits: _Bits, scan: Scan, table: dict[tuple[int, int], int], block: np.ndarray, run: int) -> int:
    """One block of an AC scan; returns how many further blocks end at once."""
    k, step = scan.start, 1 << scan.low

    def correct(at: int) -> None:
        if bits.get(1) and not abs(int(block[at])) & step:
            block[at] += step if block[at] > 0 else -step

    if not run:
        while k <= scan.end:
            rs = bits.symbol(table)
            zeros, size = rs >> 4, rs & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.get(zeros)
                break
            if not scan.high:
                k += zeros
                if size:
                    block[k] = bits.signed(size) << scan.low
                k += 1
                continue
            new = (step if bits.get(1) else -step) if size else 0
            while k <= scan.end:
                if block[k]:
                    correct(k)
                elif not zeros:
                    break
                else:
                    zeros -= 1
                k += 1
            if size and k <= scan.end:
                block[k] = new
            k += 1
    if run:
        if scan.high:
            for at in range(k, scan.end + 1):
                if block[at]:
                    correct(at)
        run -= 1
    return run


def _uniform(image: Image) -> bool:
    """Whether the file has this module's scans and tables, so that all widths are known."""
    if tuple(image.factors) != FACTORS or len(image.scans) != len(SCANS) or image.height % 16 or image.width % 16:
        return False
    for scan, (c, a, b, hi, lo, what) in zip(image.scans, SCANS, strict=True):
        if (scan.components, scan.start, scan.end, scan.high, scan.low) != ([c], a, b, hi, lo):
            return False
        kind, symbol = {"dc": ((0, scan.tables[0][0]), DC_BITS), "ac": ((1, scan.tables[0][1]), AC_BITS), "ac_bit": ((1, scan.tables[0][1]), 0)}.get(what, (None, 0))
        if kind and scan.codes.get(kind) != {(1, 0): symbol}:
            return False
    return True


def accumulate_batch(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of all images' blocks, components on end; units of each image)."""
    units = np.array([i.height * i.width // 256 for i in images], np.int64)
    _, parts = _parts(units)
    out = np.zeros((int(6 * units.sum()), 64), np.int16)
    special = {k: accumulate(i) for k, i in enumerate(images) if not _uniform(i)}
    plain = [k for k in range(len(images)) if k not in special]
    for n, (c, a, b, _, lo, what) in enumerate(SCANS):
        width = WIDTH.get(what, (b - a + 1) * (1 + AC_BITS))
        share = (4, 1, 1)[c]
        own = units * share
        rows = parts[c] if not special else parts[c][np.repeat(~np.isin(np.arange(len(images)), list(special)), own)]
        if not len(rows):
            continue
        bits = np.concatenate([np.unpackbits(np.frombuffer(images[k].scans[n].data.replace(b"\xff\x00", b"\xff"), np.uint8), count=int(own[k]) * width) for k in plain]).reshape(len(rows), width)
        if what == "ac":
            bits = bits.reshape(len(rows), b - a + 1, 1 + AC_BITS)
            if bits[:, :, 0].any():
                raise ValueError("no such code")
            size = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int16)
            out[rows, a : b + 1] = np.where(size >> (AC_BITS - 1), size, size - (1 << AC_BITS) + 1) << lo
        elif what == "ac_bit":
            if bits[:, 0].any():
                raise ValueError("no such code")
            old = out[rows, 1:]
            out[rows, 1:] = old + np.sign(old) * bits[:, 1:]
        elif what == "dc_bit":
            out[rows, 0] |= bits[:, 0].astype(np.int16) << lo
        else:
            if bits[:, 0].any():
                raise ValueError("no such code")
            code = bits[:, 1:].astype(np.int64) @ (1 << np.arange(DC_BITS - 1, -1, -1))
            diff = np.where(code >> (DC_BITS - 1), code, code - (1 << DC_BITS) + 1)
            value, counts = np.cumsum(diff), own[plain]
            first = np.cumsum(counts) - counts
            value -= np.repeat(np.where(first > 0, value[first - 1], 0), counts)
            out[rows, 0] = value << lo
    for k, coefficients in special.items():
        at = int(6 * units[:k].sum())
        for c in range(3):
            out[at : at + len(coefficients[c])] = coefficients[c]
            at += len(coefficients[c])
    return out, units


def payloads(coefficients: np.ndarray, units: np.ndarray, sizes: list[int]) -> list[bytes]:
    """The bytes that the blocks hold, ``sizes`` of each image."""
    first, parts = _parts(units)
    value = coefficients - AC_SHIFT
    for c in range(3):
        counts = units * (4, 1, 1)[c]
        local = np.arange(len(parts[c])) - np.repeat(np.cumsum(counts) - counts, counts)
        value[parts[c], 0] = coefficients[parts[c], 0] + np.where(local % 2, 0, DC_EVEN)
    if value.size and not 0 <= value.min() <= value.max() <= 255:
        raise ValueError("the coefficients hold no payload")
    flat = value.astype(np.uint8)
    return [flat[a : a + 6 * u].tobytes()[:s] for a, u, s in zip(first.tolist(), units.tolist(), sizes, strict=True)]


def rgb_blocks(coefficients: np.ndarray, units: np.ndarray, grids: list[tuple[int, int]]) -> np.ndarray:
    """Red, green and blue of each luma block's 8x8 samples, (blocks, 8, 8, 3): inverse transform, chroma upsampled, colours."""
    _, parts = _parts(units)
    natural = np.empty(coefficients.shape)
    natural[:, ZIGZAG] = coefficients
    samples = np.clip(np.floor((natural @ INVERSE + SCALE / 2) / SCALE) + 128, 0, 255).astype(np.int32)
    luma = samples[parts[0]].reshape(-1, 8, 8)
    # the chroma block over each luma block, and the quarter of it
    columns = np.repeat(np.array([2 * c for c, _ in grids]), 4 * units)
    local = np.arange(len(luma)) - np.repeat(np.cumsum(4 * units) - 4 * units, 4 * units)
    y, x = local // columns, local % columns
    over = np.repeat(np.cumsum(units) - units, 4 * units) + (y // 2) * (columns // 2) + x // 2
    rows, cols = (y % 2 * 4)[:, None] + np.arange(8) // 2, (x % 2 * 4)[:, None] + np.arange(8) // 2
    cb, cr = (samples[parts[c]].reshape(-1, 8, 8)[over[:, None, None], rows[:, :, None], cols[:, None, :]] - 128 for c in (1, 2))
    half = 1 << 15
    red = luma + ((91881 * cr + half) >> 16)
    green = luma - ((22554 * cb + 46802 * cr + half) >> 16)
    blue = luma + ((116130 * cb + half) >> 16)
    return np.clip(np.stack((red, green, blue), axis=-1), 0, 255).astype(np.uint8)


def tensors(blocks: np.ndarray, grids: list[tuple[int, int]]) -> Iterator[np.ndarray]:
    """(height, width, 3) of each image."""
    at = 0
    for c, r in grids:
        own = blocks[at : at + 4 * c * r].reshape(2 * r, 2 * c, 8, 8, 3)
        yield own.transpose(0, 2, 1, 3, 4).reshape(16 * r, 16 * c, 3)
        at += 4 * c * r


@dataclass
class Decoded:
    n_bytes: list[int]
    payload: list[bytes]
    grids: list[tuple[int, int]]
    units: np.ndarray
    blocks: np.ndarray


def decode_batch(files: list[bytes]) -> Decoded:
    images = [parse(f) for f in files]
    coefficients, units = accumulate_batch(images)
    counts = [tuple(map(int, i.comment.split()[1:3])) for i in images]
    grids = [(i.width // 16, i.height // 16) for i in images]
    return Decoded([n for n, _ in counts], payloads(coefficients, units, [s for _, s in counts]), grids, units, rgb_blocks(coefficients, units, grids))


# pages

#: Bytes of files or texts that are worked on at once.
AT_ONCE = 1_000_000
#: An image ends at a marker that entropy-coded data cannot hold.
IMAGE_END = re.compile(rb"\xff\xd9(?=\xff\xd8\xff|\Z)")


def _taken(items: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """Items in lists of about AT_ONCE bytes."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for item in items:
        if held and size + len(item[1]) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    if held:
        yield held


def _text_pages(texts: list) -> Iterator[tuple[int, bytes]]:
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t)), PAGE):
            yield i, bytes(t[k : k + PAGE])


def _files(media: list) -> Iterator[tuple[int, bytes]]:
    for i, m in enumerate(media):
        at = 0
        while at < len(m):
            end = IMAGE_END.search(m, at).end()
            yield i, bytes(m[at:end])
            at = end


def _buffers(column: pa.Array | pa.ChunkedArray) -> list[memoryview]:
    """The bytes of each value, not copied."""
    return [memoryview(v.as_buffer()) for v in column.cast(pa.binary())]


# columns


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in blocks_of(batches, "text", AT_ONCE):
        table = pa.Table.from_batches(held)
        texts = _buffers(table.column("text"))
        files: list[list[bytes]] = [[] for _ in texts]
        for pages in _taken(_text_pages(texts)):
            for (i, _), file in zip(pages, encode_batch([t for _, t in pages]), strict=True):
                files[i].append(file)
        yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array([f[0] if len(f) == 1 else b"".join(f) for f in files], pa.binary())], names=["doc_id", "media"])


TENSORS = "doc_id long, page int, pages int, height int, width int, rgb binary, payload binary, n_bytes long, media_bytes long, media_sha256 string"


def _tensors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in blocks_of(batches, "media", AT_ONCE):
        table = pa.Table.from_batches(held)
        media, ids = _buffers(table.column("media")), table.column("doc_id").to_pylist()
        whole = [(len(m), hashlib.sha256(m).hexdigest()) for m in media]
        pages = [sum(1 for _ in IMAGE_END.finditer(m)) for m in media]
        seen = [0] * len(media)
        for files in _taken(_files(media)):
            got = decode_batch([f for _, f in files])
            out = []
            for (i, _), rgb, (c, r), payload, n in zip(files, tensors(got.blocks, got.grids), got.grids, got.payload, got.n_bytes, strict=True):
                out.append((ids[i], seen[i], pages[i], 16 * r, 16 * c, rgb.tobytes(), payload, n, *whole[i]))
                seen[i] += 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            names = [c.split()[0] for c in TENSORS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed, tail, sums, size, height, n_bytes = hashlib.sha256(), b"", np.zeros(3, np.int64), 0, 0, 0
    for batch in batches:
        out = []
        column = {n: batch.column(n).to_pylist() for n in batch.schema.names if n not in ("rgb", "payload")}
        rgb, payloads_ = _buffers(batch.column("rgb")), _buffers(batch.column("payload"))
        for i in range(batch.num_rows):
            if column["page"][i] == 0:
                hashed, tail, sums, size, height, n_bytes, width = hashlib.sha256(), b"", np.zeros(3, np.int64), 0, 0, 0, column["width"][i]
            hashed.update(payloads_[i])
            tail = (tail + bytes(payloads_[i][-16:]))[-16:]
            sums += np.frombuffer(rgb[i], np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64)
            size, height, n_bytes = size + len(payloads_[i]), height + column["height"][i], n_bytes + column["n_bytes"][i]
            if column["page"][i] == column["pages"][i] - 1:
                out.append((column["doc_id"][i], n_bytes, size, hashed.hexdigest(), zlib.crc32(tail), column["media_bytes"][i], column["media_sha256"][i], f"{width}x{height}:{sums[0]}:{sums[1]}:{sums[2]}"))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media) of every row: progressive JPEG files with the text's bytes in their coefficients.

    Null and empty texts are one unit of blanks; repeated rows give a row each; other columns are
    ignored; an empty table gives no rows; a very long text is a sequence of files.
    """
    return map_arrow(keyed_text(docs, id_col, text_col), _store, "doc_id long, media binary")


def load(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Full-resolution RGB tensors, row-major, a byte a value: a row for each page, the pages of a media value on end.

    Null media give no row; other columns are ignored.
    """
    column: Column = F.col(media_col).cast("binary")
    return map_arrow(media.select(F.col(id_col).cast("long").alias("doc_id"), column.alias("media")).filter(F.col("media").isNotNull()), _tensors, TENSORS)


def features(tensor_rows: DataFrame) -> DataFrame:
    """Digests of the payload and the file, and a feature of what ``load`` returns: size and sum of each colour.

    A map right behind ``load``, so that the pages of a media value come in order.
    """
    return map_arrow(tensor_rows, _digests, DIGESTS)


def write_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``features`` of the tensors of the media column written to and read from the shared folder."""
    return features(load(materialize(store(docs, id_col, text_col), "media")))
