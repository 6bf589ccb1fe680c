"""TIFF columns: byte payloads to TIFF files and TIFF files to pages.

``tiff_pages`` walks the image file directories of each file, decodes its
strips or tiles (none, PackBits, LZW, deflate), undoes the horizontal
predictor and emits a row per page.  ``tiff_files`` stores payloads as 8-bit
grey pages, each of a layout and compression by its place in the file.

Null and empty payloads are stored as one padded row.  A null file gives no
page.  A file that can't be read, or a page over ``LARGEST`` samples, gives one
row with page -1 and the reason in ``error``; so does what follows a broken page.  Rows are independent.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField

from quire.llm._arrow import explode_texts, map_texts

#: Payload row, rows of a page, and what pages are stored as, in turn.
WIDTH, PAGE_ROWS = 576, 16
LAYOUTS = (("tile", "deflate", 2), ("strip", "packbits", 1), ("strip", "lzw", 2))
TILE_W, TILE_H, STRIP_ROWS = 192, 16, 8

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
T_WIDTH, T_LENGTH, T_BITS, T_COMPRESSION, T_PHOTOMETRIC = 256, 257, 258, 259, 262
T_STRIP_OFFSETS, T_SAMPLES, T_ROWS_PER_STRIP, T_STRIP_COUNTS, T_PLANAR, T_PREDICTOR = 273, 277, 278, 279, 284, 317
T_TILE_WIDTH, T_TILE_LENGTH, T_TILE_OFFSETS, T_TILE_COUNTS = 322, 323, 324, 325
CLEAR, END = 256, 257
#: The most samples of a page or segment that is read.
LARGEST = 1 << 28
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I"}

_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(to):
        for i in range(at, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out.append(257 - (m.end() - m.start()))
        out += m[1]
        at = m.end()
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits, width changed a code early."""
    bits, held, out = 0, 0, bytearray()
    table: dict[tuple[int, int], int] = {}
    size, following = 9, 258
    bits, held = CLEAR, 9
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        bits, held = bits << size | prefix, held + size
        table[prefix, byte] = following
        following += 1
        prefix = byte
        if following == 4094:
            bits, held = bits << size | CLEAR, held + size
            table.clear()
            size, following = 9, 258
        elif following > (1 << size) - 1 and size < 12:
            size += 1
        if held >= 512:
            keep = held % 8
            out += (bits >> keep).to_bytes(held // 8, "big")
            bits, held = bits & ((1 << keep) - 1), keep
    if prefix >= 0:
        bits, held = bits << size | prefix, held + size
        following += 1
        if following > (1 << size) - 1 and size < 12:
            size += 1
    bits, held = bits << size | END, held + size
    pad = -held % 8
    return bytes(out) + (bits << pad).to_bytes((held + pad) // 8, "big")


def lzw_decode(data: bytes, limit: int) -> bytes:
    out, total = [], 0
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    size, last = 9, b""
    bits = held = at = 0
    while total < limit:
        while held < size:
            if at >= len(data):
                return b"".join(out)
            step = data[at : at + 32]
            bits = (bits & ((1 << held) - 1)) << 8 * len(step) | int.from_bytes(step, "big")
            held, at = held + 8 * len(step), at + 32
        held -= size
        code = bits >> held & ((1 << size) - 1)
        if code == END:
            break
        if code == CLEAR:
            del table[258:]
            size, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out.append(entry)
        total += len(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) >= (1 << size) - 1 and size < 12:
                size += 1
        last = entry
    return b"".join(out)


_PACK = {"none": (NONE, bytes), "deflate": (DEFLATE, lambda b: zlib.compress(b, 1)), "packbits": (PACKBITS, packbits_encode), "lzw": (LZW, lzw_encode)}


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes in a segment")
    return out[:size]


def _segment(block: np.ndarray, pack, predictor: int) -> bytes:
    if predictor == 2:
        block = block.copy()
        block[:, 1:] -= block[:, :-1].copy()
    return pack(block.tobytes())


def encode(payload: bytes, layouts=LAYOUTS) -> bytes:
    """A little-endian TIFF whose pages hold ``payload``, WIDTH bytes a row."""
    if len(payload) % WIDTH:
        raise ValueError("a payload must fill its rows")
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body, link = bytearray(b"II*\0\0\0\0\0"), 4
    for p, top in enumerate(range(0, len(image), PAGE_ROWS)):
        page = image[top : top + PAGE_ROWS]
        kind, name, predictor = layouts[p % len(layouts)]
        number, pack = _PACK[name]
        parts = []
        if kind == "tile":
            rows = -(-len(page) // TILE_H) * TILE_H
            whole = page if rows == len(page) else np.vstack([page, np.zeros((rows - len(page), WIDTH), np.uint8)])
            parts = [_segment(whole[y : y + TILE_H, x : x + TILE_W], pack, predictor) for y in range(0, rows, TILE_H) for x in range(0, WIDTH, TILE_W)]
        else:
            parts = [_segment(page[y : y + STRIP_ROWS], pack, predictor) for y in range(0, len(page), STRIP_ROWS)]
        offsets = []
        for part in parts:
            offsets.append(len(body))
            body += part
            body += b"\0" * (len(body) % 2)
        counts = [len(x) for x in parts]
        tags = {T_WIDTH: (4, [WIDTH]), T_LENGTH: (4, [len(page)]), T_BITS: (3, [8]), T_COMPRESSION: (3, [number]), T_PHOTOMETRIC: (3, [1]), T_SAMPLES: (3, [1]), T_PLANAR: (3, [1]), T_PREDICTOR: (3, [predictor])}
        if kind == "tile":
            tags |= {T_TILE_WIDTH: (3, [TILE_W]), T_TILE_LENGTH: (3, [TILE_H]), T_TILE_OFFSETS: (4, offsets), T_TILE_COUNTS: (4, counts)}
        else:
            tags |= {T_ROWS_PER_STRIP: (4, [STRIP_ROWS]), T_STRIP_OFFSETS: (4, offsets), T_STRIP_COUNTS: (4, counts)}
        entries = []
        for tag, (type_, values) in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}{_CODES[type_]}", *values)
            if len(raw) > 4:
                where, raw = len(body), raw + b"\0" * (len(raw) % 2)
                body += raw
                raw = struct.pack("<I", where)
            entries.append(struct.pack("<HHI", tag, type_, len(values)) + raw.ljust(4, b"\0"))
        body[link : link + 4] = struct.pack("<I", len(body))
        body += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(width, height, samples, compression, interleaved 8-bit samples) of each page, in order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("a directory lies outside the file or in a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * n > len(data):
            raise ValueError("a directory is cut off")
        tags = {}
        for i in range(n):
            tag, type_, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if type_ not in _CODES:
                continue
            size = _SIZES[type_] * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if where + size > len(data):
                raise ValueError(f"tag {tag} points outside the file")
            tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[type_]}", data, where)
        yield _page(data, tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict) -> tuple[int, int, int, int, bytes]:
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    width, height, samples = one(T_WIDTH, 0), one(T_LENGTH, 0), one(T_SAMPLES, 1)
    compression, predictor = one(T_COMPRESSION, NONE), one(T_PREDICTOR, 1)
    if any(b != 8 for b in tags.get(T_BITS, (1,))) or one(T_PLANAR, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only interleaved 8-bit samples can be read")
    tiled = T_TILE_OFFSETS in tags
    offsets, counts = (tags.get(t, ()) for t in ((T_TILE_OFFSETS, T_TILE_COUNTS) if tiled else (T_STRIP_OFFSETS, T_STRIP_COUNTS)))
    w, h = (one(T_TILE_WIDTH, 0), one(T_TILE_LENGTH, 0)) if tiled else (width, min(one(T_ROWS_PER_STRIP, height), height))
    if not (width and height and w and h and samples) or max(width * height, w * h) * samples > LARGEST:
        raise ValueError("a page of no size or too large")
    across = -(-width // w)
    if min(len(offsets), len(counts)) < across * -(-height // h):
        raise ValueError("segments are missing")
    if any(a + n > len(data) for a, n in zip(offsets, counts)):
        raise ValueError("a segment lies outside the file")
    image = np.empty((height, width * samples), np.uint8)
    for i in range(across * -(-height // h)):
        y, x = i // across * h, i % across * w
        rows = h if tiled else min(h, height - y)
        raw = _unpack(data[offsets[i] : offsets[i] + counts[i]], compression, rows * w * samples)
        block = np.frombuffer(raw, np.uint8).reshape(rows, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        block = block[: height - y, : width - x]
        image[y : y + block.shape[0], x * samples : (x + block.shape[1]) * samples] = block.reshape(block.shape[0], -1)
    return width, height, samples, compression, image.tobytes()


def pad(text: str | None) -> tuple[int, bytes]:
    """The text's bytes, filled with 255 to whole rows, at least one; and their number before."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def feature(histogram: np.ndarray, n_pages: int) -> str:
    """Pages, mean, deviation, entropy in bits and share of the filler, of all samples."""
    n = histogram.sum()
    p = histogram / n
    v = np.arange(256)
    mean = float((p * v).sum())
    var = float((p * (v - mean) ** 2).sum())
    q = p[p > 0]
    return f"pages={n_pages};mean={mean:.4f};std={var**0.5:.4f};entropy={float(-(q * np.log2(q)).sum()):.4f};fill={p[255]:.4f}"


def tiff_files(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``media``: the text's bytes as a TIFF file."""

    def make():
        def run(texts):
            both = [pad(t) for t in texts]
            return [[n for n, _ in both], [encode(b) for _, b in both]]

        return run

    return map_texts(df, text_col, keep, [StructField("n_bytes", LongType()), StructField("media", BinaryType())], make)


PAGE = [StructField("page", IntegerType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("samples", IntegerType()), StructField("compression", IntegerType()), StructField("pixels", BinaryType()), StructField("error", StringType())]


def read_pages(data: bytes | None) -> Iterator[tuple]:
    """Rows of ``PAGE`` for one file."""
    if data is None:
        return
    n = 0
    try:
        for n, page in enumerate(pages(data), 1):
            yield (n - 1, *page, None)
        if not n:
            raise ValueError("no page")
    except (ValueError, LookupError, ArithmeticError, struct.error, zlib.error) as e:
        yield -1, None, None, None, None, None, str(e)


def tiff_pages(df: DataFrame, media_col: str = "media", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row per page of each file: ``keep`` columns and ``PAGE``."""

    def make():
        def run(files):
            rows = [(i, r) for i, data in enumerate(files) for r in read_pages(data)]
            return [i for i, _ in rows], [list(x) for x in zip(*(r for _, r in rows))] or [[] for _ in PAGE]

        return run

    return explode_texts(df, media_col, keep, PAGE, make)


DIGEST = [StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType())]


def digest(df: DataFrame, media_col: str = "media", keep: Sequence[str] = ("doc_id", "n_bytes")) -> DataFrame:
    """Digests and features of all pages of a file, read back one page at a time.

    A file with a page that can't be read has null digests of its payload.
    """

    def make():
        def one(data):
            if data is None:
                return (None,) * len(DIGEST)
            sha, size, tail, n = hashlib.sha256(), 0, b"", 0
            histogram = np.zeros(256, np.int64)
            for page, *_, pixels, error in read_pages(data):
                if error:
                    return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None
                sha.update(pixels)
                size, tail, n = size + len(pixels), (tail + pixels)[-32:], n + 1
                histogram += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
            return size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature(histogram, n)

        return lambda files: [list(x) for x in zip(*map(one, files))] if files else [[] for _ in DIGEST]

    return map_texts(df, media_col, keep, DIGEST, make)
