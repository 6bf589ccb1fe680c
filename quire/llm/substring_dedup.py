"""Substring dedup: words in windows that stand earlier too, found in FM-indexes of shards.

A window is ``WINDOW`` consecutive words.  Words that a window covers whose
sequence also starts earlier go: in a document of smaller id, or further left
in the same one.

*Shards.*  Equal windows must meet without each text going everywhere.  A
window's *anchor* is the least hash of the runs of ``GRAM`` words in it, the
leftmost of equals.  Consecutive windows with the same anchor form a segment,
and segments are dealt over shards by their anchor; so equal windows, having
equal anchors, come to one shard, and each window to one alone.  Anchors that
very many segments have (``HOT``) would fill a shard: their segments are cut
into single windows, dealt by the hash of the whole window.

*Copies* are put together before words move.  First only hashes do: an anchor
and a hash of the segment's words.  Of equal segments the first place stays,
the others are repeats.  Anchors that have several different segments then ask
for the words of each, once: their windows may be alike in part.

*Index.*  A shard lays these segments one after another, in the order of their
places, and keeps of that text its Burrows-Wheeler transform in a
wavelet tree (levels of packed bits with counts, laid out as a matrix) and the
counts of symbols: bits in proportion to the logarithm of the words' number,
no suffix array.  The segments are streamed through it: backward search extends
each place to the left while the match occurs elsewhere, which gives its
matching statistic up to the threshold.  Places that reach it are reported with
their interval of the index; one interval is one window, and all its places but
the first are repeats.

Windows are the same if their words' 64-bit hashes are.  Documents are ordered
by id (a whole number), a null id last, then by a hash of the text; rows alike
in id and text are one document and lose the same words.  Null texts have no
words, shorter texts than a window no windows.  Long texts are read in pieces
of bounded size.  Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quire.llm._arrow import ROWS, bounded_batches, col
from quire.storage import staged

WINDOW, GRAM = 20, 3
#: Words of a batch: what a task looks at together before it deals segments out.
BATCH_WORDS = 1 << 20
#: Segments of a shard, about; words of a shard's indexes, about; words of one index, about.
SHARD_SEGMENTS, SHARD_WORDS, INDEX_WORDS = 1 << 19, 1 << 21, 1 << 20
#: Anchors fall into 2^16 groups; a group that holds more than this share of all segments is hot.
HOT = 1 / 4096
#: No group below so many segments is hot.
HOT_LEAST = 4096
#: Queries of an index at once.
QUERIES = 1 << 18

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_G = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of a public hash)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def parts_of(raw: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part at a time."""
    at = 0
    while at < len(raw):
        m = _SPACE.search(raw, at + size)
        end = m.start() if m else len(raw)
        yield raw[at:end].split()
        at = end


class Codes(dict):
    """Words as numbers, with their hashes."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.hash, self.hashes = xxh3_64_intdigest, []

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(self.hash(word))
        self[word] = n = len(self.hashes) - 1
        return n


def windows(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places where a whole window starts, of pieces that lie one after another."""
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(ends[-1] if len(ends) else 0)
    return np.flatnonzero(left >= window)


def grams(h: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` words from each place on (the last ones run over the end and stand for nothing)."""
    out = h.copy()
    for k in range(1, GRAM):
        out[:-k] = out[:-k] * _G[k % 2] + h[k:] if k < len(h) else out[:-k]
    return mix(out)


def leftmost_least(g: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least of ``span`` values from each place on (short at the end)."""
    n, size = len(g), 1
    at = np.arange(n)
    while size < span:
        step = min(size, span - size)
        a, b = at[: n - step], at[step:]
        at = np.concatenate((np.where(g[a] <= g[b], a, b), at[n - step :]))
        size += step
    return at


def segments(h: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of each segment."""
    starts = windows(lengths, window)
    if not len(starts):
        return starts, starts, np.zeros(0, _U)
    g = grams(h)
    anchor_at = leftmost_least(g, window - GRAM + 1)[starts]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor_at) != 0) | (np.diff(starts) != 1))))
    return starts[first], np.diff(np.append(first, len(starts))), g[anchor_at[first]]


def content(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of ``size`` words from each start on."""
    up = np.full(len(h) + 1, _BASE)
    up[0] = 1
    up = np.cumprod(up)
    down = np.full(len(h) + 1, _BACK)
    down[0] = 1
    down = np.cumprod(down)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(h) * up[:-1])))
    return mix((sums[start + size] - sums[start]) * down[start] + size.astype(_U))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the given stretches, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of documents, those that touch put together."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = np.int64(1) << 40
    reach = np.maximum.accumulate(end + doc * wide)
    new = np.flatnonzero(np.concatenate(([True], (start + doc * wide)[1:] > reach[:-1])))
    return doc[new], start[new], reach[np.append(new[1:], len(doc)) - 1] - doc[new] * wide


# --- what moves between tasks ---------------------------------------------------

_DOC = np.dtype([("none", "u1"), ("id", "<i8"), ("hash", "<i8")])


def _packed(kind: int, *arrays: np.ndarray) -> bytes:
    head = np.array([kind, len(arrays), *(a.nbytes for a in arrays)], "<i8")
    raw = b"".join((head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, types: dict[int, tuple]) -> tuple[int, list[np.ndarray]]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    kind, n = np.frombuffer(raw, "<i8", 2)
    sizes = np.frombuffer(raw, "<i8", n, 16)
    at, out = 16 + 8 * int(n), []
    for size, dtype in zip(sizes.tolist(), types[int(kind)]):
        out.append(np.frombuffer(raw, dtype, size // np.dtype(dtype).itemsize, at))
        at += size
    return int(kind), out


#: Kinds of packets and the types of their parts: documents, then
#: of segments: document, place, windows, anchor, hash of all words;
#: of repeats: document, start, end; of words: document, place, windows, words, words' hashes.
SEGMENTS, REPEATS, WORDS, WIDE_WORDS = 0, 1, 2, 3
_TYPES = {
    SEGMENTS: (_DOC, "<u4", "<u4", "<u1", "<u8", "<u8"),
    REPEATS: (_DOC, "<u4", "<u4", "<u4"),
    WORDS: (_DOC, "<u4", "<u4", "<u1", "<u2", "<u8"),
    WIDE_WORDS: (_DOC, "<u4", "<u4", "<u1", "<u4", "<u8"),
}


def _turns(docs: np.ndarray) -> np.ndarray:
    """Each document's number in their order; rows alike have one number."""
    order = np.lexsort((docs["hash"], docs["id"], docs["none"]))
    number = np.empty(len(docs), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(docs[order][1:] != docs[order][:-1]))) if len(docs) else 0
    return number


def _dealt(shard: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the equal values, shard by shard."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0, [True]))) if len(shard) else []
    for lo, hi in zip(cuts, cuts[1:]):
        yield order[lo:hi]


def _few(docs: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents that are used, and their numbers among these."""
    which, number = np.unique(used, return_inverse=True)
    return docs[which], number.astype("<u4")


class Batch:
    """Pieces of texts, looked at together: their words as numbers, one after another."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.codes, self.docs, self.of, self.offsets, self.pieces, self.size = Codes(), [], [], [], [], 0

    def add(self, doc: tuple, text: str) -> Iterator[None]:
        """Takes a text in pieces; stops wherever the batch is full and must be used and cleared."""
        carry: list[bytes] = []
        offset = 0
        for words in parts_of(text.encode("utf-8", "replace")):
            words = carry + words
            if len(words) < self.window:
                carry = words
                continue
            if not self.size or self.docs[-1] is not doc:
                self.docs.append(doc)
            self.of.append(len(self.docs) - 1)
            self.offsets.append(offset)
            self.pieces.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
            # the next piece starts with the first window that this one doesn't hold
            carry, offset = words[len(words) - self.window + 1 :], offset + len(words) - self.window + 1
            if self.size >= BATCH_WORDS:
                yield

    def laid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of words, hashes by number, hashes of words, lengths of pieces)."""
        codes, hashes = np.concatenate(self.pieces), np.array(self.codes.hashes, _U)
        return codes, hashes, hashes[codes], np.array([len(p) for p in self.pieces])


class Dealer(Batch):
    """Deals the segments of batches out."""

    def __init__(self, shards: int, hot: np.ndarray, window: int = WINDOW):
        super().__init__(window)
        self.shards, self.hot = shards, np.asarray(hot, bool)

    def deal(self) -> Iterator[tuple[int, bytes]]:
        """(shard, packet) of what was gathered, which is cleared."""
        if self.size:
            yield from self._deal()
        self.clear()

    def _deal(self):
        window = self.window
        _, _, h, lengths = self.laid()
        start, count, anchor = segments(h, lengths, window)
        hot = self.hot[(anchor >> _U(48)).astype(np.int64)]
        if hot.any():
            single, cold = ranges(start[hot], count[hot]), ~hot
            start, count, anchor = (np.concatenate(x) for x in ((start[cold], single), (count[cold], np.ones_like(single)), (anchor[cold], np.zeros(len(single), _U))))
            hot = np.arange(len(start)) >= len(start) - len(single)
        key = content(h, start, count + window - 1)
        anchor = np.where(hot, key, anchor)
        first = np.cumsum(lengths) - lengths
        piece = np.searchsorted(first, start, "right") - 1
        doc = np.array(self.of)[piece]
        place = start - first[piece] + np.array(self.offsets)[piece]
        docs = np.array(self.docs, _DOC)
        turn = _turns(docs)
        by = np.lexsort((place, turn[doc], key))
        new = np.concatenate(([True], (key[by][1:] != key[by][:-1]) | (count[by][1:] != count[by][:-1])))
        head = by[new]
        leader = head[np.cumsum(new) - 1]
        # not the first of its kind, and not the first itself in a row alike
        lost = by[(turn[doc[by]] != turn[doc[leader]]) | (place[by] != place[leader])]
        if len(lost):
            of, a, b = merged(doc[lost], place[lost], place[lost] + count[lost] + window - 1)
            few, of = _few(docs, of)
            yield int(few["hash"][0] % self.shards), _packed(REPEATS, few, of, a.astype("<u4"), b.astype("<u4"))
        head = np.sort(head)
        for own in _dealt((anchor[head] % _U(self.shards)).astype(np.int64)):
            own = head[own]
            few, of = _few(docs, doc[own])
            yield int(anchor[own[0]] % _U(self.shards)), _packed(SEGMENTS, few, of, place[own].astype("<u4"), count[own].astype("<u1"), anchor[own], key[own])


class Shard:
    """Gathers a shard's packets of hashes: copies of segments, and segments to be looked at."""

    def __init__(self, window: int = WINDOW):
        self.window, self.docs, self.parts, self.ready, self.n = window, [], [], [], 0

    def add(self, blob: bytes) -> None:
        kind, (docs, of, *arrays) = _unpacked(blob, _TYPES)
        if kind == REPEATS:
            self.ready.append((docs, of.astype(np.int64), *(a.astype(np.int64) for a in arrays)))
            return
        place, count, anchor, key = arrays
        self.docs.append(docs)
        self.parts.append((of.astype(np.int64) + self.n, place.astype(np.int64), count.astype(np.int64), anchor, key))
        self.n += len(docs)

    def rows(self) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(whether repeated, documents, document, start, end); else (..., place, windows) of which the words are asked for."""
        yield from ((True, *x) for x in self.ready)
        if not self.parts:
            return
        docs = np.concatenate(self.docs)
        doc, place, count, anchor, key = (np.concatenate(x) for x in zip(*self.parts))
        turn = _turns(docs)[doc]
        by = np.lexsort((place, turn, count, key, anchor))
        differs = lambda *xs: np.concatenate(([True], np.logical_or.reduce([x[by][1:] != x[by][:-1] for x in xs])))
        by = by[differs(anchor, key, count, turn, place)]  # rows alike are one document
        new = differs(anchor, key, count)
        again = by[~new]
        if len(again):
            yield True, docs, *merged(doc[again], place[again], place[again] + count[again] + self.window - 1)
        by = by[new]
        kin = np.cumsum(differs(anchor)) - 1
        ask = by[np.bincount(kin)[kin] > 1]
        if len(ask):
            ask = ask[np.lexsort((place[ask], doc[ask]))]
            yield False, docs, doc[ask], place[ask], count[ask]


class Asked:
    """Gathers the words of segments that were asked for, and deals them out by anchor."""

    def __init__(self, shards: int, window: int = WINDOW):
        self.shards, self.window = shards, window
        self._fresh()

    def _fresh(self):
        self.codes, self.docs, self.parts, self.size = Codes(), [], [], 0

    def add(self, doc: tuple, text: str, asks: list[bytes]) -> None:
        place, count = np.concatenate([np.frombuffer(a, "<u4").reshape(-1, 2) for a in asks]).astype(np.int64).T
        where = ranges(place, count + self.window - 1)
        used, at = np.unique(where, return_inverse=True)
        words = text.encode("utf-8", "replace").split()
        own = np.fromiter(map(self.codes.__getitem__, map(words.__getitem__, used.tolist())), np.int32, len(used))
        self.parts.append((np.full(len(place), len(self.docs)), place, count, own[at]))
        self.docs.append(doc)
        self.size += len(where)

    def deal(self) -> Iterator[tuple[int, bytes]]:
        """(shard, packet) of what was gathered, which is cleared."""
        if self.parts:
            doc, place, count, codes = (np.concatenate(x) for x in zip(*self.parts))
            docs, hashes = np.array(self.docs, _DOC), np.array(self.codes.hashes, _U)
            size = count + self.window - 1
            start = np.cumsum(size) - size
            shard = (anchors(hashes[codes], start, size) % _U(self.shards)).astype(np.int64)
            local = np.zeros(len(hashes), np.int64)
            for own in _dealt(shard):
                words = codes[ranges(start[own], size[own])]
                local[words] = 1
                used = np.flatnonzero(local)
                local[used] = np.arange(len(used))
                kind, width = (WORDS, "<u2") if len(used) <= 1 << 16 else (WIDE_WORDS, "<u4")
                few, of = _few(docs, doc[own])
                yield int(shard[own[0]]), _packed(kind, few, of, place[own].astype("<u4"), count[own].astype("<u1"), local[words].astype(width), hashes[used])
                local[used] = 0
        self._fresh()


# --- the index --------------------------------------------------------------------


class Bits:
    """A row of bits with the number of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, _U)
        self.words.view(np.uint8)[: len(raw)] = raw
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Backward search over a text of symbols 0 ... sigma - 1 for patterns of up to ``depth`` symbols.

    The text is taken as a ring.  Its rotations are sorted by their first
    ``depth`` symbols or more, which is all that such patterns can tell apart.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int = WINDOW):
        n = len(text)
        rank, size = text.astype(np.int64), 1
        while True:
            key = rank * max(n, sigma) + np.roll(rank, -size)
            order = np.argsort(key)
            size *= 2
            if size >= depth:
                break
            key = key[order]
            rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        row = text[order - 1]  # the transform
        self.levels: list[tuple[int, Bits, int]] = []
        for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (row >> b & 1).astype(bool)
            self.levels.append((b, Bits(bits), n - int(bits.sum())))
            row = np.concatenate((row[~bits], row[bits]))
        self.base = np.zeros(sigma, np.int64)
        self.base = self._walk(np.arange(sigma), self.base)

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Down the tree: where the symbols before each place end up."""
        for b, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbols >> b & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol on the left."""
        both = self._walk(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        move = self.counts[symbols] - self.base[symbols]
        return both[: len(lo)] + move, both[len(lo) :] + move

    def statistics(self, stream: np.ndarray, ends: np.ndarray, threshold: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(length, first row) for each end: of the longest match that ends there and occurs twice or more, up to ``threshold``.

        The row is that of the whole match, where the threshold is reached (else -1).
        """
        length, row = np.zeros(len(ends), np.int64), np.full(len(ends), -1, np.int64)
        for at in range(0, len(ends), QUERIES):
            live = np.arange(at, min(len(ends), at + QUERIES))
            symbols = stream[ends[live]]
            lo, hi = self.counts[symbols], self.counts[symbols + 1]
            for size in range(1, threshold + 1):
                if size > 1:
                    lo, hi = self.extend(stream[ends[live] - size + 1], lo, hi)
                again = hi - lo > 1
                live, lo, hi = live[again], lo[again], hi[again]
                length[live] = size
            row[live] = lo
        return length, row


def repeated_windows(words: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of segments in order, laid one after another: for each window, whether it occurs further left too.

    ``words`` are hashes; windows are numbered by segment.
    """
    first = np.cumsum(size) - size
    count = size - window + 1
    symbols = np.unique(words, return_inverse=True)[1]
    often = np.bincount(symbols)
    # a word that stands once is in no repeated window: it parts the text as the segments' ends do
    name = np.zeros(len(often), np.int64)
    name[often > 1] = np.arange(1, int((often > 1).sum()) + 1)
    sigma = int(name.max(initial=0)) + 1
    text = np.zeros(len(words) + len(size), np.int64)
    where = ranges(first + np.arange(len(size)), size)
    text[where] = name[symbols]
    ends = where[ranges(first + window - 1, count)]
    parts = np.concatenate(([0], np.cumsum(text == 0)))
    whole = np.flatnonzero(parts[ends + 1] == parts[ends - window + 1])
    found = np.zeros(len(ends), bool)
    if sigma == 1 or not len(whole):
        return found
    length, row = FMIndex(text, sigma, window).statistics(text, ends[whole], window)
    hits = whole[length == window]
    _, leader, of = np.unique(row[length == window], return_index=True, return_inverse=True)
    found[hits] = hits != hits[leader][of]
    return found


def anchors(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The anchor of each segment, from its words alone."""
    # grams that run over a segment's end are none of its own
    inner = np.repeat(start + size, size) - np.arange(len(h)) >= GRAM
    return np.minimum.reduceat(np.where(inner, grams(h), _U(2**64 - 1)), start)


class Indexes:
    """Gathers a shard's packets of words, and finds the windows that are repeated in them."""

    def __init__(self, window: int = WINDOW):
        self.window, self.docs, self.parts, self.n = window, [], [], 0

    def add(self, blob: bytes) -> None:
        _, (docs, of, place, count, words, hashes) = _unpacked(blob, _TYPES)
        self.docs.append(docs)
        self.parts.append((of.astype(np.int64) + self.n, place.astype(np.int64), count.astype(np.int64), hashes[words]))
        self.n += len(docs)

    def rows(self) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(True, documents, document, start, end)."""
        if not self.parts:
            return
        window, docs = self.window, np.concatenate(self.docs)
        doc, place, count, h = (np.concatenate(x) for x in zip(*self.parts))
        size = count + window - 1
        start = np.cumsum(size) - size
        anchor, turn = anchors(h, start, size), _turns(docs)[doc]
        by = np.lexsort((place, turn))
        # rows alike are one document
        by = by[np.concatenate(([True], (turn[by][1:] != turn[by][:-1]) | (place[by][1:] != place[by][:-1])))]
        # one index a part: anchors are dealt over as many as keep each of bounded size
        for own in _dealt((mix(anchor[by]) % _U(int(size[by].sum()) // INDEX_WORDS + 1)).astype(np.int64)):
            own = by[own]
            hit = repeated_windows(h[ranges(start[own], size[own])], size[own], window)
            owner, at = np.repeat(own, count[own])[hit], ranges(place[own], count[own])[hit]
            if len(at):
                yield True, docs, *merged(doc[owner], at, at + window)


# --- over tables --------------------------------------------------------------------

_COUNTS = StructType([StructField("bucket", IntegerType()), StructField("n", LongType())])
_PACKET = StructType([StructField("shard", IntegerType()), StructField("packet", BinaryType())])
_KEYS = [StructField("none", BooleanType()), StructField("id", LongType()), StructField("hash", LongType())]
_FOUND = StructType([*_KEYS, StructField("spans", BinaryType()), StructField("asks", BinaryType()), StructField("words", LongType())])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``none``, ``id``, ``hash``, ``text``), none of the first three null."""
    return docs.select(col(id_col).isNull().alias("none"), F.coalesce(col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(col(text_col)).alias("hash"), col(text_col).alias("text"))


def survey(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> tuple[int, np.ndarray]:
    """(segments in all, which groups of anchors are hot).

    Each task tells its large groups; a group over ``HOT`` of all segments is
    large in some task, and what tasks leave out is too little to hide it.
    """

    def run(batches):
        counts, batch = np.zeros(1 << 16, np.int64), Batch(window)

        def count():
            if batch.size:
                anchor = segments(*batch.laid()[2:], window)[2]
                counts[:] += np.bincount((anchor >> _U(48)).astype(np.int64), minlength=1 << 16)
            batch.clear()

        for whole in batches:
            for text in whole.column(0).to_pylist():
                doc = (len(text or ""),)
                for _ in batch.add(doc, text or ""):
                    count()
        count()
        large = np.flatnonzero(counts > counts.sum() * HOT / 2)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *large.tolist()], pa.int32()), pa.array([int(counts.sum()), *counts[large].tolist()], pa.int64())], _COUNTS.names)

    bounded_batches(docs.sparkSession)
    found = staged(docs.select(col(text_col).alias("t")).mapInArrow(run, _COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")), "hot")
    total = found.where("bucket = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.zeros(1 << 16, bool)
    # 2 / HOT rows at most
    for r in found.where((F.col("bucket") >= 0) & (F.col("n") > max(HOT_LEAST, total * HOT / 2))).collect():
        hot[r["bucket"]] = True
    return total, hot


def _packet(shard: int, packet: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packet], pa.binary())], _PACKET.names)


def _looked_through(packets: DataFrame, shards: int, make, window: int) -> DataFrame:
    """Rows of ``_FOUND`` from each shard's packets, ``make`` being what gathers them."""

    def found(shard):
        for repeated, docs, of, a, b in shard.rows():
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            pairs = np.stack((a, b), 1).astype("<u4")
            own = docs[of[cuts[:-1]]]
            packed = [pairs[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
            none = [None] * len(packed)
            words = none if repeated else np.add.reduceat(b + window - 1, cuts[:-1])
            arrays = [pa.array(own["none"].astype(bool)), pa.array(own["id"]), pa.array(own["hash"]), pa.array(packed if repeated else none, pa.binary()), pa.array(none if repeated else packed, pa.binary()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, _FOUND.names)

    def run(batches):
        now, shard = None, make(window)
        for whole in batches:
            for at in range(whole.num_rows):
                number = whole.column(0)[at].as_py()
                if number != now:
                    yield from found(shard)
                    now, shard = number, make(window)
                shard.add(whole.column(1)[at].as_py())
        yield from found(shard)

    return packets.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, _FOUND)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(``none``, ``id``, ``hash``, ``spans``): stretches of repeated words (first and end, as pairs of 32-bit numbers), several rows a document."""
    total, hot = survey(docs, text_col, window)
    keyed, keys = _keyed(docs, id_col, text_col), ["none", "id", "hash"]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, total // SHARD_SEGMENTS, min(least, total // 10_000))

    def deal(batches):
        dealer = Dealer(shards, hot, window)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for *doc, text in zip(*(c.to_pylist() for c in whole.slice(at, ROWS).columns)):
                    for _ in dealer.add(tuple(doc), text or ""):
                        yield from (_packet(*x) for x in dealer.deal())
        yield from (_packet(*x) for x in dealer.deal())

    found = staged(_looked_through(keyed.mapInArrow(deal, _PACKET), shards, Shard, window), "copies")
    asked = found.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    parts = max(1, asked // SHARD_WORDS, min(least, asked // 50_000))

    def send(batches):
        asker = Asked(parts, window)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                for *doc, text, asks in zip(*(c.to_pylist() for c in whole.slice(at, ROWS).columns)):
                    asker.add(tuple(doc), text, asks)
                    if asker.size >= BATCH_WORDS:
                        yield from (_packet(*x) for x in asker.deal())
        yield from (_packet(*x) for x in asker.deal())

    asks = found.where("asks is not null").groupBy(*keys).agg(F.collect_list("asks").alias("asks"))
    words = keyed.join(asks, keys).select(*keys, "text", "asks").mapInArrow(send, _PACKET)
    more = _looked_through(words, parts, Indexes, window)
    return found.where("spans is not null").select(*keys, "spans").unionByName(more.select(*keys, "spans"))


def without(words: list[bytes], packed: list[bytes]) -> tuple[int, list[bytes]]:
    """(words removed, words kept)."""
    gone = np.zeros(len(words), bool)
    for p in packed:
        for a, b in np.frombuffer(p, "<u4").reshape(-1, 2).tolist():
            gone[a:b] = True
    n = int(gone.sum())
    return n, [words[i] for i in np.flatnonzero(~gone).tolist()] if n else words


FIELDS = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The id and ``FIELDS`` of each row; ``kept`` are the words that stay, joined by spaces."""
    keys = ["none", "id", "hash"]
    by_doc = spans(docs, id_col, text_col, window).groupBy(*keys).agg(F.collect_list("spans").alias("spans"))
    # the same exchange of texts as in ``spans``: Spark makes it once
    both = _keyed(docs, id_col, text_col).join(by_doc, keys, "left").select(F.when(~F.col("none"), F.col("id")).alias("own"), "text", "spans")
    schema = StructType([StructField(id_col, LongType()), *FIELDS])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                rows = []
                for text, packed in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (text or "").encode("utf-8", "replace").split()
                    n, kept = without(words, packed or [])
                    rows.append((len(words), n, b" ".join(kept).decode()))
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], schema.names)

    return both.mapInArrow(run, schema)
