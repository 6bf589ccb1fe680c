"""Byte-level BPE encoding and decoding by a rank file.

Each match of the pre-tokenizer's pattern is encoded on its own.  The pairs of
neighbouring tokens in it are the leaves of a segment tree over byte positions;
an inner node holds the least of its leaves by (rank, position), so the root is
the leftmost pair of lowest rank.  A merge changes the leaves of the two pairs
that remain beside it, each in as many steps as the tree is high.  A piece of n
bytes takes O(n log n), however long it is.

Null texts count as empty; empty texts give no ids.  Rows are independent, so
repeated rows and extra columns need no rule.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Sequence

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from quire.llm._arrow import map_texts
from quire.llm._pieces import PATTERN, Memo

#: Entries of a worker's memo of encoded pieces, and the longest piece kept.
MEMO, LONGEST = 700_000, 48

_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()  # leaves: one a byte; a pair's is the byte where its left token starts
    tree = [_NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the next token starts
    before = list(range(-1, n - 1))
    while (best := tree[1]) != _NONE:
        i = best % n
        gone = after[i]
        end = after[gone]
        after[i] = end
        touched = [(gone, _NONE), (i, _NONE)]
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]])
            if rank is not None:
                touched[1] = (i, rank * n + i)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            touched.append((left, _NONE if rank is None else rank * n + left))
        for leaf, value in touched:
            at = width + leaf
            if tree[at] == value:
                continue
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder of whole texts.  Ids are little-endian uint32."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        # texts are only cut up beforehand for the pattern whose cuts are known
        self.memo = Memo(self._encode, MEMO, LONGEST, cuts=pattern == PATTERN)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _encode(self, part: str) -> bytes:
        pieces = self.find(part)
        if len(pieces) == 1:
            return array("I", encode_piece(part.encode(), self.ranks)).tobytes()
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.memo.text(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


#: One codec per Python worker: its memo serves all the worker's tasks.
_codecs: dict[tuple, Codec] = {}


def codec(ranks, pattern: str) -> Codec:
    key = (ranks.id, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


class _Ranks:
    """A broadcast of the rank file, of fixed size whatever the input."""

    def __init__(self, spark, path: str):
        self.sent = spark.sparkContext.broadcast(read_ranks(path))
        self.id = path

    @property
    def value(self):
        return self.sent.value


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` (little-endian uint32)."""
    ranks = _Ranks(df.sparkSession, rank_file)

    def make():
        own = codec(ranks, pattern)

        def run(texts):
            ids = [own.encode(t or "") for t in texts]
            return [[len(x) // 4 for x in ids], ids]

        return run

    return map_texts(df, text_col, keep, [StructField("n_tokens", LongType()), StructField("ids", BinaryType())], make, keep_memo=True)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the bytes that ``ids`` stand for (null: empty)."""
    ranks = _Ranks(df.sparkSession, rank_file)

    def make():
        own = codec(ranks, pattern)
        return lambda rows: [[own.decode(x or b"") for x in rows]]

    return map_texts(df, ids_col, keep, [StructField("decoded", BinaryType())], make, keep_memo=True)


def round_trip_digest(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encode and decode each text in one pass; only digests leave the worker."""
    import hashlib

    ranks = _Ranks(df.sparkSession, rank_file)

    def make():
        own = codec(ranks, pattern)

        def run(texts):
            out = []
            for t in texts:
                ids = own.encode(t or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            return [list(x) for x in zip(*out)] if out else [[], [], []]

        return run

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return map_texts(df, text_col, keep, fields, make, keep_memo=True)
