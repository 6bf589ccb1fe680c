"""Best-fit packing of documents into sequences, certified by lower bounds.

``token_pieces`` tokenizes whole texts and cuts long ones.  ``pack`` deals the
pieces into groups; in each, best-fit decreasing fills sequences, and
dual-feasible functions bound from below how many any packing needs.  A group
whose count meets its bound is done but for its emptiest sequence.  Groups with
a gap give up all sequences that aren't full; those pieces are dealt anew, into
fewer groups, and packed again, as long as sequences are saved and the bound of
all pieces isn't met.  Only lengths decide, so copies and ties need no rule:
equal lengths go by the piece's number.

Special tokens' strings in a text give their ids, as the library has it.
Null and empty texts are documents of the end mark alone.  A group holds a
bounded number of pieces whatever the input; no document is a key.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from quire.llm._arrow import explode_texts
from quire.llm._pieces import Memo, one_word
from quire.storage import staged

#: Pieces of a group, and how many rounds' sequences can be numbered: rounds end when one saves nothing.
GROUP, ROUNDS = 16_384, 31
#: Entries of a worker's memo of encoded pieces, and the longest piece kept.
MEMO, LONGEST = 700_000, 48

# Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SIGNS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}

#: Fixed value: the pre-tokenizer whose matches are known here.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

#: Marks that after a letter start a match of their own.
MARKS = (".", ",", ";", ":", "!", "?")

_own: dict[int, Memo] = {}


def _tokenizer(spec: str) -> Memo:
    """A worker's tokenizer and memo, kept for all its tasks."""
    key = zlib.crc32(spec.encode())
    if key not in _own:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        model = tokenizer.model
        rules = json.loads(spec)
        # a text with an added token's string, or for a tokenizer of other rules, isn't cut up
        added = tuple(t["content"] for t in rules.get("added_tokens") or ())
        known = not rules.get("normalizer") and (rules.get("pre_tokenizer") or {}) == PRE_TOKENIZER

        def whole(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        def encode(piece: str) -> bytes:
            if one_word(piece):  # nothing to pre-tokenize: the library's model takes the bytes' signs
                return array("I", [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(SIGNS))]).tobytes()
            if piece[-1:] in MARKS and one_word(piece[:-1]):  # two matches, each with its own entry
                return memo[piece[:-1]] + memo[piece[-1]]
            return whole(piece)

        memo = Memo(encode, MEMO, LONGEST, whole, added, known)
        _own.clear()
        _own[key] = memo
    return _own[key]


PIECE = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType()), StructField("uid", LongType())]


def token_pieces(docs: DataFrame, tokenizer_file: str, most: int = 2048, end_id: int = 0, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``PIECE``: a row for each piece of at most ``most`` tokens.

    ``uid`` numbers the pieces by input partition and place in it.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        own = _tokenizer(spec.value)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        end = array("I", [end_id]).tobytes()

        def run(texts):
            nonlocal number
            owner: list[int] = []
            out: list[list] = [[] for _ in PIECE]
            for i, t in enumerate(texts):
                ids = own.text(t or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    to = min(n, most) if n <= most else (n % most or most) if not at else at + most
                    owner.append(i)
                    for values, v in zip(out, (piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), number)):
                        values.append(v)
                    at, piece, number = to, piece + 1, number + 1
            return owner, out

        return run

    return explode_texts(docs, text_col, keep, PIECE, make, keep_memo=True)


def best_fit_decreasing(lengths: Sequence[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each length, given in decreasing order; and the number of bins."""
    waiting: dict[int, list[int]] = {}  # bins by room
    rooms = 0  # bit r: some bin has room r
    bins, offsets, used = [], [], 0
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins.append(b)
        offsets.append(capacity - room)
        room -= n
        if room:
            if not rooms >> room & 1:
                rooms |= 1 << room
                waiting[room] = []
            waiting[room].append(b)
    return bins, offsets, used


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of ``counts[n]`` items of each length n needs fewer bins.

    The best of three families of dual-feasible functions: the lengths as they
    are; rounded to k-ths (Fekete and Schepers' u, k up to 100); and lengths
    over capacity - e counted whole, under e dropped, for each e.
    """
    counts = counts.astype(object) if counts.sum() * capacity > 1 << 53 else counts.astype(np.int64)
    n = np.arange(capacity + 1)
    best = -(-int((counts * n).sum()) // capacity)
    for k in range(1, 101):
        whole = (k + 1) * n
        exact = whole % capacity == 0
        s1 = int((counts * n)[exact].sum())
        s2 = int((counts * (whole // capacity))[~exact].sum())
        best = max(best, -(-(s1 * k + s2 * capacity) // (capacity * k)))
    many, mass = np.cumsum(counts), np.cumsum(counts * n)
    for e in range(1, capacity // 2 + 1):
        large = int(many[capacity] - many[capacity - e])
        middle = int(mass[capacity - e] - mass[e - 1])
        best = max(best, large + -(-middle // capacity))
    return best


_FILLED = [StructField("bin", LongType()), StructField("offset", LongType()), StructField("room", LongType()), StructField("again", BooleanType())]


def _fill(pieces: DataFrame, capacity: int, groups: int, salt: int) -> DataFrame:
    """Each piece's bin in its group, and whether the bin goes into the next round."""
    names = pieces.columns
    schema = StructType([f for f in pieces.schema] + [StructField("part", LongType())] + _FILLED)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths.tolist(), capacity)
        b = np.array(bins)
        room = capacity - np.bincount(b, weights=lengths, minlength=used).astype(np.int64)
        met = used == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        again = room > 0
        if met and again.any():
            again = np.arange(used) == int(room.argmax())
        return pdf.assign(bin=b, offset=offsets, room=room[b], again=again[b])[schema.names]

    dealt = pieces.select(*names, F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(groups)).alias("part"))
    return dealt.groupBy("part").applyInPandas(run, schema)


def _bins(df: DataFrame) -> int:
    """How many sequences a staged round uses."""
    return df.where("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (from ``token_pieces``) with ``sequence_id`` and ``offset``; ``uid`` goes."""
    names = [c for c in pieces.columns if c != "uid"]
    pieces = staged(pieces, "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    total, bound = int(counts.sum()), lower_bound(counts, capacity)
    if not total:
        return pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = staged(_fill(pieces, capacity, -(-total // group), 0), "packed")
    used, done, last = _bins(left), [], 0
    for r in range(1, rounds + 1):
        if used <= bound:
            break
        pool = left.where("again").select(pieces.columns)
        size, before = pool.count(), _bins(left.where("again"))
        if before < 2:
            break
        trial = staged(_fill(pool, capacity, -(-size // group), r), "packed")
        after = _bins(trial)
        if after >= before:
            break
        done.append((last, left.where("not again")))
        left, last, used = trial, r, used - before + after
    done.append((last, left))
    out = None
    for r, df in done:
        sequence = F.lit(r << 58).cast("long") + F.shiftleft("part", 24) + F.col("bin")
        rows = df.select(*names, sequence.alias("sequence_id"), "offset")
        out = rows if out is None else out.unionAll(rows)
    return out
