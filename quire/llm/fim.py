"""Fill-in-middle: texts cut at units into prefix, middle and suffix, found by an event scan.

A unit is a run of ASCII letters or any other single code point.  One
Aho-Corasick automaton goes over a text once and stops only where something
happens: at an ASCII character of another class than the one before it (a
letter after a non-letter or the other way round), and at a sentinel.  Code
points beyond ASCII are non-letters of one place each, so an ASCII stand-in
takes their place and every class change is one of ASCII characters.  Between
two events a text is letters only, which are one unit, or non-letters only,
which are as many units as places; so the units before each event follow by
arithmetic, and the place of any unit from its number by one binary search in
the events.  No unit is ever made as an object.

Where a text is cut and which form it takes depend on its id and a seed alone.
A null text is empty, a null id an empty string of digits.  Empty texts and
texts that hold a sentinel stay plain.  Rows are independent, so repeated rows
give equal rows; texts of any length are scanned in blocks.  No column but id
and text is read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.llm._arrow import ROWS, bounded_batches, col

# The sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: Characters scanned at once.
BLOCK = 1 << 20

_CHANGE, _SENTINEL = 1, 2


@dataclass(frozen=True)
class Options:
    """Of texts that can be cut, ``plain`` per cent stay as they are and ``spm`` per cent put the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20
    sentinels: tuple[str, str, str] = SENTINELS

    def __post_init__(self):
        borders = any(s[:k] == t[-k:] for s in self.sentinels for t in self.sentinels for k in range(1, len(s)))
        inside = any(s in t for s in self.sentinels for t in self.sentinels if t is not s)
        if borders or inside or not all(s and s.isascii() for s in self.sentinels):
            raise ValueError("sentinels must be ASCII, and none may end as one begins or stand in another")


@lru_cache(4)
def automaton(sentinels: Sequence[str] = SENTINELS):
    """(machine, longest word): words are pairs of ASCII characters of different classes, and the sentinels."""
    import ahocorasick

    others = [chr(c) for c in range(128) if chr(c) not in ascii_letters]
    words = dict.fromkeys((w for a in ascii_letters for b in others for w in (a + b, b + a)), _CHANGE)
    for s in sentinels:
        words[s] = words.get(s, 0) | _SENTINEL
    machine = ahocorasick.Automaton()
    for word, what in words.items():
        machine.add_word(word, what)
    machine.make_automaton()
    return machine, max(2, *map(len, sentinels))


class Units:
    """Where the letter runs of a text lie, and how many units stand before each."""

    def __init__(self, text: str, sentinels: Sequence[str] = SENTINELS):
        machine, longest = automaton(sentinels)
        flat = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        changes, self.sentinel = [np.zeros(int(flat[:1].isalpha()), np.int64)], False
        for at in range(0, len(flat), BLOCK):
            # a match that ends in this block may start in the one before
            events = np.fromiter(chain.from_iterable(machine.iter(flat, max(0, at - longest + 1), min(len(flat), at + BLOCK))), np.int64).reshape(-1, 2)
            events = events[events[:, 0] >= at]
            changes.append(events[events[:, 1] & _CHANGE > 0, 0])
            self.sentinel = self.sentinel or bool((events[:, 1] & _SENTINEL).any())
        turns = np.concatenate(changes)
        starts, ends = turns[0::2], turns[1::2]
        if len(ends) < len(starts):
            ends = np.append(ends, len(text))
        self.ends = ends
        letters = np.cumsum(ends - starts)
        #: units before each run: the non-letters before it, and a unit for each earlier run
        self.before = starts - np.concatenate(([0], letters[:-1])) + np.arange(len(starts)) if len(starts) else starts
        self.n = len(text) - (int(letters[-1]) if len(letters) else 0) + len(starts)

    def place(self, rank: int) -> int:
        """The character after the first ``rank`` units."""
        k = int(np.searchsorted(self.before, rank))
        return rank if not k else int(self.ends[k - 1]) + rank - int(self.before[k - 1]) - 1


def numbers(doc_id, seed: int) -> list[int]:
    """The first four 8-digit groups of the id's sha256."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def apart(text: str, doc_id, options: Options = Options()) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's length, middle's length, output) of one text."""
    units = Units(text, options.sentinels)
    h = numbers(doc_id, options.seed)
    if not text or units.sentinel or h[2] % 100 >= 100 - options.plain:
        return units.n, "plain", None, None, text
    a, b = (units.place(r) for r in sorted((h[0] % (units.n + 1), h[1] % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = options.sentinels
    if h[3] % 100 < options.spm:
        return units.n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return units.n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


FIELDS = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """The id and ``FIELDS`` of each row; ``output`` is the text to train on."""
    bounded_batches(docs.sparkSession)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *FIELDS])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                rows = [apart(t or "", i, options) for i, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                arrays = [pa.array(values, t) for values, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], schema.names)

    return docs.select(col(id_col).alias("k"), col(id_col).cast("string").alias("i"), col(text_col).alias("t")).mapInArrow(run, schema)


def restored(output: Column, form: Column, options: Options = Options()) -> Column:
    """The text that an output was made of.

    Texts with a sentinel are plain, so the three in an output are the only ones.
    """
    parts = F.split(output, "|".join(re.escape(s) for s in options.sentinels), -1)
    at = lambda i: F.get(parts, i)
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def digest(made: DataFrame, id_col: str = "doc_id", options: Options = Options()) -> DataFrame:
    """Digests of the outputs and of the texts restored from them."""
    back = restored(F.col("output"), F.col("form"), options)
    return made.select(col(id_col), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
