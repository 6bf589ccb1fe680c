"""License notices in texts: exact phrases, and short notices with a few edits.

A text is lower-cased (A-Z) and cut into words of digits, letters and non-ASCII
characters; everything here is in words of that normal form.

Phrases count wherever their words stand consecutively.  A notice of k allowed
edits is split into k + 1 seeds: whoever writes it with k edits at most leaves
one seed intact (pigeonhole).  An automaton finds all seeds of all notices in
one pass; around each hit the regex library's bounded-error matching verifies
the notice and tells its span and edits.

Null and empty texts have no words and no spans.  Of overlapping spans of a
label the one with fewest edits stays, then the first.  Rows are independent.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

import regex
import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quire.llm._arrow import map_texts

# The phrases of the contract.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Opening or deciding words of well-known notices by label, in normal form.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may obtain a copy of the license at http www apache org licenses", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("under the terms of the gnu general public license as published by", "gpl"),
    ("under the terms of the gnu lesser general public license as published by", "lgpl"),
    ("under the terms of the gnu affero general public license as published by", "agpl"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    ("boost software license version 1 0", "boost"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("licensed under the european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("the artistic license 2 0", "artistic"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("sil open font license version 1 1", "ofl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution", "cc"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
    ("this work is in the public domain", "public-domain"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)

#: One edit for so many characters of a notice, and the shortest seed.
CHARS_PER_EDIT, SHORTEST_SEED = 14, 6

_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normal(text: str) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_WORD).split()


@dataclass
class Notice:
    text: str
    label: str
    edits: int = field(init=False)

    def __post_init__(self):
        n = len(self.text)
        self.edits = max(1, n // CHARS_PER_EDIT)
        while self.edits > 1 and n // (self.edits + 1) < SHORTEST_SEED:
            self.edits -= 1
        self.verify = regex.compile(rf"(?b)(?<= )(?:{regex.escape(self.text, literal_spaces=True)}){{e<={self.edits}}}(?= )")

    def seeds(self) -> list[tuple[str, int]]:
        """Each of the edits + 1 parts and its offset."""
        n, k = len(self.text), self.edits + 1
        cuts = [i * n // k for i in range(k + 1)]
        return [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        import ahocorasick

        self.phrases = [(f" {p} ".encode(), p.count(" ") + 1, label) for p, label in phrases]
        self.notices = [Notice(text, label) for text, label in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for seed, at in notice.seeds():
                seeds.setdefault(seed, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for seed, owners in seeds.items():
            self.seeds.add_word(seed, (len(seed), owners))
        self.seeds.make_automaton()

    def exact(self, line: bytes) -> list[tuple[int, int, str]]:
        """(first word, words, label) of every place of every phrase."""
        found = []
        for phrase, n, label in self.phrases:
            at, word, last = line.find(phrase), 0, 0
            while at >= 0:
                word, last = word + line.count(b" ", last, at), at
                found.append((word, n, label))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: bytes) -> list[tuple[int, int, str, int, str]]:
        """(first word, end word, label, edits, matched words) of every verified notice.

        ``line`` is read a character a byte, so that offsets stay bytes'; an
        edit is then one of a byte.
        """
        flat = line.decode("latin-1")
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, owners) in self.seeds.iter(flat) if self.notices else ():
            for i, at in owners:
                k, start = self.notices[i].edits, end - n + 1 - at
                windows.setdefault(i, []).append((max(0, start - k - 1), min(len(flat), start + len(self.notices[i].text) + k + 1)))
        spans = []
        for i, places in windows.items():
            notice, done = self.notices[i], -1
            for lo, hi in sorted(set(places)):
                m = notice.verify.search(flat, lo, hi)
                if m and m.start() > done:
                    done = m.end()
                    spans.append((m.start(), m.end(), notice.label, sum(m.fuzzy_counts)))
        # the best come first; of a label's spans only the neighbours of a place can overlap it
        taken: dict[str, list[tuple[int, int, int]]] = {}
        for a, b, label, e in sorted(spans, key=lambda s: (s[3], s[0], s[1])):
            own = taken.setdefault(label, [])
            at = bisect_left(own, (a, b, e))
            if (not at or own[at - 1][1] <= a) and (at == len(own) or own[at][0] >= b):
                own.insert(at, (a, b, e))
        kept = sorted((a, b, label, e) for label, own in taken.items() for a, b, e in own)
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        number = lambda at: int(np.searchsorted(spaces, at))
        return [(number(a), number(b) + 1, label, e, line[a:b].decode("utf-8", "replace")) for a, b, label, e in kept]

    def scan(self, text: str | None) -> tuple:
        words = normal(text or "")
        line = b" " + b" ".join(words) + b" "
        exact = sorted((w, w + n, label, 0) for w, n, label in self.exact(line))
        # a word's number is the count of spaces before it, less the leading one
        exact = [(a, b, label, e, b" ".join(words[a:b]).decode("utf-8", "replace"), True) for a, b, label, e in exact]
        fuzzy = [(a - 1, b - 1, label, e, t, False) for a, b, label, e, t in self.fuzzy(line)]
        return len(words), exact + fuzzy


SPAN = StructType([
    StructField("first_word", LongType()), StructField("end_word", LongType()), StructField("label", StringType()),
    StructField("edits", IntegerType()), StructField("text", StringType()), StructField("phrase", IntegerType()),
])


def scan(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``keep`` columns, ``n_words`` and ``spans`` (phrase 1: exact, 0: a notice), by kind, then place."""

    def make():
        own = Scanner(phrases, notices)

        def run(texts):
            n, spans = [], []
            for t in texts:
                words, found = own.scan(t)
                n.append(words)
                spans.append([dict(zip(SPAN.names, (a, b, label, e, txt, int(exact)))) for a, b, label, e, txt, exact in found])
            return [n, spans]

        return run

    return map_texts(df, text_col, keep, [StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN))], make)


def summary(spans: DataFrame, lengths=NOTICES) -> DataFrame:
    """Counts and labels of ``scan``'s rows: one row a document."""
    exact = F.filter("spans", lambda s: s.phrase == 1)
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s.label))), ",")
    # 1 for an exact phrase; a notice loses a share for each edit
    part = lambda s: F.when(s.phrase == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - s.edits / F.greatest(F.length(s.text), F.lit(1))))
    return spans.withColumns({
        "n_base": F.size(exact).cast("long"),
        "first_word": F.array_min(F.transform(exact, lambda s: s.first_word)),
        "last_word": F.array_max(F.transform(exact, lambda s: s.first_word)),
        "base_labels": labels(exact),
        "labels": labels(F.col("spans")),
        "score": F.coalesce(F.array_max(F.transform("spans", part)), F.lit(0.0)).cast(DoubleType()),
    }).drop("spans")
