"""Line dedup by pairwise alignment.

A text's lines that aren't blank are its *units*, whatever their length; blank
lines hang on the units beside them.  What a unit weighs is its words, a very
long one counting for several (``LONG_WORD``), so that text without spaces has
a weight too, and short lines gather into blocks.  Documents that share a *rare*
unit, one that stands in at most ``RARE`` places of all documents, are paired,
every two of them.  Each pair is aligned by patience diff: units that either
has once are anchors, of which a longest rising sequence stays; what lies
between two anchors is aligned in the same way, and equal neighbours join at
its edges.  Aligned blocks of ``MIN_BLOCK_WORDS`` words or more go from the
later document, and so do blocks that were moved or repeated, which no order
aligns: they are found from runs of units that just reach so many words
(*windows*) and grown over equal neighbours.

Blocks of frequent units alone have no rare line to be found by, and all pairs
of those who have them would be too many.  So a window of frequent units pairs
its document with the first document that has the same window, and the pair is
aligned as any other.  Nothing is lost by it: a block that an earlier document
has either holds a rare unit, which pairs the two, or is covered by windows
that the first holder has too.  So every run of units of ``MIN_BLOCK_WORDS``
words that stands in an earlier document goes, with the blank lines beside its
units that are alike in both; lone common lines stay.

Long documents are aligned by segments of bounded size, which overlap by a
window, so a pair's cost doesn't grow with its documents' lengths.

Documents are ordered by id, then by a hash of the text; a null id comes last.
Rows alike in id and text are one document: they lose the same lines.  Null and
empty texts stay as they are; a text all of whose lines go becomes empty.
Columns keep their names and order, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from quire.llm._arrow import ROWS, col, explode_texts
from quire.storage import staged

MIN_BLOCK_WORDS = 20
#: A word of twice so many characters or more counts once for each so many.
LONG_WORD = 8
#: Places of a rare unit, at most, in all documents together.
RARE = 8
#: Units from a segment's start to the next one's.
SEGMENT = 64

#: A unit: its number, hash and words, the line it is, the lines of the units beside it,
#: hashes of what stands between.
_UNIT = [
    StructField("u", IntegerType()), StructField("h", LongType()), StructField("words", IntegerType()), StructField("line", IntegerType()),
    StructField("prev", IntegerType()), StructField("next", IntegerType()), StructField("before", IntegerType()), StructField("after", IntegerType()),
]


def weight(line: str) -> int:
    """The words of a line; 0 if it is blank."""
    words = line.split()
    if len(line) < 2 * LONG_WORD:
        return len(words)
    return len(words) + sum(len(w) // LONG_WORD - 1 for w in words if len(w) >= 2 * LONG_WORD)


def units(text: str | None) -> list[tuple]:
    """Rows of ``_UNIT`` for a text."""
    import xxhash

    if not text:
        return []
    lines = text.split("\n")
    counts = [weight(x) for x in lines]
    at = [i for i, n in enumerate(counts) if n]
    edges = [-1, *at, len(lines)]
    signed = lambda x, bits: x - (1 << bits) if x >> (bits - 1) else x
    glue = [signed(xxhash.xxh32_intdigest("\n".join(lines[a + 1 : b]).encode("utf-8", "replace")), 32) if b - a > 1 else 0 for a, b in zip(edges, edges[1:])]
    whole = lambda x: signed(xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")), 64)
    return [(u, whole(lines[i]), counts[i], i, edges[u], edges[u + 2], glue[u], glue[u + 1]) for u, i in enumerate(at)]


def overlap(min_words: int) -> int:
    """The most units of a window."""
    return max(1, min_words)


def spans(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Windows, runs of units that just reach ``min_words``, forwards or backwards, as (first, end)."""
    least, n = max(1, min_words), len(words)
    found = set()
    total = j = 0
    for i in range(n):
        while j < n and total < least:
            total += words[j]
            j += 1
        if total < least:
            break
        found.add((i, j))
        total -= words[i]
    total, i = 0, n
    for j in range(n, 0, -1):
        while i and total < least:
            i -= 1
            total += words[i]
        if total < least:
            break
        found.add((i, j))
        total -= words[j - 1]
    return sorted(found)


def runs(numbers: list[int], keep: list[bool] | None = None) -> list[tuple[int, int]]:
    """Stretches (first, end) of consecutive numbers, all of them to keep."""
    out, first = [], 0
    for i in range(len(numbers) + 1):
        if i < len(numbers) and (keep is None or keep[i]):
            if i == first or numbers[i] == numbers[i - 1] + 1:
                continue
            out.append((first, i))
            first = i
        else:
            if first < i:
                out.append((first, i))
            first = i + 1
    return out


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence (patience sorting)."""
    tops: list[int] = []
    top_at: list[int] = []
    back = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[p], top_at[p] = v, i
        back.append(top_at[p - 1] if p else -1)
    out = []
    i = top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of equal elements, rising in both."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        at = {x: p for p, x in enumerate(a[i:k], i) if in_a[x] == 1}
        both = [(at[x], q) for q, x in enumerate(b[j:m], j) if in_b[x] == 1 and x in at]
        anchors = [both[p] for p in longest_rising([p for p, _ in both])]
        out += anchors
        # without an anchor nothing in between has an order to be aligned by
        for (p, q), (p1, q1) in zip([(i - 1, j - 1), *anchors], [*anchors, (k, m)]) if anchors else ():
            todo.append((p + 1, p1, q + 1, q1))
    return sorted(out)


def common_blocks(a: dict, b: dict, min_words: int = MIN_BLOCK_WORDS) -> list[tuple[int, int]]:
    """Aligned pairs of the blocks that two segments share: first by patience diff, then what was moved.

    ``a`` and ``b`` have lists ``u`` and ``h``, ``b`` also ``words``.
    """
    ua, ub, ha, hb, words = a["u"], b["u"], a["h"], b["h"], b["words"]
    out, gone = [], [False] * len(hb)

    def take(block):
        if sum(words[j] for _, j in block) >= min_words:
            out.extend(block)
            for _, j in block:
                gone[j] = True

    block: list[tuple[int, int]] = []
    for i, j in patience(ha, hb):
        if block and not (i == block[-1][0] + 1 and j == block[-1][1] + 1 and ua[i] == ua[i - 1] + 1 and ub[j] == ub[j - 1] + 1):
            take(block)
            block = []
        block.append((i, j))
    take(block)
    if all(gone):
        return out
    places: dict[int, list[int]] = {}
    for i, x in enumerate(ha):
        places.setdefault(x, []).append(i)
    meets = lambda i, j: 0 <= i < len(ha) and 0 <= j < len(hb) and ha[i] == hb[j]
    for first, end in runs(ub):
        for p, q in spans(words[first:end], min_words):
            p, q = p + first, q + first
            if all(gone[p:q]):
                continue
            for i in places.get(hb[p], ()):
                n = q - p
                if ha[i : i + n] != hb[p:q] or ua[i + n - 1] - ua[i] != n - 1:
                    continue
                lo, hi = 0, n
                while meets(i + lo - 1, p + lo - 1) and ua[i + lo - 1] == ua[i + lo] - 1 and ub[p + lo - 1] == ub[p + lo] - 1:
                    lo -= 1
                while meets(i + hi, p + hi) and ua[i + hi] == ua[i + hi - 1] + 1 and ub[p + hi] == ub[p + hi - 1] + 1:
                    hi += 1
                take([(i + x, p + x) for x in range(lo, hi)])
                break
    return out


def lines_to_drop(a: dict, b: dict, min_words: int = MIN_BLOCK_WORDS) -> list[int]:
    """Numbers of the lines of segment ``b`` that go beside an earlier document's segment ``a``."""
    drop: set[int] = set()
    for i, j in common_blocks(a, b, min_words):
        line = b["line"][j]
        drop.add(line)
        if a["before"][i] == b["before"][j]:
            drop.update(range(b["prev"][j] + 1, line))
        if a["after"][i] == b["after"][j]:
            drop.update(range(line + 1, b["next"][j]))
    return sorted(drop)


_KEY = [StructField("key", LongType()), StructField("rare", BooleanType())]


def keys_of(segment: dict, number: int, min_words: int = MIN_BLOCK_WORDS) -> list[tuple[int, bool]]:
    """What pairs a segment: its rare units, and the windows of frequent units that start in it."""
    import xxhash

    u, h, words, rare = (segment[k] for k in ("u", "h", "words", "rare"))
    out = [(x, True) for x, r in zip(h, rare) if r]
    for first, end in runs(u, [not r for r in rare]):
        for p, q in spans(words[first:end], min_words):
            if u[first + p] // SEGMENT == number:
                key = xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little", signed=True) for x in h[first + p : first + q]))
                out.append((key - (1 << 64) if key >> 63 else key, False))
    return out


def _place(*more: str) -> Column:
    """A document's place in the order of all, as a struct."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("hash"), *more)


def _segments(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(``id``, ``hash``, ``seg`` and lists of the fields of ``_UNIT`` and ``rare``): the units that stand in more than one place."""
    keyed = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("hash"), col(text_col).alias("text"))

    def make():
        def run(texts):
            rows = [(i, r) for i, t in enumerate(texts) for r in units(t)]
            return [i for i, _ in rows], [list(x) for x in zip(*(r for _, r in rows))] or [[] for _ in _UNIT]

        return run

    every = staged(explode_texts(keyed, "text", ("id", "hash"), _UNIT, make), "units")
    # staged, so that the join has plain exchanges on both sides: Spark can then split the
    # places of a very common unit over several tasks
    shared = staged(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") <= RARE).alias("rare")), "shared")
    own = F.floor(F.col("u") / SEGMENT).cast("int")
    # a segment goes on into the next by a window
    both = F.sequence(F.greatest(F.lit(0), F.floor((F.col("u") - overlap(min_words)) / SEGMENT).cast("int")), own)
    names = [f.name for f in _UNIT] + ["rare"]
    marked = every.join(shared, "h").select("id", "hash", F.explode(both).alias("seg"), F.struct(*names).alias("x"))
    # of rows alike, each unit once; a segment has a bounded number of units
    lists = marked.groupBy("id", "hash", "seg").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    return staged(lists.select("id", "hash", "seg", *[F.col(f"xs.{n}").alias(n) for n in names]), "segments")


def _pairs(segments: DataFrame, min_words: int) -> DataFrame:
    """(``e``, ``l``): places of the segments of an earlier and a later document that are to be aligned."""
    schema = StructType([segments.schema[k] for k in ("id", "hash", "seg")] + _KEY)
    names = ("u", "h", "words", "rare")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                found = [(i, *k) for i, (seg, *lists) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]))) for k in keys_of(dict(zip(names, lists)), seg, min_words)]
                take = pa.array([i for i, _, _ in found], pa.int64())
                out = [b.column(k).take(take) for k in range(3)] + [pa.array([k for _, k, _ in found], pa.int64()), pa.array([r for _, _, r in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    keys = staged(segments.select("id", "hash", "seg", *names).mapInArrow(run, schema), "keys")
    doc = lambda x: F.struct(x["none"], x["id"], x["hash"])
    # a rare unit's places are few: all pairs of them
    few = keys.where("rare").groupBy("key").agg(F.array_sort(F.collect_set(_place("seg"))).alias("xs"))
    two = few.select(F.explode(F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, F.size("xs")), lambda y: F.struct(x.alias("e"), y.alias("l")))))).alias("p"))
    two = two.select("p.e", "p.l").where(doc(F.col("e")) != doc(F.col("l")))
    # a window of frequent units: each place with the first document's
    many = keys.where("not rare")
    firsts = many.groupBy("key").agg(F.min(_place("seg")).alias("e"), F.max(_place()).alias("final")).where(doc(F.col("e")) != F.col("final"))
    firsts = staged(firsts.select("key", "e"), "firsts")
    star = many.join(firsts, "key").select("e", _place("seg").alias("l")).where(doc(F.col("e")) != doc(F.col("l")))
    return staged(two.unionByName(star).distinct(), "pairs")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(``id``, ``hash``, ``lines``): numbers of the lines to drop, of documents that lose any."""
    segments = _segments(docs, id_col, text_col, min_words)
    pairs = _pairs(segments, min_words)
    of_a, of_b = ("u", "h", "before", "after"), ("u", "h", "words", "line", "prev", "next", "before", "after")
    side = lambda p, names: segments.select(*[F.col(k).alias(f"{p}_{k}") for k in ("id", "hash", "seg")], *[F.col(k).alias(f"{p}{k}") for k in names])
    same = lambda p: F.col(f"{p}.id").eqNullSafe(F.col(f"{p}_id")) & (F.col(f"{p}.hash") == F.col(f"{p}_hash")) & (F.col(f"{p}.seg") == F.col(f"{p}_seg"))
    both = pairs.join(side("e", of_a), same("e")).join(side("l", of_b), same("l"))
    wide = both.select(F.col("l.id").alias("id"), F.col("l.hash").alias("hash"), *[f"e{k}" for k in of_a], *[f"l{k}" for k in of_b])
    schema = StructType([wide.schema["id"], StructField("hash", LongType()), StructField("lines", ArrayType(IntegerType()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                lists = list(zip(*(c.to_pylist() for c in b.columns[2:])))
                lines = [lines_to_drop(dict(zip(of_a, x)), dict(zip(of_b, x[len(of_a) :])), min_words) for x in lists]
                keep = pa.array([bool(x) for x in lines], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([x for x in lines if x], pa.list_(pa.int32()))], schema.names)

    found = wide.mapInArrow(run, schema)
    # lists of one document's own lines, equal ones once
    return found.groupBy("id", "hash").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_BLOCK_WORDS) -> tuple[DataFrame, Column, Column]:
    """(frame, row, dropped): the struct of each row's columns, its text cut, and how many lines went."""
    drops = dropped_lines(docs, id_col, text_col, min_words).withColumnsRenamed({"id": "q_id", "hash": "q_hash", "lines": "q_lines"})
    row = docs.select(F.struct(*map(col, docs.columns)).alias("q_row"), col(id_col).alias("q_i"), F.xxhash64(col(text_col)).alias("q_h"))
    both = row.join(drops, F.col("q_i").eqNullSafe(F.col("q_id")) & (F.col("q_h") == F.col("q_hash")), "left")
    text = F.col("q_row")[text_col]
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("q_lines"))
    cut = F.when(F.col("q_lines").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return both, cut, F.when(F.col("q_lines").isNull(), F.lit(0)).otherwise(F.size("q_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """All rows and columns, texts without the blocks that an earlier document has."""
    both, cut, _ = dedup(docs, id_col, text_col, min_words)
    return both.select(*[cut.alias(c) if c == text_col else F.col("q_row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """A row a document: its id, lines, lines dropped, and the text that is left."""
    both, cut, dropped = dedup(docs, id_col, text_col, min_words)
    n = F.when(F.col("q_row")[text_col].isNull(), F.lit(0)).otherwise(F.size(F.split(F.col("q_row")[text_col], "\n", -1)))
    return both.select(F.col("q_i").alias(id_col), n.alias("n_lines"), dropped.alias("n_dropped"), cut.alias(text_col))
