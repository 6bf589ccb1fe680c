"""Exact Jaccard join of documents on word shingles, by parity sketches.

A document's set holds its distinct shingles as 64-bit hashes.  Equal sets are
one *text* from then on.  Tokens are dealt by hash into blocks; a block's word
is the XOR of its tokens' masks (their parity), so a token that only one of two
sets has changes one word at most, and the words in which two sketches differ
number no more than the sets' symmetric difference.

For J(A, B) >= t that difference is at most k = (1 - t) / (1 + t) * (|A| + |B|).
So of the first k + 1 blocks that A fills, in a fixed order of blocks, one must
have the same word in B, and stands among B's first k + 1 too (pigeonhole):
texts that share no such word can't be similar.  Blocks are laid out by size
band; a text also emits the words of the band below if similar texts may be in
it.  Blocks of shingles that very many documents have come last in the order:
few texts get as far, so a common passage makes no large group.

In a group of one word only a star is proposed: each text with the least.
Pairs whose one-bit parity sketches are farther apart (Hamming) than k can't
be similar and go; the rest is verified on the whole sets.  When the links
found join a group's texts, nothing is left to do there.  Otherwise its texts
outside the group's main component are verified against all texts of other
components in it.  So no link between components is lost, and a group of
copies or near-copies costs its size, not its square.

Null, empty and blank texts have no shingles and no links; texts of fewer
words than a shingle are one shingle.  Rows with a null id take part and never
name a component unless it has no other id.  Repeated rows are equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from quire.llm._arrow import ROWS, bounded_batches, col
from quire.llm._pieces import release
from quire.llm.components import connected
from quire.storage import files_for, staged

WORDS, NUM, DEN = 5, 75, 100

#: Buckets that shingles' document counts are kept in; a bucket is frequent from
#: this share of all documents (and this many) on.  The list of frequent ones is
#: a bitmap of BUCKETS / 8 bytes whatever the input.
BUCKETS, FREQUENT, FREQUENT_LEAST = 1 << 22, 0.0005, 64
#: Bits of the filter that picks the texts to verify: as it fills it lets more through.
FILTER = 1 << 24
#: Sizes up to which a band goes; texts up to the first have a block for each shingle.
FIRST, RATIO = 48, 2

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The text's set, ascending."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    size = min(words, n)
    out = h[: n - size + 1] + np.uint64(size)
    for i in range(1, size):
        out = _mix(out) + h[i : n - size + 1 + i]
    return np.unique(_mix(out))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        both = np.array([_mix(s).sum(dtype=np.uint64) + np.uint64(len(s))])
        return int((_mix(both) ^ np.bitwise_xor.reduce(_mix(s + _M1))).view(np.int64)[0])


def bit_sketch(s: np.ndarray) -> bytes:
    """One bit a token, toggled, in two to four times as many bits as tokens: a power of two from 64 on."""
    bits = max(64, 2 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch brought to fewer bytes by XOR of its halves: the same set's sketch of that size."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, at the shorter one's size."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())


def most_apart(n, m, num: int = NUM, den: int = DEN):
    """Largest symmetric difference of sets of n and m tokens with J >= num / den."""
    return (n + m) * (den - num) // (den + num)


def _band(n: int) -> int:
    band, top = 0, FIRST
    while n > top:
        band, top = band + 1, top * RATIO
    return band


def block_words(s: np.ndarray, frequent: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """A key for each block word the text emits, and whether the block is of frequent shingles."""
    n = len(s)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    bucket = (s & np.uint64(BUCKETS - 1)).astype(np.int64)
    often = (frequent[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1
    band = _band(n)
    least = -(-n * num // den)  # the smallest similar set
    keys, hot = [], []
    for b, k in ((band, most_apart(n, n * den // num, num, den)), (band - 1, most_apart(n, n, num, den))):
        if b < 0 or (b < band and least > FIRST * RATIO**b):
            continue
        spread = _mix(s + np.uint64(b + 1))
        if b:
            width = np.uint64(64 - (2 * FIRST * RATIO**b // 3 - 1).bit_length())
            spread = spread >> width
        else:
            spread = spread >> np.uint64(1)
        at = spread | (often.astype(np.uint64) << np.uint64(63))  # frequent ones last
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        word = np.bitwise_xor.reduceat(_mix(s[order] ^ _M2), first)[: k + 1]
        at = at[first][: k + 1]
        keys.append(_mix(_mix(at + np.uint64(b)) ^ word))
        hot.append(at >> np.uint64(63) == 1)
    return np.concatenate(keys), np.concatenate(hot)


SET = [StructField("n", LongType()), StructField("set_id", LongType()), StructField("sketch", BinaryType())]


def sets(docs: DataFrame, text_col: str, keep: Sequence[str], words: int = WORDS) -> DataFrame:
    """A row a document: ``keep`` columns and the size, name and bit sketch of its set.

    In the same pass each task counts all its documents' shingles into one array
    of buckets of fixed size, and adds a row for each bucket that stands out in
    it (``bucket`` not null; -1 has the number of documents).
    """
    schema = StructType([StructField(k, docs.schema[k].dataType) for k in keep] + SET + [StructField("bucket", IntegerType()), StructField("bucket_n", LongType())])
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts, total = np.zeros(BUCKETS, np.int32), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for t in part.column(len(keep)).to_pylist():
                    s = shingles(t, words)
                    np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                    rows.append((len(s), set_id(s), bit_sketch(s)) if len(s) else (0, None, None))
                total += len(rows)
                out = [pa.array(x, t) for x, t in zip(zip(*rows), types[len(keep) :])]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + out + [pa.nulls(len(rows), t) for t in types[-2:]], schema.names)
        at = np.flatnonzero(counts >= max(4, FREQUENT * total))
        out = [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], total), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at) + 1, t) for t in types[:-2]] + out, schema.names)

    return docs.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], col(text_col).alias("t")).mapInArrow(run, schema)


def frequent_buckets(counted: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap of the buckets whose shingles very many documents have, from the rows of ``sets``; and the number of documents.

    The list only orders blocks; the join is exact with any.
    """
    found = counted.where("bucket is not null").groupBy("bucket").agg(F.sum("bucket_n").alias("n"))
    total = found.where("bucket = -1").agg(F.max("n")).first()[0] or 0
    rows = found.where((F.col("bucket") >= 0) & (F.col("n") >= max(FREQUENT_LEAST, FREQUENT * total)))
    # eight buckets a byte, so at most BUCKETS / 8 rows
    bits = rows.groupBy(F.shiftright("bucket", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, bucket & 7)")).alias("bits")).collect()
    out = np.zeros(BUCKETS // 8, np.uint8)
    for r in bits:
        out[r["byte"]] = r["bits"]
    return out, total


_ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("size", "u1")])
_HOT = np.uint32(1 << 31)
#: A task flushes what it has for all parts at this many entries.
FLUSH = 400_000
#: About the most entries of a part, which is what a task holds at once, and the
#: most texts of a hot block that meet in one part, if a third of all have it.
PART, HOT_TEXTS = 2_000_000, 10_000


def _emit(docs: DataFrame, text_col: str, frequent: np.ndarray, parts: int, salts: int, words: int, num: int, den: int) -> DataFrame:
    """(``part``, ``entries``): block words with the names of their texts, packed by part."""
    schema = StructType([StructField("part", IntegerType()), StructField("entries", BinaryType())])
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bitmap = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        lately: dict[int, None] = {}  # texts just emitted: copies in one task go once

        def flush():
            part = np.concatenate([p for p, _ in held])
            entries = np.concatenate([e for _, e in held])
            order = np.argsort(part, kind="stable")
            part, entries = part[order], entries[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            blobs = [entries[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(part)))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(blobs, pa.binary())], schema.names)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for t in batch.slice(at, ROWS).column(0).to_pylist():
                    s = shingles(t, words)
                    if not len(s):
                        continue
                    name = set_id(s)
                    if name in lately:
                        continue
                    if len(lately) >= 100_000:
                        lately.clear()
                    lately[name] = None
                    keys, hot = block_words(s, bitmap, num, den)
                    e = np.empty(len(keys), _ENTRY)
                    e["key"] = (keys & np.uint64(_HOT - 1)).astype(np.uint32) | (hot * _HOT).astype(np.uint32)
                    e["id"] = name
                    e["size"] = _size_code(len(s))
                    where = keys >> np.uint64(32)
                    if hot.any():
                        where = where + hot * np.uint64(name % salts)
                    held.append(((where % np.uint64(parts)).astype(np.int32), e))
                    size += len(keys)
                    if size >= FLUSH:
                        size = 0
                        yield flush()
        if held:
            yield flush()

    return docs.select(col(text_col).alias("t")).mapInArrow(run, schema)


GROUP = StructType([StructField("gid", LongType()), StructField("id", LongType()), StructField("star", LongType()), StructField("fits", BooleanType())])


def _size_code(n: int) -> int:
    """A size in steps of a sixteenth of its binary logarithm."""
    return min(255, int(16 * np.log2(n)))


def _groups(emitted: DataFrame, parts: int, salts: int, num: int, den: int) -> DataFrame:
    """Rows of ``GROUP``: each text of each group of two or more, with the group's least,
    and whether their sizes allow a link.  ``emitted`` comes sorted by part; a task
    holds one part at a time.

    A group has the name of its members, so that blocks with the same members
    make one group; a hot block's, whose members lie in several parts, that of
    its key.
    """

    reach = int(16 * np.log2(den / num)) + 2

    def grouped(part: int, blobs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(blobs)
        blobs.clear()
        key, ident, code = e["key"], e["id"].astype(np.int64), e["size"].astype(np.int16)
        order = np.lexsort((ident, key))
        key, ident, code = key[order], ident[order], code[order]
        new = np.append(True, key[1:] != key[:-1])
        fresh = new | np.append(True, ident[1:] != ident[:-1])
        key, ident, code, new = key[fresh], ident[fresh], code[fresh], new[fresh]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        key = key[first].astype(np.uint64)
        hot = key >> np.uint64(31) == 1
        with np.errstate(over="ignore"):
            members = np.add.reduceat(_mix(ident.view(np.uint64)), first)
        # a hot block's part tells its salt; taken out again by the text's own name
        origin = ((part - ident[first] % salts) % parts).astype(np.uint64) << np.uint64(32) | key
        gid = np.where(hot, _mix(origin ^ _M1), _mix(members ^ _M2))
        keep = (size > 1) | hot
        _, once = np.unique(np.where(hot, key, gid), return_index=True)
        only = np.zeros(len(first), bool)
        only[once] = True
        keep &= only
        rows = np.flatnonzero(np.repeat(keep, size))
        gid, star, near = np.repeat(gid, size), np.repeat(ident[first], size), np.abs(code - np.repeat(code[first], size)) <= reach
        for at in range(0, len(rows), FLUSH):
            r = rows[at : at + FLUSH]
            yield pa.RecordBatch.from_arrays([pa.array(gid[r].view(np.int64)), pa.array(ident[r]), pa.array(star[r]), pa.array(near[r])], GROUP.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for b in batches:
            for p, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part and blobs:
                    yield from grouped(part, blobs)
                part = p
                blobs.append(np.frombuffer(e, _ENTRY))
        if blobs:
            yield from grouped(part, blobs)

    return emitted.mapInArrow(run, GROUP)


PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _near(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``a``, ``b``) of set names whose sizes and sketches allow J >= num / den."""
    of = lambda side: texts.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")

    def by_sketch(batches):
        for b in batches:
            keep = pa.array([hamming(x, y) <= most_apart(n, m, num, den) for x, y, n, m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], PAIR.names)

    return sized.select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(by_sketch, PAIR)


def _whole_sets(wanted: DataFrame, texts: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(``id``, ``tokens``): the whole sets of the named texts, in one pass over the documents.

    One text's hash stands for each set.  A filter of fixed size, in each
    worker, drops nearly all other documents before their shingles are made or
    anything is shuffled; the join makes it exact.
    """
    bit = F.col("text_hash").bitwiseAND(FILTER - 1)
    hashes = texts.join(wanted.withColumnRenamed("id", "set_id"), "set_id", "left_semi").select(bit.alias("bit"))
    # 64 bits a row, so at most FILTER / 64 rows come
    rows = hashes.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    words64 = np.zeros(FILTER // 64, np.int64)
    for r in rows:
        words64[r["word"]] = r["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(words64)
    schema = StructType([StructField("id", LongType()), StructField("tokens", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                h = part.column(0).to_numpy() & (FILTER - 1)
                hit = (bits[h >> 6] >> (h & 63)) & 1 == 1
                found = {set_id(s): s for t in part.column(1).filter(pa.array(hit)).to_pylist() if len(s := shingles(t, words))}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], schema.names)

    found = docs.select(F.xxhash64(col(text_col)).alias("h"), col(text_col).alias("t")).mapInArrow(run, schema)
    return found.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("tokens").alias("tokens"))


def _verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets have J >= num / den."""
    side = lambda c: whole.select(F.col("id").alias(c), F.col("tokens").alias(f"t_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def exact(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(at, ROWS)
                keep = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both_ = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((both_[1:] == both_[:-1]).sum())
                    keep.append(den * common >= num * (len(x) + len(y) - common))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], PAIR.names)

    return both.mapInArrow(exact, PAIR)


class _Block:
    """Some texts of a group, their sketches as matrices."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.rows, self.built = num, den, [], None

    def add(self, *row):
        self.rows.append(row)

    def _build(self):
        if self.built is None:
            ids, roots, sizes = (np.array([r[k] for r in self.rows], np.int64) for k in range(3))
            lengths = np.array([len(r[3]) for r in self.rows])
            self.built = ids, roots, sizes, {int(x): np.flatnonzero(lengths == x) for x in np.unique(lengths)}
            self.matrices = {}
        return self.built

    def near(self, i: int, root: int, n: int, sketch: bytes, above: bool = False) -> Iterator[tuple[int, int]]:
        """Pairs of the text with the block's of other components that it may be similar to."""
        if not self.rows:
            return
        ids, roots, sizes, by_length = self._build()
        for length, at in by_length.items():
            m = sizes[at]
            fits = (roots[at] != root) & (self.den * np.minimum(m, n) >= self.num * np.maximum(m, n))
            if above:
                fits &= ids[at] > i
            if not fits.any():
                continue
            size = min(length, len(sketch))
            if (length, size) not in self.matrices:
                self.matrices[length, size] = np.stack([_folded(self.rows[j][3], size) for j in at])
            pick = np.flatnonzero(fits)
            distance = np.bitwise_count(self.matrices[length, size][pick] ^ _folded(sketch, size)).sum(1, dtype=np.int64)
            for j in pick[distance <= most_apart(m[pick], n, self.num, self.den)]:
                yield i, int(ids[at[j]])

    def among(self) -> Iterator[tuple[int, int]]:
        """Such pairs within the block, once each."""
        for row in self.rows:
            yield from self.near(*row, above=True)


#: Texts outside their group's main component that one task compares with the group.
BLOCK = 4096
#: Groups of this size on are taken together if they have the same main component.
WIDE = 32


def _apart(groups: DataFrame, roots: DataFrame, texts: DataFrame, num: int, den: int, files: int) -> DataFrame:
    """Pairs of a group that lie in different components and may still be similar.

    Of such a pair one text lies outside the group's main component.  A family
    of near-copies makes a group for each block that they share, with nearly
    the same texts; such groups are taken together, so that texts meet once.
    The texts outside are dealt into blocks; each block's sketches are held as
    one matrix while the others stream by, and only pairs near enough by size
    and sketch come out.
    """
    known = groups.select("gid", "id").distinct().join(roots, "id", "left").select("gid", "id", F.coalesce("root", "id").alias("root"))
    per_root = known.groupBy("gid", "root").agg(F.count("*").alias("n"))
    main = per_root.groupBy("gid").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
    wide = F.col("size") >= WIDE
    family = main.select("gid", "main", wide.alias("wide"), F.when(wide, F.col("main")).otherwise(F.col("gid")).alias("family"))
    members = known.join(family, "gid").groupBy("wide", "family", "id", "root").agg(F.max(F.col("root") != F.col("main")).alias("outside"))
    members = staged(members, "members", files)
    blocks = members.where("outside").groupBy("wide", "family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mixed = members.join(blocks, ["wide", "family"]).join(texts.select(F.col("set_id").alias("id"), "n", "sketch"), "id")
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = mixed.select("wide", "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own.alias("own"), "id", "root", "n", "sketch")
    rows = dealt.select(F.xxhash64("wide", "family").alias("gid"), "block", F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("held"), "id", "root", "n", "sketch")
    rows = rows.repartition("gid", "block").sortWithinPartitions("gid", "block", F.desc("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, left, right = None, None, [], []

        def put(pairs):
            for i, j in pairs:
                left.append(min(i, j))
                right.append(max(i, j))

        def batch_out():
            out = pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], PAIR.names)
            left.clear()
            right.clear()
            return out

        for batch in batches:
            for g, blk, mine, i, root, n, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, blk) != key:
                    if block is not None:
                        put(block.among())
                    key, block = (g, blk), _Block(num, den)
                if mine:
                    block.add(i, root, n, sketch)
                else:
                    put(block.near(i, root, n, sketch))
            yield batch_out()
        if block is not None:
            put(block.among())
            yield batch_out()

    return rows.mapInArrow(run, PAIR).distinct()


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = (), words: int = WORDS, num: int = NUM, den: int = DEN, root: str | None = None) -> DataFrame:
    """``id_col``, ``keep`` columns, ``n_shingles`` and ``component_id`` of each row.

    The component is named by the least id that links reach, the row's own
    included.  ``root``, if given, names a further column that tells components
    apart also where ids repeat or are null (null without shingles).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    hashed = docs.select(col(id_col), *map(col, keep), F.xxhash64(col(text_col)).alias("q__hash"), col(text_col).alias("q__text"))
    counted = staged(sets(hashed, "q__text", (id_col, *keep, "q__hash"), words), "sets")
    rows = counted.where("bucket is null")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent, total = frequent_buckets(counted)
    # a text emits a word for about every third shingle, if in two bands
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    # of many shuffle partitions a table makes no more files than its texts are worth
    files = files_for(total, 8 * tokens)
    parts = max(8 * tasks, -(-tokens // (3 * PART)))
    salts = min(parts, max(16, -(-total // (3 * HOT_TEXTS))))
    emitted = _emit(docs, text_col, frequent, parts, salts, words, num, den).repartition(tasks, "part").sortWithinPartitions("part")
    groups = staged(_groups(emitted, parts, salts, num, den), "groups", files)

    texts = rows.where("n > 0").groupBy("set_id").agg(F.min(col(id_col)).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("q__hash").alias("text_hash"))
    texts = staged(texts, "texts", files)
    stars = groups.where("id <> star and fits").select(F.col("id").alias("a"), F.col("star").alias("b"))
    # a hot block's stars in its parts, linked by the least of them
    heads = groups.select("gid", "star").distinct()
    least = heads.groupBy("gid").agg(F.min("star").alias("b"))
    stars = stars.unionAll(heads.join(least, "gid").where("star <> b").select(F.col("star").alias("a"), "b"))

    def files_of(pairs: int) -> int:
        return files_for(pairs, 16 * pairs * tokens // max(1, total))  # two whole sets each

    def links_of(pairs: DataFrame, label: str, most: int) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
        whole = staged(_whole_sets(wanted, texts, docs, text_col, words), f"{label}-sets", most)
        return staged(_verified(pairs, whole, num, den), label, most)

    near = staged(_near(stars.distinct(), texts, num, den), "near", files)
    pairs = near.count()
    links = links_of(near, "links", files_of(pairs))
    roots = connected(links, "a", "b", "round", files_for(pairs, 0))

    # what the stars left apart in their groups
    more = staged(_apart(groups, roots, texts, num, den, files), "apart", files)
    if left := more.count():
        links = links.unionAll(links_of(more, "more", files_of(left)))
        roots = connected(links, "a", "b", "round", files_for(pairs + left, 0))

    named = texts.select("set_id", "least").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_text = named.select("set_id", F.col("root").alias("q__root")).join(names.withColumnRenamed("root", "q__root"), "q__root").select("set_id", "component_id", "q__root")
    out = rows.join(of_text, "set_id", "left")
    more = [F.col("q__root").alias(root)] if root else []
    return out.select(col(id_col), *map(col, keep), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(col(id_col)).alias("component_id"), *more).coalesce(files)
