"""Merkle manifest of a dataset: a tree of digests per group, and a tree over the groups.

A row's leaf is the sha256 of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value.  In each group (a language) leaves ascend by
id; while several nodes remain, every ``FAN`` consecutive ones become their
digest.  What remains is the group's subroot; the subroots, ordered by group
with null first, make the root in the same way.

Every level is one window: nodes are partitioned by group and parent number,
and the list of a whole partition, in order, is both what the parent is the
digest of and each node's siblings.  One row of each partition is kept, and the
parents of these are the next level's nodes.  A partition holds ``FAN`` nodes
at most, however large its group.  Leaves get their numbers without one task
that orders a group: rows are dealt over tasks by ranges of (group, id), and
each task's numbers start after the counts of those before it.

Proofs go down the same levels.  A parent's path is joined to its list once,
not to each of its nodes, so it moves an eighth of what whole proofs hold.

Rows with equal ids, or without one (they come first), are ordered by their
leaves; rows alike in all fields are leaves of their own, whose proofs differ
as their places do.  A group of one row is its own subroot.  Without rows there
is no root and nothing is returned.  Texts of any length are hashed where they
are read.  Only the fields named are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm._arrow import col
from quire.storage import staged

#: Children of a node, at most.
FAN = 8

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    """A sha256 as it is stored: 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _joined(digests: Column) -> Column:
    """Digests as hex text, one after another."""
    return F.array_join(F.transform(digests, _hex), "")


def leaf_text(values: Sequence[Column]) -> Column:
    """What a leaf is the digest of."""
    text = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def leaves(df: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", seen: dict[str, Column] | None = None, changed: Column | None = None) -> DataFrame:
    """(``g``, ``id``, ``h``, ``s``): each row's leaf, and its leaf as a verifier sees it.

    ``seen`` holds what stands in place of some fields where ``changed`` is true.
    """
    h = _hash(leaf_text([col(f) for f in fields]))
    s = h if not seen else F.when(changed, _hash(leaf_text([seen.get(f, col(f)) for f in fields]))).otherwise(h)
    # groups by a key without nulls that sorts as they do, null first
    g = F.coalesce(F.concat(F.lit("="), col(group_col).cast("string")), F.lit("-"))
    return df.select(g.alias("g"), col(id_col).alias("id"), h.alias("h"), s.alias("s"))


def numbered(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``df`` with ``idx``, each row's number in its group ``g`` from 0, and ``n``, the group's rows."""
    keys = [*order, "q_row"]
    dealt = df.withColumn("q_row", F.monotonically_increasing_id()).repartitionByRange("g", *keys)
    dealt = staged(dealt.withColumn("q_part", F.spark_partition_id()), label)
    counts = staged(dealt.groupBy("g", "q_part").count(), f"{label}-counts")  # a row a task and group
    before = F.sum("count").over(Window.partitionBy("g").orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("g", "q_part", F.coalesce(before, F.lit(0)).alias("q_before"), F.sum("count").over(Window.partitionBy("g")).alias("n"))
    own = F.row_number().over(Window.partitionBy("g", "q_part").orderBy(*keys)) - 1
    return dealt.withColumn("q_own", own).join(counts, ["g", "q_part"]).withColumn("idx", F.col("q_before") + F.col("q_own")).drop("q_row", "q_part", "q_before", "q_own")


def levels(nodes: DataFrame, kept: Sequence[str], label: str) -> list[DataFrame]:
    """Of each level, from the leaves up: (``g``, ``parent``, ``n``, ``run``, ``h``).

    ``run`` lists a parent's nodes (``h`` and, for leaves, the columns ``kept``), ``h`` is
    the parent's digest.  A group that is down to one node hands it on unchanged
    until the largest group is too.
    """
    out = []
    while True:
        parent = F.floor(F.col("idx") / FAN).cast("long")
        whole = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        listed = nodes.withColumn("parent", parent).withColumn("run", F.collect_list(F.struct("h", *kept)).over(whole))
        once = listed.where(F.col("idx") % FAN == 0)  # the first of each run stands for its parent
        digest = F.when(F.col("n") > 1, _hash(_joined(F.col("run.h")))).otherwise(F.col("h"))
        level = staged(once.select("g", "parent", "n", "run", digest.alias("h")), f"{label}-{len(out)}")
        out.append(level)
        most = level.agg(F.max("n")).first()[0] or 0
        if most <= FAN:
            return out
        nodes, kept = level.select("g", F.col("parent").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), "h"), ()


def descended(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """All leaves with their ``path``: (``g``, ``child``, ``path`` and the further columns of ``tops``).

    ``tops`` has each group's ``g`` and the ``path`` from its subroot on.  A step of a path
    holds the siblings left and right, one after another.
    """
    more = [c for c in tops.columns if c not in ("g", "path")]
    paths = tops.select("g", F.lit(0).cast("long").alias("parent"), "path", *more)
    for k in range(len(tree) - 1, -1, -1):
        both = tree[k].select("g", "parent", "n", "run").join(paths, ["g", "parent"])
        one = both.select("g", "parent", "n", "run", "path", *more, F.posexplode("run").alias("at", "child"))
        side = lambda first, size: F.unhex(_joined(F.transform(F.slice("run", first, size), lambda x: x.h)))
        step = F.array(F.struct(side(F.lit(1), F.col("at")).alias("l"), side(F.col("at") + 2, F.lit(FAN)).alias("r")))
        path = F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path"))
        paths = one.select("g", (F.col("parent") * FAN + F.col("at")).alias("parent"), path.alias("path"), *more, *(["child"] if k == 0 else []))
    return paths


@dataclass
class Manifest:
    """``tree``: the levels of all groups; ``over``: the levels over their subroots; ``root``: hex, None without rows."""

    tree: list[DataFrame]
    over: list[DataFrame]
    root: str | None


def build(found: DataFrame) -> Manifest:
    """The manifest of what ``leaves`` returned."""
    tree = levels(numbered(staged(found, "leaves"), ("id", "h"), "numbered"), ("id", "s"), "level")
    subroots = tree[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "h")
    over = levels(numbered(staged(subroots, "subroots"), ("of",), "roots"), ("of",), "root")
    top = over[-1].select(_hex(F.col("h"))).first()  # one row
    return Manifest(tree, over, top[0] if top else None)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and a path lead to."""
    return F.aggregate(path, leaf, lambda a, x: F.sha2(F.concat(_hex(x.l), a, _hex(x.r)), 256))


def proofs(manifest: Manifest) -> DataFrame:
    """(``g``, ``id``, ``leaf``, ``seen``, ``subroot``, ``root``, ``path``) of each row, digests in hex."""
    empty = F.array().cast("array<struct<l:binary,r:binary>>")
    groups = descended(manifest.over, manifest.over[-1].select("g", empty.alias("path")))
    tops = groups.select(F.col("child.of").alias("g"), "path", F.col("child.h").alias("subroot"))
    found = descended(manifest.tree, staged(tops, "tops"))
    return found.select("g", F.col("child.id").alias("id"), _hex(F.col("child.h")).alias("leaf"), _hex(F.col("child.s")).alias("seen"), _hex(F.col("subroot")).alias("subroot"), F.lit(manifest.root).alias("root"), "path")


def verified(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each row's digests, its proof's digest, and whether what a verifier sees leads to the root."""
    proof = F.array_join(F.transform("path", lambda x: F.concat(_hex(x.l), _hex(x.r))), "")
    folded = found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(id_col: str = "doc_id", divisor: int = 3) -> Column:
    """True where ``divisor`` divides the crc32 of the id as text; an id that is null is left alone."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % divisor == 0, F.lit(False))


def lowered(text_col: str = "text") -> Column:
    """A text with A-Z in lower case."""
    return F.translate(col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
