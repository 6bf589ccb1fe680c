"""Sections of a document: heading path and positional address of every block.

All windows run over (doc_id, pos), so one sort serves them.  The counters of
the address need partitions of their own; they run on the headings alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LEVELS = range(1, 7)


def headings(blocks: DataFrame) -> DataFrame:
    """Headings with ``path``, ``depth`` and ``section_id``."""
    heads = blocks.where("type = 'heading'").select("doc_id", "pos", F.greatest(F.least("level", F.lit(6)), F.lit(1)).alias("level"), "text")
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    last = {lv: F.last(F.when(F.col("level") == lv, F.struct("pos", "text")), ignorenulls=True).over(w) for lv in LEVELS}
    heads = heads.withColumns({f"h{lv}": c for lv, c in last.items()})

    def live(lv: int) -> Column:
        """The level's last title, unless a shallower one came after it."""
        out = F.col(f"h{lv}").isNotNull()
        for other in range(1, lv):
            out = out & (F.col(f"h{other}").isNull() | (F.col(f"h{other}.pos") < F.col(f"h{lv}.pos")))
        return F.when(out & (F.col("level") >= lv), F.col(f"h{lv}.text"))

    heads = heads.withColumn("path", F.array_compact(F.array(*[live(lv) for lv in LEVELS]))).withColumn("depth", F.size("path"))
    heads = heads.withColumns({f"g{d}": F.sum((F.col("depth") < d).cast("int")).over(w) for d in LEVELS})
    count = {d: F.sum((F.col("depth") == d).cast("int")).over(W.partitionBy("doc_id", f"g{d}").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) for d in LEVELS}
    number = F.concat_ws(".", *[F.when(F.col("depth") >= d, count[d].cast("string")) for d in LEVELS])
    return heads.withColumn("section_id", number).select("doc_id", "pos", "level", "text", "path", "depth", "section_id")


def sections(blocks: DataFrame) -> DataFrame:
    """Every block with its ``section_no``, ``section_id`` and ``path`` of titles; before the first heading `0`.

    A figure's own path, if the blocks have any, becomes ``figure_path``.
    """
    blocks = blocks.withColumnRenamed("path", "figure_path")
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    numbered = blocks.withColumn("section_no", F.sum((F.col("type") == "heading").cast("long")).over(w))
    of = headings(blocks)
    own = of.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).cast("long").alias("section_no"), "path", "depth", "section_id")
    return numbered.join(own, ["doc_id", "section_no"], "left").withColumns({
        "section_id": F.coalesce("section_id", F.lit("0")), "path": F.coalesce("path", F.array().cast("array<string>")), "depth": F.coalesce("depth", F.lit(0)),
    })
