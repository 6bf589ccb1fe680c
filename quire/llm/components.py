"""Connected components of a links table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.storage import discard, staged


def connected(links: DataFrame, a: str, b: str, label: str = "links", files: int | None = None) -> DataFrame:
    """(``id``, ``root``): the least id of each id's component, for all ids but the roots.

    Both steps only ever group a node's links to their least end and join it
    back, so no task holds a component.  Every round is written to the shared
    folder, in no more than ``files`` if given: no round has more links than the
    first.  Rounds grow as the logarithm of the longest path.
    """
    e = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct()
    e = staged(e, label, files)
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return e.select(F.col("v").alias("id"), F.col("m").alias("root"))
        state = now
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), "m").distinct()
        floor = large.groupBy("v").agg(F.min("m").alias("to"))
        small = large.join(floor, "v").select(F.col("m").alias("v"), F.col("to").alias("m")).unionAll(floor.select("v", F.col("to").alias("m")))
        e, before = staged(small.where("v <> m").distinct(), label, files), e
        discard(before)  # rounds are many in a long session
