"""Boxes: algebra, joins by cover, nearest captions, rows, corridors, columns, reading order.

A box is the columns x, y, w, h with its origin at the top left.  Joins always
carry the page as an equality, so none is a nested loop over everything; a page
holds what a sheet of paper does, so its boxes are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField

from quire.operators.fold import fold


def area(w: Column, h: Column) -> Column:
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes, given by column prefixes, share."""
    c = lambda s, n: F.col(f"{s}{n}")
    dx = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    dy = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    return F.when((dx > 0) & (dy > 0), dx * dy).otherwise(F.lit(0.0))


def coverage(a: str, b: str) -> Column:
    """Share of box a under box b."""
    own = area(F.col(f"{a}w"), F.col(f"{a}h"))
    return F.when(own > 0, overlap(a, b) / own).otherwise(F.lit(0.0))


def inset(x, y, w, h, by: float):
    return x + by, y + by, w - 2 * by, h - 2 * by


def clamp(x, y, w, h, width: Column, height: Column):
    x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    return x0, y0, F.least(x + w, width) - x0, F.least(y + h, height) - y0


def encode(x, y, w, h) -> Column:
    """The box as an array of four numbers of two decimals."""
    return F.array(*[F.round(c, 2) for c in (x, y, w, h)])


def decode(box: Column) -> Column:
    """The array of ``encode`` as a struct x, y, w, h; null for an array of another size."""
    return F.when(F.size(box) == 4, F.struct(*[F.get(box, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xywh")]))


def from_unit(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column):
    """A box in shares of the page with its origin at the bottom left, in points from the top left."""
    return x * width, (1 - y - h) * height, w * width, h * height


def union_box():
    """Aggregates of the box around all boxes that have an area."""
    full = (F.col("w") > 0) & (F.col("h") > 0)
    x0, y0 = F.min(F.when(full, F.col("x"))), F.min(F.when(full, F.col("y")))
    return x0.alias("x"), y0.alias("y"), (F.max(F.when(full, F.col("x") + F.col("w"))) - x0).alias("w"), (F.max(F.when(full, F.col("y") + F.col("h"))) - y0).alias("h")


def prefixed(df: DataFrame, p: str, names=("ord", "x", "y", "w", "h")) -> DataFrame:
    return df.select("page", *[F.col(n).alias(f"{p}{n}") for n in names])


#: Height of the bands of a page that overlapping boxes meet in.
BAND = 64.0


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes (prefixed a_ and b_) of a page that stand in a band together, each once.

    A box stands in every band that it reaches; a pair belongs to the first band
    that both reach.  So a full page doesn't pair all of its boxes, and no pair
    that overlaps is lost.
    """
    band = lambda y: F.floor(y / BAND).cast("int")
    in_bands = lambda df, p: df.where(F.col(f"{p}h") >= 0).withColumn("q_band", F.explode(F.sequence(band(F.col(f"{p}y")), band(F.col(f"{p}y") + F.col(f"{p}h")))))
    first = F.greatest(band(F.col("a_y")), band(F.col("b_y")))
    return in_bands(a, "a_").join(in_bands(b, "b_"), ["page", "q_band"]).where(F.col("q_band") == first).drop("q_band")


def over_middle(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the band that a box of ``a`` and what covers half of it or more meet in: that of its middle, once."""
    band = lambda y: F.floor(y / BAND).cast("int")
    reached = F.sequence(band(F.col("b_y")), band(F.col("b_y") + F.col("b_h")))
    return a.withColumn("q_band", band(F.col("a_y") + F.col("a_h") / 2)), b.where("b_h >= 0").withColumn("q_band", F.explode(reached))


def uncovered(boxes: DataFrame, claims: DataFrame, share: float = 0.6) -> DataFrame:
    """Boxes that no claim of their page covers by the share or more."""
    a, b = prefixed(boxes, "a_"), prefixed(claims, "b_")
    if share < 0.5:
        hidden = _meeting(a, b).where(coverage("a_", "b_") >= share).select("page", "a_ord").distinct()
        return a.join(hidden, ["page", "a_ord"], "left_anti")
    a, b = over_middle(a, b)
    return a.join(b, (a.page == b.page) & (a.q_band == b.q_band) & (coverage("a_", "b_") >= share), "left_anti").drop("q_band")


def first_claim(boxes: DataFrame, claims: DataFrame, share: float = 0.5) -> DataFrame:
    """Each box with the first claim, by number, that covers more than the share of it."""
    a, b = prefixed(boxes, "a_"), prefixed(claims, "b_")
    if share < 0.5:
        j = _meeting(a, b)
    else:
        a, b = over_middle(a, b)
        j = a.join(b, ["page", "q_band"])
    return j.where(coverage("a_", "b_") > share).groupBy("page", "a_ord").agg(F.min("b_ord").alias("claim"))


def matches(candidates: DataFrame, tables: DataFrame, share: float = 0.3) -> DataFrame:
    """Each candidate with the first table where one covers more than the share of the other, or null."""
    j = _meeting(prefixed(candidates, "a_"), prefixed(tables, "b_")).where((coverage("a_", "b_") > share) | (coverage("b_", "a_") > share))
    found = j.groupBy("page", "a_ord").agg(F.min("b_ord").alias("match"))
    return prefixed(candidates, "a_").join(found, ["page", "a_ord"], "left").select("page", "a_ord", "match")


def nearest_below(figures: DataFrame, texts: DataFrame, above: float = -2.0, below: float = 24.0, longest: int = 300) -> DataFrame:
    """Each figure with the nearest short text under it whose middle lies within its width.

    A text stands in the band of its top, a figure in those of the stretch that
    tops may lie in; so a figure meets only the texts about its lower edge.
    """
    band = lambda y: F.floor(y / BAND).cast("int")
    t = texts.select("page", *[F.col(n).alias(f"b_{n}") for n in ("ord", "x", "y", "w", "h", "text")]).where(F.length("b_text") <= longest)
    foot = F.col("a_y") + F.col("a_h")
    # a little more at either end, as sums are rounded
    reached = F.sequence(band(foot + above - 0.01), band(foot + below + 0.01))
    a = prefixed(figures, "a_").where(foot.isNotNull()).withColumn("q_band", F.explode(reached))
    j = a.join(t.withColumn("q_band", band(F.col("b_y"))), ["page", "q_band"])
    gap = F.col("b_y") - foot
    mid = F.col("b_x") + F.col("b_w") / 2
    ok = (gap >= above) & (gap < below) & (mid > F.col("a_x")) & (mid < F.col("a_x") + F.col("a_w"))
    j = j.withColumn("gap", gap).where(ok)
    return j.groupBy("page", "a_ord").agg(F.min_by("b_ord", F.struct("gap", "b_ord")).alias("caption"), F.min("gap").alias("gap"))


def splice_before(inserts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each insert with the first block below it that shares some of its width, or null (at the end)."""
    j = prefixed(inserts, "a_").join(prefixed(blocks, "b_"), "page")
    j = j.where((F.col("b_y") >= F.col("a_y") + F.col("a_h")) & (F.col("b_x") < F.col("a_x") + F.col("a_w")) & (F.col("b_x") + F.col("b_w") > F.col("a_x")))
    found = j.groupBy("page", "a_ord").agg(F.min("b_ord").alias("before"))
    return prefixed(inserts, "a_").join(found, ["page", "a_ord"], "left").select("page", "a_ord", "before")


def islands(df: DataFrame, keys: list[str], order: list[str], start: Column, name: str = "island") -> DataFrame:
    """Running number of starts: rows between two starts are an island."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(start.cast("int"), F.lit(0))).over(w))


def segments(glyphs: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Rows' glyphs cut where the space to all before is wider than ``gap``: a box each."""
    w = W.partitionBy(*keys).orderBy("x", "ord")
    reach = F.max(F.col("x") + F.col("w")).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = islands(glyphs.withColumn("reach", reach).withColumn("new", (F.col("x") - F.col("reach") > gap)), keys, ["x", "ord"], F.col("new"), "segment")
    return d.groupBy(*keys, "segment").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x1"), F.count("*").alias("n"))


def corridors(boxes: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Stretches of x, inside a group's boxes, that none covers and that are wide enough."""
    w = W.partitionBy(*keys).orderBy("x", "ord")
    reach = F.max(F.col("x") + F.col("w")).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = boxes.withColumn("low", reach).withColumn("high", F.col("x"))
    return d.where(F.col("high") - F.col("low") >= least).select(*keys, "low", "high")


def row_blocks(lines: DataFrame, keys: list[str], size: Column, gap: float = 2.0) -> DataFrame:
    """Lines in blocks: a block ends at another column or a gap over ``gap`` type sizes."""
    w = W.partitionBy(*keys).orderBy("y", "ord")
    d = lines.withColumn("size", size)
    far = F.col("y") - F.lag(F.col("y") + F.col("h")).over(w) > F.greatest(F.col("size"), F.lag("size").over(w)) * gap
    new = (F.col("col") != F.lag("col").over(w)) | far
    return islands(d.withColumn("new", new), keys, ["y", "ord"], F.col("new"), "block")


#: Share of its height by which a glyph overlaps the row that it joins.
ROW_SHARE = 0.45


def growing_rows(share: float = ROW_SHARE) -> Callable[[float, float], tuple[int]]:
    """Gives the row number of glyph after glyph, in order of y and x, from their y and h."""
    top = bottom = None
    row = 0

    def step(y, h):
        nonlocal top, bottom, row
        if top is not None and min(y + h, bottom) - max(y, top) > h * share:
            top, bottom = min(top, y), max(bottom, y + h)
        else:
            top, bottom, row = y, y + h, row + 1
        return (row,)

    return step


def rows_of(glyphs: DataFrame, keys: list[str], share: float = ROW_SHARE) -> DataFrame:
    """Row number of each glyph: it joins the row if it overlaps the row's growing box by the share of its height."""
    return fold(glyphs, keys, ["y", "x", "ord"], ["y", "h"], ["ord"], [StructField("row", IntegerType())], lambda: growing_rows(share))


def coalesce_regions(regions: DataFrame, keys: list[str], page_width: float | str, tallest: float, keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Region number of each region in order: it joins the one before if both are text
    without a heading, in one column, close, and the union stays short.

    ``page_width`` is a number or names a column; columns ``keep`` go along.
    """
    wide = regions.withColumn("q_width", F.col(page_width) if isinstance(page_width, str) else F.lit(float(page_width)))

    def make():
        box, before, n = None, False, 0

        def step(x, y, w, h, mergeable, width):
            nonlocal box, before, n
            own = (x, y, x + w, y + h)
            joins = False
            if before and mergeable and box is not None and None not in own:
                x0, y0, x1, y1 = min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])
                column = abs(box[0] - x) < width * 0.1 and x1 - x0 < max(box[2] - box[0], w) * 1.2
                joins = column and -2 <= y - box[3] < 24 and y1 - y0 <= tallest
            if joins:
                box = (x0, y0, x1, y1)
            else:
                box, n = own, n + 1
            before = bool(mergeable)
            return (n,)

        return step

    return fold(wide, keys, ["ord"], ["x", "y", "w", "h", "mergeable", "q_width"], keep, [StructField("region", IntegerType())], make)


def gutters(boxes: DataFrame, width: float, keys: list[str] = ["page"]) -> DataFrame:
    """The x, if any, that no box of a page crosses and that is clearest of all; two boxes at least on either side.

    Boxes in order of x leave gaps between all before and the next one; only the
    cuts inside a gap are looked at.
    """
    narrow = boxes.where(F.col("w") < width * 0.7)
    w = W.partitionBy(*keys).orderBy("x", "ord")
    reach = F.max(F.col("x") + F.col("w"))
    g = narrow.select(*keys, reach.over(w.rowsBetween(W.unboundedPreceding, -1)).alias("low"), F.col("x").alias("high"), reach.over(w.rowsBetween(W.unboundedPreceding, 0)).alias("all"), (F.row_number().over(w) - 1).alias("left"), F.count("*").over(W.partitionBy(*keys)).alias("n"))
    # the last box also opens the gap beyond all
    gap = lambda low, high, left: F.struct(F.col(low).alias("low"), high.alias("high"), left.alias("left"))
    inner, outer = gap("low", F.col("high"), F.col("left")), gap("all", F.lit(None).cast("double"), F.col("n").cast("int"))
    g = g.where("n >= 4").select(*keys, "n", F.inline(F.when(F.col("left") == F.col("n") - 1, F.array(inner, outer)).otherwise(F.array(inner))))
    start, step = width * 0.25, width / 200
    number = lambda at, other: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.floor((at - start) / step).cast("int"), F.lit(other))))
    cuts = g.where("low is null or high is null or low <= high").withColumn("i", F.explode(F.sequence(number(F.col("low"), 0), number(F.col("high"), 100) + 1)))
    cuts = cuts.withColumn("at", F.lit(start) + F.col("i") * step).where("i <= 100")
    clear = F.least(F.col("at") - F.col("low"), F.col("high") - F.col("at"))
    best = cuts.withColumn("clearance", clear).where("clearance >= 0").groupBy(*keys).agg(F.max_by(F.struct("at", "left", "n", "clearance"), F.struct(F.round("clearance", 6), -F.col("i"))).alias("b"))
    return best.where((F.col("b.clearance") > width * 0.015) & (F.col("b.left") >= 2) & (F.col("b.n") - F.col("b.left") >= 2)).select(*keys, F.round("b.at", 6).alias("gutter"))


def reading_order(boxes: DataFrame, width: float) -> DataFrame:
    """``rank`` in the page: left column before right where there is a gutter, each split once more
    if it has one itself; then rows by greedy tolerance of their top, half a column's upper median
    height; then left to right.  Boxes without a place come last, by number.
    """
    place = ["page", "side"]
    at = F.col("x") + F.col("w") / 2
    half = lambda df, keys, name: df.join(gutters(df, width, keys), keys, "left").withColumn(name, F.when(F.col("gutter").isNull() | (at < F.col("gutter")), 0).otherwise(1)).drop("gutter")
    g = half(half(boxes.where(F.col("x").isNotNull()), ["page"], "s1"), ["page", "s1"], "s2")
    g = g.withColumn("side", F.col("s1") * 2 + F.col("s2"))
    tall = F.when(F.col("h") > 0, F.col("h"))
    of = W.partitionBy(*place)
    g = g.withColumn("q_n", F.row_number().over(of.orderBy(tall.asc_nulls_last()))).withColumn("q_all", F.count(tall).over(of))
    g = g.withColumn("tolerance", F.coalesce(F.max(F.when(F.col("q_n") == F.floor(F.col("q_all") / 2) + 1, tall)).over(of), F.lit(1.0)) / 2)

    def make():
        top, row = None, 0

        def step(y, tolerance):
            nonlocal top, row
            if top is None or y - top > tolerance:
                top, row = y, row + 1
            return (row,)

        return step

    e = fold(g, place, ["y", "x", "ord"], ["y", "tolerance"], ["x", "ord"], [StructField("row", IntegerType())], make)
    e = e.unionByName(boxes.where(F.col("x").isNull()).select("page", F.lit(4).alias("side"), F.lit(0).alias("row"), F.lit(0.0).alias("x"), "ord"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy("side", "row", "x", "ord"))).select("page", "ord", "side", "rank")
