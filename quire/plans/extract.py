"""From lines to documents: the page stages and the whole-document passes, as one plan.

Page stages run per page and need no shuffle beyond the page's; the passes over
whole documents join bounded rows a document.  A block has ``page``, ``ord``,
``type``, its fields (``functions.blocks``) and its box x, y, w, h.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from quire.functions import blocks as B, text as T
from quire.operators import figures as FG, furniture, geometry as G, glyphs as GL, headings as H, layout as L, tables as TB
from quire.storage import staged


def without_contents(tables: DataFrame, contents: DataFrame, page: str = "page") -> DataFrame:
    """Table candidates [first_line, end_line) that no contents list's lines overlap."""
    t, c = tables.alias("t"), contents.alias("c")
    overlap = (F.col(f"t.{page}") == F.col(f"c.{page}")) & (F.col("t.first_line") < F.col("c.end_line")) & (F.col("c.first_line") < F.col("t.end_line"))
    return t.join(c, overlap, "left_anti")


def running_order(sources: list[DataFrame], page: str = "page") -> DataFrame:
    """Blocks of several sources, each with the line it starts at: by line, then source, then place."""
    parts = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("ord", F.row_number().over(W.partitionBy(page).orderBy("line", "source_no", "text")) - 1)


BOX = ("x", "y", "w", "h")


def _union(*more: Column) -> list[Column]:
    x, y = F.min("x"), F.min("y")
    return [x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"), *more]


def _paragraphs(lines: DataFrame, page: str) -> DataFrame:
    """Paragraphs of lines, classified: ``line`` is the first one's number."""
    xs = F.array_sort(F.collect_list(F.struct("ord", "text")))
    runs = L.paragraphs(lines, page).groupBy(page, "paragraph").agg(
        F.min("ord").alias("line"), F.count("*").alias("lines"), L.joined(F.transform(xs, lambda x: x.text)).alias("text"), F.max("size").alias("size"), F.every("bold").alias("bold"), *_union(),
    )
    return H.classify(runs, page).where(T.trim(F.col("text")) != "").withColumn("text", T.trim(F.col("text")))


def page_blocks(lines: DataFrame, page: str = "page") -> DataFrame:
    """Blocks of a page from its lines: contents lists, headings and paragraphs in running order.

    The lines are read twice, so hand in a stored table.
    """
    marked = L.contents_marked(lines, page)
    contents = marked.where("item is not null")
    item = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("item").alias("text"), "depth"))), lambda x: F.struct(x.text.alias("text"), x.depth.cast("int").alias("depth")))
    lists = contents.groupBy(page, "run").agg(F.min("ord").alias("line"), (F.max("ord") + 1).alias("end_line"), item.alias("items"), *_union())
    rest = marked.where("item is null").drop("run", "item", "depth")
    text = _paragraphs(rest, page).select(page, "line", F.when(F.col("is_heading"), "heading").otherwise("paragraph").alias("type"), "level", "text", "size", *BOX)
    found = lists.select(page, "line", "end_line", F.lit("list").alias("type"), F.lit(None).cast("string").alias("text"), "items", F.lit(False).alias("ordered"), *BOX)
    return running_order([found, text], page)


def table_candidates(lines: DataFrame, blocks: DataFrame, page: str = "page", search: TB.Search = TB.Search()) -> DataFrame:
    """Tables that the lines' geometry suggests, contents lists left out, numbered by their place."""
    found = TB.detect(lines.withColumn("size_pt", F.col("size").cast("double")), page, search)
    contents = blocks.where("end_line is not null").select(page, F.col("line").alias("first_line"), "end_line")
    kept = without_contents(found, contents, page)
    return kept.withColumn("ord", F.row_number().over(W.partitionBy(page).orderBy("first_line")))


def with_tables(blocks: DataFrame, candidates: DataFrame, vision: DataFrame, runs: DataFrame) -> DataFrame:
    """Blocks with a table in place of those that it covers.

    A candidate becomes the first table of ``vision`` (page, ord, rows and box)
    that it matches, or else its own cells with the text of the ``runs`` in
    them, then of doubtful structure; it goes without any text.  A block that a
    table covers by more than half belongs to the first such table, which
    stands where the first of its blocks stood; a table without blocks comes
    last.  What several branches start from is stored; so should ``blocks`` and
    ``runs`` be.
    """
    match = G.matches(candidates, vision).withColumnsRenamed({"a_ord": "ord"})
    seen = vision.select("page", F.col("ord").alias("match"), F.col("rows").alias("v_rows"), *[F.col(c).alias(f"v_{c}") for c in BOX])
    c = staged(candidates.join(match, ["page", "ord"]).join(seen, ["page", "match"], "left"), "matched")
    # a cell's number in its page, for the text of the runs in it
    flat = c.where("match is null").select("page", F.col("ord").alias("t"), F.posexplode("cells").alias("r", "row")).select("page", "t", "r", F.posexplode("row").alias("k", "b"))
    cells = flat.select("page", F.struct("t", "r", "k").alias("ord"), *[F.col(f"b.{x}").alias(x) for x in BOX])
    texts = GL.text_in(runs.select("page", "ord", *BOX, "text", "size", "bold"), cells).select("page", F.col("r_ord").alias("ord"), "text")
    filled = cells.join(texts, ["page", "ord"], "left").select("page", "ord.*", F.coalesce("text", F.lit("")).alias("text"))
    cell = F.struct("text", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    row = filled.groupBy("page", "t", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", cell.alias("c")))), lambda x: x.c).alias("row"), F.max(F.length("text")).alias("longest"))
    grid = row.groupBy("page", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x.row).alias("g_rows"), F.max("longest").alias("longest")).where("longest > 0")
    own = c.join(grid.withColumnRenamed("t", "ord"), ["page", "ord"], "left").where("match is not null or g_rows is not null")
    pick = lambda v, g: F.when(F.col("match").isNotNull(), F.col(v)).otherwise(F.col(g))
    tables = own.select("page", "ord", pick("v_rows", "g_rows").alias("rows"), F.col("match").isNull().alias("structure_suspect"), *[pick(f"v_{x}", x).alias(x) for x in BOX])
    tables = staged(tables, "page-tables")
    claims = G.first_claim(blocks, tables).withColumnsRenamed({"a_ord": "ord"})
    rest = blocks.join(claims, ["page", "ord"], "left_anti").withColumn("key", F.col("ord").cast("double"))
    at = claims.groupBy("page", F.col("claim").alias("t")).agg(F.min("ord").alias("first"))
    placed = tables.withColumnRenamed("ord", "t").join(at, ["page", "t"], "left").withColumn("key", F.coalesce(F.col("first").cast("double"), F.lit(float("inf"))))
    both = rest.unionByName(placed.select("page", "key", "t", F.lit("table").alias("type"), "rows", "structure_suspect", *BOX), allowMissingColumns=True)
    return _renumbered(both, "t")


def _renumbered(blocks: DataFrame, *ties: str) -> DataFrame:
    """Blocks numbered from 0 by ``key``, then the ties' columns, which go."""
    return blocks.withColumn("ord", F.row_number().over(W.partitionBy("page").orderBy("key", *ties)) - 1).drop("key", *ties)


def with_figures(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with the figures of their pages (page, width, height, ink: box array).

    A figure takes the lettering about it, has the nearest short paragraph under
    it as caption and stands before the first block below that shares its width.
    """
    b = B.complete(blocks)
    text = B.plain_text()
    lettering = T.chart_lettering(F.col("type"), text)
    boxed = b.where(F.col("x").isNotNull()).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", *BOX, F.coalesce(lettering, F.lit(False)).alias("lettering")))).alias("texts"))
    found = staged(FG.detect_pages(pages.join(boxed, "page", "left").withColumn("texts", F.coalesce("texts", F.array().cast(boxed.schema["texts"].dataType))).select("page", "width", "height", "ink", "texts")), "page-figures")
    took = found.select("page", F.explode("took").alias("ord")).withColumn("ord", F.col("ord").cast("int"))
    paragraphs = b.where("type = 'paragraph'").withColumn("text", T.trim(F.col("text")))
    fig = found.withColumn("ord", F.col("n"))
    captions = G.nearest_below(fig, paragraphs).select("page", F.col("a_ord").alias("n"), F.col("caption").alias("ord")).join(paragraphs.select("page", "ord", F.col("text").alias("caption")), ["page", "ord"]).drop("ord")
    kept = b.join(took, ["page", "ord"], "left_anti")
    before = G.splice_before(fig, kept).select("page", F.col("a_ord").alias("n"), "before")
    path = F.concat(F.lit("images/"), T.figure_name(F.col("page"), F.col("n")))
    key = F.coalesce(F.col("before") - 0.5, F.lit(float("inf")))
    placed = found.join(before, ["page", "n"]).join(captions, ["page", "n"], "left").select("page", "n", key.alias("key"), F.lit("figure").alias("type"), path.alias("path"), "caption", *BOX)
    return _renumbered(kept.withColumn("key", F.col("ord").cast("double")).unionByName(placed, allowMissingColumns=True), "n")


def text_regions(lines: DataFrame, page: str = "page") -> DataFrame:
    """Regions of a page that its lines show: tables, and paragraphs with their text, level and size, in order.

    The lines are read twice, so hand in a stored table; the tables found are stored here.
    """
    places = ["first_line", "end_line", *BOX]
    tables = staged(TB.detect(lines.withColumn("size_pt", F.col("size").cast("double")), page).select(page, *places), "regions-tables")
    inside = tables.select(F.col(page).alias("t_page"), "first_line", "end_line")
    rest = lines.join(inside, (F.col(page) == F.col("t_page")) & (F.col("ord") >= F.col("first_line")) & (F.col("ord") < F.col("end_line")), "left_anti")
    text = _paragraphs(rest, page).select(page, "line", F.lit("text").alias("kind"), "text", F.when(F.col("is_heading"), F.col("level")).alias("level"), "size", *BOX)
    return running_order([tables.select(page, F.col("first_line").cast("int").alias("line"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), *BOX), text], page)


def vision_regions(blocks: DataFrame) -> DataFrame:
    """Regions of blocks that an OCR engine found; figures and blocks without a place are none."""
    kind = F.when(F.col("type").isin("table", "formula"), F.col("type")).otherwise("text")
    return blocks.where((F.col("type") != "figure") & F.col("x").isNotNull()).select("page", "ord", kind.alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("size"), *BOX)


#: What a region reader gets, and space around a crop.
CROP = 6.0


def read_regions(regions: DataFrame, reader: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str, page_width: float | str, tallest: float) -> DataFrame:
    """Blocks that ``reader`` reads out of the regions of pages, small ones taken together.

    ``reader`` maps frames of (page, region, kind, x, y, w, h), a crop each, to
    rows of ``schema``: page, region, ord, type, text and more.  A heading's
    region gives one heading; pieces take their region's place.  ``page_width``
    is a number or names a column of ``regions``.  The regions are worked out
    once; their crops are stored, as the reader's blocks meet them again.
    """
    numbered = G.coalesce_regions(regions.withColumn("mergeable", (F.col("kind") == "text") & F.col("level").isNull()), ["page"], page_width, tallest, ("ord", "kind", "level", "size", *BOX))
    joined = numbered.groupBy("page", "region").agg(F.min_by("kind", "ord").alias("kind"), F.max("level").alias("level"), F.max("size").alias("size"), *_union())
    joined = staged(joined, "crops")
    crops = joined.select("page", "region", "kind", *[c.alias(n) for c, n in zip(G.inset(*[F.col(x) for x in BOX], -CROP), BOX)])
    read = crops.mapInPandas(reader, schema)
    own = joined.select("page", "region", F.col("level").alias("r_level"), "size", *BOX)
    d = B.complete(read).join(own, ["page", "region"])
    blank = F.col("r_level").isNotNull() & (T.trim(B.plain_text()) == "")
    kept = placed(d, ["page", "region"], F.col("r_level")).where(~blank)
    return _renumbered(kept.withColumnRenamed("ord", "piece").withColumn("key", F.col("region")).drop("r_level", "region"), "piece")


def finish(blocks: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """The four passes over whole documents, in order: furniture, headings below body size,
    bibliography entries, levels.  Blocks carry doc, page, ord, type, text, size, level, y, h, page_height.

    They are read several times, so hand in a stored table; of what is written
    in between, keys and headings, only the headings have texts.
    """
    found = staged(furniture.repeated(furniture.with_keys(blocks)), "furniture")
    kept = furniture.strip(blocks, found).drop("key")
    body = H.body_size(kept.where("type = 'paragraph'"), doc)
    heads = kept.where("type = 'heading'").withColumn("at", F.struct(page, "ord"))
    heads = staged(H.demote_small(heads, body, doc).drop("body_size").withColumnRenamed("kept", "large"), "heads")
    real = staged(H.demote_bibliography(heads.where("large"), doc, "at").withColumnRenamed("kept", "own"), "real")
    levels = H.normalize_levels(real.where("own"), doc)
    names = kept.columns
    as_paragraph = lambda df: df.withColumns({"type": F.lit("paragraph"), "level": F.lit(None).cast("int")}).select(names)
    out = levels.withColumn("level", F.col("new_level")).select(names)
    for part in (as_paragraph(heads.where("not large")), as_paragraph(real.where("not own")), kept.where("type <> 'heading'").select(names)):
        out = out.unionByName(part)
    return out


def convert(lines: DataFrame, pages: DataFrame, vision: DataFrame, doc: str = "doc") -> DataFrame:
    """Blocks of whole documents from the lines of their pages.

    ``lines``: page, ord, text, x, y, w, h, col, size, bold and ``boxes`` (x, x1)
    of what stands in them; ``pages``: page, ``doc``, width, height, ink;
    ``vision``: tables that an OCR engine read (page, ord, rows and box), if any.
    Each stage is written and read again, as several later ones use it.
    """
    lines, pages, vision = staged(lines, "lines"), staged(pages, "pages"), staged(vision, "vision")
    text = staged(page_blocks(lines), "blocks")
    tables = staged(with_tables(text, staged(table_candidates(lines, text), "candidates"), vision, lines), "tables")
    blocks = TB.normalized(B.complete(with_figures(tables, pages)))
    return finish(staged(blocks.join(pages.select("page", doc, F.col("height").alias("page_height")), "page"), "figures"), doc)


def vision_blocks(found: DataFrame, page: str = "page", share: float = 0.6, under_title: float = 0.9) -> DataFrame:
    """An OCR engine's findings (kind table, list, title or paragraph) without the paragraphs that others cover."""
    side = lambda p, df: df.select(page, *[F.col(c).alias(f"{p}{c}") for c in ("ord", "x", "y", "w", "h", "kind")])
    a, b = side("a_", found.where("kind = 'paragraph'")), side("b_", found.where("kind <> 'paragraph'"))
    enough = F.when(F.col("b_kind") == "title", F.lit(under_title)).otherwise(F.lit(share))
    if min(share, under_title) < 0.5:
        both = a.join(b, page)
    else:
        a, b = G.over_middle(a, b)
        both = a.join(b, [page, "q_band"])
    hidden = both.where(G.coverage("a_", "b_") >= enough).select(page, F.col("a_ord").alias("ord")).distinct()
    return found.join(hidden, [page, "ord"], "left_anti")


#: Kinds of list markers that number their items.
NUMBERING = ("lowercaseLatin", "uppercaseLatin", "decimal", "decorativeDecimal", "compositeDecimal")


def vision_tables(cells: DataFrame, keys: tuple[str, ...] = ("page", "ord")) -> DataFrame:
    """``rows`` of tables from an engine's cells (``keys``, row, col, row_end, col_end, text), and whether they look doubtful.

    A cell reaches to row_end and col_end (not in it; null: the next) and stands
    in the row that it starts in; rows in which no cell starts stay, empty.  Tables of
    no cell are none.
    """
    span = lambda a, b: F.greatest(F.coalesce(F.col(b) - F.col(a), F.lit(1)), F.lit(1)).cast("int")
    cell = F.struct(F.coalesce(T.trim(F.col("text")), F.lit("")).alias("text"), span("row", "row_end").alias("row_span"), span("col", "col_end").alias("col_span"))
    row = cells.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("c")))), lambda x: x.c).alias("cells"))
    every = F.collect_list(F.struct("row", "cells"))
    rows = row.groupBy(*keys).agg(F.map_from_entries(every).alias("by"), F.min("row").alias("first"), F.max("row").alias("last"))
    none = F.array().cast(rows.schema["by"].dataType.valueType)
    out = rows.select(*keys, F.transform(F.sequence("first", "last"), lambda i: F.coalesce(F.try_element_at("by", i), none)).alias("rows"))
    return out.withColumn("structure_suspect", TB.suspect(F.col("rows")))


def vision_lists(items: DataFrame, keys: tuple[str, ...] = ("page", "ord")) -> DataFrame:
    """``items`` and ``ordered`` of lists from an engine's items (``keys``, path, text, marker).

    ``path`` numbers an item in its list and, below it, in the lists of the item:
    [2] is the third item, [2, 0, 1] the second of its first list.  One level of
    nesting is kept, deeper items go, and so do items without text; the markers of the
    first level tell whether the list is numbered.
    """
    depth = F.when(F.size("path") == 1, 0).when(F.size("path") == 3, 1)
    text = T.trim(F.coalesce("text", F.lit("")))
    known = items.withColumns({"q_depth": depth, "q_text": text}).where("q_depth is not null")
    one = F.when(F.col("q_text") != "", F.struct("path", F.struct(F.col("q_text").alias("text"), F.col("q_depth").cast("int").alias("depth")).alias("item")))
    numbered = F.coalesce(F.col("marker").isin(*NUMBERING), F.lit(False)) & (F.col("q_depth") == 0)
    return known.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.item).alias("items"), F.max(numbered).alias("ordered"))


def vision_page(found: DataFrame, cells: DataFrame, items: DataFrame, page: str = "page") -> DataFrame:
    """Blocks of an OCR engine's findings: tables with rows, lists with items, paragraphs and headings.

    ``found``: page, ord, kind (table, list, title, paragraph), text, lines, boxes.
    What tables, lists and the title cover is dropped; the title is the one
    heading of level 1, the others start a level lower where there is one.
    """
    kept = staged(vision_blocks(found, page), "found")
    keys = (page, "ord")
    tables = kept.where("kind = 'table'").join(vision_tables(cells, keys), list(keys)).withColumn("type", F.lit("table"))
    lists = kept.where("kind = 'list'").join(vision_lists(items, keys), list(keys)).withColumn("type", F.lit("list"))
    titled = kept.where(T.trim("text") != "")
    title = titled.where("kind = 'title'").withColumns({"type": F.lit("heading"), "level": F.lit(1), "size": F.col("h") / F.greatest(F.col("lines"), F.lit(1))})
    text = titled.where("kind = 'paragraph'").withColumns({"text": T.trim("text"), "lines": F.greatest(F.col("lines"), F.lit(1)), "bold": F.lit(False)})
    text = H.classify(text.withColumn("size", F.col("h") / F.col("lines")), page).join(kept.where("kind = 'title'").select(page, F.lit(1).alias("lower")).distinct(), page, "left")
    text = text.withColumns({"type": F.when(F.col("is_heading"), "heading").otherwise("paragraph"), "level": F.when(F.col("is_heading"), F.least(F.col("level") + F.coalesce("lower", F.lit(0)), F.lit(6)))})
    out = [t.select(page, "ord", "type", *more, *BOX) for t, more in ((tables, ["rows", "structure_suspect"]), (lists, ["items", "ordered"]), (title.withColumn("text", T.trim("text")), ["text", "level", "size"]), (text, ["text", "level", "size"]))]
    both = out[0]
    for t in out[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return B.complete(both)


def placed(pieces: DataFrame, keys: list[str], level: Column) -> DataFrame:
    """A region's pieces, in order: the first is the region's heading if it has a level."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy("ord")) == 1
    head = first & level.isNotNull()
    own = F.col("level") if "level" in pieces.columns else F.lit(None).cast("int")
    return pieces.withColumns({"type": F.when(head, "heading").otherwise(F.col("type")), "level": F.when(head, level).otherwise(own)})
