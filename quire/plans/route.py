"""Routed conversion: each page by its text layer or by an engine, and each page to read by the best regions that it has.

A page's route is told by its own text layer (``operators.stats.page_route``).
Pages by text layer become blocks from their lines; such a page without any
block is read after all.  An engine that reads pages gets whole ones.  One that
reads regions gets, page by page, the regions of the page's lines; if it has
none, those of what an OCR engine found on it; if it has none either, the page
as a whole.  Each branch is one plan over all of its pages: which pages a
branch has is a semi or anti join on the page, never a loop.

Pages without anything to read give no blocks.  Rows of ``lines`` or ``vision``
whose page isn't among ``pages`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import blocks as B
from quire.operators import stats
from quire.plans import extract as X
from quire.plans.engines import Engine, read_pages, reader
from quire.storage import staged

TEXT_LAYER, VISION = "textLayer", "vision"


def _of(df: DataFrame, pages: DataFrame) -> DataFrame:
    return df.join(pages.select("page"), "page", "left_semi")


def _not_of(df: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        df = df.join(o.select("page").distinct(), "page", "left_anti")
    return df


def regions_by_page(pages: DataFrame, lines: DataFrame, vision: DataFrame) -> DataFrame:
    """Regions of each page from the first source that has any: its lines, else what an OCR engine found."""
    own = staged(X.text_regions(_of(lines, pages)), "own-regions")
    seen = X.vision_regions(_not_of(_of(vision, pages), own))
    return own.select("page", "ord", "kind", "text", "level", "size", *X.BOX).unionByName(seen.withColumn("ord", F.col("ord").cast(own.schema["ord"].dataType)))


def read_by_engine(pages: DataFrame, lines: DataFrame, vision: DataFrame, engine: Engine) -> DataFrame:
    """Blocks of pages (page, width, height) that the engine reads, with the ``engine`` of each page."""
    if not engine.prefers_regions:
        return B.complete(read_pages(pages, engine)).withColumn("engine", F.lit(engine.id))
    regions = staged(regions_by_page(pages, lines, vision).join(pages.select("page", F.col("width").alias("page_width")), "page"), "regions")
    parts = X.read_regions(regions, reader(engine, "regions"), engine.schema, "page_width", engine.tallest).withColumn("engine", F.lit(engine.by_region))
    whole = B.complete(read_pages(_not_of(pages, regions), engine)).withColumn("engine", F.lit(engine.id))
    return parts.unionByName(whole.drop("region"), allowMissingColumns=True)


def convert_pages(pages: DataFrame, lines: DataFrame, vision: DataFrame, engine: Engine, force: bool = False) -> DataFrame:
    """Blocks of all pages (page, ord, type, its fields, box, ``engine``).

    ``pages``: page, width, height and what ``page_route`` takes; ``lines``: as
    ``extract.page_blocks`` takes them, with ``boxes``; ``vision``: blocks that
    an OCR engine found (page, ord, type, rows, box), whose tables confirm those
    of the text layer and whose places are regions where a page has no lines.
    ``force`` reads every page.
    """
    routed = staged(stats.page_route(pages).select("page", "width", "height", F.when(F.lit(force), "needsOCR").otherwise(F.col("route")).alias("route")), "routes")
    lines, vision = staged(lines, "lines"), staged(vision, "vision")
    by_text = routed.where("route = 'textLayer'")
    own = staged(_of(lines, by_text), "own-lines")
    text = staged(X.page_blocks(own), "blocks")
    found = staged(X.table_candidates(own, text), "candidates")
    tables = _of(vision.where("type = 'table'"), by_text).select("page", "ord", "rows", *X.BOX)
    converted = B.complete(X.with_tables(text, found, tables, own)).join(found.select("page").distinct().withColumn("confirmed", F.lit(True)), "page", "left")
    converted = converted.withColumn("engine", F.when(F.col("confirmed"), F.lit(VISION)).otherwise(F.lit(TEXT_LAYER))).drop("confirmed")
    to_read = staged(routed.where("route <> 'textLayer'").unionByName(_not_of(by_text, text)).drop("route"), "to-read")
    return converted.unionByName(read_by_engine(to_read, lines, vision, engine), allowMissingColumns=True)
