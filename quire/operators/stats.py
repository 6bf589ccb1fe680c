"""Document statistics, page routing, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T
from quire.functions.blocks import complete, plain_text

DENSITY, GARBLED = 0.08, 0.04


def document_statistics(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counts of a document; its text is its blocks' plain texts joined by newlines, so tokens are rounded once."""
    blocks = complete(blocks).withColumn("text", plain_text())
    n = F.count("*")
    solid = F.sum(F.length(T.solid(F.col("text"))))
    dense = F.sum(T.count_of(T.solid(F.col("text")), T.DENSE))
    kind = lambda k: F.count_if(F.col("type") == k)
    return blocks.groupBy(doc).agg(
        F.count_distinct("page_index").alias("pages"), (F.sum(F.length("text")) + n - 1).cast("long").alias("characters"), solid.alias("solid_characters"),
        F.sum(T.word_count(F.col("text"))).alias("words"), F.round((solid - dense) / F.lit(3.8) + dense * F.lit(1.1)).cast("long").alias("tokens"),
        n.alias("blocks"), kind("heading").alias("headings"), kind("table").alias("tables"), kind("figure").alias("figures"),
        F.count_if((F.col("type") == "table") & F.col("structure_suspect")).alias("uncertain_tables"),
    )


def page_route(pages: DataFrame) -> DataFrame:
    """Pages (characters, area, text_area, garbled, fonts, lines, multi_column) with route, reasons, density and coverage."""
    area = F.col("area")
    density = F.when(area > 0, F.col("characters") / (area / 1000)).otherwise(F.lit(0.0))
    has = F.col("characters") > 0
    sparse, broken = density < DENSITY, F.col("garbled") > GARBLED
    fontless, lineless = has & ~F.col("fonts"), has & (F.col("lines") == 0)
    bad = F.array_compact(F.array(
        F.when(sparse, F.lit("sparse")), F.when(broken, F.lit("garbled")), F.when(fontless, F.lit("no fonts")), F.when(lineless, F.lit("no geometry")),
        F.when(F.col("multi_column"), F.lit("multi-column")),
    ))
    return pages.withColumns({
        "density": density, "coverage": F.when(area > 0, F.least(F.lit(1.0), F.col("text_area") / area)).otherwise(F.lit(0.0)),
        "route": F.when(sparse | broken | fontless | lineless, F.lit("needsOCR")).otherwise(F.lit("textLayer")),
        "reasons": F.when(F.size(bad) == 0, F.array(F.lit("clean"))).otherwise(bad),
    })


def total_duration(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Seconds that a document's pages took in all; pages that tell none count nothing."""
    return pages.groupBy(doc).agg(F.sum(F.coalesce(F.col("duration").cast("double"), F.lit(0.0))).alias("seconds"))


def engine_mix(pages: DataFrame, doc: str, engine: str = "engine") -> DataFrame:
    return pages.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_set(engine)), "+").alias("engines"))


def recovery(read: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    """Words read over words in the text layer, per key."""
    a = read.groupBy(key).agg(F.sum(T.word_count(F.col("text"))).alias("read_words"))
    b = layer.groupBy(key).agg(F.sum(T.word_count(F.col("text"))).alias("layer_words"))
    return b.join(a, key, "left").select(key, F.coalesce("read_words", F.lit(0)).alias("read_words"), "layer_words", F.when(F.col("layer_words") > 0, F.coalesce("read_words", F.lit(0)) / F.col("layer_words")).otherwise(F.lit(0.0)).alias("ratio"))


def document_report(blocks: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages, blocks, headings, tables and figures of each document, characters a page, and seconds in all and a page.

    ``pages`` has ``doc``, ``page_index`` and ``duration`` (null: none told); pages without blocks count.
    """
    kind = lambda k: F.count_if(F.col("type") == k)
    b = complete(blocks).groupBy(doc).agg(F.count("*").alias("blocks"), kind("heading").alias("headings"), kind("table").alias("tables"), kind("figure").alias("figures"), F.sum(F.length(plain_text())).alias("characters"))
    p = pages.groupBy(doc).agg(F.count_distinct("page_index").alias("pages"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("seconds"))
    a_page = lambda c: F.when(F.col("pages") > 0, F.col(c) / F.col("pages")).otherwise(F.lit(0.0))
    return p.join(b, doc, "left").na.fill(0).select(doc, "pages", "blocks", "headings", "tables", "figures", a_page("characters").alias("per_page"), "seconds", a_page("seconds").alias("seconds_per_page"))


def grouped_number(n: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(n, 0)


def padded(t: Column, width: int, right: bool = False) -> Column:
    """Cut or filled to a width."""
    return F.lpad(F.left(t, F.lit(width)), width, " ") if right else F.rpad(F.left(t, F.lit(width)), width, " ")
