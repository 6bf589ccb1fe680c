"""The registered queries: each applies an operator to a whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.functions import blocks as BL, maths, text as T
from quire.operators import chunks as C, figures, furniture, geometry as G, glyphs as GL, headings as H, layout as L, markdown as M, search as Q, stats, tables as TB
from quire.operators.sections import sections
from quire.plans import extract as X, route
from quire.plans.engines import Engine
from quire.sources import adapters as A, files, sinks
from quire.storage import staged
from quire.streaming import documents as DS, events as E, pages as PG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return A.table(spark, d, "documents")


def _joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _r(c, n=6):
    return F.round(c, n)


# --- text -----------------------------------------------------------------------


@query
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query
def garbled_ratio(spark, d):
    return _docs(spark, d).select("doc_id", _r(T.garbled_ratio(F.col("text"))).alias("ratio"))


@query
def word_counts(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query
def section_depth(spark, d):
    return A.heading_candidates(spark, d).select("page", "ord", "text", T.section_depth(F.col("text")).alias("depth"))


def _text_lines(spark, d):
    """Every line of every text."""
    return A.document_blocks(spark, d).select("doc_id", "ord", "text")


@query
def chart_label(spark, d):
    return _text_lines(spark, d).select("doc_id", "ord", T.chart_label(F.col("text")).cast("int").alias("chart"))


@query
def citation(spark, d):
    return _text_lines(spark, d).select("doc_id", "ord", T.citation(F.col("text")).cast("int").alias("cite"))


@query
def chart_lettering(spark, d):
    c = A.heading_candidates(spark, d)
    return c.select("page", "ord", T.chart_lettering(F.lit("paragraph"), F.regexp_replace("text", r"^[^ ]* ", "")).cast("int").alias("lettering"))


@query
def bold_font(spark, d):
    p = A.table(spark, d, "part")
    name = F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, F.lit("-SemiBold")).otherwise(F.lit("-Regular")))
    return p.select("p_partkey", T.bold_font(name).cast("int").alias("bold"))


@query
def is_math(spark, d):
    return _text_lines(spark, d).select("doc_id", "ord", T.is_math(F.regexp_replace("text", "[%*]", "^")).cast("int").alias("math"))


@query
def escape_inline(spark, d):
    return _docs(spark, d).select("doc_id", T.escape_inline(F.col("text")).alias("md"))


@query
def escape_cell(spark, d):
    return _docs(spark, d).select("doc_id", T.escape_cell(F.col("text")).alias("cell"))


@query
def unescape(spark, d):
    return _docs(spark, d).select("doc_id", T.unescape(T.escape_inline(F.col("text"))).alias("text"))


@query
def fence(spark, d):
    ticks = F.concat(F.lit("x"), F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int")), F.lit("y"))
    return _docs(spark, d).select("doc_id", T.fence(ticks).alias("fence"))


@query
def encode_path(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.encode_path(F.concat(F.col("url"), F.lit(" é#1"))).alias("path"))


@query
def sha256_file(spark, d):
    return files.with_sha256(_docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("content"))).select("doc_id", "sha256")


@query
def number_format(spark, d):
    return _docs(spark, d).select("doc_id", stats.grouped_number(F.col("n_chars")).alias("n"))


@query
def report_columns(spark, d):
    return _docs(spark, d).select("doc_id", stats.padded(F.col("source"), 4).alias("name"), stats.padded(F.col("n_chars").cast("string"), 8, True).alias("n"))


@query
def figure_names(spark, d):
    return A.boxes(spark, d).select("page", "ord", T.figure_name(F.col("page"), F.col("ord")).alias("name"))


# --- statistics -------------------------------------------------------------------


@query
def document_statistics(spark, d):
    return stats.document_statistics(A.document_blocks(spark, d))


@query
def stats_by_source(spark, d):
    s = stats.document_statistics(A.document_blocks(spark, d))
    src = _docs(spark, d).select("doc_id", "source")
    return s.join(src, "doc_id").groupBy("source").agg(F.sum("pages").alias("pages"), F.sum("blocks").alias("blocks"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))


@query
def page_route(spark, d):
    b = A.boxes(spark, d)
    p = b.groupBy("page").agg(F.sum(F.col("l_linenumber")).alias("characters"), F.sum(G.area(F.col("w"), F.col("h"))).alias("text_area"), F.count("*").alias("lines"), F.max("col").alias("m"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    p = p.withColumns({"area": F.lit(600.0 * 800.0), "garbled": F.col("r") / F.col("lines") / 8, "fonts": F.col("page") % 5 != 0, "multi_column": F.col("m") == 1})
    r = stats.page_route(p)
    return r.select("page", "route", F.array_join("reasons", "; ").alias("reasons"), _r("density").alias("density"), _r("coverage").alias("coverage"))


@query
def engine_mix(spark, d):
    b = A.boxes(spark, d).select((F.floor(F.col("page") / 10)).alias("doc"), F.when(F.col("l_returnflag") == "R", "vision").when(F.col("l_returnflag") == "A", "textLayer").otherwise("ocr").alias("engine"))
    return stats.engine_mix(b, "doc")


@query
def total_duration(spark, d):
    e = A.table(spark, d, "events").withColumn("duration", F.when(F.col("user_id") % 3 != 0, F.col("value")))
    return stats.total_duration(e, "event_type").select("event_type", _r("seconds", 3).alias("seconds"))


@query
def recovery_ratio(spark, d):
    b = A.document_blocks(spark, d)
    return stats.recovery(b.where("ord % 2 = 0"), b, "doc_id").select("doc_id", "read_words", "layer_words", _r("ratio").alias("ratio"))


# --- sections, chunks, search --------------------------------------------------------


@query
def sections_of(spark, d):
    return sections(A.conversation_blocks(spark, d)).select("doc_id", "pos", "section_no", "section_id", F.array_join("path", " / ").alias("path"), "depth")


@query
def chunk_pack(spark, d):
    return C.pack(A.conversation_blocks(spark, d), C.Options(target=120, minimum=20)).select("doc_id", "pos", "section_id", "part", "cost")


def _chunks(spark, d, **o):
    return C.chunks(A.conversation_blocks(spark, d), C.Options(**o))


@query
def chunks_of(spark, d):
    c = _chunks(spark, d, target=120, minimum=20)
    return c.select("doc_id", "chunk_id", "text", "section_id", "part", "part_count", _joined("pages").alias("pages"), "tokens", F.array_join("types", ",").alias("types"), "previous_id", "next_id")


@query
def chunk_context(spark, d):
    c = _chunks(spark, d, target=120, minimum=20)
    return c.select("doc_id", "chunk_id", C.context(F.col("path"), F.col("part"), F.col("part_count"), F.col("text")).alias("context"))


@query
def outline(spark, d):
    o = C.outline(_chunks(spark, d))
    return o.select("doc_id", "section_id", "parent_id", "depth", "title", "level", "tokens", _joined("pages").alias("pages"), _joined("chunk_ids").alias("chunk_ids"), "first_chunk")


@query
def outline_text(spark, d):
    o = C.outline(_chunks(spark, d))
    lines = F.array_sort(F.collect_list(F.struct("first_chunk", C.outline_line(o).alias("line"))))
    return o.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("outline"))


@query
def read_section(spark, d):
    return Q.section(_chunks(spark, d), "1").select("doc_id", "chunk_id", "section_id", "tokens")


@query
def read_section_alone(spark, d):
    return Q.section(_chunks(spark, d), "1", False).select("doc_id", "chunk_id", "section_id", "tokens")


@query
def search_topk(spark, d):
    return Q.search(_chunks(spark, d), "user the, and ST that", 8).select("doc_id", "chunk_id", "section_id", _r("score").alias("score"))


@query
def read_chunk_neighbours(spark, d):
    return Q.around(_chunks(spark, d), 1, 1).select("doc_id", "chunk_id", F.length(Q.excerpt(F.col("text"))).alias("n"))


@query
def render_markdown(spark, d):
    return sinks.document_markdown(A.conversation_blocks(spark, d))


@query
def parse_markdown(spark, d):
    p = M.parse_markdown(render_markdown(spark, d), "doc_id", "markdown")
    return p.select("doc_id", "ord", "type", "level", "text")


@query
def jsonl_chunks(spark, d):
    c = _chunks(spark, d)
    return c.select("doc_id", "chunk_id", sinks.chunk_json(c).alias("json"))


@query
def json_document(spark, d):
    return sinks.document_json(A.conversation_blocks(spark, d))


@query
def plain_text(spark, d):
    b = BL.complete(A.conversation_blocks(spark, d))
    return b.select("doc_id", "pos", BL.plain_text().alias("text"))


# --- headings and furniture -------------------------------------------------------------


@query
def heading_body_sizes(spark, d):
    return H.page_body_sizes(A.heading_candidates(spark, d))


@query
def classify_headings(spark, d):
    return H.classify(A.heading_candidates(spark, d)).select("page", "ord", F.col("is_heading").cast("int").alias("is_heading"), "level")


def _paras(spark, d):
    return A.heading_candidates(spark, d).withColumn("doc", F.floor(F.col("page") / 12))


@query
def body_size(spark, d):
    return H.body_size(_paras(spark, d).where("not bold"))


@query
def demote_small(spark, d):
    heads = _paras(spark, d).where("bold").withColumn("text", F.when(F.col("ord") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^[^ ]* ", "")))
    return H.demote_small(heads, H.body_size(_paras(spark, d).where("not bold"))).select("page", "ord", F.col("kept").cast("int").alias("kept"))


@query
def demote_bibliography(spark, d):
    heads = _paras(spark, d).where("bold").withColumn("text", F.when(F.col("ord") % 53 == 0, F.lit(" References ")).otherwise(F.col("text")))
    return H.demote_bibliography(heads, "page").select("page", "ord", F.col("kept").cast("int").alias("kept"))


@query
def size_tiers(spark, d):
    c = A.heading_candidates(spark, d)
    return c.groupBy("page").agg(_joined(H.tiers(F.collect_list("size"))).alias("tiers"))


@query
def normalize_levels(spark, d):
    heads = A.heading_candidates(spark, d).withColumn("level", F.lit(1)).withColumn("text", F.when(F.col("page") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^[^ ]* ", "")))
    return H.normalize_levels(heads, "page").select("page", "ord", "new_level")


@query
def furniture_keys(spark, d):
    return furniture.with_keys(A.source_pages(spark, d)).select("doc", "page", "ord", "key")


@query
def furniture_found(spark, d):
    return furniture.repeated(furniture.with_keys(A.source_pages(spark, d)))


@query
def strip_furniture(spark, d):
    return furniture.strip(A.source_pages(spark, d)).select("doc", "page", "ord", "type")


# --- geometry --------------------------------------------------------------------------


@query
def box_algebra(spark, d):
    b = A.boxes(spark, d)
    n = b.select("page", (F.col("ord") + 1).alias("ord"), *[F.col(c).alias(f"n_{c}") for c in "xywh"])
    j = b.select("page", "ord", *[F.col(c).alias(f"m_{c}") for c in "xywh"]).join(n, ["page", "ord"])
    x, y, w, h = G.clamp(*G.inset(*[F.col(f"m_{c}") for c in "xywh"], 1.0), F.lit(400.0), F.lit(90.0))
    return j.select("page", "ord", _r(G.overlap("m_", "n_"), 4).alias("overlap"), _r(G.coverage("m_", "n_"), 4).alias("coverage"), _joined(G.encode(x, y, w, h)).alias("box"))


@query
def box_union_agg(spark, d):
    u = A.boxes(spark, d).groupBy("page").agg(*G.union_box())
    return u.select("page", *[_r(c, 4).alias(c) for c in "xywh"])


@query
def coverage_anti(spark, d):
    b = A.boxes(spark, d)
    return G.uncovered(b.where("ord % 4 <> 0"), b.where("ord % 4 = 0")).select("page", F.col("a_ord").alias("ord"))


@query
def claim_first(spark, d):
    b = A.boxes(spark, d)
    return G.first_claim(b.where("ord % 4 <> 0"), b.where("ord % 4 = 0"))


@query
def table_match(spark, d):
    b = A.boxes(spark, d)
    return G.matches(b.where("ord % 4 <> 0"), b.where("ord % 4 = 0"))


@query
def caption_nearest(spark, d):
    b = A.boxes(spark, d).withColumn("text", F.col("l_returnflag"))
    return G.nearest_below(b.where("ord % 5 = 0"), b.where("ord % 5 <> 0")).select("page", "a_ord", "caption", _r("gap", 4).alias("gap"))


@query
def splice_order(spark, d):
    b = A.boxes(spark, d)
    return G.splice_before(b.where("ord % 5 = 0"), b.where("ord % 5 <> 0"))


@query
def segments(spark, d):
    s = G.segments(A.boxes(spark, d), ["page", "l_linenumber"], F.lit(12.0))
    return s.select("page", "l_linenumber", "segment", _r("x", 4).alias("x"), _r("x1", 4).alias("x1"), "n")


@query
def corridors(spark, d):
    c = G.corridors(A.boxes(spark, d), ["page", "l_linenumber"], 9.0)
    return c.select("page", "l_linenumber", _r("low", 4).alias("low"), _r("high", 4).alias("high"))


@query
def row_blocks(spark, d):
    return G.row_blocks(A.boxes(spark, d), ["page"], F.lit(4.0)).select("page", "ord", "block")


@query
def row_cluster(spark, d):
    return G.rows_of(A.boxes(spark, d), ["page"])


@query
def coalesce_regions(spark, d):
    b = A.boxes(spark, d).withColumn("mergeable", F.col("l_returnflag") != "R")
    return G.coalesce_regions(b, ["page"], 3000.0, 60.0)


def _spread(spark, d):
    """Boxes of pages in two columns or four, on some pages crossed by others; some without a place."""
    b = A.boxes(spark, d)
    two = F.when(F.col("col") == 1, 330 + F.col("x") / 10).otherwise(F.col("x") / 10)
    four = 40 + F.col("col") * 300 + (F.col("l_partkey") % 2) * 140 + F.col("x") / 25
    columns, across = F.col("page") % 3 == 1, (F.col("page") % 4 == 0) & (F.col("ord") % 8 == 0)
    x = F.round(F.when(columns, four).otherwise(two), 3)
    w = F.round(F.when(across, F.lit(380.0)).when(columns, F.lit(80.0)).otherwise(F.col("w") * 2.2), 3)
    lost = F.col("ord") % 50 == 49
    return b.select("page", "ord", *[F.when(~lost, c).alias(n) for n, c in (("x", x), ("y", F.col("y")), ("w", w), ("h", F.col("h")))])


@query
def page_gutter(spark, d):
    return G.gutters(_spread(spark, d), 600.0)


@query
def reading_order(spark, d):
    return G.reading_order(_spread(spark, d), 600.0)


# --- layout, lists, tables -----------------------------------------------------------------


def _lines(spark, d):
    j = A.heading_candidates(spark, d, *"xywh", "col")
    text = F.when(F.col("ord") % 6 == 0, F.col("text")).otherwise(F.regexp_replace("text", r"^[^ ]* ", ""))
    return j.withColumn("text", F.when(F.col("ord") % 4 == 1, F.concat(text, F.lit("-"))).otherwise(text)).withColumns({"y": F.round(F.col("ord") * 11.0 + F.col("y") / 20, 3), "x": F.round(F.col("x") / 40, 3), "col": F.floor(F.col("ord") / 30).cast("int")})


@query
def paragraphs(spark, d):
    return L.paragraphs(_lines(spark, d)).select("page", "ord", "paragraph")


@query
def paragraph_texts(spark, d):
    return L.paragraph_texts(L.paragraphs(_lines(spark, d)))


@query
def column_measure(spark, d):
    return L.column_measure(_lines(spark, d)).select("page", "ord", "measure")


@query
def contents_lists(spark, d):
    return L.contents_lists(A.nav_lines(spark, d)).select("page_id", "ord", "item", "depth")


@query
def list_numbering(spark, d):
    return L.list_numbers(A.order_items(spark, d)).select("doc_id", "ord", "depth", "number")


def _tables(spark, d):
    return A.order_tables(spark, d)


@query
def table_width(spark, d):
    return _tables(spark, d).select("doc_id", TB.width(F.col("rows")).alias("width"), F.size("rows").alias("height"))


@query
def table_confidence(spark, d):
    t = _tables(spark, d)
    ragged = F.transform("rows", lambda r, i: F.when(i % 3 == 2, F.slice(r, 1, 2)).otherwise(r))
    t = t.withColumn("rows", F.when(F.col("doc_id") % 2 == 0, ragged).otherwise(F.col("rows")))
    s, u = TB.suspect(F.col("rows")), TB.doubtful(F.col("rows"))
    return t.select("doc_id", s.cast("int").alias("suspect"), u.cast("int").alias("doubtful"), (s & u).cast("int").alias("flagged"))


@query
def bullet_lists(spark, d):
    mark = lambda c: F.when(c.text == "R", F.lit("•")).when(c.text == "A", F.lit("-")).otherwise(F.lit(""))
    two = F.transform("rows", lambda r: F.transform(F.slice(r, 1, 2), lambda c, i: F.struct(F.when(i == 0, mark(c)).otherwise(c.text).alias("text"), c.row_span.alias("row_span"), c.col_span.alias("col_span"))))
    items = TB.bullet_list(F.col("rows"))
    return _tables(spark, d).withColumn("rows", two).select("doc_id", F.array_join(items, "|").alias("items"))


@query
def render_table(spark, d):
    return _tables(spark, d).select("doc_id", TB.table_markdown(F.col("rows"), F.col("doc_id") % 2 == 0).alias("markdown"))


@query
def flatten_spans(spark, d):
    spanned = F.transform("rows", lambda r, i: F.transform(r, lambda c, j: F.struct(c.text.alias("text"), F.when((i % 3 == 0) & (j == 0), 2).otherwise(1).alias("row_span"), c.col_span.alias("col_span"))))
    g = TB.flattened(_tables(spark, d).withColumn("rows", spanned), "doc_id", "rows")
    return g.select("doc_id", F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "/").alias("grid"))


@query
def detect_tables(spark, d):
    b = A.boxes(spark, d)
    cells = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((i * 150.0 + F.col("ord") % 5).alias("x"), (i * 150.0 + F.when(F.col("ord") % 20 < 14, 90.0).otherwise(170.0)).alias("x1")))
    lines = b.select("page", "ord", (F.col("ord") * 14.0).alias("y"), "h", F.lit(10.0).alias("size_pt"), F.lit(0).alias("col"), cells.alias("boxes"))
    t = TB.detect(lines)
    cells = F.array_join(F.transform(F.flatten("cells"), lambda c: F.format_string("%.1f:%.1f:%.1f:%.1f", c.x, c.y, c.w, c.h)), " ")
    return t.select("page", "first_line", "end_line", "columns", *[_r(c, 3).alias(c) for c in "xywh"], cells.alias("cells"))


@query
def figures_of(spark, d):
    b = A.boxes(spark, d)
    box = F.struct("ord", (F.col("x") % 560).alias("x"), ((F.col("y") * 7) % 760).alias("y"), F.col("w").alias("w"), F.lit(30.0).alias("h"), (F.col("l_returnflag") == "R").alias("lettering"))
    some = lambda c: F.array_sort(F.collect_list(F.when(c, box)))
    p = b.groupBy("page").agg(some(F.col("ord") % 3 == 0).alias("ink"), some(F.col("ord") % 3 != 0).alias("texts"))
    f = figures.detect_pages(p.withColumns({"width": F.lit(600.0), "height": F.lit(800.0)}))
    return f.select("page", "n", *[_r(c, 3).alias(c) for c in "xywh"], _joined("took").alias("took"))


@query
def math_display(spark, d):
    t = F.concat(F.lit("$\\frac{x_{"), F.col("p_size").cast("string"), F.lit("}}{\\alpha^2}$ of "), "p_name")
    return A.table(spark, d, "part").select("p_partkey", maths.display_udf(t).alias("text"))


@query
def page_event_stream(spark, d):
    return E.final_state(spark, d)


@query
def document_event_stream(spark, d):
    return E.converted(spark, d)


@query
def page_stream(spark, d):
    return PG.converted(spark, d)


@query
def streamed_documents(spark, d):
    return DS.converted(spark, d).select(F.col("doc_id").alias("doc"), F.col("page_index").cast("long").alias("page"), "ord", "type", "level")


@query
def model_answers(spark, d):
    fenced = F.concat(F.lit("```md\n"), F.regexp_replace("text", "`", "'"), F.lit(" $ x^2 $\n```"))
    return _docs(spark, d).select("doc_id", maths.clean_model_output(fenced).alias("text"))


# --- glyphs and whole plans -----------------------------------------------------------


@query
def glyph_scan(spark, d):
    b = A.boxes(spark, d).withColumns({"w": F.when(F.col("ord") % 10 == 0, 0.0).otherwise(F.col("w") * 4), "x": F.col("x") - 20})
    return GL.scan(b, 600.0, 120.0).select("page", "ord", *[_r(c, 3).alias(c) for c in "xywh"])


@query
def text_in_rect(spark, d):
    b = A.boxes(spark, d).withColumns({"text": F.concat(F.lit("w"), F.col("ord").cast("string")), "size": F.col("l_linenumber").cast("double"), "bold": F.col("l_returnflag") != "N"})
    rects = b.where("ord % 25 = 0").select("page", "ord", "x", "y", (F.col("w") * 3).alias("w"), (F.col("h") * 2).alias("h"))
    return GL.text_in(b.select("page", "ord", "x", "y", "w", "h", "text", "size", "bold"), rects).select("page", F.col("r_ord").alias("ord"), "text", "size", F.col("bold").cast("int").alias("bold"))


def _glyphs(spark, d, *more):
    """Two columns of glyphs with some rows across, most pages; ``more`` columns of their boxes go along."""
    b = A.boxes(spark, d)
    across = F.col("ord") % 30 == 0
    x = F.when(across, 60.0).when(F.col("ord") % 2 == 0, 40.0 + (F.col("l_partkey") % 18) * 12).otherwise(330.0 + (F.col("l_suppkey") % 18) * 12)
    return b.select("page", "ord", x.alias("x"), (F.floor(F.col("ord") / 2) * 12.0).alias("y"), F.when(across, 420.0).otherwise(10.0).alias("w"), "h", *more)


@query
def column_gutters(spark, d):
    return GL.column_gutters(_glyphs(spark, d), 600.0, 800.0, 80).select("page", _r("center", 4).alias("center"), _r("half", 4).alias("half"))


@query
def arrange_rows(spark, d):
    return GL.arrange(_glyphs(spark, d), 600.0, 800.0, 80)


@query
def contents_exclude(spark, d):
    b = A.boxes(spark, d)
    span = lambda c, end: b.where(c).select("page", F.col("ord").alias("first_line"), (F.col("ord") + end).alias("end_line"))
    return X.without_contents(span("ord % 4 = 0", F.col("l_linenumber")), span("ord % 4 <> 0", F.lit(1)))


@query
def vision_blocks(spark, d):
    b = A.boxes(spark, d)
    kind = F.when(F.col("ord") == 5, "title").when(F.col("ord") % 6 == 0, "table").otherwise("paragraph")
    return X.vision_blocks(b.select("page", "ord", "x", "y", "w", "h", kind.alias("kind"))).select("page", "ord", "kind")


@query
def place_headings(spark, d):
    b = A.boxes(spark, d).select("page", "l_linenumber", "ord", F.lit("paragraph").alias("type"), "l_returnflag")
    level = F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber"))
    return X.placed(b, ["page", "l_linenumber"], level).select("page", "ord", "type", "level")


@query
def figure_pages(spark, d):
    b = A.boxes(spark, d).withColumn("page_index", F.col("page"))
    name = F.format_string("images/p%03d-fig%02d.png", F.col("page") + 1, F.col("ord"))
    fig = b.select("page", "page_index", F.when(F.col("ord") % 20 == 0, "figure").otherwise("paragraph").alias("type"), name.alias("path"), *"xywh")
    pages = b.groupBy("page", "page_index").agg(F.max("x").alias("width"), F.max("y").alias("height"))
    return sinks.figure_crops(fig, pages, "page").select("page", "path", *[_r(c, 3).alias(c) for c in ("x", "y", "w", "h", "width", "height")])


@query
def document_report(spark, d):
    r = stats.document_report(A.conversation_blocks(spark, d), A.conversation_pages(spark, d))
    return r.select("doc_id", "pages", "blocks", "headings", "tables", "figures", *[_r(c, 4).alias(c) for c in ("per_page", "seconds", "seconds_per_page")])


@query
def embedded_fonts(spark, d):
    font = F.when(F.col("ord") % 40 >= 36, F.lit("Times"))
    return files.has_embedded_fonts(A.document_blocks(spark, d).select("doc_id", "ord", "text", font.alias("font")), "doc_id").select("doc_id", F.col("fonts").cast("int").alias("fonts"))


@query
def box_decode(spark, d):
    b = A.boxes(spark, d)
    unit = G.from_unit(*[F.col(c) / 1000 for c in "xywh"], F.lit(600.0), F.lit(800.0))
    c = G.decode(G.encode(*unit))
    return b.select("page", "ord", *[c[n].alias(n) for n in "xywh"])


@query
def extract_pages(spark, d):
    return X.page_blocks(staged(_lines(spark, d), "lines")).select("page", "ord", "type", "level", "text")


@query
def finish_documents(spark, d):
    kind = F.when((F.col("type") == "heading") | (F.length("text") <= 40), "heading").otherwise("paragraph")
    size = F.when(kind == "heading", 9 + F.length("text") % 3 * 1.5).otherwise(9.0)
    b = A.source_pages(spark, d).withColumns({"size": size, "level": F.when(kind == "heading", 1), "type": kind})
    return X.finish(b).select("doc", "page", "ord", "type", "level")


def _sheets(spark, d):
    """Lines of pages with what stands in them, pages with ink, and tables that an OCR engine read."""
    cells = F.when(F.col("ord") % 24 < 6, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((i * 150.0).alias("x"), (i * 150.0 + 90.0).alias("x1")))).otherwise(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(400.0).alias("x1"))))
    lines = _lines(spark, d).withColumns({"y": F.col("ord") * 11.0, "h": F.lit(10.0), "x": F.lit(0.0), "w": F.lit(400.0), "boxes": cells})
    box = F.struct(F.lit(420.0).alias("x"), (F.col("ord") * 11.0).alias("y"), F.lit(150.0).alias("w"), F.lit(200.0).alias("h"))
    pages = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.when(F.col("ord") == 20, box))).alias("ink")).withColumns({"doc": F.floor(F.col("page") / 12), "width": F.lit(600.0), "height": F.lit(2000.0)})
    text = F.struct(F.col("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    vision = lines.where("ord % 24 = 2 and page % 2 = 0").select("page", "ord", F.array(F.array(text)).alias("rows"), "x", (F.col("y") - 11).alias("y"), "w", F.lit(40.0).alias("h"))
    return lines, pages, vision


@query
def convert_documents(spark, d):
    """From lines to the Markdown of whole documents."""
    b = X.convert(*_sheets(spark, d))
    return sinks.document_markdown(b.withColumnsRenamed({"page": "page_index"}).withColumn("pos", F.struct("page_index", "ord")), "doc")


@query
def read_regions(spark, d):
    """Regions of pages, read by a stand-in for a model."""
    def reader(frames):
        for f in frames:
            yield f[["page", "region", "kind"]].assign(ord=0, type="paragraph", text=[f"{k} {int(w)}x{int(h)}" for k, w, h in zip(f["kind"], f["w"], f["h"])])[["page", "region", "ord", "type", "text"]]

    lines, _, _ = _sheets(spark, d)
    r = X.read_regions(X.text_regions(staged(lines, "lines")), reader, "page long, region int, ord int, type string, text string", 600.0, 60.0)
    return r.select("page", "ord", "type", "level", "text", *[_r(c, 3).alias(c) for c in "xywh"])


def _layer(spark, d):
    """A text layer: boxes of glyphs, and as many runs with text, most pages in two columns."""
    b = _glyphs(spark, d, "l_suppkey", "l_returnflag")
    wide = F.col("ord") % 30 == 0
    text = F.when(F.col("ord") % 41 == 7, "").when(wide, F.concat(F.lit("Wide "), F.col("ord").cast("string"))).otherwise(F.concat(F.lit("w"), F.col("ord").cast("string"), F.when(F.col("ord") % 9 == 0, "-").otherwise("")))
    size = F.when(wide, 14.0).otherwise(10.0 + F.col("l_suppkey") % 2)
    return b.select("page", "ord", *"xywh"), b.select("page", "ord", *"xywh", text.alias("text"), size.alias("size"), (F.col("l_returnflag") == "R").alias("bold"))


@query
def glyph_lines(spark, d):
    """From glyphs and runs to lines with text, type and segments."""
    lines = GL.lines(*_layer(spark, d), 600.0, 800.0, 80)
    return lines.select("page", "ord", "text", "col", "size", F.col("bold").cast("int").alias("bold"), *[_r(c, 3).alias(c) for c in "xywh"], F.size("boxes").alias("glyphs"), F.array_join(F.transform("segments", lambda s: s.text), "|").alias("segments"))


@query
def glyph_blocks(spark, d):
    """From glyphs and runs to a page's blocks."""
    lines = staged(GL.lines(*_layer(spark, d), 600.0, 800.0, 80), "lines")
    return X.page_blocks(lines).select("page", "ord", "type", "level", "text")


class _Measuring:
    """Stands in for a model: says what it was shown."""

    @staticmethod
    def _said(f):
        return [f"{k} {math.floor(w)}x{math.floor(h)}" for k, w, h in zip(f["kind"], f["w"], f["h"])]

    def regions(self, f):
        return f[["page", "region"]].assign(ord=0, type="paragraph", text=self._said(f))

    def pages(self, f):
        return f[["page"]].assign(region=0, ord=0, type="paragraph", text=self._said(f))


#: Reads by regions.
STAND_IN = Engine("reader", _Measuring, "page long, region int, ord int, type string, text string", prefers_regions=True, tallest=120.0)


@query
def routed_pages(spark, d):
    """Pages by text layer, by the regions of their lines, by those that an OCR engine found, or whole."""
    bare, broken = F.col("page") % 7 == 3, F.col("page") % 3 == 1
    whole = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(400.0).alias("x1")))
    lines = _lines(spark, d).where(~bare).withColumn("boxes", whole)
    b = A.boxes(spark, d)
    pages = b.groupBy("page").agg(F.count("*").alias("lines"), F.sum(G.area(F.col("w"), F.col("h"))).alias("text_area"))
    pages = pages.withColumns({
        "width": F.lit(600.0), "height": F.lit(2000.0), "area": F.lit(480000.0), "characters": F.when(bare, 0).otherwise(F.col("lines") * 40), "lines": F.when(bare, 0).otherwise(F.col("lines")),
        "garbled": F.when(broken, 0.2).otherwise(0.0), "fonts": F.lit(True), "multi_column": F.lit(False),
    })
    vision = b.where(bare & (F.col("page") % 2 == 0) & (F.col("ord") % 10 == 0)).select("page", "ord", F.when(F.col("ord") % 20 == 0, "table").otherwise("paragraph").alias("type"), F.lit(None).cast(BL.FIELDS["rows"]).alias("rows"), *"xywh")
    return route.convert_pages(pages, lines, vision, STAND_IN).select("page", "ord", "type", "level", "text", "engine")


@query
def vision_page(spark, d):
    """An OCR engine's findings as blocks: tables from cells with spans, lists from nested items."""
    b = A.boxes(spark, d)
    kind = F.when(F.col("ord") == 5, "title").when(F.col("ord") % 6 == 0, "table").when(F.col("ord") % 11 == 0, "list").otherwise("paragraph")
    text = F.concat(F.lit("Text "), F.col("l_partkey").cast("string"))
    found = b.select("page", "ord", *"xywh", kind.alias("kind"), text.alias("text"), (1 + F.col("ord") % 2).cast("int").alias("lines"))
    n = F.col("ord").cast("string")
    cells = b.where("ord % 6 = 0 and ord <> 5").select("page", "ord", "l_suppkey", F.posexplode(F.sequence(F.lit(0), F.lit(5))).alias("i", "q")).select(
        "page", "ord", F.floor(F.col("i") / 2).cast("int").alias("row"), (F.col("i") % 2).cast("int").alias("col"), F.floor(F.col("i") / 2 + F.when(F.col("i") == 0, 2).otherwise(1)).cast("int").alias("row_end"),
        F.when((F.col("i") == 3) & (F.col("l_suppkey") % 2 == 0), 3).cast("int").alias("col_end"), F.concat(F.lit(" c"), n, F.lit("."), F.col("i").cast("string"), F.lit(" ")).alias("text"))
    cells = cells.where("not (ord % 12 = 0 and row = 1)")
    paths = F.array(*[F.struct(F.array(*map(F.lit, p)).alias("path")) for p in ((0,), (0, 0, 0), (0, 0, 1), (1,), (1, 0, 0, 0, 0), (2,))])
    items = b.where("ord % 11 = 0 and ord % 6 <> 0").select("page", "ord", "l_suppkey", F.inline(paths)).select(
        "page", "ord", "path", F.when(F.element_at("path", 1) == 1, " ").otherwise(F.concat(F.lit("item "), F.array_join(F.transform("path", lambda x: x.cast("string")), "."))).alias("text"),
        F.when(F.col("l_suppkey") % 2 == 0, "decimal").otherwise("bullet").alias("marker"))
    v = X.vision_page(found, cells, items)
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.format_string("%s:%d:%d", c.text, c.row_span, c.col_span)), "|")), "/")
    said = F.array_join(F.transform("items", lambda x: F.concat(x.depth.cast("string"), F.lit(" "), x.text)), "|")
    return v.select("page", "ord", "type", "level", F.when(F.col("type").isin("heading", "paragraph"), F.col("text")).alias("text"), rows.alias("rows"), F.col("structure_suspect").cast("int").alias("suspect"), said.alias("items"), F.col("ordered").cast("int").alias("ordered"))
