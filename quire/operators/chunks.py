"""Retrieval chunks: blocks packed into a token budget within their section."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import blocks as B, text as T
from quire.operators.sections import sections


@dataclass(frozen=True)
class Options:
    target: int = 512
    minimum: int = 64


def _starts(costs: Column, o: Options) -> Column:
    """Places, from 0, of the costs that open a part.  Only these are kept, so long sections cost their length."""
    start = F.struct(F.lit(0).cast("bigint").alias("tokens"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("out"))

    def step(acc, cost):
        cut = (acc.tokens + cost > o.target) & (acc.tokens >= o.minimum)
        return F.struct((F.when(cut, F.lit(0)).otherwise(acc.tokens) + cost).alias("tokens"), (acc.at + 1).alias("at"), F.when(cut, F.concat(acc.out, F.array(acc.at))).otherwise(acc.out).alias("out"))

    return F.aggregate(costs, start, step, lambda acc: acc.out)


def pack(blocks: DataFrame, options: Options = Options()) -> DataFrame:
    """Blocks with sections, ``cost``, Markdown (``md``) and ``part``: a part is closed when the next block would
    overrun the target and it has the minimum already.  No block is split.

    A block costs the tokens of its plain text, 0 without any.  Only positions
    and costs of a section are gathered, never its texts.
    """
    s = sections(B.complete(blocks).withColumn("cost", T.token_estimate(B.plain_text())).withColumn("md", B.markdown()))
    lists = s.groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("pos", "cost"))).alias("xs"))
    starts = lists.withColumn("starts", _starts(F.transform("xs", lambda x: x.cost), options))
    length = lambda i: F.coalesce(F.get("starts", i + 1), F.size("xs")) - F.get("starts", i)
    parts = F.transform("starts", lambda at, i: F.struct((i + 1).alias("part"), F.transform(F.slice("xs", at + 1, length(i)), lambda x: x.pos).alias("ps")))
    of = starts.select("doc_id", "section_no", F.inline(parts)).select("doc_id", "section_no", "part", F.explode("ps").alias("pos"))
    return s.join(of, ["doc_id", "section_no", "pos"])


def chunks(blocks: DataFrame, options: Options = Options()) -> DataFrame:
    """A row a chunk: id, text, path, section, part of parts, pages, tokens, types, neighbours."""
    p = pack(blocks, options)
    xs = F.array_sort(F.collect_list(F.struct("pos", "page_index", "md")))
    g = p.groupBy("doc_id", "section_no", "section_id", "path", "part").agg(xs.alias("xs"), F.array_sort(F.collect_set("type")).alias("types"), F.min("pos").alias("first_pos"))
    g = g.withColumn("part_count", F.max("part").over(W.partitionBy("doc_id", "section_no")))
    g = g.withColumn("text", F.array_join(F.filter(F.transform("xs", lambda x: x.md), lambda m: m != ""), "\n\n"))
    pages = F.transform("xs", lambda x: x.page_index)
    runs = F.filter(F.arrays_zip(pages.alias("p"), F.concat(F.array(F.lit(-1).cast("bigint")), F.slice(pages, F.lit(1), F.size(pages) - 1)).alias("before")), lambda z: z.p != z.before)
    g = g.withColumn("pages", F.transform(runs, lambda z: z.p)).where(T.trim(F.col("text")) != "")
    w = W.partitionBy("doc_id").orderBy("section_no", "part")
    g = g.withColumn("chunk_id", (F.row_number().over(w) - 1).cast("long"))
    return g.select(
        "doc_id", "chunk_id", "text", "path", "section_id", "part", "part_count", "pages", T.token_estimate(F.col("text")).alias("tokens"), "types",
        F.lag("chunk_id").over(w).alias("previous_id"), F.lead("chunk_id").over(w).alias("next_id"),
    )


def context(path: Column, part: Column, parts: Column, text: Column) -> Column:
    """A chunk's text under its breadcrumb."""
    crumb = F.concat(F.array_join(path, " › "), F.when(parts > 1, F.format_string(" (part %d of %d)", part, parts)).otherwise(F.lit("")))
    return F.when(crumb == "", text).otherwise(F.concat(crumb, F.lit("\n\n"), text))


def outline(chunked: DataFrame) -> DataFrame:
    """A row a section, in order of first sight, with its parent: the nearest ancestor that has chunks."""
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages"))))
    s = chunked.groupBy("doc_id", "section_id").agg(
        F.min("chunk_id").alias("first_chunk"), F.sum("tokens").alias("tokens"), pages.alias("pages"),
        F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.min_by("path", "chunk_id").alias("path"),
    )
    s = s.withColumns({"title": F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("Document")), "level": F.size("path")})
    names = F.split("section_id", r"\.")
    up = s.select("doc_id", "section_id", "first_chunk", F.explode(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1)))).alias("k"), names.alias("names"))
    up = up.where(F.col("k") < F.size("names")).withColumn("ancestor", F.array_join(F.slice("names", F.lit(1), F.col("k")), "."))
    there = s.select("doc_id", F.col("section_id").alias("ancestor"), F.col("first_chunk").alias("ancestor_chunk"))
    found = up.join(there, ["doc_id", "ancestor"], "left")
    # a tree is descended from its root: the first missing ancestor ends the walk
    seen = F.min(F.when(F.col("ancestor_chunk").isNull() | (F.col("ancestor_chunk") > F.col("first_chunk")), F.col("k"))).over(W.partitionBy("doc_id", "section_id"))
    parent = found.withColumn("stop", seen).where(F.col("stop").isNull() | (F.col("k") < F.col("stop"))).groupBy("doc_id", "section_id").agg(F.max_by("ancestor", "k").alias("parent_id"), F.max("k").alias("depth"))
    return s.join(parent, ["doc_id", "section_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))).drop("path")


def outline_line(o: DataFrame) -> Column:
    """One indented line of an outline: address, title, tokens and pages."""
    first, last = F.element_at("pages", 1) + 1, F.element_at("pages", -1) + 1
    span = F.when(first == last, F.concat(F.lit("p."), first.cast("string"))).otherwise(F.concat(F.lit("p."), first.cast("string"), F.lit("–"), last.cast("string")))
    return F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("section_id"), F.lit(" "), F.col("title"), F.lit("  ["), F.col("tokens").cast("string"), F.lit(" tokens · "), span, F.lit("]"))
