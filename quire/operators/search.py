"""Reading a chunked document: sections, neighbours, ranked lexical search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import trim

MATCH_WEIGHT = 3.0


def section(chunks: DataFrame, section_id: str, with_subsections: bool = True) -> DataFrame:
    own = F.col("section_id") == section_id
    return chunks.where(own | F.col("section_id").startswith(section_id + ".") if with_subsections else own)


def around(chunks: DataFrame, chunk_id: int, neighbours: int = 1) -> DataFrame:
    if neighbours < 0:
        raise ValueError("neighbours can't be negative")
    there = chunks.where(F.col("chunk_id") == chunk_id).select("doc_id")  # documents without the chunk give nothing
    return chunks.where(F.col("chunk_id").between(chunk_id - neighbours, chunk_id + neighbours)).join(there, "doc_id", "left_semi")


def terms(query: str) -> list[str]:
    """Lower-case runs of letters and digits of two or more; repeats stay."""
    out, run = [], ""
    for c in query.lower() + " ":
        if c.isalnum():
            run += c
        else:
            if len(run) > 1:
                out.append(run)
            run = ""
    return out


def occurrences(t: Column, term: Column) -> Column:
    """Times that a string stands in another, without overlap."""
    return F.floor((F.length(t) - F.length(F.replace(t, term, F.lit("")))) / F.length(term))


def search(chunks: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The best chunks of each document together: log-damped matches, titles three times, times the share of terms met."""
    if limit < 0:
        raise ValueError("limit can't be negative")
    words = terms(query)
    if not words:
        return chunks.withColumn("score", F.lit(0.0)).where(F.lit(False))
    body, title = F.lower("text"), F.lower(F.array_join("path", " "))
    each = []
    for w in words:
        n, m = occurrences(body, F.lit(w)), occurrences(title, F.lit(w))
        each.append(F.struct((F.log1p(n.cast("double")) + MATCH_WEIGHT * m).alias("s"), ((n > 0) | (m > 0)).cast("int").alias("hit")))
    total = F.aggregate(F.array(*each), F.lit(0.0), lambda a, x: a + x.s)
    met = F.aggregate(F.array(*each), F.lit(0), lambda a, x: a + x.hit)
    scored = chunks.withColumn("score", total * met / F.lit(float(len(words))))
    return scored.where("score > 0").orderBy(F.desc(F.round("score", 9)), "doc_id", "chunk_id").limit(limit)


def excerpt(t: Column, length: int = 700) -> Column:
    return F.left(trim(t), F.lit(length))
