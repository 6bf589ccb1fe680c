"""Readers: PDF folders, JSON documents, Markdown texts, and pluggable page decoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from quire.operators import geometry as G

#: A JSON document: its own fields, the rest of a block's by name.
DOCUMENT_SCHEMA = """
source struct<filename:string,pages:int,sha256:string>, engine struct<tier:string,model:string,appVersion:string>,
pages array<struct<index:int,width:double,height:double,engine:string,duration:double,
  blocks:array<struct<type:string,level:int,text:string,fontSize:double,confidence:double,ordered:boolean,
    items:array<struct<text:string,depth:int>>,rows:array<array<struct<text:string,rowSpan:int,colSpan:int>>>,
    structureSuspect:boolean,path:string,caption:string,latex:string,isInline:boolean,language:string,bbox:array<double>>>>>,
statistics struct<pages:bigint,characters:bigint,charactersExcludingWhitespace:bigint,words:bigint,estimatedTokens:bigint,blocks:bigint,headings:bigint,tables:bigint,figures:bigint,uncertainTables:bigint>
"""


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content, sha256) of a folder's PDF files, not of its subfolders."""
    return with_sha256(spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "false").load(path))


def with_sha256(files: DataFrame) -> DataFrame:
    """Files and the hash of their ``content``, in lower-case hexadecimal digits."""
    return files.withColumn("sha256", F.sha2("content", 256))


def decode_pages(files: DataFrame, decoder: Callable[[bytes, int, int | None], Iterator[dict]], schema: StructType | str, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows that ``decoder(content, first, last)`` yields for each file, by Arrow batches.

    The page range goes to the decoder, so pages outside it are never opened.
    """
    if first < 0:
        raise ValueError("the first page can't be negative")

    def run(batches):
        for pdf in batches:
            rows = [row for content in pdf["content"] for row in decoder(content, first, last)]
            yield pd.DataFrame(rows)

    return files.select("content").mapInPandas(run, schema)


def has_embedded_fonts(runs: DataFrame, page: str = "page", sample: int = 2000) -> DataFrame:
    """(``page``, ``fonts``): whether a run that starts among a page's first characters names its font.

    ``runs``: page, ord, text, font (null: none told).  The sample is the test's
    own: a page either tells its fonts or doesn't.
    """
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy(page).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("q_at", before).groupBy(page).agg(F.coalesce(F.max((F.col("q_at") < sample) & (F.length("text") > 0) & F.col("font").isNotNull()), F.lit(False)).alias("fonts"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row a document, the schema given and nothing inferred."""
    return spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True)


def document_sources(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where each document is from, what read it and its counts: ``sinks.document_json`` writes them again."""
    return docs.select(key, "source.filename", "source.pages", "source.sha256", "engine.tier", "engine.model", F.col("engine.appVersion").alias("app_version"), "statistics")


def document_pages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.explode("pages").alias("p")).select(key, F.col("p.index").alias("page_index"), "p.width", "p.height", "p.engine", "p.duration")


def document_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The blocks relation of nested documents, in reading order, its columns named as the operators name them."""
    pages = docs.select(key, F.posexplode("pages").alias("page_no", "p"))
    blocks = pages.select(key, "page_no", F.col("p.index").alias("page_index"), F.posexplode("p.blocks").alias("ord", "b"))
    cell = lambda c: F.struct(c.text.alias("text"), F.greatest(F.coalesce(c.rowSpan, F.lit(1)), F.lit(1)).alias("row_span"), F.greatest(F.coalesce(c.colSpan, F.lit(1)), F.lit(1)).alias("col_span"))
    d = blocks.select(key, "page_index", "ord", (F.col("page_no").cast("long") * 1_000_000 + F.col("ord")).alias("pos"), "b.*")
    d = d.withColumns({
        "rows": F.transform("rows", lambda r: F.transform(r, cell)), "level": F.when(F.col("type") == "heading", F.least(F.greatest("level", F.lit(1)), F.lit(6))), "box": G.decode(F.col("bbox")),
    })
    d = d.withColumnsRenamed({"fontSize": "font_size", "structureSuspect": "structure_suspect", "isInline": "is_inline"}).drop("bbox")
    return d.withColumns({c: F.col(f"box.{c}") for c in "xywh"}).drop("box")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, markdown) of whole Markdown or text files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("markdown"))


def math_lines(spark: SparkSession, path: str, limit: int = 6) -> DataFrame:
    """The first lines that hold a dollar, by file and place."""
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))
    return lines.where(F.col("value").contains("$")).orderBy("file", "ord").limit(limit)
