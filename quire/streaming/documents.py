"""Documents converted while their pages stream in: previews of what has come, whole-document passes at the end.

A page comes with its blocks as one JSON text (``body``), so whatever fields
blocks have pass through.  Which pages count, and when a document has all of
them, is for ``streaming.pages`` to say; its events carry the bodies of the
pages it lets in, each once.  A batch writes its events under its number.  When
documents end in it, their pages are read back from the batches since the first
of them started, older files being skipped by the times that they hold, and the
passes over whole documents run once, over all that ended in the batch
together.  A batch that runs again writes the same rows to the same places.

Documents that failed, and those that have not ended, are in previews only.
Pages without a block count as pages and give no rows; a stream without files
gives none either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quire.plans import extract as X
from quire.sources import adapters as A, sinks
from quire.storage import discarding
from quire.streaming import events as E, pages as PG


#: Documents that end in a batch whose ids are broadcast; with more, the pages of the batches move to them.
BROADCAST = 1_000_000
#: Of the files in a stream's folder, which stay and hold all texts.
CODEC = "zstd"


def page_rows(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Rows that the stream takes, from pages (doc_id, page_index, pages) with an array of blocks, in order."""
    return pages.select("doc_id", F.col("page_index").cast("int").alias("page_index"), "pages", F.size(blocks).cast("long").alias("blocks"), F.lit(0).cast("long").alias("words"), F.to_json(blocks).alias("body"))


def _opened(rows: DataFrame, schema: StructType) -> DataFrame:
    """Blocks of rows with a ``body``."""
    return rows.select("doc_id", "page_index", F.inline(F.from_json("body", ArrayType(schema))))


def _events(spark: SparkSession, root: str) -> DataFrame:
    return E.written(spark, f"{PG.CARRYING}, batch int", f"{root}/out")


def finished(blocks: DataFrame) -> DataFrame:
    """The passes over whole documents, for blocks of documents that have all of their pages."""
    named = {"doc_id": "doc", "page_index": "page"}
    return X.finish(blocks.withColumnsRenamed(named)).withColumnsRenamed({v: k for k, v in named.items()})


def run(spark: SparkSession, stream: DataFrame, schema: StructType, root: str, patience: int = 3600) -> DataFrame:
    """Blocks of all documents that have ended so far; what lies at ``root`` is carried on from.

    ``stream``: as ``page_rows`` gives it; ``schema``: of one block, with what
    ``extract.finish`` needs.
    """
    out = StructType([StructField("doc_id", stream.schema["doc_id"].dataType), StructField("page_index", stream.schema["page_index"].dataType), *schema])

    def keep(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}", compression=CODEC)
        ended = _events(own, root).where((F.col("batch") == number) & (F.col("event") == "finished")).select("doc_id", "since")
        since, n = ended.agg(F.min("since"), F.count("*")).first()
        path = f"{root}/documents/batch={number}"
        if since is None:
            own.createDataFrame([], out).write.mode("overwrite").parquet(path)
            return
        pages = _events(own, root).where((F.col("event") == "page") & (F.col("at") >= since) & (F.col("batch") <= number))
        ids = ended.select("doc_id")
        whole = _opened(pages.join(F.broadcast(ids) if n <= BROADCAST else ids, "doc_id", "left_semi"), schema)
        with discarding():
            finished(whole).select(out.names).write.mode("overwrite").parquet(path, compression=CODEC)

    PG.start(spark, PG.page_stream(stream, patience, carry=("body",)), keep, root)
    return E.written(spark, StructType([*out, StructField("batch", PG.BATCH)]), f"{root}/documents").drop("batch")


def preview(spark: SparkSession, root: str, schema: StructType, everything: bool = False) -> DataFrame:
    """Markdown of the blocks so far (doc_id, pages_so_far, markdown) of documents that have not ended, or of all.

    Pages stand in order, whatever order they came in, without markers; no pass
    over the whole document has run yet.
    """
    events = _events(spark, root)
    open_ = events if everything else events.join(events.where(F.col("event").isin("finished", "failed")).select("doc_id"), "doc_id", "left_anti")
    pages = open_.where("event = 'page'")
    blocks = _opened(pages, schema).withColumn("pos", F.struct("page_index", "ord"))
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages_so_far"))
    return n.join(sinks.document_markdown(blocks), "doc_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))


#: Pages of a document in the registered queries.
SHEETS = 64

BLOCK = "type string, ord int, text string, y double, h double, page_height double, size double, level int"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of a table's rows as pages; every ``SHEETS`` ids are one document, of as many pages as there are rows."""
    number = F.floor(F.col("doc_id") / SHEETS).cast("long")
    there = A.table(spark, sf_dir, "documents").groupBy(number.alias("doc_id")).agg(F.count("*").cast("int").alias("pages"))
    pages = A.page_arrays(E.page_events(spark, sf_dir, "documents.parquet")).select(number.alias("doc_id"), F.col("page").alias("page_index"), "page_height", "blocks")

    def full(b):
        kind = F.when((b.type == "heading") | (F.length(b.text) <= 40), "heading").otherwise("paragraph")
        size = F.when(kind == "heading", 9 + F.length(b.text) % 3 * 1.5).otherwise(9.0)
        return F.struct(kind.alias("type"), b.ord.alias("ord"), b.text.alias("text"), b.y.alias("y"), b.h.alias("h"), F.col("page_height").alias("page_height"), size.alias("size"), F.when(kind == "heading", 1).alias("level"))

    return page_rows(pages.withColumn("blocks", F.transform("blocks", full)).join(there, "doc_id"))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents of the table, converted as its pages streamed in."""
    return run(spark, sheets(spark, sf_dir), spark.createDataFrame([], BLOCK).schema, E.new_root(spark))
