"""Page events as a stream: a document is started, comes page by page and is finished, or fails.

A micro-batch hands on the events of the documents that it brings, under its
number: a batch that runs again writes the same rows to the same place, so a
lost driver costs no event and doubles none.  A running summary is written the
same way, and the last number holds the state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quire.functions import text as T
from quire.storage import shared_dir


def _status(spark: SparkSession, path: str):
    """What lies at a path, in any file system; None if nothing does."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(target) if fs.exists(target) else None


def page_events(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stream of a table of a folder: one file, or a folder of files that more may come to."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    files = spark.readStream.schema(schema)
    if _status(spark, f"{folder}/{name}").isDirectory():
        return files.parquet(f"{folder}/{name}")
    return files.option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder)


def written(spark: SparkSession, schema: StructType | str, path: str) -> DataFrame:
    """What batches wrote below a path; no rows if none has run."""
    if _status(spark, path) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def summary(events: DataFrame) -> DataFrame:
    """Per user (a document) and type: events, the sum of their values and the last time."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("ts").alias("last_ts"))


def document_events(docs: DataFrame, lines_a_page: int = 40) -> DataFrame:
    """(doc_id, seq, event, page_index, blocks, words) of documents (doc_id, text).

    ``started`` and ``finished`` tell the document's pages in ``page_index``; a
    document without a line of text has ``failed`` alone.
    """
    line = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.struct(F.floor(i / lines_a_page).cast("int").alias("page"), t.alias("text")))
    kept = F.filter(line, lambda x: F.length(F.btrim(x.text)) > 0)
    rows = docs.select("doc_id", F.inline_outer(kept))
    pages = rows.groupBy("doc_id", "page").agg(F.count("text").alias("blocks"), F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).alias("words"))
    every = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", "blocks", "words")))).alias("ps"))
    n = F.size("ps")
    total = lambda c: F.aggregate("ps", F.lit(0).cast("bigint"), lambda a, p: a + p[c])
    event = lambda name, seq, page, blocks, words: F.struct(seq.cast("int").alias("seq"), F.lit(name).alias("event"), page.cast("int").alias("page_index"), blocks.cast("bigint").alias("blocks"), words.cast("bigint").alias("words"))
    none = F.lit(None)
    whole = F.concat(
        F.array(event("started", F.lit(0), n, none, none)), F.transform("ps", lambda p, i: event("page", i + 1, p.page, p.blocks, p.words)), F.array(event("finished", n + 1, n, total("blocks"), total("words"))),
    )
    return every.select("doc_id", F.inline(F.when(n > 0, whole).otherwise(F.array(event("failed", F.lit(0), none, none, none)))))


def new_root(spark: SparkSession) -> str:
    """A folder of a stream's own in the shared one."""
    return f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame, mode: str, of: Callable[[DataFrame], DataFrame]) -> str:
    """Run a stream over all there is; ``of`` each batch lies below the folder returned, by its number."""
    root = new_root(spark)

    def keep(batch: DataFrame, number: int) -> None:
        of(batch).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    running = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    running.awaitTermination()
    return f"{root}/out"


def final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all events, as the last batch wrote it."""
    path = _run(spark, summary(page_events(spark, sf_dir, "events.parquet")), "complete", lambda batch: batch)
    out = spark.read.parquet(path)
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).drop("batch")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all documents of the table, from all batches."""
    stream = page_events(spark, sf_dir, "documents.parquet").select("doc_id", "text")
    schema = "doc_id long, seq int, event string, page_index int, blocks long, words long, batch int"
    return written(spark, schema, _run(spark, stream, "append", document_events)).drop("batch")
