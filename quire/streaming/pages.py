"""Pages as a stream: a document is started by its first page and finished by its last, over any number of batches.

A state a document holds which pages have come and their counts, never their
texts.  Pages go out as they come, each once; the counts of the whole document
when its last page has come; a document whose pages stay away for too long has
failed.  What comes of a document that has ended, or of a page for the second
time, is dropped, so a page that is sent again makes no event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType

from quire.functions import text as T
from quire.streaming import events as E

EVENT = "doc_id long, seq int, event string, page_index int, blocks long, words long"
#: Events that carry a text: when they came and when their document started, in milliseconds.
CARRYING = f"{EVENT}, at long, since long, body string"
EVENT_ROW = Row(*(c.split()[0] for c in EVENT.split(", ")))
#: Pages of a document that are held at once.
STRETCH = 10_000
BATCH = IntegerType()
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FALLOCATE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pages(StatefulProcessor):
    """Events of a document from its pages (page_index, pages, blocks, words); ``patience`` in seconds.

    A document's state is one value and at most one timer, so it costs a read
    and a write a batch, however many pages come.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n int, blocks long, words long, ended boolean, since long, due long, seen array<int>")

    #: What the events of pages hand on.
    carry: tuple[str, ...] = ()

    def _parts(self, rows: Iterator[Row]) -> Iterator[list]:
        """Rows in stretches that are sorted and held at once."""
        while part := list(islice(rows, STRETCH)):
            yield sorted(part, key=lambda r: r.page_index)

    def _events(self, key, rows: list[tuple], at: int, since: int) -> Iterable:
        return [EVENT_ROW(key[0], *r) for r in rows]

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        known, now = self.total.get(), timerValues.getCurrentProcessingTimeInMs()
        n, blocks, words, ended, since, due, seen = known if known is not None else (0, 0, 0, False, now, None, ())
        if ended:
            for _ in rows:
                pass
            return
        here, pages = set(seen), None
        # events go out part by part: the texts of one are held at a time
        for part in self._parts(rows):
            out = []
            for r in part:
                if known is None and pages is None:
                    out.append((0, "started", int(r.pages), None, None))
                pages, index = int(r.pages), int(r.page_index)
                if index in here:
                    continue
                here.add(index)
                n, blocks, words = n + 1, blocks + int(r.blocks), words + int(r.words)
                out.append((n, "page", index, int(r.blocks), int(r.words), *(getattr(r, c) for c in self.carry)))
            if out:
                yield from self._events(key, out, now, since)
        if due is not None:
            self.handle.deleteTimer(due)
            due = None
        if pages is not None and n >= pages:
            ended, here = True, ()
        else:
            due = now + self.patience * 1000
            self.handle.registerTimer(due)
        self.total.update((n, blocks, words, ended, since, due, sorted(here)))
        if ended:
            yield from self._events(key, [(n + 1, "finished", pages, blocks, words)], now, since)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        n, blocks, words, ended, since, *_ = self.total.get()
        self.total.update((n, blocks, words, True, since, None, []))
        if not ended:
            yield from self._events(key, [(n + 1, "failed", None, blocks, words)], timerValues.getCurrentProcessingTimeInMs(), since)

    def close(self) -> None:
        pass


class CarryingPages(Pages):
    """The same by frames, for events that hand texts on: ``carry`` names their columns.

    All events also tell their time and their document's first.
    """

    def __init__(self, patience: int, carry: Sequence[str]):
        super().__init__(patience)
        self.carry = tuple(carry)

    def _parts(self, rows: Iterator[pd.DataFrame]) -> Iterator[Iterable]:
        for frame in rows:
            yield frame.sort_values("page_index").itertuples(index=False)

    def _events(self, key, rows: list[tuple], at: int, since: int) -> Iterable:
        names = [c.split()[0] for c in EVENT.split(", ")]
        out = pd.DataFrame([(key[0], *r[:5]) for r in rows], columns=names)
        out = out.astype({"seq": "Int32", "page_index": "Int32", "blocks": "Int64", "words": "Int64"})
        out["at"], out["since"] = at, since
        for i, c in enumerate(self.carry):
            out[c] = pd.Series([r[5 + i] if len(r) > 5 else None for r in rows], dtype=object)
        return [out]


def page_stream(pages: DataFrame, patience: int = 3600, carry: Sequence[str] = ()) -> DataFrame:
    """Events (``EVENT``) of a stream of pages: doc_id, page_index, ``pages`` (how many the document has), blocks, words.

    ``seq`` numbers a document's pages as they come.  With ``carry`` (one text,
    ``body``) the events are ``CARRYING``.  The session's state store must be
    RocksDB's; ``start`` sees to it.
    """
    rows = pages.select("doc_id", "page_index", "pages", "blocks", "words", *carry).groupBy("doc_id")
    if carry:
        return rows.transformWithStateInPandas(CarryingPages(patience, carry), CARRYING, "Append", "ProcessingTime")
    return rows.transformWithState(Pages(patience), EVENT, "Append", "ProcessingTime")


def pages_of(docs: DataFrame, lines_a_page: int = 40) -> DataFrame:
    """Pages of documents (doc_id, text) with a line of text: the counts of each, and how many there are."""
    # a page is a slice of the lines, so that a long document costs no more for each of them than a short one
    d = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    texts = lambda p: F.filter(F.slice("lines", p * lines_a_page + 1, lines_a_page), lambda t: F.length(F.btrim(t)) > 0)
    every = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / lines_a_page).cast("int")), lambda p: F.struct(p.alias("page_index"), texts(p).alias("texts")))
    d = d.select("doc_id", F.filter(every, lambda p: F.size(p.texts) > 0).alias("whole"))
    d = d.select("doc_id", F.size("whole").alias("pages"), F.inline("whole"))
    words = F.aggregate("texts", F.lit(0).cast("bigint"), lambda a, t: a + T.word_count(t))
    return d.select("doc_id", "page_index", "pages", F.size("texts").cast("bigint").alias("blocks"), words.alias("words"))


def start(spark: SparkSession, events: DataFrame, keep: Callable[[DataFrame, int], None], root: str) -> None:
    """Hand all that there is of a stream of events to ``keep``, batch by batch; the log at ``root`` is carried on from."""
    # a run ends with what there is: it must not wait for the patience of documents that are not whole yet
    # many partitions with little state each: none takes disk in advance
    own = {PROVIDER: ROCKS, FALLOCATE: "false", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        events.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark: SparkSession, stream: DataFrame, root: str, patience: int = 3600) -> DataFrame:
    """All events so far of a stream of pages; what lies at ``root`` is carried on from, by batch number."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    start(spark, page_stream(stream, patience), keep, root)
    return E.written(spark, f"{EVENT}, batch int", f"{root}/out")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all documents of the table whose pages come as a stream."""
    stream = pages_of(E.page_events(spark, sf_dir, "documents.parquet").select("doc_id", "text"))
    return run(spark, stream, E.new_root(spark)).drop("batch")
