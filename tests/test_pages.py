"""Engines, routes, lines from glyphs, data sources of documents and the stream of pages."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F
from pyspark.sql.types import DoubleType, StructField

from quire.operators import fold, glyphs as GL, tables as TB
from quire.plans import engines, extract as X, route
from quire.sources import documents, files, sinks
from quire.streaming import documents as DS, events as E, pages as PG

LINE = "page long, ord int, text string, x double, y double, w double, h double, col int, size double, bold boolean, boxes array<struct<x:double,x1:double>>"
VISION = "page long, ord int, type string, rows array<array<struct<text:string,row_span:int,col_span:int>>>, x double, y double, w double, h double"


def counting(folder):
    """Loads a stand-in that leaves a file whenever it is loaded; made here, so that workers needn't import this file."""

    class Counting:
        def __init__(self):
            open(f"{folder}/{os.getpid()}-{id(self)}", "w").close()

        def pages(self, f):
            return pd.DataFrame({"page": f["page"], "region": 0, "ord": 0, "type": "paragraph", "text": [f"whole at {d:.0f} dpi" for d in f["dpi"]]})

        def regions(self, f):
            return pd.DataFrame({"page": f["page"], "region": f["region"], "ord": 0, "type": "paragraph", "text": f["kind"]})

    return lambda: Counting()


READ = "page long, region int, ord int, type string, text string"


def test_an_engine_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)
    engine = engines.Engine("counting", counting(folder), READ, dpi=200.0)
    pages = spark.range(60).select(F.col("id").alias("page"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height")).repartition(12)
    for _ in range(3):
        assert {r["text"] for r in engines.read_pages(pages, engine).collect()} == {"whole at 200 dpi"}
    workers = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(workers) == len(set(workers)) < 12


def page_rows():
    page = lambda p, **k: dict(dict(page=p, width=600.0, height=800.0, area=480000.0, characters=1000, text_area=1e5, garbled=0.0, fonts=True, lines=2, multi_column=False), **k)
    return [page(0), page(1, garbled=0.5), page(2, characters=0, lines=0), page(3, characters=0, lines=0), page(4)]


@pytest.mark.parametrize("regions", [True, False])
def test_pages_go_where_they_can_be_read(spark, tmp_path, regions):
    folder = str(tmp_path)
    engine = engines.Engine(f"routes{regions}", counting(folder), READ, prefers_regions=regions)
    pages = spark.createDataFrame([tuple(r.values()) for r in page_rows()], "page long, width double, height double, area double, characters long, text_area double, garbled double, fonts boolean, lines long, multi_column boolean")
    whole = [(50.0, 300.0)]
    # page 4 claims text but has none
    lines = [(p, i, t, 50.0, 20.0 + 40 * i, 250.0, 10.0, 0, 10.0, False, whole) for p in (0, 1) for i, t in enumerate(("some prose here", "and a second paragraph"))] + [(4, 0, "  ", 50.0, 20.0, 250.0, 10.0, 0, 10.0, False, whole)]
    vision = [(2, 0, "table", None, 0.0, 0.0, 100.0, 100.0), (2, 1, "figure", None, 0.0, 200.0, 100.0, 100.0), (2, 2, "paragraph", None, 0.0, 400.0, 100.0, 20.0), (1, 0, "paragraph", None, 0.0, 0.0, 9.0, 9.0)]
    got = route.convert_pages(pages, spark.createDataFrame(lines, LINE), spark.createDataFrame(vision, VISION), engine).orderBy("page", "ord").collect()
    said = [(r["page"], r["ord"], r["text"], r["engine"]) for r in got]
    text = [(0, 0, "some prose here", "textLayer"), (0, 1, "and a second paragraph", "textLayer")]
    layout, own = engine.by_region, engine.id
    if regions:
        assert said == text + [(1, 0, "text", layout), (1, 1, "text", layout), (2, 0, "table", layout), (2, 1, "text", layout), (3, 0, "whole at 150 dpi", own), (4, 0, "whole at 150 dpi", own)]
    else:
        assert said == text + [(p, 0, "whole at 150 dpi", own) for p in (1, 2, 3, 4)]
    forced = route.convert_pages(pages, spark.createDataFrame(lines, LINE), spark.createDataFrame(vision, VISION), engine, force=True)
    assert {r["engine"] for r in forced.where("page = 0").collect()} == {layout if regions else own}


def test_lines_from_glyphs(spark):
    """A line with a wide space has two segments; a run counts where its middle lies; rows without text are none."""
    glyphs = [(0, i, 10.0 + 6 * i, 10.0, 5.0, 10.0) for i in range(10)] + [(0, 10 + i, 200.0 + 6 * i, 11.0, 5.0, 9.0) for i in range(5)] + [(0, 20, 10.0, 40.0, 5.0, 10.0), (0, 21, 10.0, 60.0, 30.0, 12.0)]
    runs = [(0, 0, 10.0, 10.0, 60.0, 10.0, "left  part", 10.0, False), (0, 1, 200.0, 11.0, 30.0, 9.0, "right", 12.0, True), (0, 2, 10.0, 60.0, 30.0, 12.0, "below", None, True), (1, 3, 10.0, 10.0, 60.0, 10.0, "another page", 10.0, False)]
    df = spark.createDataFrame(glyphs, "page long, ord int, x double, y double, w double, h double")
    rf = spark.createDataFrame(runs, "page long, ord int, x double, y double, w double, h double, text string, size double, bold boolean")
    a, b = GL.lines(df, rf, 600.0, 800.0).orderBy("ord").collect()
    assert (a["ord"], a["text"], a["size"], a["bold"], a["col"], len(a["boxes"])) == (0, "left part right", 12.0, False, 0, 15)
    assert [(s["text"], s["x"], s["w"]) for s in a["segments"]] == [("left part", 10.0, 59.0), ("right", 200.0, 29.0)]
    assert (b["ord"], b["text"], b["size"], b["bold"], [s["text"] for s in b["segments"]]) == (1, "below", 12.0, True, ["below"])
    blocks = X.page_blocks(GL.lines(df, rf, 600.0, 800.0)).orderBy("ord").collect()
    assert " ".join(r["text"] for r in blocks) == "left part right below"
    assert GL.lines(df.where("page > 9"), rf, 600.0, 800.0).count() == 0


def test_tables_and_lists_of_an_engine(spark):
    cells = [(0, 0, 0, 0, 1, 2, " head "), (0, 0, 0, 2, None, None, None), (0, 0, 2, 0, 3, 1, "a"), (0, 0, 2, 1, 4, 3, "b")]
    (t,) = X.vision_tables(spark.createDataFrame(cells, "page int, ord int, row int, col int, row_end int, col_end int, text string")).collect()
    assert [[tuple(c) for c in r] for r in t["rows"]] == [[("head", 1, 2), ("", 1, 1)], [], [("a", 1, 1), ("b", 2, 2)]]
    items = [(0, 0, [0], " one ", "bullet"), (0, 0, [0, 0, 1], "under two", "decimal"), (0, 0, [0, 0, 0], "under one", None), (0, 0, [1], " ", "decimal"), (0, 0, [0, 0, 0, 0, 0], "too deep", None), (0, 1, [0], "x", "bullet")]
    a, b = X.vision_lists(spark.createDataFrame(items, "page int, ord int, path array<int>, text string, marker string")).orderBy("ord").collect()
    assert [tuple(i) for i in a["items"]] == [("one", 0), ("under one", 1), ("under two", 1)] and a["ordered"] and not b["ordered"]


def test_a_pass_carries_its_state_over_batches(spark):
    df = spark.range(25_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("ord"))

    def make():
        n = 0

        def step(ord):
            nonlocal n
            n += 1
            return (n,)

        return step

    from pyspark.sql.types import IntegerType, StructField

    got = fold.fold(df, ["k"], ["ord"], ["ord"], ["ord"], [StructField("n", IntegerType())], make)
    assert got.where("n <> floor(ord / 3) + 1").count() == 0 and got.count() == 25_000


def test_many_lines_are_searched_for_tables_in_no_time():
    import time

    import numpy as np

    row = np.array([(0.0, 90.0), (150.0, 240.0), (300.0, 390.0)])
    began = time.monotonic()
    (a, b, edges), = TB.windows_of_columns([row] * 2000, np.full(2000, 10.0))
    assert (a, b, len(edges)) == (0, 2000, 3)
    broken = [row if i % 20 < 14 else np.array([(0.0, 400.0)]) for i in range(2000)]
    assert len(TB.windows_of_columns(broken, np.full(2000, 10.0))) == 100
    assert time.monotonic() - began < 3


# --- data sources ------------------------------------------------------------------


def test_only_wanted_pages_are_opened(spark, tmp_path):
    opened = str(tmp_path / "opened")

    def decoder(content, first, last):
        for i, page in enumerate(content.split(b"|")[first:last], first):
            with open(opened, "a") as f:
                f.write(f"{i}\n")
            yield {"page": i, "text": page.decode()}

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.pdf").write_bytes(b"|".join(b"page %d" % i for i in range(20)))
    (folder / "a.PDF").write_bytes(b"only")
    (folder / "c.txt").write_bytes(b"no")
    read = lambda **k: documents.read_pages(spark, str(folder), decoder, "text string", **k)
    assert read().count() == 21
    os.remove(opened)
    got = read().where("page >= 5 and page < 8").collect()
    assert [(os.path.basename(r["file"]), r["page"], r["text"]) for r in got] == [("b.pdf", i, f"page {i}") for i in (5, 6, 7)]
    assert sorted(open(opened).read().split()) == ["5", "6", "7"]
    whole = read(pages_per_task=6, count=lambda f: f.read().count(b"|") + 1)
    assert whole.rdd.getNumPartitions() == 5 and whole.count() == 21 and whole.where("page = 7").count() == 1
    assert documents.read_pages(spark, str(folder), decoder, "text string", ending=".none").count() == 0


def test_documents_are_written_together(spark, tmp_path):
    b = spark.createDataFrame([(1, 0, 0, "paragraph", "one"), (2, 0, 0, "paragraph", "two")], "doc_id int, page_index int, pos long, type string, text string")
    names = spark.createDataFrame([(1, "/in/first.v2.pdf"), (2, "second")], "doc_id int, filename string")
    chunk = spark.createDataFrame([(1, 1, '{"b":2}'), (1, 0, '{"a":1}'), (2, 0, "{}")], "doc_id int, chunk_id int, json string")
    outline = spark.createDataFrame([(1, "[]"), (2, "[]")], "doc_id int, json string")
    folder = str(tmp_path / "out")
    frames = {"markdown": sinks.document_markdown(b), "json": sinks.document_json(b), "chunks": chunk, "outline": outline}
    for d in (1, 2):  # one after the other: the second leaves the first alone
        paths = sinks.export({k: f.where(F.col("doc_id") == d) for k, f in frames.items()}, folder, names=names)
    assert sorted(os.listdir(folder)) == sorted(f"{s}{e}" for s in ("first.v2", "second") for e in (".md", ".json", ".chunks.jsonl", ".outline.json"))
    assert open(f"{folder}/first.v2.md").read() == "one\n" and open(f"{folder}/first.v2.chunks.jsonl").read() == '{"a":1}\n{"b":2}\n' and json.load(open(f"{folder}/second.json"))
    assert paths["markdown"] == f"{folder}/*.md"
    both = spark.createDataFrame([(1, "x.pdf"), (2, "x.txt")], "doc_id int, filename string")
    with pytest.raises(Exception, match="two documents"):
        sinks.export({"markdown": frames["markdown"]}, str(tmp_path / "twice"), names=both)
    seen = lambda name: [f for f in os.listdir(tmp_path / name) if not f.startswith(".")]
    assert seen("twice") == []
    with pytest.raises(Exception):
        documents.write_files(spark.createDataFrame([("ok", b"1"), ("../out", b"2")], "file string, content binary"), str(tmp_path / "failed"))
    assert seen("failed") == [] and not (tmp_path / "out2").exists()


def test_a_document_comes_back_whole(spark, tmp_path):
    whole = {
        "source": {"filename": "a.pdf", "pages": 2, "sha256": "x"}, "engine": {"tier": "fast", "appVersion": "1"},
        "pages": [{"index": 0, "width": 600.0, "height": 800.0, "engine": "textLayer", "duration": 0.5, "blocks": [{"type": "heading", "level": 1, "text": "A title"}, {"type": "table", "rows": [[{"text": "a", "rowSpan": 1, "colSpan": 2}]], "structureSuspect": True}]}, {"index": 1, "width": 600.0, "height": 800.0, "engine": "vision", "blocks": []}],
        "statistics": {"pages": 2, "characters": 9, "charactersExcludingWhitespace": 7, "words": 3, "estimatedTokens": 2, "blocks": 2, "headings": 1, "tables": 1, "figures": 0, "uncertainTables": 1},
    }
    (tmp_path / "a.json").write_text(json.dumps(whole))
    docs = files.json_documents(spark, str(tmp_path)).withColumn("doc_id", F.lit(1))
    out = sinks.document_json(files.document_blocks(docs), pages=files.document_pages(docs), documents=files.document_sources(docs).drop("statistics"))
    assert json.loads(out.first()["json"]) == whole
    bare = sinks.document_json(files.document_blocks(docs.where("doc_id = 9")), pages=files.document_pages(docs.where("doc_id = 9")), documents=files.document_sources(docs))
    assert json.loads(bare.first()["json"])["pages"] == []


# --- plans that stay small -------------------------------------------------------------


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_glyphs_are_dealt_by_page_and_not_again(spark):
    glyphs = spark.createDataFrame([(0, 1, 10.0, 10.0, 5.0, 10.0)], "page long, ord int, x double, y double, w double, h double")
    runs = glyphs.selectExpr("*", "'a' as text", "10d as size", "false as bold")
    assert exchanges(GL.column_gutters(glyphs, 600.0, 800.0)) == 1 and exchanges(GL.arrange(glyphs, 600.0, 800.0)) == 2
    assert exchanges(GL.lines(glyphs, runs, 600.0, 800.0)) <= 5
    assert exchanges(X.page_blocks(spark.createDataFrame([], LINE))) <= 3


def test_regions_are_worked_out_once(spark, monkeypatch):
    searched, detect = [], TB.detect
    monkeypatch.setattr(TB, "detect", lambda *a: searched.append(0) or detect(*a))
    lines = spark.createDataFrame([(0, i, f"text {i}", 10.0, 20.0 * i, 300.0, 10.0, 0, 10.0, False, [(10.0, 310.0)]) for i in range(3)], LINE)
    read = X.read_regions(X.text_regions(lines), lambda frames: (f[["page", "region", "kind"]].assign(ord=0, type="paragraph", text=f["kind"])[["page", "region", "ord", "type", "text"]] for f in frames), "page long, region int, ord int, type string, text string", 600.0, 60.0)
    # neither the search nor the numbering of regions is part of what remains
    assert len(searched) == 1 and "MapInArrow" not in read._jdf.queryExecution().executedPlan().toString() and exchanges(read) <= 4
    assert {r["text"] for r in read.collect()} == {"text"}


def test_figures_are_looked_for_once(spark):
    blocks = spark.createDataFrame([(0, 0, "paragraph", "Text", 10.0, 400.0, 300.0, 20.0)], "page long, ord int, type string, text string, x double, y double, w double, h double")
    pages = spark.createDataFrame([(0, 600.0, 800.0, [(0, 100.0, 100.0, 200.0, 200.0)])], "page long, width double, height double, ink array<struct<ord:int,x:double,y:double,w:double,h:double>>")
    got = X.with_figures(blocks, pages)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("MapIn", "EvalPython", "FlatMapGroups"))
    assert [r["type"] for r in got.orderBy("ord").collect()] == ["figure", "paragraph"]


def test_blocks_that_can_hold_no_table_are_not_searched(spark):
    lines = lambda n: [(0, i, f"text {i}", 10.0, 20.0 * i, 300.0, 10.0, 0, 10.0, False, [(10.0, 60.0), (200.0, 310.0)] if i < n else [(10.0, 60.0)]) for i in range(4)]
    found = [TB.detect(spark.createDataFrame(lines(n), LINE).withColumn("size_pt", F.col("size"))) for n in (0, 1, 2, 4)]
    assert [[(r["first_line"], r["end_line"]) for r in f.collect()] for f in found] == [[], [], [(0, 3)], [(0, 4)]]
    assert "q_several" in found[0]._jdf.queryExecution().executedPlan().toString()


def test_groups_over_the_edges_of_batches(spark):
    rows = [(p, i, float(i)) for p, n in ((None, 4), (1, 1), (2, 11), (5, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "page long, ord int, x double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = fold.fold_groups(df, ["page"], ["ord"], ["x"], ["ord"], [StructField("all", DoubleType())], lambda x: [x * 0 + x.sum()]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = {p: sum(x for q, _, x in rows if q == p) for p, _, _ in rows}
    assert sorted(map(str, got)) == sorted(str(Row(page=p, ord=i, all=whole[p])) for p, i, _ in rows)


# --- the stream of pages ---------------------------------------------------------------


def test_a_document_over_several_batches(spark, tmp_path):
    schema = "doc_id long, page_index int, pages int, blocks long, words long"
    source, root = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def arrive(name, rows):
        pd.DataFrame(rows, columns=["doc_id", "page_index", "pages", "blocks", "words"]).astype({"page_index": "int32", "pages": "int32"}).to_parquet(source / f"{name}.parquet")

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    arrive("a", [(1, 0, 3, 2, 10), (2, 0, 1, 1, 5)])
    arrive("b", [(1, 2, 3, 1, 20), (1, 0, 3, 2, 10)])  # the first page once more
    run = lambda **k: sorted((r["doc_id"], r["seq"], r["event"], r["page_index"], r["blocks"], r["words"]) for r in PG.run(spark, stream(), root, **k).collect())
    first = [(1, 0, "started", 3, None, None), (1, 1, "page", 0, 2, 10), (1, 2, "page", 2, 1, 20)]
    second = [(2, 0, "started", 1, None, None), (2, 1, "page", 0, 1, 5), (2, 2, "finished", 1, 1, 5)]
    assert run() == first + second
    arrive("c", [(1, 1, 3, 4, 40), (2, 0, 1, 1, 5)])  # after a restart
    done = first + [(1, 3, "page", 1, 4, 40), (1, 4, "finished", 3, 7, 70)] + second
    assert run() == done
    arrive("d", [(3, 0, 2, 1, 1)])
    assert run(patience=0)[-3:] == [(3, 0, "started", 2, None, None), (3, 1, "page", 0, 1, 1), (3, 2, "failed", None, 1, 1)]
    arrive("e", [(3, 1, 2, 1, 1), (4, 0, 2, 1, 1)])  # too late
    assert run()[-3:] == [(3, 2, "failed", None, 1, 1), (4, 0, "started", 2, None, None), (4, 1, "page", 0, 1, 1)]


def test_a_document_costs_one_read_and_one_write_of_its_state_a_batch():
    class Handle:
        def __init__(self):
            self.calls, self.value, self.timers = [], None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 5000

    handle, pages, row = Handle(), PG.Pages(10), Row("page_index", "pages", "blocks", "words")
    pages.init(handle)
    come = lambda *ps: [(r["seq"], r["event"], r["page_index"]) for r in pages.handleInputRows((1,), iter([row(p, 100, 1, 2) for p in ps]), Now())]
    assert come(*range(98, -1, -1), 7) == [(0, "started", 100), *((i + 1, "page", i) for i in range(99))]
    assert handle.calls == ["get", "update"] and handle.timers == [15000]
    assert come(3, 99) == [(100, "page", 99), (101, "finished", 100)] and handle.calls == ["get", "update"] * 2 and handle.timers == []
    assert come(5) == []


def test_documents_are_converted_as_their_pages_come(spark, tmp_path, monkeypatch):
    """Previews of what has come; whole-document passes once all has, over batches and a restart; a page sent again counts once."""
    block = spark.createDataFrame([], DS.BLOCK).schema
    source, root = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def blocks(page):
        return [
            dict(type="heading", ord=0, text="Journal 7", y=10.0, h=8.0, page_height=800.0, size=9.0, level=1),
            dict(type="heading", ord=1, text=f"Part {page}", y=300.0, h=20.0, page_height=800.0, size=16.0, level=1),
            dict(type="paragraph", ord=2, text=f"Text of page {page}.", y=400.0, h=20.0, page_height=800.0, size=10.0, level=None),
        ]

    def arrive(name, rows):
        df = pd.DataFrame([(d, p, n, 0 if empty else 3, 0, json.dumps([] if empty else blocks(p))) for d, p, n, empty in rows], columns=["doc_id", "page_index", "pages", "blocks", "words", "body"])
        df.astype({"page_index": "int32", "pages": "int32"}).to_parquet(source / f"{name}.parquet")

    schema = "doc_id long, page_index int, pages int, blocks long, words long, body string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = lambda: sorted((r["doc_id"], r["page_index"], r["ord"], r["type"], r["text"]) for r in DS.run(spark, stream(), block, root).collect())
    shown = lambda **k: {r["doc_id"]: (r["pages_so_far"], r["markdown"]) for r in DS.preview(spark, root, block, **k).collect()}
    page = lambda d, p: [(d, p, 1, "heading", f"Part {p}"), (d, p, 2, "paragraph", f"Text of page {p}.")]

    assert run() == [] and shown() == {}  # nothing has come yet
    arrive("a", [(1, 2, 3, False), (2, 0, 2, False), (3, 0, 1, True)])
    assert run() == []
    said = lambda p: f"# Journal 7\n\n# Part {p}\n\nText of page {p}."
    assert shown() == {1: (1, said(2) + "\n"), 2: (1, said(0) + "\n")}
    arrive("b", [(1, 0, 3, False), (1, 2, 3, False), (4, 0, 3, False), (4, 1, 3, False), (4, 2, 3, False)])
    # the header goes where enough pages repeat it
    assert run() == [x for p in range(3) for x in page(4, p)]
    assert shown() == {1: (2, said(0) + "\n\n" + said(2) + "\n"), 2: (1, said(0) + "\n")}
    monkeypatch.setattr(DS, "BROADCAST", 0)  # more documents end than are broadcast
    arrive("c", [(1, 1, 3, False), (4, 1, 3, False)])
    assert run() == [x for d in (1, 4) for p in range(3) for x in page(d, p)]
    assert set(shown()) == {2} and set(shown(everything=True)) == {1, 2, 3, 4} and shown(everything=True)[3] == (1, "")


def test_a_table_of_many_files_streams_as_one_of_one_file(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    df.repartition(4).write.parquet(f"{tmp_path}/a/documents.parquet")
    (tmp_path / "b").mkdir()
    df.toPandas().to_parquet(tmp_path / "b" / "documents.parquet")
    seen = [sorted(map(tuple, E.converted(spark, f"{tmp_path}/{d}").collect())) for d in "ab"]
    assert seen[0] == seen[1] and len(seen[0]) == 60
