"""Readers, writers, shared tables and whole plans."""

import glob
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.plans import extract as X
from quire.operators import tables as TB
from quire.sources import files, sinks
from quire.storage import discard, discarding, shared_dir, staged

DOCUMENT = {
    "source": {"filename": "a.pdf", "pages": 1, "sha256": "x"}, "engine": {"tier": "fast", "model": None, "appVersion": "1"},
    "pages": [{"index": 0, "width": 600.0, "height": 800.0, "engine": "textLayer", "duration": 0.5, "blocks": [
        {"type": "heading", "level": 1, "text": "T", "bbox": [1.23, 2.0, 3.0, 4.0]}, {"type": "table", "rows": [[{"text": "a", "rowSpan": 1, "colSpan": 2}]], "structureSuspect": True},
        {"type": "list", "ordered": False, "items": [{"text": "i", "depth": 0}]}, {"type": "formula", "latex": "x^2", "isInline": False}]}],
}


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT, indent=1))
    docs = files.json_documents(spark, str(tmp_path)).withColumn("doc_id", F.lit(1))
    blocks = files.document_blocks(docs).orderBy("pos").collect()
    assert [b["type"] for b in blocks] == ["heading", "table", "list", "formula"]
    assert (blocks[0]["x"], blocks[0]["h"]) == (1.23, 4.0) and blocks[1]["x"] is None and blocks[1]["rows"][0][0]["col_span"] == 2
    assert files.document_pages(docs).first()["duration"] == 0.5
    # what a reader gives, every operator takes; and it is written as it was read
    b = files.document_blocks(docs)
    assert sinks.document_markdown(b).first()["markdown"].startswith("# T\n\n> ⚠︎ Table") and TB.flattened(b.where("type = 'table'"), "doc_id").first()["grid"] == [["a", ""]]
    out = json.loads(sinks.document_json(b, pages=files.document_pages(docs)).first()["json"])
    (page,) = out["pages"]
    assert page["blocks"] == DOCUMENT["pages"][0]["blocks"] and page["duration"] == 0.5 and page["index"] == 0


def test_pdf_folder_and_decoder(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"page one|page two|page three")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = files.pdf_files(spark, str(tmp_path))
    assert found.count() == 1 and len(found.first()["sha256"]) == 64

    def decoder(content, first, last):
        for i, page in enumerate(content.split(b"|")[first:last], first):
            yield {"page": i, "text": page.decode()}

    rows = files.decode_pages(found, decoder, "page long, text string", 1, 2).collect()
    assert [(r["page"], r["text"]) for r in rows] == [(1, "page two")]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n$x_1$ here\nno\n")
    assert files.markdown_files(spark, str(tmp_path)).first()["markdown"].startswith("# T")
    assert files.math_lines(spark, str(tmp_path)).count() == 1


def test_markdown_sink_and_export(spark, tmp_path):
    rows = [(1, 0, 0, "# T"), (1, 1, 1, "p"), (1, 1, 2, "")]
    b = spark.createDataFrame(rows, "doc_id int, page_index long, pos long, md string")
    assert sinks.document_markdown(b).first()["markdown"] == "# T\n\np\n"
    assert sinks.document_markdown(b, page_markers=True).first()["markdown"].startswith("<!-- page 1 -->\n\n# T\n\n<!-- page 2 -->")
    paths = sinks.export({"markdown": sinks.document_markdown(b)}, str(tmp_path / "out"))
    assert paths == {"markdown": f"{tmp_path}/out/*.md"} and (tmp_path / "out" / "1.md").read_text() == "# T\n\np\n"


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = staged(spark.range(10), "numbers")
    gone = staged(spark.range(3), "gone")
    discard(gone)
    assert not glob.glob(gone.staged_path.removeprefix("file://"))
    assert df.count() == 10 and all(shared_dir(spark).split(":")[-1].lstrip("/") in f for f in df.inputFiles())


def test_fonts_of_the_first_characters(spark):
    rows = [(1, 0, "x" * 1999, None), (1, 1, "y", "F"), (2, 0, "x" * 2000, None), (2, 1, "y", "F"), (3, 0, "", "F")]
    got = {r["page"]: r["fonts"] for r in files.has_embedded_fonts(spark.createDataFrame(rows, "page int, ord int, text string, font string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_a_page_from_lines_to_blocks(spark):
    """A contents list, a heading, prose, a table of cells, one that an engine read, and a captioned figure."""
    cols = [(50.0, 120.0), (150.0, 220.0)]
    whole = [(50.0, 300.0)]
    lines = [("1 Scope ........ 3", 20.0, whole, 10.0), ("2 Terms ........ 4", 32.0, whole, 10.0), ("Annex ........ 9", 44.0, whole, 10.0), ("A Long Title", 70.0, whole, 16.0)]
    lines += [("prose of the first paragraph", 100.0, whole, 10.0), ("that goes on below", 111.0, whole, 10.0)]
    lines += [(f"left{i} right{i}", 150.0 + 12 * i, cols, 10.0) for i in range(3)] + [(f"p{i} q{i}", 250.0 + 12 * i, cols, 10.0) for i in range(3)] + [("Figure 1. What it shows", 640.0, whole, 10.0)]
    rows = [(0, i, t, 50.0, y, 250.0, 10.0, 0, size, False, b) for i, (t, y, b, size) in enumerate(lines)]
    df = spark.createDataFrame(rows, "page long, ord int, text string, x double, y double, w double, h double, col int, size double, bold boolean, boxes array<struct<x:double,x1:double>>")
    runs = [(0, 100 + 2 * i + k, f"{side}{i}", 50.0 + 100 * k, 150.0 + 12 * i, 60.0, 10.0, 10.0, False) for i in range(3) for k, side in enumerate(("left", "right"))]
    runs = spark.createDataFrame(runs, "page long, ord int, text string, x double, y double, w double, h double, size double, bold boolean")
    vision = spark.createDataFrame([(0, 1, [[("read", 1, 1)]], 50.0, 248.0, 240.0, 40.0)], "page long, ord int, rows array<array<struct<text:string,row_span:int,col_span:int>>>, x double, y double, w double, h double")
    text = staged(X.page_blocks(df), "t")
    kinds = [(r["type"], (r["text"] or "")[:12]) for r in text.orderBy("ord").collect()]
    assert kinds[:3] == [("list", ""), ("heading", "A Long Title"), ("paragraph", "prose of the")]
    found = staged(X.table_candidates(df, text), "c")
    assert [(r["first_line"], r["end_line"]) for r in found.orderBy("ord").collect()] == [(6, 9), (9, 12)]
    tables = staged(X.with_tables(text, found, vision, runs), "b")
    got = tables.orderBy("ord").collect()
    assert [r["type"] for r in got] == ["list", "heading", "paragraph", "table", "table", "paragraph"] and [r["ord"] for r in got] == list(range(6))
    assert [[c["text"] for c in r] for r in got[3]["rows"]] == [[f"left{i}", f"right{i}"] for i in range(3)] and got[3]["structure_suspect"]
    assert got[4]["rows"][0][0]["text"] == "read" and not got[4]["structure_suspect"] and [x["text"] for x in got[0]["items"]][0] == "1 Scope · p. 3"
    pages = spark.createDataFrame([(0, 600.0, 800.0, [(60.0, 400.0, 200.0, 230.0)])], "page long, width double, height double, ink array<struct<x:double,y:double,w:double,h:double>>")
    figs = X.with_figures(tables, pages).orderBy("ord").collect()
    assert [r["type"] for r in figs] == ["list", "heading", "paragraph", "table", "table", "figure", "paragraph"]
    assert (figs[5]["path"], figs[5]["caption"]) == ("images/p001-fig01.png", "Figure 1. What it shows")


def test_regions_are_read_and_placed(spark):
    regions = [(0, 0, "text", 1, 10.0, 0.0, 100.0, 12.0), (0, 1, "text", None, 10.0, 20.0, 100.0, 10.0), (0, 2, "text", None, 10.0, 35.0, 100.0, 10.0), (0, 3, "table", None, 10.0, 60.0, 100.0, 50.0)]
    df = spark.createDataFrame([(*r[:3], "t", r[3], 9.0, *r[4:]) for r in regions], "page int, ord int, kind string, text string, level int, size double, x double, y double, w double, h double")

    def reader(frames):
        for f in frames:
            out = f[["page", "region", "kind"]].merge(f[["page", "region"]].assign(ord=[[0, 1]] * len(f)).explode("ord"))
            out["type"], out["level"] = "paragraph", None
            out["text"] = [f"{k} {o}" for k, o in zip(out["kind"], out["ord"])]
            yield out[["page", "region", "ord", "type", "level", "text"]]

    got = X.read_regions(df, reader, "page int, region int, ord int, type string, level int, text string", 600.0, 60.0).orderBy("ord").collect()
    assert [(r["type"], r["level"], r["text"], r["y"], r["h"]) for r in got] == [
        ("heading", 1, "text 0", 0.0, 12.0), ("paragraph", None, "text 1", 0.0, 12.0), ("paragraph", None, "text 0", 20.0, 25.0), ("paragraph", None, "text 1", 20.0, 25.0), ("paragraph", None, "table 0", 60.0, 50.0), ("paragraph", None, "table 1", 60.0, 50.0)]
    seen = X.vision_regions(spark.createDataFrame([(0, 0, "table", 1.0), (0, 1, "figure", 1.0), (0, 2, "list", 1.0), (0, 3, "formula", None)], "page int, ord int, type string, x double").withColumns({c: F.col("x") for c in "ywh"}))
    assert [r["kind"] for r in seen.orderBy("ord").collect()] == ["table", "text"]


def test_finish_runs_the_passes_in_order(spark):
    rows = []
    for p in range(5):
        rows += [("d", p, 790.0, "heading", 0, "Running head", 20.0, 10.0, 9.0, 6), ("d", p, 790.0, "heading", 1, f"{p + 1} Part" if p < 4 else "References", 100.0, 14.0, 14.0, 1)]
        rows += [("d", p, 790.0, "paragraph", 2, "text " * 40, 200.0, 300.0, 10.0, None), ("d", p, 790.0, "heading", 3, "small words", 600.0, 9.0, 8.0, 3)]
    rows.append(("d", 4, 790.0, "heading", 4, "1 Smith Journal", 640.0, 9.0, 12.0, 2))
    df = spark.createDataFrame(rows, "doc string, page int, page_height double, type string, ord int, text string, y double, h double, size double, level int")
    out = X.finish(df).collect()
    heads = sorted((r["page"], r["text"], r["level"]) for r in out if r["type"] == "heading")
    assert heads == [(0, "1 Part", 1), (1, "2 Part", 1), (2, "3 Part", 1), (3, "4 Part", 1), (4, "References", 1)]
    assert sum(r["type"] == "paragraph" for r in out) == 11 and not any(r["text"] == "Running head" for r in out)


def test_what_is_staged_for_a_batch_goes_with_it(spark):
    outer = staged(spark.range(3), "outer")
    there = lambda df: Path(df.staged_path.removeprefix("file://")).exists()
    with pytest.raises(KeyError):
        with discarding():
            inner = staged(outer.where("id > 0"), "inner")
            assert inner.count() == 2 and there(inner)
            raise KeyError
    assert there(outer) and not there(inner)
