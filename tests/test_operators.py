"""Expectations on small literal inputs."""

import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import maths, text as T
from quire.operators import chunks as C, figures, furniture, geometry as G, glyphs as GL, headings as H, layout as L, markdown as M, search as Q, stats, tables as TB
from quire.operators.sections import sections
from quire.plans import extract as X
from quire.plans.service import Service
from quire.sources import sinks

BLOCK = "doc_id int, page_index long, ord int, type string, level int, text string, pos long"


def blocks(spark, items, doc=1):
    """'H1 title' or plain paragraphs; an item may be (page, text)."""
    rows = []
    for i, item in enumerate(items):
        page, t = item if isinstance(item, tuple) else (0, item)
        head = t[:1] == "H" and t[1:2].isdigit() and t[2:3] == " "
        rows.append((doc, page, i, "heading" if head else "paragraph", int(t[1]) if head else None, t[3:] if head else t, i))
    return spark.createDataFrame(rows, BLOCK)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(spark, f, *values):
    return [one(spark, f(F.lit(v))) for v in values]


# --- sections and chunks -------------------------------------------------------


def test_addresses_and_paths(spark):
    b = blocks(spark, ["intro", "H1 One", "p", "H2 One A", "p", "H2 One B", "p", "H1 Two", "p"])
    got = [(r["section_id"], r["path"]) for r in sections(b).orderBy("pos").collect()]
    assert got[0] == ("0", [])
    assert [g[0] for g in got[1:]] == ["1", "1", "1.1", "1.1", "1.2", "1.2", "2", "2"]
    assert got[6][1] == ["One", "One B"] and got[8][1] == ["Two"]


def test_levels_that_are_skipped(spark):
    b = blocks(spark, ["H3 a", "H1 b", "H3 c", "H2 d", "H3 e", "H3 f"])
    assert [r["section_id"] for r in sections(b).orderBy("pos").collect()] == ["1", "2", "2.1", "2.2", "2.2.1", "2.2.2"]


def test_parts_neighbours_and_pages(spark):
    b = blocks(spark, ["H1 Long"] + [(i // 3, "word " * 60) for i in range(10)])
    rows = C.chunks(b, C.Options(target=200)).orderBy("chunk_id").collect()
    assert len(rows) > 1 and [r["part"] for r in rows] == list(range(1, len(rows) + 1)) and {r["part_count"] for r in rows} == {len(rows)}
    assert rows[0]["previous_id"] is None and rows[-1]["next_id"] is None and rows[0]["next_id"] == 1
    assert rows[0]["pages"] == sorted(set(rows[0]["pages"]))


def test_parts_by_a_plain_loop(spark):
    items = ["H1 x"] + ["word " * (i * 7 % 40) for i in range(120)]
    got = [r["part"] for r in C.pack(blocks(spark, items), C.Options(target=50, minimum=10)).orderBy("pos").collect()]
    tokens, part, want = 0, 1, []
    for r in C.pack(blocks(spark, items), C.Options()).orderBy("pos").select("cost").collect():
        if tokens + r["cost"] > 50 and tokens >= 10:
            tokens, part = 0, part + 1
        tokens += r["cost"]
        want.append(part)
    assert got == want and got[-1] > 5


RICH = "doc_id int, page_index long, ord int, pos long, type string, level int, text string, ordered boolean, items array<struct<text:string,depth:int>>, rows array<array<struct<text:string,row_span:int,col_span:int>>>, structure_suspect boolean, path string, caption string, latex string, is_inline boolean, language string"


def rich(spark, items):
    names = [x.split()[0] for x in RICH.split(", ")]
    return spark.createDataFrame([tuple({"doc_id": 1, "page_index": 0, "ord": i, "pos": i, **x}.get(n) for n in names) for i, x in enumerate(items)], RICH)


EVERY = [
    dict(type="heading", level=2, text="A *b*"), dict(type="paragraph", text="p"),
    dict(type="list", ordered=True, items=[("one", 0), ("two", 1), ("deep", 3), ("deep", 3), ("two", 1), ("three", 0), ("four", 1)]), dict(type="list", items=[("x", 0)]),
    dict(type="table", rows=[[("wide", 1, 2)], [("tall|", 3, 1), ("x", 1, 1)], [("y", 1, 1)]], structure_suspect=True), dict(type="table", rows=[]),
    dict(type="figure", path="images/a b.png", caption="Fig. [1]"), dict(type="figure", path="c.png"), dict(type="formula", latex="x^2", is_inline=True), dict(type="formula", latex=" y "), dict(type="code", text="a\n", language="py"), dict(type="paragraph"),
]


def test_every_type_of_block(spark):
    from quire.functions import blocks as B

    d = B.complete(rich(spark, EVERY)).select("ord", B.markdown().alias("md"), B.plain_text().alias("t")).orderBy("ord").collect()
    assert [r["md"] for r in d] == [
        "## A \\*b\\*", "p", "1. one\n  1. two\n      1. deep\n      2. deep\n  2. two\n2. three\n  1. four", "- x",
        "> ⚠︎ Table structure is uncertain; verify against the source page.\n\n| wide |  |\n| --- | --- |\n| tall\\| | x |\n|  | y |\n|  |  |", "",
        "![Fig. \\[1\\]](images/a%20b.png)\n\n*Fig. \\[1\\]*", "![](c.png)", "$x^2$", "$$\ny\n$$", "```py\na\n```", "",
    ]
    assert [r["t"] for r in d] == ["A *b*", "p", "one\ntwo\ndeep\ndeep\ntwo\nthree\nfour", "x", "wide\ntall| x\ny", "", "Fig. [1]", "", "x^2", " y ", "a\n", ""]


def test_a_block_without_text_ends_no_packing(spark):
    items = [dict(type="heading", level=1, text="h")] + [dict(type="paragraph", text="word " * 60) for _ in range(10)] + [dict(type="table", rows=[[("a", 1, 1)]])] + [dict(type="paragraph", text="word " * 60) for _ in range(10)]
    rows = C.chunks(rich(spark, items), C.Options(target=200)).collect()
    assert len(rows) >= 7 and max(r["tokens"] for r in rows) < 300 and any("| a |" in r["text"] for r in rows)


def test_bullet_tables_and_doubt(spark):
    cell = lambda t: (t, 1, 1)
    d = TB.normalized(rich(spark, [dict(type="table", rows=[[cell("•"), cell("one")], [cell(""), cell("more")], [cell("-"), cell("two")]], structure_suspect=True), dict(type="table", rows=[[cell("a"), cell("b")], [cell("c"), cell("d")]], structure_suspect=True), dict(type="table", rows=[[cell(""), cell("")], [cell("c"), cell("")]], structure_suspect=True)]))
    got = d.orderBy("ord").collect()
    assert [r["type"] for r in got] == ["list", "table", "table"] and [x["text"] for x in got[0]["items"]] == ["one more", "two"] and [r["structure_suspect"] for r in got] == [None, False, True]


def test_no_blocks_no_chunks(spark):
    assert C.chunks(blocks(spark, ["x"]).where("pos > 9")).count() == 0


def test_outline_tree(spark):
    b = blocks(spark, ["H1 One", "p", "H2 One A", "p", "H1 Two", (1, "p")])
    o = C.outline(C.chunks(b))
    got = {r["section_id"]: (r["parent_id"], r["depth"], r["title"]) for r in o.collect()}
    assert got == {"1": (None, 0, "One"), "1.1": ("1", 1, "One A"), "2": (None, 0, "Two")}
    tree = json.loads(sinks.outline_json(o).first()["json"])
    assert [s["title"] for s in tree["sections"]] == ["One", "Two"] and tree["sections"][0]["children"][0]["title"] == "One A"


SAMPLE = ["H1 Methods", "We collected samples from four sites.", "H2 Datasets", "The corpus contains ten thousand annotated documents.", (1, "H1 Results"), (1, "Accuracy improved on every corpus we measured.")]


def test_search_and_reading(spark):
    c = C.chunks(blocks(spark, SAMPLE)).persist()
    assert Q.search(c, "datasets").first()["path"][-1] == "Datasets"
    assert "Accuracy" in Q.search(c, "corpus accuracy").first()["text"]
    assert Q.search(c, "helicopter").count() == 0 and Q.search(c, "a !").count() == 0
    assert Q.section(c, "1").count() > Q.section(c, "1", False).count()
    assert [r["chunk_id"] for r in Q.around(c, 1, 1).orderBy("chunk_id").collect()] == [0, 1, 2] and Q.around(c, 99, 5).count() == 0
    with pytest.raises(ValueError):
        Q.search(c, "x", -1)
    with pytest.raises(ValueError):
        Q.around(c, 1, -1)


def test_service(spark):
    calls = []

    def convert(path):
        calls.append(path)
        return blocks(spark, SAMPLE)

    s = Service(convert)
    ask = lambda method, ident=1, **params: json.loads(s.handle(json.dumps({"jsonrpc": "2.0", "id": ident, "method": method, "params": params})))
    assert len(ask("tools/list")["result"]["tools"]) == 6
    assert ask("nope")["error"]["code"] == -32601 and json.loads(s.handle("{"))["error"]["code"] == -32700
    assert s.handle(json.dumps({"jsonrpc": "2.0", "method": "ping"})) is None
    found = ask("tools/call", name="search_document", arguments={"path": "a", "query": "corpus"})
    assert not found["result"]["isError"] and "chunk" in found["result"]["content"][0]["text"]
    assert "Methods" in ask("tools/call", name="open_document", arguments={"path": "a"})["result"]["content"][0]["text"]
    assert calls == ["a"]
    assert ask("tools/call", name="nope", arguments={})["result"]["isError"]
    out = io.StringIO()
    s.run(io.StringIO('{"id": 1, "method": "ping"}\n\n'), out)
    assert json.loads(out.getvalue())["result"] == {}


# --- text ------------------------------------------------------------------------


def test_tokens(spark):
    latin, cjk = lit(spark, T.token_estimate, "a" * 400, "文" * 400)
    assert 80 < latin < 130 and latin < cjk == 440


def test_section_depths(spark):
    assert lit(spark, T.section_depth, "2 Methods", "3.1 Data", "4.2.1. More", "A Proofs", "B.2 Lemma", "2019 was warm", "3", "3.x Foo", "1 2", "intro") == [1, 2, 3, 1, 2, None, None, None, None, None]


def test_chart_labels_and_citations(spark):
    assert lit(spark, T.chart_label, "r = 0.841", "Science 0.5 27%", "12.5 30", "4.1 Dataset", "Results") == [True, True, True, False, False]
    assert lit(spark, T.citation, "Smith et al. 2020", "Iansiti, M. & Lakhani", "Lee, K.", "Data and methods") == [True, True, True, False]


def test_garbled(spark):
    assert lit(spark, T.garbled_ratio, "ab�", "", "ok fine") == [0.5, 0.0, 0.0]


def test_escapes(spark):
    assert lit(spark, T.escape_inline, "a*b_c", "# x", "a - b", "- x", "1. x", "x 1. y", "$A_{1}$ * b", "$5 * $6") == ["a\\*b\\_c", "\\# x", "a - b", "\\- x", "1\\. x", "x 1. y", "$A_{1}$ \\* b", "$5 \\* $6"]
    assert lit(spark, T.escape_cell, " a|b\nc ") == ["a\\|b<br>c"]
    assert lit(spark, T.unescape, "a\\*b\\alpha") == ["a*b\\alpha"]
    assert lit(spark, T.fence, "x", "a```b") == ["```", "````"]
    assert lit(spark, T.encode_path, "a b/ü.png") == ["a%20b/%C3%BC.png"]
    assert lit(spark, T.bold_font, "Times-Bold", "CMR10-Medi", "Times") == [True, True, False]


# --- headings, furniture -------------------------------------------------------------


def test_tiers_and_levels(spark):
    assert one(spark, H.tiers(F.array(*map(F.lit, [20.0, 19.6, 19.9, 12.0, 11.8])))) == [20.0, 12.0]
    rows = [("d", 1, "Title", 20.0, 1), ("d", 2, "1 Intro", 12.0, 1), ("d", 3, "1.1 Sub", 12.0, 1), ("d", 4, "1.1.1 Deep", 10.0, 1)]
    df = spark.createDataFrame(rows, "doc string, ord int, text string, size double, level int")
    assert [r["new_level"] for r in H.normalize_levels(df).orderBy("ord").collect()] == [1, 2, 3, 4]
    same = H.normalize_levels(df.withColumn("size", F.lit(12.0)))
    assert {r["new_level"] for r in same.collect()} == {1}


def test_heading_candidates(spark):
    rows = [(1, "Introduction", 1, 20.0, False), (2, "body text of a paragraph that runs on", 5, 10.0, False), (3, "Bold title", 1, 10.0, True), (4, "2536", 1, 20.0, False), (5, "—", 1, 20.0, False), (6, "2.1 Numbered", 1, 10.0, False), (7, "x" * 130, 1, 20.0, False)]
    df = spark.createDataFrame([(0, *r) for r in rows], "page int, ord int, text string, lines int, size double, bold boolean")
    got = {r["ord"]: r["level"] for r in H.classify(df).collect() if r["is_heading"]}
    assert got == {1: 1, 3: 2, 6: 2}


def test_body_size_and_demotion(spark):
    text = spark.createDataFrame([("d", "x" * 900, 8.2), ("d", "y" * 100, 10.0)], "doc string, text string, size double")
    body = H.body_size(text)
    assert body.first()["body_size"] == 8.25
    heads = spark.createDataFrame([("d", "Small", 8.0), ("d", "2.1 Small", 8.0), ("d", "Large", 12.0)], "doc string, text string, size double")
    assert [r["kept"] for r in H.demote_small(heads, body).orderBy("text").collect()] == [True, True, False]


def test_bibliography(spark):
    heads = spark.createDataFrame([("d", i, t) for i, t in enumerate(["1 Intro", " References ", "2 Smith", "Appendix"])], "doc string, ord int, text string")
    assert [r["kept"] for r in H.demote_bibliography(heads).orderBy("ord").collect()] == [True, True, False, True]


def furniture_pages(spark, n, extra=()):
    rows = []
    for p in range(n):
        rows += [("d", p, 790.0, "heading", 0, "Running title", 20.0, 10.0), ("d", p, 790.0, "paragraph", 1, "Body", 200.0, 300.0), ("d", p, 790.0, "paragraph", 2, f"Page {p} of {n}", 760.0, 10.0)]
    return spark.createDataFrame(rows + list(extra), "doc string, page int, page_height double, type string, ord int, text string, y double, h double")


def test_furniture(spark):
    left = furniture.strip(furniture_pages(spark, 8, [("d", 3, 790.0, "heading", 3, "Only here", 20.0, 10.0), ("d", 4, 790.0, "table", 4, "Running title", 20.0, 10.0)]))
    assert sorted((r["type"], r["text"]) for r in left.collect()) == [("heading", "Only here")] + [("paragraph", "Body")] * 8 + [("table", "Running title")]
    assert furniture.strip(furniture_pages(spark, 2)).count() == 6


# --- geometry, layout, tables ------------------------------------------------------------


def box(spark, rows, more=""):
    return spark.createDataFrame(rows, f"page int, ord int, x double, y double, w double, h double{more}")


def test_gutter_and_order(spark):
    rows = [(0, i * 2, 50.0, 14.0 * i, 200.0, 10.0) for i in range(5)] + [(0, i * 2 + 1, 320.0, 14.0 * i, 200.0, 10.0) for i in range(5)]
    b = box(spark, rows)
    assert 250 < G.gutters(b, 600.0).first()["gutter"] < 320
    assert [r["ord"] for r in G.reading_order(b, 600.0).orderBy("rank").collect()] == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    # rows within half a line's height are one; a half's own clearest place lies beside it, so it splits no more; what has no place comes last
    four = [(0, 10 * c + i, x, 14.0 * i + (c % 2) * 3, 80.0, 10.0) for c, x in enumerate((40.0, 180.0, 340.0, 480.0)) for i in range(4)] + [(0, 99, None, None, None, None)]
    assert [r["ord"] for r in G.reading_order(box(spark, four), 600.0).orderBy("rank").collect()] == [10 * c + i for half in ((0, 1), (2, 3)) for i in range(4) for c in half] + [99]
    row = [(0, 1, 300.0, 4.0, 50.0, 10.0), (0, 2, 20.0, 0.0, 50.0, 10.0), (0, 3, 150.0, 5.5, 50.0, 10.0)]
    assert [r["ord"] for r in G.reading_order(box(spark, row), 600.0).orderBy("rank").collect()] == [2, 1, 3]


def test_box_codecs(spark):
    assert one(spark, G.decode(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])))) == (1, 2, 3, 4) and one(spark, G.decode(F.array(F.lit(1.0)))) is None
    assert [round(one(spark, c), 6) for c in G.from_unit(*map(F.lit, (0.1, 0.2, 0.3, 0.4, 600.0, 800.0)))] == [60, 320, 180, 320]


def test_glyphs_of_two_columns(spark):
    rows, n = [], 0
    for line in range(30):
        for x in [*range(50, 250, 20), *range(330, 530, 20)]:
            rows.append((0, n, float(x + line * 7 % 20), 20.0 * line + 60, 12.0, 10.0))
            n += 1
    title = [(0, n + i, 60.0 + 12 * i, 20.0, 12.0, 10.0) for i in range(38)]
    g = box(spark, rows + title)
    assert 250 < GL.column_gutters(g, 600.0, 800.0).first()["center"] < 330
    got = GL.arrange(g, 600.0, 800.0).orderBy("line").collect()
    assert [r["column"] for r in got] == [-1] + [0] * 30 + [1] * 30 and got[0]["n"] == 38
    assert GL.column_gutters(box(spark, rows[:100]), 600.0, 800.0).count() == 0


def test_union_ignores_empty(spark):
    r = box(spark, [(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 500.0, 500.0, 0.0, 10.0)]).groupBy("page").agg(*G.union_box()).first()
    assert (r["x"], r["y"], r["w"], r["h"]) == (0, 0, 10, 10)


def test_paragraphs_split(spark):
    s = ", text string, col int, size double, bold boolean"
    title = box(spark, [(0, 1, 50.0, 0.0, 200.0, 12.0, "5 Evaluating Semantic Embedding", 0, 12.0, False), (0, 2, 90.0, 14.0, 80.0, 12.0, "Capabilities", 0, 12.0, False)] + [(0, 3 + i, 50.0, 60.0 + 11 * i, 240.0, 10.0, "body", 0, 10.0, False) for i in range(4)], s)
    assert [r["paragraph"] for r in L.paragraphs(title).orderBy("ord").collect()] == [1, 1, 2, 2, 2, 2]
    run_in = box(spark, [(0, 1, 50.0, 0.0, 150.0, 10.0, "5.1 Generalization", 0, 10.0, False), (0, 2, 50.0, 11.0, 240.0, 10.0, "We test", 0, 10.0, False), (0, 3, 50.0, 22.0, 240.0, 10.0, "more", 0, 10.0, False)], s)
    assert [r["paragraph"] for r in L.paragraphs(run_in).orderBy("ord").collect()] == [1, 2, 2]


def test_dehyphenation(spark):
    assert one(spark, L.joined(F.array(*map(F.lit, ["exam-", "ple of", "A-", "B"])))) == "example of A- B"


def test_contents(spark):
    lines = ["1 Policy perspective ................ 10", "1.1 Aims .... 12", "1.1.1 Scope .... 13", "Annex ..... 20", "the figure rose to 2019", "Preface ... iv"]
    df = spark.createDataFrame([(1, i, t, 0) for i, t in enumerate(lines)], "page_id int, ord int, text string, col int")
    got = L.contents_lists(df).orderBy("ord").collect()
    assert [r["depth"] for r in got] == [0, 1, 2, 0] and got[0]["item"] == "1 Policy perspective · p. 10"
    assert L.contents_lists(df.where("ord < 2")).count() == 0


def rows_of(texts):
    return [[dict(text=c, row_span=1, col_span=1) for c in row] for row in texts]


ROWS = "doc_id int, rows array<array<struct<text:string,row_span:int,col_span:int>>>"


def test_table_rules(spark):
    df = spark.createDataFrame([(1, rows_of([["•", "one"], ["", "more"], ["-", "two"]])), (2, rows_of([["a", "b"], ["c", "d"]])), (3, rows_of([["a", ""], ["", ""], ["", ""]])), (4, [])], ROWS)
    got = {r["doc_id"]: r for r in df.select("doc_id", TB.bullet_list(F.col("rows")).alias("items"), TB.suspect(F.col("rows")).alias("s"), TB.doubtful(F.col("rows")).alias("d")).collect()}
    assert got[1]["items"] == ["one more", "two"] and got[2]["items"] is None
    assert not got[2]["s"] and not got[2]["d"] and got[3]["d"] and got[4]["s"] and got[4]["d"]


def test_spans(spark):
    cell = lambda t, r=1, c=1: (t, r, c)
    tables = [[[cell("wide", c=2)], [cell("a"), cell("b")]], [[cell("tall", r=2), cell("x")], [cell("y")]], [], [[cell("a", 2), cell("b", 3, 2)], [cell("c"), cell("d")], [cell("e")]]]
    df = spark.createDataFrame(list(enumerate(tables)), ROWS)
    got = {r["doc_id"]: r["grid"] for r in TB.flattened(df, "doc_id").collect()}
    assert got == {0: [["wide", ""], ["a", "b"]], 1: [["tall", "x"], ["", "y"]], 2: [], 3: [["a", "b", ""], ["", "", ""], ["e", "", ""]]}


def search(rows, sizes=None):
    return TB.windows_of_columns([np.array(r, float).reshape(-1, 2) for r in rows], np.array(sizes or [10.0] * len(rows)))


def all_windows(rows, size=10.0):
    """The longest window that is a table, the first of such, then on below it: every window from its definition."""
    out, top = [], 0
    while True:
        best = None
        for a in range(top, len(rows)):
            for b in range(a + 3, len(rows) + 1):
                cover = []
                for lo, hi in sorted(x for r in rows[a:b] for x in r):
                    if cover and lo <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], hi)
                    else:
                        cover.append([lo, hi])
                edges = [cover[0]] if cover else []
                for lo, hi in cover[1:]:
                    if lo - edges[-1][1] >= 0.9 * size:
                        edges.append([lo, hi])
                    else:
                        edges[-1] = [edges[-1][0], hi]
                two = sum(len({next((i for i, (lo, hi) in enumerate(edges) if lo <= (x + y) / 2 <= hi), None) for x, y in r} - {None}) >= 2 for r in rows[a:b])
                if len(edges) >= 2 and two >= 0.6 * (b - a) and (best is None or b - a > best[1] - best[0]):
                    best = (a, b, [tuple(e) for e in edges])
        if best is None:
            return out
        out.append(best)
        top = best[1]


def test_table_search():
    grid = [(0, 50), (70, 120), (140, 190)]
    assert [t[:2] for t in search([grid] * 5)] == [(0, 5)] and len(search([grid] * 3)[0][2]) == 3
    assert search([grid] * 2) == [] and search([[(0, 50), (52, 120)]] * 5) == [] and search([]) == [] and search([[]] * 4) == []
    assert search([[(0, 40 + 9 * i), (55 + 9 * i, 190)] for i in range(8)]) == []
    assert search([[(0, 190)]] + [grid] * 4 + [[(0, 190)]] + [grid] * 3) == [(1, 5, [(0, 50), (70, 120), (140, 190)]), (6, 9, [(0, 50), (70, 120), (140, 190)])]
    rng = np.random.default_rng(4)
    for _ in range(150):
        rows = [[(x, x + w) for x, w in zip((rng.integers(0, 12, k) * 15).tolist(), (rng.integers(1, 5, k) * 10).tolist())] for k in rng.integers(0, 4, rng.integers(1, 11))]
        assert search(rows) == all_windows(rows)


def test_tables_of_pages(spark):
    """Blocks end at gaps and columns; cells lie under the columns' edges."""
    boxes = [(0.0, 50.0), (70.0, 120.0)]
    line = lambda page, i, y, col=0: (page, i, y, 10.0, 10.0, col, boxes)
    rows = [line(0, i, 14.0 * i) for i in range(4)] + [line(0, 4 + i, 200 + 14.0 * i) for i in range(2)] + [line(1, i, 14.0 * i, int(i > 2)) for i in range(5)]
    df = spark.createDataFrame(rows, "page int, ord int, y double, h double, size_pt double, col int, boxes array<struct<x:double,x1:double>>")
    got = {r["page"]: r for r in TB.detect(df).collect()}
    assert {p: (r["first_line"], r["end_line"], r["columns"], r["x"], r["y"], r["w"], r["h"]) for p, r in got.items()} == {0: (0, 4, 2, 0.0, 0.0, 120.0, 52.0), 1: (0, 3, 2, 0.0, 0.0, 120.0, 38.0)}
    assert [[tuple(c) for c in r] for r in got[1]["cells"]] == [[(0.0, 14.0 * i, 50.0, 10.0), (70.0, 14.0 * i, 50.0, 10.0)] for i in range(3)]


def test_figures():
    rows, cols = figures.cells(600, 800)
    assert (rows, cols) == (96, 72) and figures.cells(800, 600) == (72, 96)
    ink = np.zeros((rows, cols), bool)
    ink[10:30, 10:40] = True
    ink[60, 5:70] = True  # a rule
    cell = (800 / 96, 600 / 72)
    box = (10 * cell[1], 10 * cell[0], 30 * cell[1], 20 * cell[0])
    assert figures.detect(ink, [], 600, 800) == [pytest.approx(box)]
    assert figures.detect(ink, [(70.0, 70.0, 290.0, 190.0)], 600, 800) == []
    assert figures.absorb((0, 0, 100, 100), [(102, 10, 8, 10), (400, 400, 5, 5), (110, 10, 9, 10)]) == ((0, 0, 119, 100), [0, 2])
    assert figures.absorb((0, 0, 100, 100), [(0, 100, 100, 200)])[1] == [] and figures.absorb((0, 0, 100, 100), [(102, 10, 8, 10)], [False])[1] == []
    gray = np.full((8, 8), 255.0)
    gray[0, 0], gray[5, 5] = 0, 240
    assert figures.ink_grid(gray).tolist() == [[True, False], [False, False]]


def test_patches_and_unions_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        grid = rng.random((9, 11)) < 0.35
        at = {tuple(map(int, p)) for p in np.argwhere(grid)}
        want = []
        while at:
            todo, patch = [at.pop()], []
            while todo:
                y, x = todo.pop()
                patch.append((y, x))
                near = {(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)} & at
                at -= near
                todo += near
            ys, xs = zip(*patch)
            want.append((min(ys), min(xs), max(ys) + 1, max(xs) + 1, len(patch)))
        box, n = figures.patches(grid)
        assert sorted((*map(int, b), int(k)) for b, k in zip(box, n)) == sorted(want)
        boxes = [(x, y, x + w, y + h, 1) for x, y, w, h in rng.integers(1, 40, (rng.integers(1, 9), 4)).tolist()]
        got, k = figures.joined(np.array([b[:4] for b in boxes], float), np.ones(len(boxes)), 6.0)
        while pair := next(((p, q) for i, p in enumerate(boxes) for q in boxes[i + 1 :] if max(p[0], q[0]) - min(p[2], q[2]) < 6 and max(p[1], q[1]) - min(p[3], q[3]) < 6), None):
            p, q = pair
            boxes.remove(p)
            boxes.remove(q)
            boxes.append((min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]))
        assert sorted((*map(int, b), int(c)) for b, c in zip(got, k)) == sorted(boxes)


# --- Markdown, maths ---------------------------------------------------------------------


def test_markdown_blocks():
    md = "# Head\n\n#Docs: text\nwrapped\n\n| a | b |\n|---|:-:|\n| 1 | x\\|y |\n| 2 |\n\n1. one\n  - two\n2. three\n\n```py\ncode\n```\n$$\nx^2\n$$\n![Cap](img.png)\n| orphan"
    b = list(M.parse(md))
    assert [x["type"] for x in b] == ["heading", "paragraph", "table", "list", "code", "formula", "figure"]
    assert b[1]["text"] == "#Docs: text wrapped" and b[2]["rows"] == [["a", "b"], ["1", "x|y"], ["2"]] and b[2]["structure_suspect"]
    assert b[3]["items"] == [("one", 0), ("two", 1), ("three", 0)] and b[3]["ordered"] and b[4]["language"] == "py" and b[6]["caption"] == "Cap"
    assert [x["type"] for x in M.parse("| orphan", keep_orphan_rows=True)] == ["paragraph"]
    assert list(M.parse("")) == [] and list(M.parse("```\n```")) == []


def test_maths():
    assert maths.unicode(r"\mathcal{L}_{1} \in \mathbb{R}^2") == "ℒ₁ ∈ ℝ²"
    assert maths.unicode(r"\left(\alpha \leq \beta\right)") == "(α ≤ β)"
    assert maths.unicode(r"\frac{a}{b}") == "a⁄b" and maths.unicode(r"\widehat{y}") == "y" and maths.unicode(r"\{A_1\}") == "{A₁}"
    assert maths.display("cost $5 and $x^2$") == "cost $5 and x²"
    assert maths.spans("a $$x_1$$ b") == [("", "a "), ("$$", "x_1"), ("", " b")]
    assert maths.unicode(r"\mathcal{A}=\{A_{1}, A_{2}, \ldots, A_{n}\}") == "𝒜={A₁, A₂, …, Aₙ}" and maths.unicode("x^{ab") == "x{ab" and maths.unicode(r"x^{a_{1}}") == "xa₁"
    assert maths.unicode(r"\foo bar \sqrt{x} a\,b\!c") == "foo bar √{x} a bc" and maths.unicode("x^") == "x" and maths.unicode("") == ""


def test_model_answers(spark):
    said = {"```markdown\n$ x^2 $\n```": "$x^2$", "  plain ": "plain", "```\na\n\nb\n```": "a\n\nb", "$$ x $$ and $ y $": "$$ x $$ and $y$", "$ a$$ b$": "$a$$ b$", "$ a\nb $": "$ a\nb $", "```x": "```x", "": "", "cost $ 5": "cost $ 5"}
    df = spark.createDataFrame([(k, v) for k, v in said.items()] + [(None, None)], "t string, want string")
    for r in df.withColumn("got", maths.clean_model_output(F.col("t"))).collect():
        assert r["got"] == r["want"], r


def test_statistics(spark):
    b = blocks(spark, ["H1 Title here", "Four words in this."]).withColumn("structure_suspect", F.lit(False))
    t = b.limit(1).withColumns({"type": F.lit("table"), "text": F.lit("x"), "structure_suspect": F.lit(True), "pos": F.lit(9).cast("long")})
    r = stats.document_statistics(b.unionByName(t)).first()
    assert (r["pages"], r["headings"], r["tables"], r["uncertain_tables"], r["words"]) == (1, 1, 1, 1, 7)


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7])
def test_boxes_that_overlap_meet_in_bands(spark, share):
    """Covers by bands against all pairs, boxes of all heights, across bands, with and without an area."""
    rng = random.Random(int(share * 10))
    rows = lambda n: [(rng.randrange(3), i, float(rng.randrange(80)), float(rng.randrange(400)), float(rng.choice([0, 5, 40])), float(rng.choice([0, 3, 60, 200, 64]))) for i in range(n)]
    a, b = rows(150), rows(60)
    schema = "page long, ord int, x double, y double, w double, h double"
    df, claims = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)

    def cover(p, q):
        dx, dy = min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]), min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])
        return dx * dy / (p[4] * p[5]) if dx > 0 and dy > 0 and p[4] * p[5] > 0 else 0.0

    same = lambda p: [q for q in b if q[0] == p[0]]
    assert {r["a_ord"] for r in G.uncovered(df, claims, share).collect()} == {p[1] for p in a if all(cover(p, q) < share for q in same(p))}
    assert {(r["a_ord"], r["claim"]) for r in G.first_claim(df, claims, share).collect()} == {(p[1], min(own)) for p in a if (own := [q[1] for q in same(p) if cover(p, q) > share])}
    assert {(r["a_ord"], r["match"]) for r in G.matches(df, claims, share).collect()} == {(p[1], min((q[1] for q in same(p) if cover(p, q) > share or cover(q, p) > share), default=None)) for p in a}


def test_captions_and_findings_meet_in_bands(spark):
    """Captions and what an engine's findings cover, by bands against all pairs; boxes without a place are left alone."""
    rng = random.Random(5)
    rows = lambda n: [(rng.randrange(2), i, float(rng.randrange(60)), float(rng.randrange(500)), float(rng.choice([0, 5, 40])), float(rng.choice([0, 3, 24, 64, 150]))) for i in range(n)]
    figs, texts = rows(40), [(*r, "long " * 80 if r[1] % 9 == 0 else "short") for r in rows(300)]
    box = "page long, ord int, x double, y double, w double, h double"
    nowhere = [(0, 900, None, None, None, None)]
    got = G.nearest_below(spark.createDataFrame(figs + nowhere, box), spark.createDataFrame(texts + [(*nowhere[0], "short")], f"{box}, text string"))
    near = lambda f, t: (t[3] - (f[3] + f[5]), t[1])
    under = lambda f, t: f[0] == t[0] and -2 <= near(f, t)[0] < 24 and f[2] < t[2] + t[4] / 2 < f[2] + f[4] and len(t[6]) <= 300
    want = {(f[0], f[1], *min(near(f, t) for t in texts if under(f, t))[::-1]) for f in figs if any(under(f, t) for t in texts)}
    assert {tuple(r[c] for c in ("page", "a_ord", "caption", "gap")) for r in got.collect()} == want and want

    found = [(*r, rng.choice(["title", "table", "list", "paragraph", "paragraph"])) for r in rows(200)]

    def cover(p, q):
        dx, dy = min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]), min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])
        return dx * dy / (p[4] * p[5]) if dx > 0 and dy > 0 and p[4] * p[5] > 0 else 0.0

    for share in (0.6, 0.2):
        hidden = {p[1] for p in found for q in found if p[0] == q[0] and p[6] == "paragraph" != q[6] and cover(p, q) >= (0.9 if q[6] == "title" else share)}
        kept = X.vision_blocks(spark.createDataFrame(found + [(*nowhere[0], "paragraph")], f"{box}, kind string"), share=share)
        assert {r["ord"] for r in kept.collect()} == {p[1] for p in found} - hidden | {900} and hidden
