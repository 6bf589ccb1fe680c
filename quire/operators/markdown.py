"""Markdown to blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType


ITEM = StructType([StructField("text", StringType()), StructField("depth", IntegerType())])
CELL = StructType([StructField("text", StringType()), StructField("row_span", IntegerType()), StructField("col_span", IntegerType())])
BLOCK = StructType([
    StructField("ord", IntegerType()), StructField("type", StringType()), StructField("level", IntegerType()), StructField("text", StringType()),
    StructField("ordered", BooleanType()), StructField("items", ArrayType(ITEM)), StructField("rows", ArrayType(ArrayType(CELL))),
    StructField("structure_suspect", BooleanType()), StructField("path", StringType()), StructField("caption", StringType()), StructField("language", StringType()),
    StructField("latex", StringType()),
])

_HEADING = re.compile(r"(#{1,6}) +(.*\S)", re.S)
_LIST = re.compile(r"(?:[-*+] |(\d+)[.)] )(.*)", re.S)
_FIGURE = re.compile(r"!\[([^\]]*)\]\((.+)\)[^)]*", re.S)
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_PIPE = re.compile(r"\\.|(\|)", re.S)


def unescape(t: str) -> str:
    return _ESCAPED.sub(r"\1", t)


def split_row(line: str) -> list[str]:
    """Cells between pipes that no backslash escapes; the first pipe opens the row."""
    cuts = [0] + [m.start() for m in _PIPE.finditer(line) if m[1] and m.start()]
    cells = [line[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
    rest = line[cuts[-1] + 1 :]
    return cells + [rest] if rest.strip() else cells


def _delimiter(line: str) -> bool:
    cells = split_row(line) if _table(line) else []
    return bool(cells) and all(re.fullmatch(r"[-:]+", c.strip()) for c in cells)


def _table(line: str) -> bool:
    return line.startswith("|") and len(line) > 1


def _fence(line: str) -> str:
    ticks = re.match("`*", line)[0]
    return ticks if len(ticks) >= 3 else ""


def _starts_block(line: str) -> bool:
    return bool(_HEADING.fullmatch(line) or _table(line) or _LIST.match(line) or _fence(line) or line == "$$" or _FIGURE.match(line))


def parse(markdown: str, keep_orphan_rows: bool = False) -> Iterator[dict]:
    """Blocks of a text, in order.

    A line that opens with a pipe but heads no table is dropped, unless
    ``keep_orphan_rows`` makes a paragraph of it.
    """
    lines = markdown.replace("\r\n", "\n").split("\n")
    at = 0

    def until(start, stop):
        end = start
        while end < len(lines) and not stop(lines[end].strip(" \t")):
            end += 1
        return end

    while at < len(lines):
        raw, line = lines[at], lines[at].strip(" \t")
        if not line:
            at += 1
        elif fence := _fence(line):
            end = until(at + 1, lambda x: x.startswith(fence))
            if end > at + 1:
                yield dict(type="code", text="\n".join(lines[at + 1 : end]), language=line[len(fence) :].strip() or None)
            at = end + 1
        elif line == "$$":
            end = until(at + 1, lambda x: x == "$$")
            if latex := "\n".join(lines[at + 1 : end]).strip():
                yield dict(type="formula", text=latex, latex=latex)
            at = end + 1
        elif m := _HEADING.fullmatch(line):
            yield dict(type="heading", level=len(m[1]), text=unescape(m[2].strip()))
            at += 1
        elif _table(line) and at + 1 < len(lines) and _delimiter(lines[at + 1].strip(" \t")):
            end = until(at, lambda x: not _table(x))
            body = [x for x in (y.strip(" \t") for y in lines[at:end]) if not _delimiter(x)]
            rows = [[unescape(c.strip()).replace("<br>", "\n") for c in split_row(x)] for x in body]
            if rows:
                yield dict(type="table", rows=rows, structure_suspect=len({len(r) for r in rows}) > 1)
            at = end
        elif _LIST.match(line):
            end = until(at, lambda x: not _LIST.match(x))
            found = [(_LIST.match(x.strip(" \t")), len(x) - len(x.lstrip(" \t"))) for x in lines[at:end]]
            yield dict(type="list", ordered=any(m[1] for m, _ in found), items=[(unescape(m[2].strip()), indent // 2) for m, indent in found])
            at = end
        elif m := _FIGURE.match(line):
            yield dict(type="figure", path=m[2], caption=unescape(m[1]) or None)
            at += 1
        else:
            end = until(at, lambda x: not x or _starts_block(x))
            if end > at or keep_orphan_rows:
                end = max(end, at + 1)
                yield dict(type="paragraph", text=unescape(" ".join(x.strip(" \t") for x in lines[at:end])))
            at = max(end, at + 1)


def _shaped(name: str, value):
    """A table's cells with their spans, which Markdown has none of."""
    return [[dict(text=c, row_span=1, col_span=1) for c in row] for row in value] if name == "rows" and value else value


def parse_markdown(docs: DataFrame, key: str = "doc_id", md: str = "markdown") -> DataFrame:
    """A row a block of each document's Markdown; ``docs`` holds whole documents."""
    schema = StructType([docs.schema[key], *BLOCK.fields])
    names = BLOCK.names[1:]

    def run(batches):
        for pdf in batches:
            rows = [(k, i, *[_shaped(n, b.get(n)) for n in names]) for k, t in zip(pdf[key], pdf[md]) for i, b in enumerate(parse(t or ""))]
            out = pd.DataFrame(rows, columns=schema.names, dtype=object)
            yield out

    return docs.select(key, md).mapInPandas(run, schema)
