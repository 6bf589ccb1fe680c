"""Blocks of every type as plain text and as Markdown.

A frame of blocks has ``type``, ``level`` and ``text``; a table's ``rows``, a
list's ``items`` and ``ordered``, a figure's ``path`` and ``caption``, a
formula's ``latex`` and ``is_inline`` and a code block's ``language`` are null
elsewhere, and a frame without such blocks may lack the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as T

#: Columns of a block beside its text, and their types.
FIELDS = {
    "level": "int", "ordered": "boolean", "items": "array<struct<text:string,depth:int>>",
    "rows": "array<array<struct<text:string,row_span:int,col_span:int>>>", "structure_suspect": "boolean",
    "path": "string", "caption": "string", "latex": "string", "is_inline": "boolean", "language": "string",
}


def complete(blocks: DataFrame) -> DataFrame:
    """``blocks`` with all of ``FIELDS``: null where the frame has none."""
    return blocks.withColumns({c: F.lit(None).cast(t) for c, t in FIELDS.items() if c not in blocks.columns})


def plain_text() -> Column:
    """A complete frame's text: list items by lines, table rows by lines and cells by spaces, a figure's caption; never null."""
    items = F.array_join(F.transform("items", lambda x: F.coalesce(x.text, F.lit(""))), "\n")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c.text, F.lit(""))), " ")), "\n")
    kind = F.col("type")
    own = (
        F.when(kind == "list", F.coalesce(items, F.col("text"))).when(kind == "table", F.coalesce(rows, F.col("text")))
        .when(kind == "figure", F.col("caption")).when(kind == "formula", F.coalesce("latex", "text")).otherwise(F.col("text"))
    )
    return F.coalesce(own, F.lit(""))


def item_numbers(depths: Column) -> Column:
    """Each item's number among its depth's since the last shallower item, for depths of any size."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("out"))

    def step(acc, d):
        d = F.greatest(F.coalesce(d, F.lit(0)), F.lit(0))
        shallower = F.slice(acc.open, F.lit(1), d)
        filled = F.concat(shallower, F.array_repeat(F.lit(0), d - F.size(shallower)))
        n = F.coalesce(F.get(acc.open, d), F.lit(0)) + 1
        return F.struct(F.concat(filled, F.array(n)).alias("open"), F.concat(acc.out, F.array(n)).alias("out"))

    return F.aggregate(depths, start, step, lambda acc: acc.out)


def list_markdown(items: Column, ordered: Column) -> Column:
    numbers = item_numbers(F.transform(items, lambda x: x.depth))

    def line(x, i):
        marker = F.when(F.coalesce(ordered, F.lit(False)), F.concat(F.get(numbers, i).cast("string"), F.lit("."))).otherwise(F.lit("-"))
        indent = F.repeat(F.lit("  "), F.greatest(F.coalesce(x.depth, F.lit(0)), F.lit(0)))
        return F.concat(indent, marker, F.lit(" "), T.trim(T.escape_inline(F.coalesce(x.text, F.lit("")))))

    return F.array_join(F.transform(items, line), "\n")


def figure_markdown(path: Column, caption: Column) -> Column:
    """The image with its caption as alternative text and, if it has one, below."""
    said = T.trim(F.coalesce(caption, F.lit("")))
    image = F.concat(F.lit("!["), T.trim(T.escape_inline(F.coalesce(caption, F.lit("")))), F.lit("]("), T.encode_path(path), F.lit(")"))
    return F.when(said == "", image).otherwise(F.concat(image, F.lit("\n\n*"), T.escape_inline(said), F.lit("*")))


def markdown() -> Column:
    """A complete frame's Markdown; empty for what has nothing to show."""
    from quire.operators.tables import table_markdown

    kind, t = F.col("type"), F.coalesce("text", F.lit(""))
    latex = T.trim(F.coalesce("latex", "text", F.lit("")))
    formula = F.when(latex == "", F.lit("")).when(F.coalesce("is_inline", F.lit(False)), F.concat(F.lit("$"), latex, F.lit("$"))).otherwise(F.concat(F.lit("$$\n"), latex, F.lit("\n$$")))
    return F.coalesce(
        F.when(kind == "list", list_markdown(F.col("items"), F.col("ordered")))
        .when(kind == "table", table_markdown(F.col("rows"), F.col("structure_suspect")))
        .when(kind == "figure", figure_markdown(F.col("path"), F.col("caption")))
        .when(kind == "formula", formula)
        .otherwise(T.render_block(kind, F.col("level"), t, F.col("language"))),
        F.lit(""),
    )
