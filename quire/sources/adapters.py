"""The supplied tables as documents: blocks, boxes, lines, tables and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph for each line with text; forty lines a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    d = d.where(F.length(F.btrim("text")) > 0)
    return d.select("doc_id", "source", F.floor(F.col("ord") / 40).cast("int").alias("page_index"), "ord", F.col("ord").cast("long").alias("pos"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), "text")


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a document: a turn is a page, opened by a heading of its role's level.

    Turns close, by number, with a table, a list, a figure, a formula, a piece of code or nothing more.
    """
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    heads = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), F.lit(0).alias("ord"), F.lit("heading").alias("type"), level.alias("level"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("text"))
    lines = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    lines = lines.where(F.length(F.btrim("text")) > 0).select("doc_id", "page_index", (F.col("ord") + 1).alias("ord"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), "text")
    turn, k = F.col("turn").cast("string"), F.col("turn") % 6
    cell = lambda t: F.struct(t.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    item = lambda t, depth: F.struct(t.alias("text"), F.lit(depth).alias("depth"))
    more = c.where(k < 5).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), F.lit(99_990).alias("ord"),
        F.get(F.array(*map(F.lit, ("table", "list", "figure", "formula", "code"))), k.cast("int")).alias("type"),
        F.when(k == 4, F.concat(F.lit("turn = "), turn)).alias("text"),
        F.when(k == 0, F.array(F.array(cell(F.lit("role")), cell(F.lit("turn"))), F.array(cell(F.col("role")), cell(turn)))).alias("rows"), F.when(k == 0, F.col("turn") % 4 == 0).alias("structure_suspect"),
        F.when(k == 1, F.array(item(F.col("role"), 0), item(F.concat(F.lit("turn "), turn), 1))).alias("items"), F.when(k == 1, F.lit(True)).alias("ordered"),
        F.when(k == 2, F.concat(F.lit("images/p"), turn, F.lit(".png"))).alias("path"), F.when(k == 2, F.col("role")).alias("caption"),
        F.when(k == 3, F.concat(F.lit("x_{"), turn, F.lit("}"))).alias("latex"), F.when(k == 3, F.lit(False)).alias("is_inline"), F.when(k == 4, F.lit("py")).alias("language"),
    )
    return heads.unionByName(lines).unionByName(more, allowMissingColumns=True).withColumn("pos", F.col("page_index") * 100000 + F.col("ord"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is a page; each takes a quarter of a second more than the one before."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), (F.col("turn") * 0.25).cast("double").alias("duration"))


#: Orders whose lines are the boxes of a page.
ORDERS = 32


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes, numbered by all their columns; the lines of ``ORDERS`` orders make a page, so pages keep their size."""
    li = table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    w = W.partitionBy("page").orderBy(*cols)
    return li.withColumn("page", F.floor(F.col("l_orderkey") / ORDERS)).select(
        "page", F.row_number().over(w).alias("ord"),
        F.round(F.col("l_quantity") * 10, 2).alias("x"), F.round(F.col("l_linenumber") * 14 + F.col("l_discount") * 100, 2).alias("y"),
        F.round(20 + F.col("l_tax") * 1000, 2).alias("w"), F.lit(10.0).alias("h"),
        (F.col("l_linestatus") == "O").cast("int").alias("col"), "l_linenumber", "l_returnflag", "l_suppkey", "l_partkey", "l_orderkey",
    )


def heading_candidates(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Part names under section numbers, in five sizes; ``more`` columns of their boxes go along."""
    li, part = boxes(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select(
        "page", "ord", F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_suppkey") % 4).cast("string"), F.lit(" "), F.initcap("p_name")).alias("text"),
        F.when(F.col("l_linenumber") % 3 == 0, 2).otherwise(1).alias("lines"),
        (8 + (F.col("l_linenumber") % 5) * 0.5).cast("double").alias("size"), (F.col("l_returnflag") == "R").alias("bold"), *more,
    )


def page_arrays(d: DataFrame) -> DataFrame:
    """A row of ``documents`` as a page of its source: an array of a header, all the lines of its text and a footer."""
    block = lambda kind, ord_, text, y, h: F.struct(F.lit(kind).alias("type"), ord_.cast("int").alias("ord"), text.alias("text"), F.lit(y).alias("y"), F.lit(h).alias("h"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    header = F.array(block("heading", F.lit(0), F.concat(F.col("lang"), F.lit(" p. "), F.col("doc_id").cast("string")), 20.0, 10.0))
    body = F.transform(lines, lambda t, i: block("paragraph", i + 1, t, 200.0, 300.0))
    footer = F.array(block("paragraph", F.size(lines) + 1, F.col("n_chars").cast("string"), 760.0, 10.0))
    return d.select("doc_id", F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.lit(790.0).alias("page_height"), F.concat(header, body, footer).alias("blocks"))


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as a document of pages, a row a block."""
    return page_arrays(table(spark, sf_dir, "documents")).select("doc", "page", "page_height", F.inline("blocks"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a table: flag (blank for N), quantity and price of each line, as one array of rows."""
    li = table(spark, sf_dir, "lineitem")
    cell = lambda c: F.struct(c.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    flag = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_returnflag"))
    row = F.array(cell(flag), cell(F.col("l_quantity").cast("long").cast("string")), cell(F.floor("l_extendedprice").cast("string")))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = li.select("l_orderkey", F.struct(key.alias("k"), row.alias("r")).alias("x"))
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.r).alias("rows"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as list items of depth 0 to 4."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("ord"), (F.col("l_linenumber") % 5).alias("depth"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"))


def nav_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a page's navigation as lines of a table of contents."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"<li><a[^>]*>([^<]*)</a>"), F.lit(1)).alias("items"))
    e = p.select("page_id", F.posexplode("items").alias("ord", "item"))
    # every seventh line is prose, so that runs end
    text = F.when(F.col("ord") % 7 == 6, F.concat("item", F.lit(" is prose,"))).otherwise(F.concat("item", F.lit(" ..... "), (F.col("ord") + 1).cast("string")))
    return e.select("page_id", "ord", text.alias("text"), (F.col("ord") % 11 >= 8).cast("int").alias("col"))
