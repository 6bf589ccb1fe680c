"""Heading detection and the whole-document passes over headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T

TIER = 0.06
# Titles that open a list of sources.
BIBLIOGRAPHY = ("references", "bibliography", "works cited", "literature", "literatur", "literaturverzeichnis", "quellen")


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def with_median(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Rows with the ``upper_median`` of their group's values, null left out; the rows are sorted, never gathered."""
    of = W.partitionBy(*keys)
    d = df.withColumn("q_v", value)
    d = d.withColumn("q_n", F.row_number().over(of.orderBy(F.col("q_v").asc_nulls_last()))).withColumn("q_all", F.count("q_v").over(of))
    return d.withColumn(name, F.max(F.when(F.col("q_n") == F.floor(F.col("q_all") / 2) + 1, F.col("q_v"))).over(of)).drop("q_v", "q_n", "q_all")


def page_body_sizes(c: DataFrame, page: str = "page") -> DataFrame:
    """Upper median size of a page's candidates of several lines, or of all if none has."""
    sizes = lambda f: F.array_compact(F.collect_list(f))
    g = c.groupBy(page).agg(sizes(F.when(F.col("lines") > 1, F.col("size"))).alias("many"), sizes(F.col("size")).alias("each"))
    return g.select(page, upper_median(F.when(F.size("many") > 0, F.col("many")).otherwise(F.col("each"))).alias("body"))


def classify(c: DataFrame, page: str = "page") -> DataFrame:
    """Candidates with ``is_heading`` and ``level``: the rank of their size among the page's headings, 6 at most."""
    j = with_median(c, [page], F.when(F.col("lines") > 1, F.col("size")), "q_many")
    j = with_median(j, [page], F.col("size"), "q_each").withColumn("body", F.coalesce("q_many", "q_each")).drop("q_many", "q_each")
    j = T.with_heading_shape(j)
    half = F.round(F.col("size") * 2) / 2
    # headings rank among themselves: the others share a partition of their own, and no level
    rank = F.dense_rank().over(W.partitionBy(page, "is_heading").orderBy(F.desc(half)))
    return j.withColumn("level", F.when(F.col("is_heading"), F.least(rank, F.lit(6))))


def body_size(paragraphs: DataFrame, doc: str = "doc") -> DataFrame:
    """The size, by quarter points, that most characters are set in; of ties the smallest."""
    q = (F.round(F.col("size") * 4) / 4).alias("size")
    mass = paragraphs.where("size > 0").groupBy(doc, q).agg(F.sum(F.length("text")).alias("mass"))
    return mass.groupBy(doc).agg(F.max_by("size", F.struct("mass", -F.col("size"))).alias("body_size"))


def demote_small(heads: DataFrame, bodies: DataFrame, doc: str = "doc", tolerance: float = 1.02) -> DataFrame:
    """``kept``: false for headings below the document's body size, unless numbered."""
    j = heads.join(bodies, doc, "left")
    low = (F.col("body_size") > 0) & (F.col("size") > 0) & (F.col("size") < F.col("body_size") * tolerance)
    return j.withColumn("kept", ~F.coalesce(low & T.section_depth(F.col("text")).isNull(), F.lit(False)))


def demote_bibliography(heads: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """``kept``: false for numbered headings after the bibliography's title.

    A document gives its first such title's place, a row, so that no task holds
    a document's headings.
    """
    title = F.lower(T.trim(F.col("text"))).isin(*BIBLIOGRAPHY)
    first = heads.where(title).groupBy(doc).agg(F.min(order).alias("q_first"))
    j = heads.join(first, doc, "left")
    listed = (F.col(order) > F.col("q_first")) & ~title & T.section_depth(F.col("text")).isNotNull()
    return j.withColumn("kept", ~F.coalesce(listed, F.lit(False))).drop("q_first")


def tiers(sizes: Column, tolerance: float = TIER) -> Column:
    """Descending heads of clusters: a size within the tolerance of its cluster's head starts none."""
    return F.aggregate(
        F.sort_array(sizes, asc=False), F.array().cast("array<double>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s > F.try_element_at(acc, F.lit(-1)) * (1 - tolerance)), acc).otherwise(F.concat(acc, F.array(s))),
    )


def tier_of(size: Column, heads: Column) -> Column:
    """Number, from 1, of the first tier that a size reaches; the last if none."""
    reached = F.filter(F.sequence(F.lit(1), F.size(heads)), lambda i: size > F.element_at(heads, i) * 0.94)
    return F.coalesce(F.get(reached, F.lit(0)), F.size(heads))


def normalize_levels(heads: DataFrame, doc: str = "doc") -> DataFrame:
    """``new_level``: by numbering (under the title) or by size tier; untouched with one size or one tier.

    A document's distinct sizes, which type has few of, make its tiers.
    """
    sized = F.when(F.col("size") > 0, F.col("size"))
    of = heads.groupBy(doc).agg(F.count(sized).alias("n_sizes"), tiers(F.collect_set(sized)).alias("tiers"), F.max(T.section_depth(F.col("text")).isNotNull().cast("int")).alias("numbered"))
    j = heads.join(of, doc)
    depth = T.section_depth(F.col("text"))
    ranked = F.when(depth.isNotNull(), F.least(depth + F.col("numbered"), F.lit(6))).when(F.col("size") > 0, F.least(tier_of(F.col("size"), F.col("tiers")), F.lit(6))).otherwise(F.col("level"))
    apply = (F.col("n_sizes") > 1) & (F.size("tiers") > 1)
    return j.withColumn("new_level", F.when(apply, ranked).otherwise(F.col("level")).cast("int")).drop("n_sizes", "numbered", "tiers")
