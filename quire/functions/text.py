"""Text functions as Spark columns: white space, tokens, headings, Markdown escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Unicode White_Space, and the scripts whose characters cost a token or so.
WS_SET = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{WS_SET}]"
BLANK = r"[\t \u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"  # white space within a line
DENSE = r"[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF]"


def let(value: Column, of) -> Column:
    """``of(value)``, the value being computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def solid(t: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(t, WS, "")


def count_of(t: Column, pattern: str) -> Column:
    """How many characters match."""
    return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))


def token_estimate(t: Column) -> Column:
    """Tokens of a byte-pair tokenizer, estimated: 3.8 characters each, dense scripts 1.1 tokens each."""
    s = solid(t)
    dense = count_of(s, DENSE)
    return F.round((F.length(s) - dense) / F.lit(3.8) + dense * F.lit(1.1)).cast("long")


def trim(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def trim_blank(t: Column) -> Column:
    return F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", "")


def trim_end_newlines(t: Column) -> Column:
    return F.regexp_replace(t, r"[\n\r\x0B\f\u0085\u2028\u2029]+$", "")


def word_count(t: Column) -> Column:
    """Runs of characters other than white space."""
    # cut at white space: the class of all else takes five times as long to match
    return F.size(F.array_remove(F.split(t, f"[{WS_SET}]+"), "")).cast("long")


def garbled_ratio(t: Column) -> Column:
    """Share of private-use, control, unassigned and replacement characters among the solid ones."""
    s = solid(t)
    return F.when(F.length(s) > 0, count_of(s, r"[\p{Co}\p{Cc}\p{Cn}\uFFFD]") / F.length(s)).otherwise(F.lit(0.0))


_LABEL = r"^(\p{N}{1,2}|\p{Lu})((?:\.\p{N}+){0,3})\.?[ \t]"


def section_depth(t: Column) -> Column:
    """Parts of a section label such as ``3``, ``4.2.1.`` or ``A.2`` before a title; else null."""
    s = trim_blank(t)
    rest = trim_blank(F.regexp_replace(s, r"^[^ \t]*[ \t]", ""))
    titled = (F.length(rest) >= 2) & rest.rlike(r"\p{L}")
    return F.when(s.rlike(_LABEL) & titled, count_of(F.regexp_extract(s, _LABEL, 2), r"\.") + 1).cast("int")


def _after_label(t: Column, depth: Column) -> Column:
    return F.when(depth.isNotNull(), F.regexp_replace(t, r"^[^ \t]*[ \t]", "")).otherwise(t)


def _arithmetic(t: Column, body: Column, digits: Column, letters: Column) -> Column:
    return t.contains("=") | (body.contains("%") & (digits > 0)) | (letters == 0) | (digits / F.greatest(F.lit(1), digits + letters) > 0.18)


def chart_label(t: Column) -> Column:
    """Arithmetic where a title would have words."""
    body = _after_label(t, section_depth(t))
    return _arithmetic(t, body, count_of(body, r"\p{N}"), count_of(body, r"\p{L}"))


def citation(t: Column) -> Column:
    """Names of authors: `et al.`, an ampersand, an initial."""
    return t.contains(" et al.") | t.contains(" & ") | t.rlike(r"[ ,]\p{Lu}\.")


def with_heading_shape(df: DataFrame, text: str = "text", lines: str = "lines", size: str = "size", bold: str = "bold", body: str = "body", name: str = "is_heading") -> DataFrame:
    """Adds whether a run of text looks like a heading beside body text of a size.

    What several tests need is computed once, in columns that go again.
    """
    h = lambda c: F.col(f"h__{c}")
    d = df.withColumn("h__s", trim(F.col(text))).withColumns({"h__depth": section_depth(h("s")), "h__n": F.length(h("s"))})
    d = d.withColumn("h__body", _after_label(h("s"), h("depth")))
    d = d.withColumns({"h__digits": count_of(h("body"), r"\p{N}"), "h__letters": count_of(h("body"), r"\p{L}")})
    s, n = h("s"), h("n")
    numbered = (F.col(lines) == 1) & (n <= 90) & h("depth").isNotNull() & s.rlike(f"^[^{WS_SET}]+{WS}+\\p{{Lu}}")
    set_apart = (F.col(size) >= F.col(body) * 1.06) | (F.col(bold) & (F.col(size) >= F.col(body) * 0.95) & (n <= 80))
    shaped = (
        (n >= 2) & (F.col(lines) <= 2) & (n <= 120) & (set_apart | numbered) & s.rlike(r"\p{L}") & ~(s.endswith(".") & (n > 60)) & ~s.rlike(r"^\p{Ll}")
        & ~_arithmetic(s, h("body"), h("digits"), h("letters")) & ~citation(s)
    )
    return d.withColumn(name, shaped).drop(*[c for c in d.columns if c.startswith("h__")])


def chart_lettering(kind: Column, t: Column) -> Column:
    """Short text inside a drawing: labels and legends, not captions or titles."""
    s = trim(t)
    words = F.array_remove(F.split(s, " +"), "")
    sentence = s.endswith(".") & (F.size(words) > 6)
    return (
        kind.isin("paragraph", "heading") & (F.length(s) > 0) & (F.length(s) <= 90) & ~sentence & section_depth(s).isNull()
        & (chart_label(s) | F.exists(words, lambda w: w.rlike(r"^\p{L}$")) | (F.size(words) <= 3))
    )


def bold_font(name: Column) -> Column:
    return F.lower(name).rlike("bold|-bd|semibold|black|heavy|-medi|demi")


def is_math(t: Column) -> Column:
    return (F.length(t) > 0) & ~t.contains("\n") & t.rlike(r"[\\_^{}]")


def furniture_text(t: Column) -> Column:
    """Lower case, numbers out, white space collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(t), r"\p{N}", ""), f"{WS}+", " "))


# --- Markdown -----------------------------------------------------------------

MATH = r"\$\$(?:(?!\$\$)[^\n])*?[\\_^{}](?:(?!\$\$)[^\n])*\$\$|\$[^$\n]*[\\_^{}][^$\n]*\$"


def escape_prose(t: Column) -> Column:
    """Backslashes before what Markdown would read as marks."""
    s = F.regexp_replace(t, r"([\\`*_\[\]<])", r"\\$1")
    s = F.regexp_replace(s, r"(^|[\n\r\u0085\u2028\u2029])([#+>-])(?= |\z)", r"$1\\$2")
    return F.regexp_replace(s, r"(^|[\n\r\u0085\u2028\u2029])(\p{N}+)\.(?= |\z)", r"$1$2\\.")


def escape_inline(t: Column) -> Column:
    """As ``escape_prose``, formulas between dollars left alone."""
    parts = F.regexp_extract_all(t, F.lit(f"(?s)(?:{MATH})|(?:(?!{MATH}).)+"), F.lit(0))
    mixed = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^(?:{MATH})$"), x).otherwise(escape_prose(x))), "")
    return F.when(t.contains("$"), mixed).otherwise(escape_prose(t))


def escape_cell(t: Column) -> Column:
    """A table cell: no bare pipe, line breaks as ``<br>``."""
    return trim(F.regexp_replace(F.replace(escape_inline(t), F.lit("|"), F.lit("\\|")), "\r?\n", "<br>"))


def unescape(t: Column) -> Column:
    return F.regexp_replace(t, r"\\([!-/:-@\[-`{-~])", "$1")


def fence(t: Column) -> Column:
    """Backticks that no run inside reaches, three at least."""
    runs = F.transform(F.regexp_extract_all(t, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def encode_path(t: Column) -> Column:
    """Percent-encoding of a path, its separators kept."""
    out = F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))
    for code, char in (("%2F", "/"), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def render_block(kind: Column, level: Column, t: Column, language: Column | None = None) -> Column:
    """Markdown of a heading, paragraph, formula or code block; empty if it has no text."""
    escaped = trim(escape_inline(t))
    latex = trim(t)
    code = F.concat(fence(t), F.coalesce(language, F.lit("")) if language is not None else F.lit(""), F.lit("\n"), trim_end_newlines(t), F.lit("\n"), fence(t))
    return (
        F.when(kind == "heading", F.when(escaped == "", F.lit("")).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), escaped)))
        .when(kind == "formula", F.when(latex == "", F.lit("")).otherwise(F.concat(F.lit("$$\n"), latex, F.lit("\n$$"))))
        .when(kind == "code", code)
        .otherwise(escaped)
    )


def figure_name(page: Column, number: Column) -> Column:
    """A figure's file: its page, from 1, and its number there."""
    return F.format_string("p%03d-fig%02d.png", page + 1, number)
