"""Quality rules learned as a decision list.

``text_stats`` counts what a text shows; ``features`` are ratios of the counts
as Spark columns.  ``learn`` grows a list of conjunctions of thresholds by
sequential covering: the next rule is grown on two thirds of the rows left by
information gain, pruned on the other third, and kept if it is precise and
covers enough; the rows it covers leave.  ``DecisionList.column`` emits the
list as one ordered ``CASE`` expression, which Spark evaluates natively.

Only rules that reject are learned; a row that none covers is kept.  Null and
empty texts have zero counts.  Without labelled rows of both classes the list
is empty and keeps everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from quire.llm._arrow import col, map_texts

#: The most labelled rows that a list is learned from: a model's training set, chosen by hash of the id.
SAMPLE = 6_000
WINDOW = 5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_marks", "n_distinct_words", "n_chars")

_SYMBOLS = b"#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mix = h[: n - window + 1].copy()
    for i in range(1, window):
        mix *= np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        mix += h[i : n - window + 1 + i]
    order = np.argsort(mix)
    same = mix[order][1:] == mix[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(mix) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # at 0x20 and 0x09-0x0D alone
    gaps = sum(map(text.count, _SPACE))
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - gaps, gone(_SYMBOLS), dup, repeated_words(words), sum(1 for x in lines if x and not x.isspace()),
        gone(_CAPITALS), gone(_DIGITS), gone(b"!?"), len(set(words)), len(text),
    )


def text_stats(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``STATS``, each a long."""

    def make():
        return lambda texts: [list(x) for x in zip(*map(stats_of, texts))] if texts else [[] for _ in STATS]

    return map_texts(df, text_col, keep, [StructField(s, LongType()) for s in STATS], make)


def _ratio(a: str, b: str) -> Column:
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(0.0))




def features() -> dict[str, Column]:
    """Name to native expression over ``STATS``."""
    return {
        "chars_per_word": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "capitals_per_char": _ratio("n_capitals", "word_chars"),
        "digits_per_char": _ratio("n_digits", "word_chars"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "distinct_share": _ratio("n_distinct_words", "n_words"),
        "n_words": col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold)."""

    terms: tuple[tuple[str, str, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, at in self.terms:
            out &= x[f] <= at if op == "<=" else x[f] > at
        return out

    def column(self, feats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, op, at in self.terms:
            out = out & (feats[f] <= at if op == "<=" else feats[f] > at)
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """True (keep) or false, by the first rule that holds."""
        feats, out = features(), None
        for rule in self.rules:
            hit = rule.column(feats)
            out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self):
        return "\n".join(["if " + " and ".join(f"{f} {op} {at:.4g}" for f, op, at in r.terms) + ": reject" for r in self.rules] + ["else keep"])


def _best_term(x, bad, live, names):
    """The threshold of highest information gain among the rows that are live."""
    p0, n0 = bad[live].sum(), (~bad[live]).sum()
    base = np.log2(p0 / (p0 + n0))
    best = (0.0, None)
    for f in names:
        v = x[f][live]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[live][order]
        cut = np.flatnonzero(v[1:] != v[:-1])
        if not len(cut):
            continue
        below = np.cumsum(b)[cut].astype(float)
        n_below = (cut + 1).astype(float)
        mid = (v[cut] + v[cut + 1]) / 2
        for op, p, n in (("<=", below, n_below), (">", p0 - below, len(v) - n_below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - base), -1)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), (f, op, float(mid[i])))
    return best[1]


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 5, most_rules: int = 12, most_terms: int = 4) -> DecisionList:
    """Sequential covering.  ``rows``: feature to values; ``bad``: rows to reject."""
    names = sorted(rows)
    part = np.arange(len(bad)) % 3 == 0  # the pruning third
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = left & ~part, left & part
        if bad[grow].sum() < support or not (~bad[grow]).any():
            break
        terms: list[tuple[str, str, float]] = []
        live = grow.copy()
        while len(terms) < most_terms and (~bad[live]).any():
            term = _best_term(rows, bad, live, names)
            if term is None:
                break
            terms.append(term)
            live = grow & Rule(tuple(terms)).holds(rows)
        if not terms:
            break

        def worth(t):  # reduced-error pruning: (covered bad - covered good) of what is covered
            hit = prune & Rule(tuple(t)).holds(rows)
            p, n = bad[hit].sum(), (~bad[hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(terms) > 1:
            fewer = max((terms[:i] + terms[i + 1 :] for i in range(len(terms))), key=worth)
            if worth(fewer) < worth(terms):
                break
            terms = fewer
        rule = Rule(tuple(terms))
        hit = left & rule.holds(rows)
        p, n = bad[hit].sum(), hit.sum()
        if p < support or p < precision * n:
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learn from at most ``sample`` labelled documents, least hash of the id first.

    ``sample`` bounds what is broadcast to find them and what reaches the
    driver: numbers alone, no texts.  Of an id with several labels the least
    counts.
    """
    picked = (
        labels.where(col(id_col).isNotNull() & col(quality_col).isNotNull())
        .groupBy(col(id_col).alias("q_id")).agg(F.min(col(quality_col)).alias("q_label"))
        .orderBy(F.xxhash64("q_id"), "q_id").limit(sample)
    )
    chosen = docs.select(col(id_col).alias("q_id"), col(text_col).alias("q_text")).join(F.broadcast(picked), "q_id")
    stats = text_stats(chosen, "q_text", ("q_id", "q_label"))
    got = stats.select("q_id", "q_label", *[e.alias(f) for f, e in features().items()]).orderBy("q_id", "n_words").limit(2 * sample).toPandas()
    if not len(got):
        return DecisionList(())
    return learn({f: got[f].to_numpy(float) for f in features()}, got["q_label"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``STATS``, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return text_stats(docs, text_col, keep).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.column())


def apply_rules(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents that ``judge`` keeps, all their columns as they were."""
    names = docs.columns
    all_stats = [StructField(f"q__{s}", LongType()) for s in STATS]

    def make():
        return lambda texts: [list(x) for x in zip(*map(stats_of, texts))] if texts else [[] for _ in STATS]

    rows = map_texts(docs.select(F.struct(*map(col, names)).alias("q__row"), col(text_col).alias("q__text")), "q__text", ("q__row",), all_stats, make)
    named = rows.select("q__row", *[F.col(f"q__{s}").alias(s) for s in STATS])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return named.where(~failed & rules.column()).select("q__row.*")
