"""URL filters: rules first, then a model that reads words out of host names.

Host names run words together.  A unigram model with the counts of all words
of paths and page titles splits each label of a host by Viterbi; a multinomial naive Bayes
model scores the words of host and path.  It learns from the urls that a rule
decides: the words that stand in allowed and in blocked ones.  All words count,
each by itself; both models are tables that hosts and paths are joined with.

Host and path are cut as the contract says, by Spark's own functions; rules
are native too.  Null urls and urls without ``://`` have an empty host and
path; no rule fits them and the model scores the prior alone.  Equal scores
allow.  Rows are independent; repeated rows count as often as they stand.
Urls of any length: a long one's words and stretches carry an id, not its text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quire.llm._arrow import ROWS, col, explode_texts
from quire.storage import files_for, staged

# The contract's rules, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Tasks that a hot host's or path's urls are dealt over; what has more urls than
#: ``HOT_LEAST`` and than ``HOT`` of all is hot, so at most 1 / HOT keys are.
SALTS, HOT, HOT_LEAST = 16, 1 / 1000, 1000

_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[^\W_]+")


def host_column(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), *_A_Z)


def path_column(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """Number of the longest rule that fits, or null."""
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    out = None
    for i in ranked:
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def parts(urls: DataFrame, url_col: str = "url", keep: Sequence[str] = ("page_id",), rules=RULES) -> DataFrame:
    """``keep`` columns as k0, k1, ..., ``host``, ``path``, ``rule`` (number or null)."""
    cut = urls.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], host_column(col(url_col)).alias("host"), path_column(col(url_col)).alias("path"))
    return cut.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def viterbi(label: str, words: dict[str, float], unknown: float) -> list[str]:
    """The likeliest split of a label's letters and digits into words."""
    n = len(label)
    best = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    lengths = sorted({len(w) for w in words if w})
    for i in range(n):
        base = best[i]
        for size in lengths:
            j = i + size
            if j > n:
                break
            p = words.get(label[i:j])
            if p is not None and base + p > best[j]:
                best[j], back[j] = base + p, i
        # a letter that no word explains joins the stretch before it
        if base + unknown > best[i + 1]:
            best[i + 1], back[i + 1] = base + unknown, i
    out, j = [], n
    while j:
        out.append(label[back[j] : j])
        j = back[j]
    return out[::-1]


@dataclass
class Model:
    """Counts of words, and log odds of words in blocked over allowed urls, as tables.

    ``words`` has (w, count), ``odds`` (place, w, odds).  Filled by hand, ``words``
    is a dict of log probabilities.
    """

    words: DataFrame | dict[str, float]
    unknown: float  # of a letter that belongs to no word
    odds: DataFrame | object
    prior: float
    log_total: float = 0.0
    lengths: tuple[int, ...] = ()  # of all words
    hosts: DataFrame | None = None  # hosts segmented while it learned: (hid, words)

    def segment(self, label: str) -> list[str]:
        """The likeliest split of a label, by ``words`` as a dict."""
        return viterbi(label, self.words, self.unknown)


def _exploded(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, ``k`` and ``w``: the words of a text and their places."""

    def make():
        def run(rows):
            found = [(i, k, w) for i, r in enumerate(rows) for k, w in enumerate(words_of(r or ""))]
            return [i for i, _, _ in found], [[k for _, k, _ in found], [w for _, _, w in found]]

        return run

    return explode_texts(df, text_col, keep, [StructField("k", IntegerType()), StructField("w", StringType())], make)


def unigrams(texts: DataFrame, files: int | None = None) -> Model:
    """Counts of the words in all rows of column ``t``, and an unknown letter's log probability.

    A letter that belongs to no word costs more than the rarest word.
    """
    words = staged(_exploded(texts, "t").where("not w rlike '^[0-9]+$'").groupBy("w").count(), "words", files)
    sizes = words.groupBy(F.length("w").alias("size")).agg(F.sum("count").alias("places"), F.count("*").alias("words")).collect()  # a row a length
    if not sizes:
        return Model(words, -10.0, None, 0.0)
    log_total = math.log(sum(r["places"] + r["words"] for r in sizes))
    return Model(words, -log_total - 2.0, None, 0.0, log_total, tuple(sorted(r["size"] for r in sizes)))


#: Stretches of labels that go to Spark at once.
OUT = 1 << 16


def _segmented(labels: DataFrame, model: Model) -> DataFrame:
    """(``lid``, ``words``) of labels (``lid``, ``label``).

    The stretches of each label meet the words that they are, so a task needs
    no more of the words than stand in its labels.  Stretches go by their
    hashes and labels by their ids: nothing is copied for each stretch.  A label
    is a stretch of itself, the only one that brings its text.
    """
    lengths, unknown, log_total = model.lengths, model.unknown, model.log_total
    schema = StructType([StructField("lid", LongType()), StructField("wid", LongType()), StructField("label", StringType())])

    def stretches(batches):
        from xxhash import xxh64_intdigest

        def out():
            arrays = [pa.array(owners, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        owners, hashes, texts = [], [], []
        for batch in batches:
            for lid, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # ends of characters, so that stretches are cut out of the bytes
                raw = label.encode("utf-8", "replace")
                ends = [i for i, x in enumerate(raw) if x & 0xC0 != 0x80] + [len(raw)]
                owners.append(lid)
                hashes.append(xxh64_intdigest(raw, seed=42))
                texts.append(label)
                for n in lengths:
                    if n >= len(label):
                        break
                    # Spark's xxhash64 of a string
                    found = {xxh64_intdigest(raw[ends[i] : ends[i + n]], seed=42) for i in range(len(label) - n + 1)}
                    owners += [lid] * len(found)
                    hashes += found
                    texts += [None] * len(found)
                    if len(owners) >= OUT:
                        yield out()
                        owners, hashes, texts = [], [], []
        if owners:
            yield out()

    words = model.words.withColumn("wid", F.xxhash64("w"))
    met = labels.select("lid", "label").mapInArrow(stretches, schema).join(words, "wid", "left").where("label is not null or w is not null")
    known = met.groupBy("lid").agg(F.max("label").alias("label"), F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "count"))).alias("known"))
    schema_out = StructType([StructField("lid", LongType()), StructField("words", ArrayType(StringType()))])

    def split(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                out = []
                for label, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    out.append(viterbi(label, {x["w"]: math.log(x["count"] + 1) - log_total for x in words or ()}, unknown))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], schema_out.names)

    return known.select("lid", "label", "known").mapInArrow(split, schema_out)


def host_words(hosts: DataFrame, model: Model, files: int | None = None) -> DataFrame:
    """``hid`` and ``words`` of distinct hosts (``hid``, ``host``); a host without a letter or digit has no row."""
    hosts = hosts.coalesce(files) if files else hosts
    labels = staged(_exploded(hosts, "host", ("hid",)).withColumn("lid", F.xxhash64("w")), "labels")
    splits = _segmented(labels.groupBy("lid").agg(F.min("w").alias("label")), model)
    both = labels.join(splits, "lid").groupBy("hid").agg(F.array_sort(F.collect_list(F.struct("k", "words"))).alias("xs"))
    return staged(both.select("hid", F.flatten(F.col("xs.words")).alias("words")), "host-words", files)


def _size(urls: DataFrame, *cols: str) -> tuple[int, int]:
    """Rows, and bytes of the columns."""
    size = sum((F.coalesce(F.octet_length(col(c)), F.lit(0)).cast("long") for c in cols), F.lit(0))
    got = urls.agg(F.count("*").alias("n"), F.sum(size).alias("size")).first()
    return got["n"], got["size"] or 0


def train(urls: DataFrame, url_col: str = "url", html_col: str | None = None, rules=RULES) -> Model:
    """Unigram model from the words of all paths and page titles, naive Bayes from all urls that a rule decides.

    Host names don't count as words: they are what is to be split.
    """
    files = files_for(*_size(urls, url_col, *([html_col] if html_col else [])))
    cut = parts(urls, url_col, (), rules).withColumn("hid", F.xxhash64("host"))
    title = F.regexp_extract(col(html_col), r"(?is)<title[^>]*>([^<]*)", 1) if html_col else F.lit("")
    model = unigrams(urls.select(F.concat_ws(" ", path_column(col(url_col)), title).alias("t")), files)
    verdicts = F.element_at(F.array(*[F.lit(int(v == "block")) for v, _, _ in rules]), F.col("rule") + 1) if rules else F.lit(0)
    ruled = cut.where("rule is not null").select("hid", "path", verdicts.alias("block"))
    model.hosts = host_words(cut.select("hid", "host").distinct(), model, files)
    of_hosts = ruled.groupBy("hid", "block").count().join(model.hosts, "hid").select(F.lit("host").alias("place"), F.explode("words").alias("w"), "block", "count")
    of_paths = _exploded(ruled.groupBy("path", "block").count(), "path", ("block", "count")).select(F.lit("path").alias("place"), "w", "block", "count")
    blocked = lambda b: F.sum(F.when(F.col("block") == b, F.col("count")).otherwise(0))
    seen = staged(of_hosts.unionAll(of_paths).groupBy("place", "w").agg(blocked(1).alias("n1"), blocked(0).alias("n0")), "seen", files)
    sums = seen.agg(F.count("*").alias("v"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    rate = lambda c: F.log((F.col(c) + 0.5) / ((sums[c] or 0) + 0.5 * max(1, sums["v"])))
    n = {r["block"]: r["count"] for r in ruled.groupBy("block").count().collect()}
    model.odds = seen.select("place", "w", (rate("n1") - rate("n0")).alias("odds"))
    model.prior = math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))
    return model


def _sums(tokens: DataFrame, model: Model, place: str, key: str) -> DataFrame:
    """``key`` and the sum of the odds of its words (column ``w``); words never seen say nothing."""
    odds = model.odds.where(F.col("place") == place).select("w", "odds")
    # a url's own words, added in one order whatever the tasks did
    xs = tokens.join(odds, "w").groupBy(key).agg(F.array_sort(F.collect_list("odds")).alias("xs"))
    return xs.select(F.col(key), F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).alias(f"{place}_odds"))


def _hot(cut: DataFrame, key: str, total: int) -> list[int]:
    """Ids of the hosts or paths with very many urls: at most 1 / HOT."""
    return [r[key] for r in cut.groupBy(key).count().where(F.col("count") > max(HOT_LEAST, total * HOT)).select(key).collect()]


def judge(urls: DataFrame, model: Model, url_col: str = "url", keep: Sequence[str] = ("page_id",), rules=RULES) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``verdict``, ``score`` and the host's ``words``.

    Hosts and paths meet their scores by 64-bit ids of theirs.  Only hosts that
    the model hasn't met while it learned are segmented.
    """
    cut = parts(urls, url_col, keep, rules).withColumns({"hid": F.xxhash64("host"), "pid": F.xxhash64("path")})
    ks = [f"k{i}" for i in range(len(keep))]
    total, size = _size(urls, url_col)
    hosts, new = model.hosts, cut.where("host != ''").select("hid", "host").distinct()
    if hosts is None:
        hosts = host_words(new, model, files_for(total, size))
    elif not (new := new.join(hosts, "hid", "left_anti")).isEmpty():
        hosts = hosts.unionByName(host_words(new, model, files_for(total, size)))
    of_hosts = hosts.select("hid", "words").join(_sums(hosts.select("hid", F.explode("words").alias("w")), model, "host", "hid"), "hid", "left")
    of_paths = _sums(_exploded(cut.select("path", "pid").distinct(), "path", ("pid",)), model, "path", "pid")
    score = F.lit(model.prior) + F.coalesce(F.col("host_odds"), F.lit(0.0)) + F.coalesce(F.col("path_odds"), F.lit(0.0))
    words = F.coalesce(F.col("words"), F.array().cast("array<string>"))
    salt = F.pmod(F.xxhash64(*ks, "host", "path"), F.lit(SALTS)).cast("int")
    out = cut
    for key, one in (("hid", of_hosts), ("pid", of_paths)):
        # a hot host's or path's urls are dealt over several tasks, each with a copy of its one row
        hot = F.col(key).isin(_hot(cut, key, total))
        dealt = one.withColumn("q_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        out = out.withColumn("q_salt", F.when(hot, salt).otherwise(0)).join(dealt, [key, "q_salt"], "left").drop("q_salt")
    out = out.select(*ks, "host", "path", "rule", score.alias("score"), words.alias("words"))
    at = F.col("rule") + 1
    names = F.array(*[F.lit(h + p) for _, h, p in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules]) if rules else F.array().cast("array<string>")
    verdict = F.coalesce(F.when(at.isNotNull(), F.element_at(verdicts, at)), F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(k).alias(n) for k, n in zip(ks, keep)], "host", "path", F.when(at.isNotNull(), F.element_at(names, at)).alias("rule"), verdict.alias("verdict"), "score", "words")
