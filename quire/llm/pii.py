"""Personal data by weak supervision, in Spark's own functions alone.

Candidates of each kind come from two patterns: the strict one, whose matches
that pass its test (parts, Luhn, digits) are *base* spans and always stay; and
a loose one, with strict matches that fail Luhn.  Four labelers vote on each
candidate (1, 0 abstains, -1): the regex that found it, a gazetteer (top-level
domains, country codes, card prefixes, key names), the words before it (up to
the kind's last match), and the characters beside it.  The votes of all documents are counted by pattern,
which makes a table of bounded size; expectation-maximisation on it estimates
how reliable each labeler is and how likely each pattern is personal data.
With those probabilities as soft labels a logistic classifier of span features
is fitted, and emitted as a Spark expression that decides on loose candidates.

Null and empty texts have no spans.  Rows are independent; equal texts have
equal spans.  Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm._arrow import col

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The contract's patterns.  Possessive, and anchored at the start
# of a run (or the last match's end), they match the same in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[a-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"""(?i)(?<![a-z0-9])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)["']? ?[=:] ?["']?[a-z0-9+/_=-]{12,256}+["']?""",
}
#: Cheap tests that a text can have any match.
_MAY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
}
_MAY_LOOSE = {
    "email": lambda t: t.rlike(r"(?i)[\[(] ?at ?[\])]"),
    "ip": lambda t: t.contains(":") & t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "phone": lambda t: t.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"""(?i)(?:token|secret|passw|key)[a-z]*["']? ?[=:]"""),
}
# Top-level domains of countries by their first letter, and general ones.
_COUNTRIES = (
    "a[c-gilmoq-uwxz]|b[abd-jmnorstvwyz]|c[acdf-ik-oruvw-z]|d[ejkmoz]|e[cegrstu]|f[ijkmor]|g[abd-ilmnp-uwy]|h[kmnrtu]|i[del-oq-t]|j[emop]|k[eghimnprwyz]|l[abcikr-vy]"
    "|m[acdeghk-z]|n[acefgilopruz]|om|p[ae-hk-nrstwy]|qa|r[eosuw]|s[a-eg-or-vxyz]|t[cdfghj-ortvwz]|u[agksyz]|v[aceginu]|w[fs]|y[et]|z[amw]"
)
_GENERAL = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|tel|cat|asia|post|academy|agency|app|bank|blog|care|center|city|cloud|club|community"
    "|company|consulting|design|dev|digital|education|email|energy|expert|finance|fund|global|group|health|house|insurance|international|law|legal|life|live|market|marketing"
    "|media|money|network|news|online|page|photos|school|science|services|shop|site|social|software|solutions|space|store|studio|support|systems|team|tech|today|tools|top"
    "|university|video|website|wiki|work|world|xyz|zone"
)
# Endings that no mail goes to, of files and reserved.
_NO_DOMAIN = "png|jpe?g|gif|svg|webp|ico|js|css|html?|php|json|xml|ya?ml|java|class|jar|zip|gz|pdf|exe|dll|log|txt|tmp|local|localhost|example|invalid|test"
# Calling codes of countries by zone.
_CALLING = (
    "1|7|2(?:0|7|1[12368]|[2346][0-9]|5[0-8]|9[01789])|3(?:[0-469]|5[0-9]|7[0-9]|8[0-35-79])|4(?:[013-9]|2[013])|5(?:[1-8]|0[0-9]|9[0-9])"
    "|6(?:[0-6]|7[02-9]|8[0-35-9]|9[0-2])|8(?:[1246]|5[02356]|8[06])|9(?:[0-58]|6[0-8]|7[0-7]|9[2-68])"
)
# First digits of card numbers by issuer.
_ISSUERS = "4|5[0-8]|22(?:0[0-4]|2[1-9]|[3-9])|2[3-6]|27(?:[01]|20)|3[4679]|38|30[0-5]|35(?:2[89]|[3-8])|6(?:[0237]|011|4[4-9]|5)"
_GAZETTEER = {  # (for, against)
    "email": (rf"(?i)(?:\.|dot ?[\])] ?)(?:{_COUNTRIES}|{_GENERAL})$", rf"(?i)(?:\.|dot ?[\])] ?)(?:{_NO_DOMAIN})$"),
    "ip": (r"^(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9])\.|:", r"^(?:0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"),
    "card": (rf"^(?:{_ISSUERS})", rf"^(?!{_ISSUERS})"),  # of the digits alone
    "phone": (rf"^\+[(]?(?:{_CALLING})(?![0-9]{{13}})|^\(?[2-9]", r"^\(?0{3}|^\(?[2-9]11"),
    "secret": (r"(?i)^(?:token|api)|[=:] ?[\"']?(?:sk[_-]|gh[opsu]_|xox[abps]-|akia|asia|aiza|eyj)", r"(?i)[=:] ?[\"']?[a-z]+[\"']?$|x{6}|changeme|placeholder|your[_-]"),
}
_CUES = {  # in the characters before the span: (for, against)
    "email": (r"(?i)mail|contact|write|@|correo|courriel|escrib|schreib", r"(?i)import|package"),
    "ip": (r"(?i)\bip\b|address|host|server|from", r"(?i)version|\bv\.? ?$|release|section"),
    "card": (r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta|kredit", r"(?i)isbn|order|invoice|serial"),
    "phone": (r"(?i)phone|call|t[e\u00e9]l|fax|mobile|whatsapp|handy|rufen|appel|llam|portable|m[o\u00f3]vil", r"(?i)isbn|order|invoice|serial"),
    "secret": (r"(?i)auth|bearer|config|export", r"(?i)example"),
}
BEFORE = 24

_SPAN = "array<struct<s:int,e:int,t:string,b:string,a:string>>"
#: Elements that a fold's list is copied with, at most.
CHUNK = 256


def _none(kind: str = _SPAN) -> Column:
    return F.array().cast(kind)


def _let(value: Column, of) -> Column:
    """``of(value)``, the value being computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _chunks(xs: Column) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * CHUNK + 1, CHUNK))


def _scan(xs: Column, zero: Column, add, emit, of: str) -> Column:
    """``emit(state, x)`` (of type ``of``) of each element, ``state`` being what ``add`` makes of ``zero`` and all before it.

    A fold copies its list at each step; so the states at the starts of chunks
    are found first and only lists of a chunk are folded.
    """

    def start(acc, c):
        return F.struct(F.aggregate(c, acc.state, add).alias("state"), F.concat(acc.out, F.array(acc.state)).alias("out"))

    def step(acc, x):
        return F.struct(add(acc.state, x).alias("state"), F.concat(acc.out, F.array(emit(acc.state, x))).alias("out"))

    def each(cs):
        starts = F.aggregate(cs, F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("out")), start, lambda acc: acc.out)
        return F.flatten(F.zip_with(cs, starts, lambda c, s: F.aggregate(c, F.struct(s.alias("state"), _none(of).alias("out")), step, lambda acc: acc.out)))

    return _let(_chunks(xs), each)


def _places(text: Column, pattern: str) -> Column:
    """Start, end and text of each match, and what stands before and after it: gaps between matches tell the places."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    near = lambda w: F.transform(w.found, lambda m, i: F.struct(F.get(w.gaps, i).alias("g"), m.alias("m"), F.get(w.gaps, i + 1).alias("n")))
    end = lambda at, x: at + F.length(x.g) + F.length(x.m)

    def span(at, x):
        return F.struct((at + F.length(x.g)).alias("s"), end(at, x).alias("e"), x.m.alias("t"), F.right(x.g, F.lit(BEFORE)).alias("b"), F.left(x.n, F.lit(1)).alias("a"))

    return _let(_let(both, near), lambda xs: _scan(xs, F.lit(0), end, span, _SPAN))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _card_length(s: Column) -> Column:
    return F.length(_digits(s.t)).between(13, 19)


_PASSES = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s.t.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    "card": lambda s: _card_length(s) & F.when(_card_length(s), luhn(_digits(s.t))).otherwise(F.lit(False)),
    "phone": lambda s: F.length(_digits(s.t)).between(9, 15),
}


_LEVEL = "array<struct<s:int,p:int,e:int,k:int,t:string,b:string,a:string>>"


def _levels(spans: Column, level: int, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(level).alias("p"), x.e.alias("e"), F.lit(kind).alias("k"), x.t.alias("t"), x.b.alias("b"), x.a.alias("a")))


def _unhidden(spans: Column, levels: int) -> Column:
    """Of spans with a level ``p``, sorted by start and level, those that none of a lower level overlaps.

    One pass forwards with the furthest end of each level so far, one backwards
    with the nearest start.
    """
    kept = lambda hidden, x: F.struct(x.s.alias("s"), F.when(hidden, -1).otherwise(x.p).alias("p"), x.e.alias("e"), x.k.alias("k"), x.t.alias("t"), x.b.alias("b"), x.a.alias("a"))
    set_at = lambda state, x, f: F.transform(state, lambda v, i: F.when(i == x.p, f(v)).otherwise(v))
    lower = lambda state, x: F.slice(state, F.lit(1), F.greatest(x.p, F.lit(0)))
    # a span that is hidden still hides others
    ahead = _scan(
        spans, F.array_repeat(F.lit(0), levels), lambda st, x: set_at(st, x, lambda v: F.greatest(v, x.e)),
        lambda st, x: F.struct(x.alias("x"), F.exists(lower(st, x), lambda v: v > x.s).alias("hidden")), f"array<struct<x:{_LEVEL[6:-1]},hidden:boolean>>",
    )
    back = _let(F.reverse(ahead), lambda ys: _scan(
        ys, F.array_repeat(F.lit((1 << 31) - 1), levels), lambda st, y: set_at(st, y.x, lambda v: F.least(v, y.x.s)),
        lambda st, y: kept(y.hidden | F.exists(lower(st, y.x), lambda v: v < y.x.e), y.x), _LEVEL,
    ))
    return F.reverse(F.filter(back, lambda x: x.p >= 0))


def _vote(t: Column, patterns: tuple[str, str]) -> Column:
    return F.when(t.rlike(patterns[1]), F.lit(-1)).when(t.rlike(patterns[0]), F.lit(1)).otherwise(F.lit(0))


def _labelled(kind: str, spans: Column, base: bool) -> Column:
    """Each candidate with its votes and features."""

    def one(s):
        before, after = s.b, s.a
        digits, length = F.length(_digits(s.t)), F.length(s.t)
        edge = F.when(before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]"), F.lit(-1)).otherwise(F.lit(1))
        by_regex = 1 if base or kind == "secret" else -1 if kind == "card" else 0
        return F.struct(
            s.s.alias("s"), s.e.alias("e"), s.t.alias("t"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.lit(by_regex).alias("v_regex"), _vote(_digits(s.t) if kind == "card" else s.t, _GAZETTEER[kind]).alias("v_gazetteer"), _vote(before, _CUES[kind]).alias("v_context"), edge.alias("v_edge"),
            F.least(F.floor(length / 8), F.lit(7)).cast("int").alias("f_length"), F.floor(4 * digits / F.greatest(length, F.lit(1))).cast("int").alias("f_digits"),
            s.t.rlike("[ ().-]").cast("int").alias("f_separated"),
        )

    return F.transform(spans, one)


VOTES = ("v_regex", "v_gazetteer", "v_context", "v_edge")
FEATURES = ("f_length", "f_digits", "f_separated")


def with_candidates(docs: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """``docs`` and two columns, ``base`` and ``loose`` spans, by kind, then start."""
    raw = F.coalesce(col(text_col), F.lit(""))
    found = {k: F.when(_MAY[k](raw), _places(raw, STRICT[k])).otherwise(_none()) for k in BASE_KINDS}
    loose = {k: F.when(_MAY_LOOSE[k](raw), _places(raw, LOOSE[k])).otherwise(_none()) for k in LOOSE}
    p = prefix
    step = docs.withColumns({f"{p}m_{k}": c for k, c in found.items()} | {f"{p}l_{k}": c for k, c in loose.items()})
    base = {k: F.filter(F.col(f"{p}m_{k}"), _PASSES[k]) for k in BASE_KINDS}
    step = step.withColumns({f"{p}b_{k}": c for k, c in base.items()})
    strict = [F.col(f"{p}b_{k}") for k in BASE_KINDS]
    loose = {k: F.col(f"{p}l_{k}") for k in LOOSE}
    loose["card"] = F.filter(F.col(f"{p}m_card"), lambda s: _card_length(s) & ~luhn(_digits(s.t)))
    step = step.withColumn(f"{p}x_all", F.concat(*[_levels(loose[k], 1, i) for i, k in enumerate(KINDS)]))
    clear = F.array_sort(F.concat(F.col(f"{p}x_all"), *[_levels(s, 0, -1) for s in strict]))
    clear = F.filter(_let(clear, lambda xs: _unhidden(xs, 2)), lambda x: x.p == 1)
    step = step.withColumn(f"{p}x_all", F.when(F.size(f"{p}x_all") > 0, clear).otherwise(_none(_LEVEL)))
    # of loose spans that overlap, the kind listed first stays
    order = F.array(*[F.lit(("secret", "email", "ip", "phone", "card").index(k)) for k in KINDS])
    ranked = F.array_sort(F.transform(f"{p}x_all", lambda x: F.struct(x.s.alias("s"), F.get(order, x.k).alias("p"), x.e.alias("e"), x.k.alias("k"), x.t.alias("t"), x.b.alias("b"), x.a.alias("a"))))
    step = step.withColumn(f"{p}x_own", F.when(F.size(f"{p}x_all") > 1, _let(ranked, lambda xs: _unhidden(xs, len(KINDS)))).otherwise(F.col(f"{p}x_all")))
    kept = {k: F.filter(f"{p}x_own", lambda x: x.k == i) for i, k in enumerate(KINDS)}
    step = step.withColumns({
        f"{p}base": F.concat(*[_labelled(k, F.col(f"{p}b_{k}"), True) for k in BASE_KINDS]),
        f"{p}loose": F.concat(*[_labelled(k, kept[k], False) for k in KINDS]),
    })
    return step.drop(f"{p}x_all", f"{p}x_own", *[f"{p}{x}_{k}" for x in "mlb" for k in KINDS])


@dataclass
class Model:
    """What each labeler is worth, and the classifier of spans."""

    reliability: dict[str, dict[str, float]] = field(default_factory=dict)
    bias: float = 0.0
    weights: dict[tuple[str, str, int], float] = field(default_factory=dict)
    kinds: tuple[str, ...] = ()

    def score(self, s: Column) -> Column:
        """The span's probability, as a Spark expression."""
        z = F.lit(self.bias)
        for k in self.kinds:
            of_kind = [(f, v, w) for (kind, f, v), w in sorted(self.weights.items()) if kind == k]
            part = F.lit(0.0)
            for f, v, w in of_kind:
                part = part + F.when(s[f] == v, F.lit(w)).otherwise(F.lit(0.0))
            z = z + F.when(s.kind == k, part).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _em(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each vote pattern and each labeler's share of right votes.

    Labelers vote apart from one another given the truth.  Start: majority.
    """
    total = votes.sum(1)
    p = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.5)).astype(float)
    for _ in range(rounds):
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        log_odds = np.full(len(n), math.log(prior / (1 - prior)))
        right = []
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                yes = ((n * p)[at].sum() + (1.5 if v > 0 else 1)) / ((n * p).sum() + 3.5)
                no = ((n * (1 - p))[at].sum() + (1.5 if v < 0 else 1)) / ((n * (1 - p)).sum() + 3.5)
                log_odds[at] += math.log(yes / no)
            votes_cast = (n * (votes[:, j] != 0)).sum()
            agree = (n * np.where(votes[:, j] > 0, p, np.where(votes[:, j] < 0, 1 - p, 0))).sum()
            right.append((agree + 1) / (votes_cast + 2))
        new = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            p = new
            break
        p = new
    return p, np.array(right)


#: Values of one-hot features: all are of bounded range.
_INPUTS = (*FEATURES, *VOTES)


def train(docs: DataFrame, text_col: str = "text", ridge: float = 1.0) -> Model:
    """Count all documents' vote patterns, run EM, fit the classifier.

    The counts' keys are kinds, votes and bucketed features: at most a few
    thousand rows, however many documents.
    """
    spans = with_candidates(docs.select(col(text_col).alias("text"))).select(F.explode(F.concat("pii_base", "pii_loose")).alias("x"))
    rows = spans.groupBy("x.kind", *[f"x.{c}" for c in _INPUTS]).count().collect()
    rows.sort(key=lambda r: tuple(map(str, r)))
    if not rows:
        return Model()
    soft, reliability = np.zeros(len(rows)), {}
    n = np.array([r["count"] for r in rows], float)
    kinds = tuple(k for k in KINDS if any(r["kind"] == k for r in rows))
    for k in kinds:
        at = np.array([r["kind"] == k for r in rows])
        votes = np.array([[r[v] for v in VOTES] for r in rows])[at]
        soft[at], right = _em(votes, n[at])
        reliability[k] = dict(zip(VOTES, right.tolist()))
    names = sorted({(r["kind"], f, int(r[f])) for r in rows for f in _INPUTS})
    index = {x: i + 1 for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        for f in _INPUTS:
            x[i, index[r["kind"], f, int(r[f])]] = 1
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * min(n.sum(), 1e4)  # so that ridge means the same at any size
    for _ in range(25):  # Newton
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (soft - q)) - ridge * w
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(reliability, float(w[0]), {name: float(w[i]) for name, i in index.items()}, kinds)


def find(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "pii_", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``base`` spans and ``spans``, all of them, by kind, then start."""
    p = prefix
    step = with_candidates(docs, text_col, p)
    step = step.withColumn(f"{p}loose", F.filter(F.col(f"{p}loose"), lambda s: model.score(s) >= threshold) if model.kinds else F.slice(F.col(f"{p}loose"), 1, 0))
    of = lambda k: F.array_sort(F.filter(F.concat(f"{p}base", f"{p}loose"), lambda s: s.kind == k))
    return step.withColumn(f"{p}spans", F.concat(*map(of, KINDS))).drop(f"{p}loose")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.s.cast("string"), s.e.cast("string"))), ",")


def digest(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: base counts, base digest and all spans."""
    found = find(docs.select(col(id_col).alias("i"), col(text_col).alias("text")), model)
    n = lambda k: F.size(F.filter("pii_base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("i").alias(id_col), *map(n, BASE_KINDS), F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"))


def mask(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, each span of the text replaced by its kind in brackets."""
    names = docs.columns
    packed = docs.select(F.struct(*map(col, names)).alias("q_row"), col(text_col).alias("q_text"))
    found = find(packed, model, "q_text").withColumn("q_sorted", F.array_sort(F.transform("pii_spans", lambda s: F.struct(s.s, s.e, s.kind))))
    # of spans that overlap the first stands for all
    cut = "array<struct<a:int,b:int,kind:string>>"
    merged = F.filter(
        _scan(F.col("q_sorted"), F.lit(0), lambda at, x: F.greatest(at, x.e), lambda at, x: F.when(x.s >= at, F.struct(at.alias("a"), x.s.alias("b"), x.kind.alias("kind"))), cut),
        lambda x: x.isNotNull(),
    )
    step = found.withColumns({"q_cut": F.when(F.size("pii_spans") > 0, merged), "q_end": F.array_max(F.transform("q_sorted", lambda x: x.e))})

    # a piece is found by counting from the start of its chunk's stretch of the text
    def pieces(c):
        first = F.get(c, F.lit(0)).a
        stretch = F.substring(F.col("q_text"), first + 1, F.get(c, F.size(c) - 1).b - first)
        return _let(stretch, lambda t: F.array_join(F.transform(c, lambda x: F.concat(F.substring(t, x.a - first + 1, x.b - x.a), F.lit("["), F.upper(x.kind), F.lit("]"))), ""))

    text = F.when(F.col("q_cut").isNull(), F.col("q_text")).otherwise(
        F.concat(F.array_join(F.transform(_chunks(F.col("q_cut")), pieces), ""), F.substring(F.col("q_text"), F.col("q_end") + 1, F.length("q_text")))
    )
    return step.select(*[text.alias(c) if c == text_col else F.col("q_row")[c].alias(c) for c in names])
