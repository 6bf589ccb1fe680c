"""Language identification by a bidirectional gated recurrent network over bytes.

The network is a GRU of a few units in each direction over the text's UTF-8
bytes, written and trained in numpy: backpropagation through time, Adam,
cross-entropy at every position.  It labels every byte of a text with language
probabilities; a document's are the normalised mean of their logarithms over
its positions that belong to letters.

A text is read in stretches of ``STEP`` bytes that share no state, so that many
run side by side as rows of one matrix and a long text needs no more memory
than a short one.  All bytes of all stretches are labelled.

Null texts and texts without a letter are ``und`` with score 0.  Training takes
a bounded sample; a language must occur in it to be learned.  Without any
labelled text everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField

from quire.llm._arrow import col, explode_texts, map_texts

#: Bytes of a stretch, units of a direction, and rows that run side by side.
STEP, UNITS, ROWS = 96, 8, 4096
#: Bounds of the training set: documents of a language, stretches of a document,
#: documents in all (shared out evenly where there are many languages), languages.
DOCS_PER_LANG, STRETCHES = 400, 6
MOST_DOCS, MOST_LANGS = 4_000, 1_000

_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


#: Bytes that are surely no part of a letter: ASCII other than A-Z and a-z.
_COUNTS = np.array([c >= 0x80 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def _init(rng, units: int, langs: int) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.3, (257, 3 * units))  # by byte; 256 is padding
        p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(units), (units, 3 * units))
        p[f"c{d}"] = np.zeros(units)
    p["V"] = rng.normal(0, 1 / np.sqrt(2 * units), (2 * units, langs))
    p["a"] = np.zeros(langs)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(p, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [time, row, unit] of one direction; x: bytes [time, row].

    z and r gates by tanh(v / 2) / 2 + 1 / 2; candidate tanh(e + r * (h U + c)).
    """
    E, U, c = p[f"E{d}"], p[f"U{d}"], p[f"c{d}"]
    units = len(c)
    T, B = x.shape
    h = np.zeros((B, units), np.float32)
    out = np.empty((T, B, units), np.float32)
    for t in range(T) if d == "f" else range(T - 1, -1, -1):
        e = E[x[t]]
        g = h @ U
        zr = np.tanh((g[:, : 2 * units] + e[:, : 2 * units]) * np.float32(0.5))
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r = zr[:, :units], zr[:, units:]
        gn = g[:, 2 * units :] + c
        n = np.tanh(e[:, 2 * units :] + r * gn)
        if keep is not None:
            keep.append((t, h, z, r, gn, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def _backward(p, d: str, x, kept, grad_out, grads) -> None:
    """Backpropagation through time of ``_forward``."""
    U, units = p[f"U{d}"], len(p[f"c{d}"])
    dE, dU, dc = grads[f"E{d}"], grads[f"U{d}"], grads[f"c{d}"]
    dh = np.zeros_like(grad_out[0])
    for t, h, z, r, gn, n in reversed(kept):
        dh = dh + grad_out[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dgn = dn * r
        de = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dgn], 1)
        np.add.at(dE, x[t], de)
        dU += h.T @ dg
        dc += dgn.sum(0)
        dh = dh * z + dg @ U.T
    # the state before the first byte is constant


def _log_probs(p, hf, hb) -> np.ndarray:
    units = hf.shape[-1]
    logits = hf @ p["V"][:units] + hb @ p["V"][units:] + p["a"]
    logits -= logits.max(-1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(-1, keepdims=True))


@dataclass
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]

    def label(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities [time, row, language] of every position of bytes [time, row]."""
        return _log_probs(self.params, _forward(self.params, "f", x), _forward(self.params, "b", x))

    def documents(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text."""
        sums = np.zeros((len(texts), max(1, len(self.langs))))
        count = np.zeros(len(texts))
        rows: list[np.ndarray] = []
        owner: list[int] = []

        def run():
            if not rows:
                return
            x = np.stack(rows, 1)
            logp = self.label(x)
            live = _COUNTS_PAD[x]
            per = np.einsum("tbl,tb->bl", logp, live)
            np.add.at(sums, owner, per)
            np.add.at(count, owner, live.sum(0))
            rows.clear()
            owner.clear()

        ok = [bool(self.langs) and has_letter(t) for t in texts]
        for i, t in enumerate(texts):
            if not ok[i]:
                continue
            for part in stretches(t):
                rows.append(part)
                owner.append(i)
                if len(rows) >= ROWS:
                    run()
        run()
        out, score = [], []
        for i in range(len(texts)):
            if not ok[i] or not count[i]:
                out.append("und")
                score.append(0.0)
                continue
            mean = sums[i] / count[i]
            prob = np.exp(mean - mean.max())
            prob /= prob.sum()
            best = int(prob.argmax())
            out.append(self.langs[best])
            score.append(float(prob[best]))
        return out, score


_COUNTS_PAD = np.append(_COUNTS, False).astype(np.float32)


def stretches(text: str) -> np.ndarray:
    """[stretch, STEP] of byte numbers, filled up with 256."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int16)
    n = -(-len(raw) // STEP)
    out = np.full(n * STEP, 256, np.int16)
    out[: len(raw)] = raw
    return out.reshape(n, STEP)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 14, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Model:
    """Train on stretches [row, STEP] with a label each.  Classes weigh alike."""
    rng = np.random.default_rng(seed)
    p = _init(rng, UNITS, len(langs))
    if len(langs) < 2 or not len(x):
        return Model(langs, p)
    weight = (len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs))))).astype(np.float32)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            xb, yb = x[pick].T, y[pick]
            keep_f: list = []
            keep_b: list = []
            hf, hb = _forward(p, "f", xb, keep_f), _forward(p, "b", xb, keep_b)
            d = np.exp(_log_probs(p, hf, hb))
            d[:, np.arange(len(pick)), yb] -= 1
            live = _COUNTS_PAD[xb] * weight[yb]
            d *= (live / max(1.0, live.sum()))[:, :, None]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            flat = d.reshape(-1, len(langs))
            grads["V"][:UNITS] = hf.reshape(-1, UNITS).T @ flat
            grads["V"][UNITS:] = hb.reshape(-1, UNITS).T @ flat
            grads["a"] = flat.sum(0)
            _backward(p, "f", xb, keep_f, d @ p["V"][:UNITS].T, grads)
            _backward(p, "b", xb, keep_b, d @ p["V"][UNITS:].T, grads)
            step += 1
            lr = rate * (1 - 0.95 * step / total)
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                p[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return Model(langs, p)


def held_out(id_col: str = "doc_id") -> Column:
    """True where the crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from at most ``MOST_DOCS`` documents that are not held out.

    Each language gives about ``DOCS_PER_LANG``, or an equal share of
    ``MOST_DOCS`` if they are many, by hash of id and text; of each document
    ``STRETCHES`` stretches, spread over the whole text, leave its executor.
    The bounds hold whatever the input.  Of more than ``MOST_LANGS`` languages
    the most frequent are learned.
    """
    usable = docs.where(~held_out(id_col) & col(text_col).isNotNull() & col(lang_col).isNotNull())
    counts = usable.groupBy(col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return Model([], _init(np.random.default_rng(0), UNITS, 1))
    mark = F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    quota = min(DOCS_PER_LANG, MOST_DOCS / len(counts))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, quota / r["count"]))])
    # a mark is told as a part of its language's share, so that the bound cuts all languages alike
    sample = (
        usable.select(col(id_col).alias("i"), col(text_col).alias("t"), col(lang_col).alias("lang"), (mark / share[col(lang_col)]).alias("mark"))
        .where("mark < 1")
    )

    def make():
        def run(texts):
            owner, parts = [], []
            for i, t in enumerate(texts):
                if not has_letter(t):
                    continue
                all_ = stretches(t)
                for k in np.unique(np.linspace(0, len(all_) - 1, min(STRETCHES, len(all_))).astype(int)):
                    owner.append(i)
                    parts.append(all_[k].tobytes())
            return owner, [parts]

        return run

    cut = explode_texts(sample, "t", ("i", "lang", "mark"), [StructField("part", BinaryType())], make)
    got = cut.orderBy("mark", "i", "lang", "part").limit(MOST_DOCS * STRETCHES).select("lang", "part").collect()
    langs = sorted({r["lang"] for r in got})
    x = np.array([np.frombuffer(bytes(r["part"]), np.int16) for r in got]).reshape(len(got), STEP)
    y = np.array([langs.index(r["lang"]) for r in got], int)
    return fit(x, y, langs)




def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every whole text."""

    def make():
        return lambda texts: list(model.documents(texts))

    return map_texts(docs, text_col, keep, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], make)


def label_positions(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The same network's label of every byte: ``labels`` holds a language number (``model.langs``) a byte."""

    def make():
        def one(t):
            if not t or not model.langs:
                return b""
            x = stretches(t)
            return model.label(x.T).argmax(-1).T.reshape(-1)[: len(t.encode("utf-8", "replace"))].astype(np.uint8).tobytes()

        return lambda texts: [[one(t) for t in texts]]

    return map_texts(docs, text_col, keep, [StructField("labels", BinaryType())], make)
