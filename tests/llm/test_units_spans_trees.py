"""Fill-in-middle, substring dedup and the Merkle manifest against brute force, edge cases included."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ahocorasick")

from quire.llm import fim, merkle, queries, substring_dedup as sub  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "é", "日本語 café", "a\x00b", "x" * 3000, "word " * 300, "\t\r\n mixed   space", "<P>", "a<S>b", "<<P", "P> <M", "ÅAå", "0aA9"]
EMPTY = "doc_id < -999"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def clashing(df):
    return df.withColumns({n: F.lit(1) for n in ("id", "hash", "none", "spans", "g", "h", "idx", "n", "k", "i", "t", "run", "parent", "form", "output", "shard", "q_row", "own")})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- fill-in-middle -----------------------------------------------------------------


def plain_units(text):
    return re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)


def random_text(rng, n):
    return "".join(rng.choice("aZ  .9é日<PSM>\n") for _ in range(n))


@pytest.mark.parametrize("block", [1 << 20, 1, 7])
def test_units_are_found_by_events(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(block)
    for text in [t or "" for t in ODD] + [random_text(rng, rng.randrange(60)) for _ in range(400)]:
        units, want = fim.Units(text), plain_units(text)
        assert units.n == len(want)
        assert units.sentinel == any(s in text for s in fim.SENTINELS)
        assert [units.place(r) for r in range(len(want) + 1)] == [len("".join(want[:r])) for r in range(len(want) + 1)]


def brute_fim(text, doc_id):
    us = plain_units(text)
    h = [int(sha(f"1:{doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(us) + 1), h[1] % (len(us) + 1)))
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(us), "plain", None, None, text
    return (len(us), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(us), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_query(spark):
    rng = random.Random(3)
    texts = ODD + [random_text(rng, rng.randrange(40)) for _ in range(200)] + ["plain words, and more of them"] * 3
    made = fim.transform(clashing(docs(spark, texts)))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    forms = set()
    for r in made.collect():
        want = brute_fim(texts[r["doc_id"]] or "", r["doc_id"])
        assert tuple(r)[1:] == want
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}
    for r in fim.digest(made).collect():
        text = texts[r["doc_id"]] or ""
        assert r["restored_sha256"] == sha(text) and r["output_sha256"] == sha(brute_fim(text, r["doc_id"])[4])
    assert fim.digest(fim.transform(docs(spark, texts).where(EMPTY))).count() == 0
    none = spark.createDataFrame([(None, "some words stand here")], "doc_id long, text string")
    assert fim.digest(fim.transform(none)).first()["restored_sha256"] == sha("some words stand here")


def test_fim_options(spark):
    own = fim.Options(seed=7, plain=0, spm=100, sentinels=("[a]", "[b]", "[c]"))
    rows = fim.transform(docs(spark, ["x.y z"] * 20), options=own).withColumn("back", fim.restored(F.col("output"), F.col("form"), own)).collect()
    assert all(r["form"] == "spm" and r["output"].startswith("[b]") and r["back"] == "x.y z" for r in rows)
    with pytest.raises(ValueError):
        fim.Options(sentinels=("<P", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fim.Options(sentinels=("|a|", "<S>", "<M>"))


# --- substring dedup ------------------------------------------------------------------


def brute_removed(rows, window=20):
    """{row number: words kept}; rows are (id, text) in any order, ids distinct."""
    words = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, (_, t) in enumerate(rows)}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words, key=lambda i: (rows[i][0] is None, rows[i][0])):
        for k in range(len(words[i]) - window + 1):
            w = tuple(words[i][k : k + window])
            if w in seen:
                gone[i].update(range(k, k + window))
            seen.add(w)
    return {i: [w for k, w in enumerate(words[i]) if k not in gone[i]] for i in words}


def repeating(rng, n_docs, vocabulary):
    """Texts of few words, with passages that stand in several of them and in one twice."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    out = []
    for _ in range(n_docs):
        words = []
        for _ in range(rng.randrange(4)):
            words += [word() for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            words += p[rng.randrange(3) : len(p) - rng.randrange(3)]
            if rng.random() < 0.2:
                words[rng.randrange(len(words))] = "edited"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("batch,index,hot", [(1 << 20, 1 << 20, False), (150, 1 << 20, False), (400, 90, False), (300, 300, True)])
def test_spans_are_exact(monkeypatch, batch, index, hot):
    monkeypatch.setattr(sub, "BATCH_WORDS", batch)
    monkeypatch.setattr(sub, "INDEX_WORDS", index)
    monkeypatch.setattr(sub, "QUERIES", 37)
    parts = sub.parts_of
    monkeypatch.setattr(sub, "parts_of", lambda raw: parts(raw, 70))
    for seed in range(8):
        rng = random.Random(seed)
        texts = repeating(rng, 40, rng.choice([2, 5, 4000])) + ["same " * 90, "same " * 45, "", "short text"] + ["a b " * 60]
        ids = rng.sample(range(1000), len(texts))
        groups = np.zeros(1 << 16, bool)
        groups[:: 3] = hot
        dealer, asker, packets, spans, asks = sub.Dealer(3, groups), sub.Asked(2), [], {}, {}
        for i in rng.sample(range(len(texts)), len(texts)):
            for _ in dealer.add((False, ids[i], hash(texts[i])), texts[i]):
                packets += dealer.deal()
        packets += dealer.deal()

        def look(make, packets):
            for number in {s for s, _ in packets}:
                shard = make()
                for s, p in packets:
                    if s == number:
                        shard.add(p)
                for repeated, d, of, a, b in shard.rows():
                    for j, x, y in zip(of, a, b):
                        (spans if repeated else asks).setdefault(int(d["id"][j]), []).append(np.array([x, y], "<u4").tobytes())

        look(sub.Shard, packets)
        packets = []
        for i, t in enumerate(texts):
            if ids[i] in asks:
                asker.add((False, ids[i], hash(t)), t, asks[ids[i]])
            if asker.size > batch:
                packets += asker.deal()
        packets += asker.deal()
        look(sub.Indexes, packets)
        want = brute_removed(list(zip(ids, texts)))
        for i, t in enumerate(texts):
            assert [w.decode() for w in sub.without(t.encode().split(), spans.get(ids[i], []))[1]] == want[i]


def test_index_counts_patterns():
    rng = np.random.default_rng(5)
    for sigma, n in ((2, 40), (4, 300), (60, 900)):
        text = np.concatenate((rng.integers(1, sigma, n), [0]))
        index = sub.FMIndex(text, sigma, 20)
        for _ in range(60):
            at = int(rng.integers(0, n - 8))
            pattern = text[at : at + int(rng.integers(1, 9))]
            if rng.random() < 0.3:
                pattern = rng.integers(1, sigma, len(pattern))
            lo, hi = index.counts[pattern[-1:]], index.counts[pattern[-1:] + 1]
            for c in pattern[-2::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            want = sum(np.array_equal(text[i : i + len(pattern)], pattern) for i in range(n))
            assert max(0, int(hi[0] - lo[0])) == want
        ends = np.arange(19, n)
        length, _ = index.statistics(text, ends)
        stretches = [text[e - k + 1 : e + 1].tobytes() for e in range(n) for k in range(1, 21) if e - k + 1 >= 0]
        many = {x for x in stretches if stretches.count(x) > 1} if n < 100 else None
        if many is not None:
            assert length.tolist() == [max((k for k in range(1, 21) if text[e - k + 1 : e + 1].tobytes() in many), default=0) for e in ends]


@pytest.mark.parametrize("least", [sub.HOT_LEAST, 0])
def test_substring_dedup_query(spark, monkeypatch, least):
    monkeypatch.setattr(sub, "HOT_LEAST", least)
    monkeypatch.setattr(sub, "HOT", 1e-3)
    rng = random.Random(11)
    texts = ODD + repeating(rng, 60, 3000) + ["w" + " same" * 200, "same " * 30, "x " * 19, "y " * 20, "y " * 21]
    df = clashing(docs(spark, texts)).repartition(5)
    assert sub.survey(df)[1].any() == (least == 0)
    want = brute_removed(list(enumerate(texts)))
    rows = sub.dedup(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", texts[r["doc_id"]] or ""))
        assert (r["n_words"], r["n_removed"], r["kept"]) == (n, n - len(want[r["doc_id"]]), " ".join(want[r["doc_id"]]))
    assert sub.dedup(df.where(EMPTY)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, passage), (2, passage), (2, passage), (3, f"x {passage} y"), (2, None), (None, None)]
    got = sorted(((r["doc_id"], r["n_removed"], r["kept"]) for r in sub.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    # rows alike are one document; a null id comes last
    assert got == sorted([(None, 30, ""), (2, 0, passage), (2, 0, passage), (3, 30, "x y"), (2, 0, ""), (None, 0, "")], key=str)


# --- Merkle manifest --------------------------------------------------------------------


def brute_manifest(rows):
    """{doc_id: (leaf, subroot, root, proof, folded root)} of rows (doc_id, text, lang, source, n_chars)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(field(x) for x in (r[0], r[3], r[2], r[4], r[1])))
    lower = lambda t: t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            out.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            i //= 8
        return out

    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    order = sorted(groups)
    trees = {g: tree([leaf(r) for r in sorted(groups[g], key=lambda r: r[0])]) for g in order}
    over = tree([trees[g][-1][0] for g in order])
    out = {}
    for g in order:
        for i, r in enumerate(sorted(groups[g], key=lambda r: r[0])):
            steps = path(trees[g], i) + path(over, order.index(g))
            seen = leaf((r[0], lower(r[1]), *r[2:])) if zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for a, b in steps:
                seen = sha(a + seen + b)
            out[r[0]] = (leaf(r), trees[g][-1][0], over[-1][0], sha("".join(a + b for a, b in steps)), seen)
    return out


@pytest.mark.parametrize("sizes", [{"en": 200, None: 70, "de": 9, "é": 1, "zz": 8}, {"en": 1}, {None: 3}, {f"l{i:02d}": 1 + i % 3 for i in range(70)}])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    rows = [(next(ids), rng.choice([None, "", "Mixed Case É", "lower", "x" * 5000]), lang, rng.choice([None, "s", ""]), rng.choice([None, 5])) for lang, n in sizes.items() for _ in range(n)]
    df = clashing(spark.createDataFrame(rows, DOC)).repartition(3)
    found = merkle.leaves(df, seen={"text": merkle.lowered()}, changed=merkle.tampered())
    want = brute_manifest(rows)
    got = merkle.verified(merkle.proofs(merkle.build(found))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) == want[r["doc_id"]]
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", None, None, None), (None, "b", None, None, None), (7, "A", "en", "s", 1), (7, "A", "en", "s", 1), (7, "B", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOC)
    got = merkle.verified(merkle.proofs(merkle.build(merkle.leaves(df)))).collect()
    assert len(got) == 5 and all(r["verified"] for r in got)
    none = merkle.leaves(df.where(EMPTY))
    assert merkle.build(none).root is None and merkle.proofs(merkle.build(none)).count() == 0


# --- the queries against their SQL --------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_fim_transform", "op12_substring_dedup", "op13_merkle_manifest"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, (tuple(r[i] for i in place) for r in want.fetchall())))
