"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import bpe, fim, langid, license_scan, line_dedup, merkle, ngram_join, packing, pii, quality_rules, substring_dedup, tiff, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(pages, html_col="html")).select("page_id", "host", "path", "rule", "verdict")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.train(docs))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(tiff.tiff_files(_table(spark, sf_dir, "documents")))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


def op11_fim_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(_table(spark, sf_dir, "documents")))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.leaves(_table(spark, sf_dir, "documents"), seen={"text": merkle.lowered()}, changed=merkle.tampered())
    return merkle.verified(merkle.proofs(merkle.build(found)))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_tiff": op9_tiff,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_fim_transform": op11_fim_transform,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The other queries hold verdicts of trained models, digests of encodings or texts
#: aligned pair by pair; they are tested against brute force instead.
ORACLES: dict[str, str] = {
    "op10_ngram_jaccard_join": r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op11_fim_transform": r"""WITH
h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, [('0x' || substr(d, 8 * i + 1, 8))::UBIGINT::BIGINT FOR i IN range(4)] AS hs FROM h),
r AS (SELECT *, len(us) AS n, least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS a, greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""",
    "op12_substring_dedup": r"""WITH
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest([array_to_string(ws[k:k + 19], ' ') FOR k IN range(1, len(ws) - 18)]) AS s FROM d),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE again),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id""",
    "op13_merkle_manifest": r"""WITH RECURSIVE
d AS (SELECT *, coalesce('=' || lang, '-') AS g, list_reduce(list_concat([4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b::BIGINT) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS c FROM documents),
x AS (SELECT *, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM d),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM x),
l AS (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS s FROM f),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT 0 AS k, g, i, n, leaf AS h FROM z
  UNION ALL SELECT k + 1, g, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, g, i // 8),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
o AS (SELECT 0 AS k, i, n, subroot AS h FROM sub
  UNION ALL SELECT k + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM o WHERE n > 1 GROUP BY k, i // 8),
runs AS (SELECT k, g, i // 8 AS p, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY 1, 2, 3),
over_runs AS (SELECT k, i // 8 AS p, list(h ORDER BY i) AS hs FROM o WHERE n > 1 GROUP BY 1, 2),
tall AS (SELECT g, max(k) AS top FROM t GROUP BY g),
path AS (SELECT z.doc_id, z.leaf, z.s, k, array_to_string(hs[:(z.i // (8 ** k)::BIGINT) % 8], '') AS lh, array_to_string(hs[(z.i // (8 ** k)::BIGINT) % 8 + 2:], '') AS rh
    FROM z JOIN runs ON runs.g = z.g AND runs.p = z.i // (8 ** (k + 1))::BIGINT
  UNION ALL SELECT z.doc_id, z.leaf, z.s, top + r.k, array_to_string(hs[:(sub.i // (8 ** r.k)::BIGINT) % 8], ''), array_to_string(hs[(sub.i // (8 ** r.k)::BIGINT) % 8 + 2:], '')
    FROM z JOIN sub ON sub.g = z.g JOIN tall ON tall.g = z.g JOIN over_runs r ON r.p = sub.i // (8 ** (r.k + 1))::BIGINT),
walk AS (SELECT doc_id, leaf, 0 AS k, s AS a FROM z
  UNION ALL SELECT walk.doc_id, walk.leaf, walk.k + 1, sha256(lh || a || rh) FROM walk JOIN path ON path.doc_id = walk.doc_id AND path.leaf = walk.leaf AND path.k = walk.k),
ends AS (SELECT doc_id, leaf, max_by(a, k) AS folded_root FROM walk GROUP BY 1, 2),
proof AS (SELECT doc_id, leaf, sha256(string_agg(lh || rh, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY 1, 2),
root AS (SELECT h AS root FROM o WHERE n = 1)
SELECT z.doc_id, z.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM z JOIN sub ON sub.g = z.g CROSS JOIN root JOIN ends ON ends.doc_id = z.doc_id AND ends.leaf = z.leaf LEFT JOIN proof ON proof.doc_id = z.doc_id AND proof.leaf = z.leaf""",
}
