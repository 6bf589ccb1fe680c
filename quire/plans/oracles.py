"""SQL that says what the queries compute, for another engine to check them by."""

from __future__ import annotations

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOT_WS = "[^" + _WS[1:]
_BLANK = r"[\t \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_DENSE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def _cut(t: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({t}, '{pattern}', '{to}', 'g')"


def _solid(t):
    return _cut(t, _WS)


def _count(t, pattern):
    return f"(length({t}) - length({_cut(t, pattern)}))"


def _dense(t):
    return _count(_solid(t), _DENSE)


def _tokens(t):
    return f"CAST(round((length({_solid(t)}) - {_dense(t)}) / 3.8 + {_dense(t)} * 1.1) AS BIGINT)"


def _trim(t):
    return _cut(t, f"^{_WS}+|{_WS}+$")


def _words(t):
    return f"CAST(len(regexp_extract_all({t}, '{_NOT_WS}+')) AS BIGINT)"


def _label_cut(t):
    return f"regexp_replace({t}, '^[^ \\t]*[ \\t]', '')"


_LABEL = r"^(\p{N}{1,2}|\p{Lu})((?:\.\p{N}+){0,3})\.?[ \t]"


def _depth(t):
    s = _cut(t, f"^{_BLANK}+|{_BLANK}+$")
    rest = _cut(_label_cut(s), f"^{_BLANK}+|{_BLANK}+$")
    return f"CASE WHEN regexp_matches({s}, '{_LABEL}') AND length({rest}) >= 2 AND regexp_matches({rest}, '\\p{{L}}') THEN CAST({_count(f'regexp_extract({s}, $${_LABEL}$$, 2)', chr(92) + '.')} + 1 AS INTEGER) END"


def _chart(t):
    body = f"CASE WHEN ({_depth(t)}) IS NOT NULL THEN {_label_cut(t)} ELSE {t} END"
    digits, letters = _count(f"({body})", r"\p{N}"), _count(f"({body})", r"\p{L}")
    return f"(contains({t}, '=') OR (contains({body}, '%') AND {digits} > 0) OR {letters} = 0 OR {digits} * 1.0 / greatest(1, {digits} + {letters}) > 0.18)"


def _citation(t):
    return rf"(contains({t}, ' et al.') OR contains({t}, ' & ') OR regexp_matches({t}, '[ ,]\p{{Lu}}\.'))"


def _prose(t):
    s = f"regexp_replace({t}, '([\\\\`*_\\[\\]<])', '\\\\\\1', 'g')"
    s = f"regexp_replace({s}, '(^|[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}])([#+>-])( |$)', '\\1\\\\\\2\\3', 'g')"
    return f"regexp_replace({s}, '(^|[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}])(\\p{{N}}+)\\.( |$)', '\\1\\2\\\\.\\3', 'g')"


_DOCS = "documents"
_BLOCKS = """(SELECT doc_id, source, CAST(i // 40 AS INTEGER) AS page_index, i AS ord, l AS text FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE length(trim(l)) > 0)"""
_NOTE = "> ⚠︎ Table structure is uncertain; verify against the source page."
# ``fixed``: Markdown of blocks that are neither headings nor paragraphs; ``js``: their JSON
_MORE = f"""SELECT conv_id, turn, role, turn % 6 AS k, turn * 100000 + 99990 AS pos, ['table', 'list', 'figure', 'formula', 'code'][turn % 6 + 1] AS type,
  CASE turn % 6 WHEN 0 THEN 'role turn' || chr(10) || role || ' ' || turn WHEN 1 THEN role || chr(10) || 'turn ' || turn WHEN 2 THEN role WHEN 3 THEN 'x_{{' || turn || '}}' ELSE 'turn = ' || turn END AS text,
  CASE turn % 6 WHEN 0 THEN CASE WHEN turn % 4 = 0 THEN '{_NOTE}' || chr(10) || chr(10) ELSE '' END || '| role | turn |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || role || ' | ' || turn || ' |'
    WHEN 1 THEN '1. ' || role || chr(10) || '  1. turn ' || turn WHEN 2 THEN '![' || role || '](images/p' || turn || '.png)' || chr(10) || chr(10) || '*' || role || '*'
    WHEN 3 THEN '$$' || chr(10) || 'x_{{' || turn || '}}' || chr(10) || '$$' ELSE '```py' || chr(10) || 'turn = ' || turn || chr(10) || '```' END AS fixed,
  CASE turn % 6 WHEN 0 THEN '{{"rows":[[{{"colSpan":1,"rowSpan":1,"text":"role"}},{{"colSpan":1,"rowSpan":1,"text":"turn"}}],[{{"colSpan":1,"rowSpan":1,"text":"' || role || '"}},{{"colSpan":1,"rowSpan":1,"text":"' || turn || '"}}]],"structureSuspect":' || (turn % 4 = 0) || ',"type":"table"}}'
    WHEN 1 THEN '{{"items":[{{"depth":0,"text":"' || role || '"}},{{"depth":1,"text":"turn ' || turn || '"}}],"ordered":true,"type":"list"}}' WHEN 2 THEN '{{"caption":"' || role || '","path":"images/p' || turn || '.png","type":"figure"}}'
    WHEN 3 THEN '{{"isInline":false,"latex":"x_{{' || turn || '}}","type":"formula"}}' ELSE '{{"language":"py","text":"turn = ' || turn || '","type":"code"}}' END AS js FROM conversations WHERE turn % 6 < 5"""
_TALK = f"""(SELECT conv_id AS doc_id, turn AS page_index, 'heading' AS type, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, role || ' ' || turn AS text, turn * 100000 AS pos, NULL::VARCHAR AS fixed, NULL::VARCHAR AS js FROM conversations
  UNION ALL SELECT doc_id, page_index, 'paragraph', NULL, l, page_index * 100000 + i, NULL, NULL FROM (
    SELECT conv_id AS doc_id, turn AS page_index, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE length(trim(l)) > 0
  UNION ALL SELECT conv_id, turn, type, NULL, text, pos, fixed, js FROM ({_MORE}))"""
_BOXES = """(SELECT page, ord, round(l_quantity * 10, 2) AS x, round(l_linenumber * 14 + l_discount * 100, 2) AS y, round(20 + l_tax * 1000, 2) AS w, 10.0::DOUBLE AS h,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS col, l_linenumber, l_returnflag, l_suppkey, l_partkey FROM (
  SELECT *, l_orderkey // 32 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS ord FROM lineitem))"""
_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_HEADS = f"""(SELECT page, ord, l_linenumber || '.' || (l_suppkey % 4) || ' ' || {_TITLE} AS text, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 1 END AS lines,
  8 + (l_linenumber % 5) * 0.5::DOUBLE AS size, l_returnflag = 'R' AS bold, x, y, w, h, col FROM {_BOXES} b JOIN part ON p_partkey = l_partkey)"""
_W = "OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"

# three levels occur in conversations
_SECTIONS = f"""
t AS {_TALK},
h0 AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) {_W} AS p1, max(CASE WHEN level = 2 THEN pos END) {_W} AS p2, max(CASE WHEN level = 3 THEN pos END) {_W} AS p3 FROM t WHERE type = 'heading'),
h1 AS (SELECT *, p1 IS NOT NULL AS l1, level >= 2 AND p2 IS NOT NULL AND (p1 IS NULL OR p1 < p2) AS l2, level >= 3 AND p3 IS NOT NULL AND (p1 IS NULL OR p1 < p3) AND (p2 IS NULL OR p2 < p3) AS l3 FROM h0),
h2 AS (SELECT h1.*, l1::INT + l2::INT + l3::INT AS depth, list_filter([CASE WHEN l1 THEN a.text END, CASE WHEN l2 THEN b.text END, CASE WHEN l3 THEN c.text END], lambda x: x IS NOT NULL) AS path
  FROM h1 LEFT JOIN t a ON a.doc_id = h1.doc_id AND a.pos = p1 LEFT JOIN t b ON b.doc_id = h1.doc_id AND b.pos = p2 LEFT JOIN t c ON c.doc_id = h1.doc_id AND c.pos = p3),
h3 AS (SELECT *, sum((depth < 1)::INT) {_W} AS g1, sum((depth < 2)::INT) {_W} AS g2, sum((depth < 3)::INT) {_W} AS g3, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM h2),
h4 AS (SELECT *, sum((depth = 1)::INT) OVER (PARTITION BY doc_id, g1 ORDER BY pos) AS c1, sum((depth = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY pos) AS c2, sum((depth = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY pos) AS c3 FROM h3),
h5 AS (SELECT doc_id, section_no, depth, path, array_to_string(list_slice([CAST(c1 AS VARCHAR), CAST(c2 AS VARCHAR), CAST(c3 AS VARCHAR)], 1, depth), '.') AS section_id FROM h4),
s0 AS (SELECT *, CAST(sum((type = 'heading')::INT) {_W} AS BIGINT) AS section_no FROM t),
s AS (SELECT s0.*, coalesce(h5.section_id, '0') AS section_id, coalesce(path, []) AS path, coalesce(depth, 0) AS depth FROM s0 LEFT JOIN h5 USING (doc_id, section_no))"""


def _packed(target: int, least: int) -> str:
    return f"""{_SECTIONS},
n AS (SELECT *, {_tokens('text')} AS cost, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY pos) AS i FROM s),
p AS (SELECT doc_id, section_no, i, pos, 1 AS part, cost AS tokens FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.section_no, n.i, n.pos, p.part + (p.tokens + n.cost > {target} AND p.tokens >= {least})::INT,
    CASE WHEN p.tokens + n.cost > {target} AND p.tokens >= {least} THEN 0 ELSE p.tokens END + n.cost FROM p JOIN n ON n.doc_id = p.doc_id AND n.section_no = p.section_no AND n.i = p.i + 1),
k AS (SELECT n.*, p.part FROM n JOIN p USING (doc_id, section_no, pos))"""


_MD = f"CASE WHEN fixed IS NOT NULL THEN fixed WHEN type = 'heading' THEN CASE WHEN {_trim(_prose('text'))} = '' THEN '' ELSE repeat('#', level) || ' ' || {_trim(_prose('text'))} END ELSE {_trim(_prose('text'))} END"


def _chunks(target: int = 512, least: int = 64) -> str:
    return f"""WITH RECURSIVE {_packed(target, least)},
m AS (SELECT *, {_MD} AS md FROM k),
c0 AS (SELECT doc_id, section_no, section_id, path, part, string_agg(md, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE md <> '') AS text, list_sort(list_distinct(list(type))) AS types, list_sort(list_distinct(list(page_index))) AS pages FROM m GROUP BY ALL),
c1 AS (SELECT *, max(part) OVER (PARTITION BY doc_id, section_no) AS part_count FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part) - 1 AS chunk_id FROM c1 WHERE coalesce({_trim('text')}, '') <> ''),
c AS (SELECT *, {_tokens('text')} AS tokens, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS previous_id, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS next_id FROM c2)"""


_OUTLINE = f"""{_chunks()},
o AS (SELECT doc_id, section_id, min(chunk_id) AS first_chunk, CAST(sum(tokens) AS BIGINT) AS tokens, list_sort(list_distinct(flatten(list(pages)))) AS pages, list_sort(list(chunk_id)) AS chunk_ids, arg_min(path, chunk_id) AS path FROM c GROUP BY doc_id, section_id),
u AS (SELECT doc_id, section_id, first_chunk, unnest(range(1, len(string_split(section_id, '.')))) AS k, string_split(section_id, '.') AS names FROM o),
a AS (SELECT u.doc_id, u.section_id, k, array_to_string(list_slice(names, 1, k), '.') AS ancestor, x.first_chunk IS NULL OR x.first_chunk > u.first_chunk AS missing FROM u LEFT JOIN o x ON x.doc_id = u.doc_id AND x.section_id = array_to_string(list_slice(names, 1, k), '.')),
b AS (SELECT *, min(CASE WHEN missing THEN k END) OVER (PARTITION BY doc_id, section_id) AS stop FROM a),
q AS (SELECT doc_id, section_id, arg_max(ancestor, k) AS parent_id, CAST(max(k) AS INTEGER) AS depth FROM b WHERE stop IS NULL OR k < stop GROUP BY doc_id, section_id),
r AS (SELECT o.*, parent_id, coalesce(depth, 0) AS depth, coalesce(path[-1], 'Document') AS title, CAST(len(path) AS INTEGER) AS level FROM o LEFT JOIN q USING (doc_id, section_id))"""

_LIST = "array_to_string({}, ',')"


def _hits(t, term):
    return f"((length({t}) - length(replace({t}, '{term}', ''))) // {len(term)})"


def _search() -> str:
    terms = ["user", "the", "and", "st", "that"]
    body, title = "lower(text)", "lower(array_to_string(path, ' '))"
    total = " + ".join(f"ln(1 + {_hits(body, w)}) + 3.0 * {_hits(title, w)}" for w in terms)
    met = " + ".join(f"({_hits(body, w)} > 0 OR {_hits(title, w)} > 0)::INT" for w in terms)
    return f"{_chunks()}, z AS (SELECT doc_id, chunk_id, section_id, ({total}) * ({met}) / {len(terms)}.0 AS score FROM c) SELECT doc_id, chunk_id, section_id, round(score, 6) AS score FROM z WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id, chunk_id LIMIT 8"


_MEDIAN = "list_sort({0})[len({0}) // 2 + 1]"
_BODY = f"SELECT page, coalesce({_MEDIAN.format('list(size) FILTER (WHERE lines > 1)')}, {_MEDIAN.format('list(size)')}) AS body FROM {_HEADS} GROUP BY page"
_SHAPED = f"""(length({_trim('text')}) >= 2 AND lines <= 2 AND length({_trim('text')}) <= 120 AND regexp_matches(text, '\\p{{L}}') AND NOT (suffix({_trim('text')}, '.') AND length({_trim('text')}) > 60)
  AND NOT regexp_matches({_trim('text')}, '^\\p{{Ll}}') AND NOT {_chart('text')} AND NOT {_citation('text')}
  AND ((lines = 1 AND length({_trim('text')}) <= 90 AND ({_depth('text')}) IS NOT NULL AND regexp_matches({_trim('text')}, '^{_NOT_WS}+{_WS}+\\p{{Lu}}')) OR size >= body * 1.06 OR (bold AND size >= body * 0.95 AND length({_trim('text')}) <= 80)))"""
_NO_LABEL = "regexp_replace(text, '^[^ ]* ', '')"
_PARAS = f"(SELECT *, page // 12 AS doc FROM {_HEADS})"
_BODY_SIZE = f"(SELECT doc, arg_max(size, mass * 1000 - size) AS body_size FROM (SELECT doc, round(size * 4) / 4 AS size, sum(length(text)) AS mass FROM {_PARAS} WHERE NOT bold GROUP BY 1, 2) GROUP BY doc)"
_KEYED = rf"""(SELECT *, CASE WHEN (y + h <= 790 * 0.13 OR y >= 790 - 790 * 0.13) AND length(key) <= 200 THEN CASE WHEN y + h <= 790 * 0.13 THEN 'top:' ELSE 'bottom:' END || key END AS k FROM (
  SELECT *, trim({_cut(_cut('lower(text)', chr(92) + 'p{N}'), _WS + '+', ' ')}) AS key FROM (
  SELECT source AS doc, doc_id AS page, 'heading' AS type, 0 AS ord, lang || ' p. ' || doc_id AS text, 20.0 AS y, 10.0 AS h FROM documents
  UNION ALL SELECT source, doc_id, 'paragraph', i, l, 200.0, 300.0 FROM (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
  UNION ALL SELECT source, doc_id, 'paragraph', len(string_split(coalesce(text, ''), chr(10))) + 1, CAST(n_chars AS VARCHAR), 760.0, 10.0 FROM documents)))"""
_FOUND = f"SELECT doc, k AS key, count(DISTINCT page) AS pages FROM {_KEYED} q JOIN (SELECT source AS doc, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1) USING (doc) WHERE k IS NOT NULL GROUP BY doc, k, n HAVING n >= 3 AND count(DISTINCT page) >= greatest(3, round(n * 0.4))"


def _over(a, b):
    return f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


def _cover(a, b):
    return f"({_over(a, b)} / ({a}.w * {a}.h))"


_AB = f"b AS MATERIALIZED {_BOXES}"
_SPREAD = f"""(SELECT page, ord, CASE WHEN ord % 50 <> 49 THEN round(CASE WHEN page % 3 = 1 THEN 40 + col * 300 + (l_partkey % 2) * 140 + x / 25 WHEN col = 1 THEN 330 + x / 10 ELSE x / 10 END, 3) END AS x, CASE WHEN ord % 50 <> 49 THEN y END AS y,
  CASE WHEN ord % 50 <> 49 THEN round(CASE WHEN page % 4 = 0 AND ord % 8 = 0 THEN 380.0 WHEN page % 3 = 1 THEN 80.0 ELSE w * 2.2 END, 3) END AS w, CASE WHEN ord % 50 <> 49 THEN h END AS h FROM {_BOXES})"""


def _gutter(source: str, keys: str, p: str) -> str:
    return f"""{p}0 AS (SELECT {keys}, i, 150 + i * 3.0::DOUBLE AS "at", min(CASE WHEN x < 150 + i * 3.0 AND x + w > 150 + i * 3.0 THEN -1 WHEN x + w <= 150 + i * 3.0 THEN 150 + i * 3.0 - x - w ELSE x - (150 + i * 3.0) END) AS clearance,
  count(*) FILTER (WHERE x + w / 2 < 150 + i * 3.0) AS l, count(*) AS n FROM {source}, range(0, 101) r(i) WHERE w < 420 GROUP BY {keys}, i),
{p}1 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(clearance, 6) DESC, i) AS rk FROM {p}0 WHERE clearance >= 0 AND n >= 4),
{p} AS (SELECT {keys}, round("at", 6) AS gutter FROM {p}1 WHERE rk = 1 AND clearance > 9 AND l >= 2 AND n - l >= 2)"""


_GUTTER = f"sp AS MATERIALIZED {_SPREAD}, {_gutter('sp', 'page', 'gg')}"
_LINES = f"(SELECT page, ord, CASE WHEN ord % 6 = 0 THEN text ELSE {_NO_LABEL} END || CASE WHEN ord % 4 = 1 THEN '-' ELSE '' END AS text, size, bold, round(x / 40, 3) AS x, round(ord * 11.0 + y / 20, 3) AS y, w, h, CAST(ord // 30 AS INTEGER) AS col FROM {_HEADS})"
_PARAGRAPHS = f"""l AS (SELECT *, ({_depth('text')}) IS NOT NULL AS opens FROM {_LINES}),
l1 AS (SELECT l.*, m.median, max(w) OVER (PARTITION BY l.page, col) AS measure FROM l JOIN (SELECT page, {_MEDIAN.format('list(size)')} AS median FROM l GROUP BY page) m USING (page)),
l2 AS (SELECT *, coalesce(y - lag(y + h) OVER v > median * 0.75 OR col <> lag(col) OVER v OR (size <= median * 1.05 AND x - lag(x) OVER v > median * 0.9) OR greatest(size, lag(size) OVER v) > least(size, lag(size) OVER v) * 1.06 OR bold <> lag(bold) OVER v OR (opens AND lag(ord) OVER v IS NOT NULL), FALSE) AS brk FROM l1 WINDOW v AS (PARTITION BY page ORDER BY ord)),
l3 AS (SELECT *, sum(brk::INT) OVER (PARTITION BY page ORDER BY ord) AS run FROM l2),
l4 AS (SELECT *, first_value(opens) OVER v AS titled, row_number() OVER v AS pos_in FROM l3 WINDOW v AS (PARTITION BY page, run ORDER BY ord)),
l5 AS (SELECT *, titled AND pos_in > 1 AND w >= measure * 0.9 AS f FROM l4),
l6 AS (SELECT *, coalesce(sum(f::INT) OVER (PARTITION BY page, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb FROM l5),
l7 AS (SELECT *, CAST(sum((pos_in = 1 OR (f AND fb = 0))::INT) OVER (PARTITION BY page ORDER BY ord) AS BIGINT) AS paragraph FROM l6)"""
_NAV = """(SELECT page_id, i AS ord, CASE WHEN i % 7 = 6 THEN item || ' is prose,' ELSE item || ' ..... ' || (i + 1) END AS text, (i % 11 >= 8)::INT AS col FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1)) AS item, generate_subscripts(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1), 1) - 1 AS i FROM pages))"""
_TRIMS = r"[ .·…\x{A0}\t\-–—]"
_ENTRY = f"""e0 AS (SELECT *, {_cut('text', f'^{_BLANK}+|{_BLANK}+$')} AS line FROM {_NAV}),
e1 AS (SELECT *, regexp_extract(line, '([\\p{{N}}ivxlcdm]*)$', 1) AS tail FROM e0),
e2 AS (SELECT *, left(line, length(line) - length(tail)) AS pre FROM e1),
e3 AS (SELECT *, regexp_extract(pre, '([.·… \\x{{A0}}\\t]*)$', 1) AS lead, {_cut('pre', f'^{_TRIMS}+|{_TRIMS}+$')} AS title FROM e2),
e4 AS (SELECT *, length(line) >= 5 AND length(tail) BETWEEN 1 AND 6 AND (regexp_matches(tail, '^\\p{{N}}+$') OR regexp_matches(tail, '^[ivxlcdm]+$')) AND length(title) >= 3 AND regexp_matches(title, '\\p{{L}}') AND ({_count('lead', '[.·…]')} >= 2 OR length(lead) >= 3 OR ({_depth('title')}) IS NOT NULL) AND NOT suffix(title, ',') AS ok, coalesce({_depth('title')}, 1) AS depth FROM e3),
e45 AS (SELECT *, NOT ok OR coalesce(NOT lag(ok) OVER v, TRUE) OR col <> lag(col) OVER v AS brk FROM e4 WINDOW v AS (PARTITION BY page_id ORDER BY ord)),
e5 AS (SELECT *, sum(brk::INT) OVER (PARTITION BY page_id ORDER BY ord) AS run FROM e45),
e6 AS (SELECT *, count(*) OVER (PARTITION BY page_id, run) AS n FROM e5 WHERE ok)"""
_ITEMS = "(SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS ord, l_linenumber % 5 AS depth FROM lineitem)"
_ROWS = "(SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS i, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS a, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS b, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS c FROM lineitem)"

_COLUMNS = f"""b AS MATERIALIZED (SELECT page, ord, CASE WHEN ord % 30 = 0 THEN 60.0 WHEN ord % 2 = 0 THEN 40.0 + (l_partkey % 18) * 12 ELSE 330.0 + (l_suppkey % 18) * 12 END AS x, (ord // 2) * 12.0 AS y, CASE WHEN ord % 30 = 0 THEN 420.0 ELSE 10.0 END AS w, h FROM {_BOXES}),
      k AS (SELECT page, unnest(range(greatest(0, least(119, CAST(floor(y / (800.0 / 120)) AS INTEGER))), greatest(0, least(119, CAST(floor((y + h) / (800.0 / 120)) AS INTEGER))) + 1)) AS s, greatest(0, least(199, CAST(floor(x / 600 * 200) AS INTEGER))) AS x0, greatest(0, least(199, CAST(floor((x + w) / 600 * 200) AS INTEGER))) AS x1 FROM b WHERE x + w >= 0 AND x < 600),
      c AS MATERIALIZED (SELECT DISTINCT page, s, unnest(range(x0, x1 + 1)) AS xi FROM k), st AS (SELECT page, count(DISTINCT s) AS strips FROM c GROUP BY 1),
      ev AS MATERIALIZED (SELECT st.page, strips, r.xi, coalesce(n, 0) AS n FROM st, range(0, 200) r(xi) LEFT JOIN (SELECT page, xi, count(*) AS n FROM c GROUP BY 1, 2) z ON z.page = st.page AND z.xi = r.xi),
      be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n, xi) AS rk FROM ev WHERE xi BETWEEN 50 AND 150) WHERE rk = 1 AND strips >= 20 AND n < strips * 0.55),
      en AS (SELECT be.page, coalesce(max(ev.xi + 1) FILTER (WHERE ev.xi < be.xi), 0) AS lo, coalesce(min(ev.xi - 1) FILTER (WHERE ev.xi > be.xi), 199) AS hi FROM be LEFT JOIN ev ON ev.page = be.page AND ev.n >= be.n + 1 GROUP BY 1),
      g AS (SELECT page, ((lo + hi) / 2.0 + 0.5) * 3.0 AS center, greatest(3.0, (hi - lo + 1) * 3.0 / 2) AS half FROM en),
      gt AS MATERIALIZED (SELECT page, center, half FROM (SELECT b.page, center, half, count(*) AS n, count(*) FILTER (WHERE x + w / 2 < center) AS l FROM b JOIN g USING (page) GROUP BY 1, 2, 3) WHERE n >= 80 AND l > floor(n / 8.0) AND l < floor(n * 7 / 8.0))"""

def _rows_of(source: str, keys: str, p: str) -> str:
    """Rows that grow by overlap of height, as a fold over the glyphs of each group."""
    on = " AND ".join(f"n.{k} = f.{k}" for k in keys.split(", "))
    fits = "least(n.y + n.h, y1) - greatest(n.y, y0) > n.h * 0.45"
    return f"""{p}n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY y, x, ord) AS i FROM {source}),
      {p} AS (SELECT {keys}, i, ord, 1 AS row, y AS y0, y + h AS y1 FROM {p}n WHERE i = 1 UNION ALL SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.i, n.ord, f.row + (NOT {fits})::INT,
        CASE WHEN {fits} THEN least(y0, n.y) ELSE n.y END, CASE WHEN {fits} THEN greatest(y1, n.y + n.h) ELSE n.y + n.h END FROM {p} f JOIN {p}n n ON {on} AND n.i = f.i + 1)"""


#: Rows of glyphs in reading order, up to ``z``; paragraphs of lines, up to ``k``.
_ARRANGED = f"""{_COLUMNS}, {_rows_of('b', 'page', 'fr')},
      s AS (SELECT b.*, fr.row, center, half, x + w / 2 < center AS lf FROM b JOIN fr USING (page, ord) LEFT JOIN gt USING (page)),
      q AS (SELECT *, min(x) FILTER (WHERE NOT lf) OVER v - max(x + w) FILTER (WHERE lf) OVER v AS between_ FROM s WINDOW v AS (PARTITION BY page, row)),
      c2 AS MATERIALIZED (SELECT page, ord, x, y, w, h, CASE WHEN center IS NULL THEN 0 WHEN between_ IS NOT NULL AND between_ < greatest(6.0, half) THEN -1 WHEN lf THEN 0 ELSE 1 END AS col FROM q), {_rows_of('c2', 'page, col', 'fc')},
      bx AS MATERIALIZED (SELECT page, col, row, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1, max(h) AS size, count(*) AS n FROM c2 JOIN fc USING (page, col, ord) GROUP BY 1, 2, 3),
      z AS (SELECT bx.*, CAST((SELECT count(*) FROM bx t WHERE t.page = bx.page AND t.col = -1 AND t.y < CASE WHEN bx.col = -1 THEN bx.y ELSE (bx.y + bx.y1) / 2 END) AS INTEGER) AS section FROM bx)"""
_PAGE_BLOCKS = f"""g AS MATERIALIZED (SELECT page, paragraph, min(ord) AS line, count(*) AS lines, replace(regexp_replace(string_agg(text, chr(57344) ORDER BY ord), '(\\p{{L}})-' || chr(57344) || '(\\p{{Ll}})', '\\1\\2', 'g'), chr(57344), ' ') AS text, max(size) AS size, bool_and(bold) AS bold FROM l7 GROUP BY 1, 2),
      bd AS (SELECT page, coalesce({_MEDIAN.format('list(size) FILTER (WHERE lines > 1)')}, {_MEDIAN.format('list(size)')}) AS body FROM g GROUP BY page), j AS MATERIALIZED (SELECT *, {_SHAPED} AS is_heading FROM g JOIN bd USING (page)),
      k AS (SELECT page, line, text, 'heading' AS type, CAST(least(6, dense_rank() OVER (PARTITION BY page ORDER BY round(size * 2) / 2 DESC)) AS INTEGER) AS level FROM j WHERE is_heading UNION ALL SELECT page, line, text, 'paragraph', NULL FROM j WHERE NOT is_heading)"""
_READING = """CAST(row_number() OVER (PARTITION BY page ORDER BY section, CASE WHEN col = -1 THEN 2 ELSE col END, y, x, row) AS INTEGER)"""
_RUNS = f"""rn AS MATERIALIZED (SELECT b.page, b.ord, b.x, b.y, b.w, b.h, CASE WHEN ord % 41 = 7 THEN '' WHEN ord % 30 = 0 THEN 'Wide ' || ord ELSE 'w' || ord || CASE WHEN ord % 9 = 0 THEN '-' ELSE '' END END AS text,
  CASE WHEN ord % 30 = 0 THEN 14.0 ELSE 10.0 + l_suppkey % 2 END AS size, l_returnflag = 'R' AS bold FROM b JOIN (SELECT page, ord, l_suppkey, l_returnflag FROM {_BOXES}) q USING (page, ord))"""


def _runs_in(rects: str, key: str) -> str:
    return f"""SELECT r.page, {key}, regexp_replace(trim(string_agg(t.text, ' ' ORDER BY t.ord)), ' +', ' ', 'g') AS text, max(t.size) AS size, sum(CASE WHEN t.bold THEN length(t.text) ELSE 0 END) > 0.8 * sum(length(t.text)) AS bold
      FROM {rects} r JOIN rn t ON t.page = r.page AND t.x + t.w / 2 >= r.x AND t.x + t.w / 2 <= r.x + (r.x1 - r.x) AND t.y + t.h / 2 >= r.y AND t.y + t.h / 2 <= r.y + (r.y1 - r.y) GROUP BY r.page, {key}"""


_GLYPH_LINES = f"""{_ARRANGED}, {_RUNS}, za AS MATERIALIZED (SELECT *, {_READING} AS line FROM z), rt AS ({_runs_in('za', 'line')}),
      kp AS MATERIALIZED (SELECT za.page, za.line, za.col, za.row, x, y, x1, y1, text, coalesce(rt.size, za.size) AS size, coalesce(bold, FALSE) AS bold FROM za JOIN rt USING (page, line) WHERE text <> ''),
      og AS (SELECT kp.page, line, c2.ord, c2.x, c2.w, kp.size, max(c2.x + c2.w) OVER (PARTITION BY kp.page, line ORDER BY c2.x, c2.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c2 JOIN fc USING (page, col, ord) JOIN kp ON kp.page = c2.page AND kp.col = c2.col AND kp.row = fc.row),
      os AS (SELECT *, sum(coalesce(x - reach > size * 1.2, FALSE)::INT) OVER (PARTITION BY page, line ORDER BY x, ord) AS seg FROM og),
      sg AS MATERIALIZED (SELECT os.page, line, seg, min(os.x) AS x, max(os.x + os.w) AS x1, any_value(kp.y) AS y, any_value(kp.y1) AS y1, count(*) AS n FROM os JOIN kp USING (page, line) GROUP BY 1, 2, 3),
      sm AS (SELECT page, line, count(*) AS parts, sum(n) AS glyphs FROM sg GROUP BY 1, 2), sq AS (SELECT * FROM ({_runs_in('(SELECT * FROM sg JOIN sm USING (page, line) WHERE parts > 1)', 'line, seg')}) WHERE text <> ''),
      ss AS (SELECT page, line, string_agg(text, '|' ORDER BY seg) AS said FROM sq GROUP BY 1, 2),
      gl AS MATERIALIZED (SELECT kp.page, CAST(row_number() OVER (PARTITION BY kp.page ORDER BY kp.line) - 1 AS INTEGER) AS ord, text, kp.col, size, bold, x, y, x1 - x AS w, y1 - y AS h, CAST(glyphs AS INTEGER) AS glyphs, CASE WHEN parts = 1 THEN text ELSE coalesce(said, '') END AS segments
        FROM kp JOIN sm USING (page, line) LEFT JOIN ss USING (page, line))"""

ORACLES: dict[str, str] = {
    "token_estimate": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "garbled_ratio": rf"SELECT doc_id, round(CASE WHEN length({_solid('text')}) > 0 THEN {_count(_solid('text'), '[' + chr(92) + 'p{Co}' + chr(92) + 'p{Cc}' + chr(92) + 'x{FFFD}]')} * 1.0 / length({_solid('text')}) ELSE 0.0 END, 6) AS ratio FROM documents",
    "word_counts": f"SELECT doc_id, {_words('text')} AS words FROM documents",
    "section_depth": f"SELECT page, ord, text, {_depth('text')} AS depth FROM {_HEADS}",
    "chart_label": f"SELECT doc_id, ord, {_chart('text')}::INT AS chart FROM {_BLOCKS}",
    "chart_lettering": f"""SELECT page, ord, (length(s) BETWEEN 1 AND 90 AND NOT (suffix(s, '.') AND len(ws) > 6) AND ({_depth('s')}) IS NULL AND ({_chart('s')} OR len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{L}}$'))) > 0 OR len(ws) <= 3))::INT AS lettering FROM (
      SELECT *, list_filter(string_split_regex(s, ' +'), lambda w: w <> '') AS ws FROM (SELECT page, ord, {_trim(_NO_LABEL)} AS s FROM {_HEADS}))""",
    "plain_text": f"SELECT doc_id, pos, text FROM {_TALK}",
    "citation": f"SELECT doc_id, ord, {_citation('text')}::INT AS cite FROM {_BLOCKS}",
    "bold_font": "SELECT p_partkey, regexp_matches(lower(p_brand || CASE WHEN p_size % 3 = 0 THEN '-SemiBold' ELSE '-Regular' END), 'bold|-bd|semibold|black|heavy|-medi|demi')::INT AS bold FROM part",
    "is_math": r"SELECT doc_id, ord, regexp_matches(regexp_replace(text, '[%*]', '^', 'g'), '[\\_^{}]')::INT AS math FROM " + _BLOCKS,
    "escape_inline": f"SELECT doc_id, {_prose('text')} AS md FROM documents",
    "escape_cell": f"SELECT doc_id, {_trim('replace(replace(' + _prose('text') + ', chr(124), chr(92) || chr(124)), chr(10), $$<br>$$)')} AS cell FROM documents",
    "unescape": "SELECT doc_id, text FROM documents",
    "fence": "SELECT doc_id, repeat('`', greatest(3, doc_id % 7 + 1)) AS fence FROM documents",
    "sha256_file": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "number_format": "SELECT doc_id, format('{:,}', n_chars) AS n FROM documents",
    "report_columns": "SELECT doc_id, rpad(left(source, 4), 4, ' ') AS name, lpad(left(CAST(n_chars AS VARCHAR), 8), 8, ' ') AS n FROM documents",
    "figure_names": f"SELECT page, ord, printf('p%03d-fig%02d.png', page + 1, ord) AS name FROM {_BOXES}",
    "document_statistics": f"""SELECT doc_id, count(DISTINCT page_index) AS pages, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS characters, CAST(sum(length({_solid('text')})) AS BIGINT) AS solid_characters, CAST(sum({_words('text')}) AS BIGINT) AS words,
      CAST(round((sum(length({_solid('text')})) - sum({_dense('text')})) / 3.8 + sum({_dense('text')}) * 1.1) AS BIGINT) AS tokens, count(*) AS blocks, 0::BIGINT AS headings, 0::BIGINT AS tables, 0::BIGINT AS figures, 0::BIGINT AS uncertain_tables FROM {_BLOCKS} GROUP BY doc_id""",
    "stats_by_source": f"""SELECT source, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
      SELECT doc_id, any_value(source) AS source, count(DISTINCT page_index) AS pages, count(*) AS blocks, sum({_words('text')}) AS words, round((sum(length({_solid('text')})) - sum({_dense('text')})) / 3.8 + sum({_dense('text')}) * 1.1) AS tokens FROM {_BLOCKS} GROUP BY doc_id) GROUP BY source""",
    "page_route": f"""SELECT page, CASE WHEN sparse OR broken OR fontless THEN 'needsOCR' ELSE 'textLayer' END AS route,
      coalesce(nullif(concat_ws('; ', CASE WHEN sparse THEN 'sparse' END, CASE WHEN broken THEN 'garbled' END, CASE WHEN fontless THEN 'no fonts' END, CASE WHEN m = 1 THEN 'multi-column' END), ''), 'clean') AS reasons, round(ch / 480.0, 6) AS density, round(least(1.0, ta / 480000.0), 6) AS coverage
      FROM (SELECT *, ch / 480.0 < 0.08 AS sparse, r * 1.0 / n / 8 > 0.04 AS broken, ch > 0 AND page % 5 = 0 AS fontless FROM (SELECT page, sum(l_linenumber) AS ch, sum(w * h) AS ta, count(*) AS n, max(col) AS m, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM {_BOXES} GROUP BY page))""",
    "engine_mix": f"SELECT page // 10 AS doc, array_to_string(list_sort(list_distinct(list(CASE l_returnflag WHEN 'R' THEN 'vision' WHEN 'A' THEN 'textLayer' ELSE 'ocr' END))), '+') AS engines FROM {_BOXES} GROUP BY 1",
    "total_duration": "SELECT event_type, round(sum(CASE WHEN user_id % 3 <> 0 THEN coalesce(value, 0.0) ELSE 0.0 END), 3) AS seconds FROM events GROUP BY 1",
    "recovery_ratio": f"SELECT doc_id, CAST(coalesce(sum({_words('text')}) FILTER (WHERE ord % 2 = 0), 0) AS BIGINT) AS read_words, CAST(sum({_words('text')}) AS BIGINT) AS layer_words, round(CASE WHEN sum({_words('text')}) > 0 THEN coalesce(sum({_words('text')}) FILTER (WHERE ord % 2 = 0), 0) * 1.0 / sum({_words('text')}) ELSE 0.0 END, 6) AS ratio FROM {_BLOCKS} GROUP BY doc_id",
    "sections_of": f"WITH {_SECTIONS} SELECT doc_id, pos, section_no, section_id, array_to_string(path, ' / ') AS path, depth FROM s",
    "chunk_pack": f"WITH RECURSIVE {_packed(120, 20)} SELECT doc_id, pos, section_id, part, cost FROM k",
    "chunks_of": f"{_chunks(120, 20)} SELECT doc_id, chunk_id, text, section_id, part, part_count, {_LIST.format('pages')} AS pages, tokens, {_LIST.format('types')} AS types, previous_id, next_id FROM c",
    "chunk_context": f"{_chunks(120, 20)} SELECT doc_id, chunk_id, CASE WHEN crumb = '' THEN text ELSE crumb || chr(10) || chr(10) || text END AS context FROM (SELECT *, array_to_string(path, ' › ') || CASE WHEN part_count > 1 THEN ' (part ' || part || ' of ' || part_count || ')' ELSE '' END AS crumb FROM c)",
    "outline": f"{_OUTLINE} SELECT doc_id, section_id, parent_id, depth, title, level, tokens, {_LIST.format('pages')} AS pages, {_LIST.format('chunk_ids')} AS chunk_ids, first_chunk FROM r",
    "outline_text": f"{_OUTLINE} SELECT doc_id, string_agg(repeat('  ', depth) || section_id || ' ' || title || '  [' || tokens || ' tokens · p.' || (pages[1] + 1) || CASE WHEN len(pages) > 1 THEN '–' || (pages[-1] + 1) ELSE '' END || ']', chr(10) ORDER BY first_chunk) AS outline FROM r GROUP BY doc_id",
    "read_section": f"{_chunks()} SELECT doc_id, chunk_id, section_id, tokens FROM c WHERE section_id = '1' OR starts_with(section_id, '1.')",
    "read_section_alone": f"{_chunks()} SELECT doc_id, chunk_id, section_id, tokens FROM c WHERE section_id = '1'",
    "search_topk": _search(),
    "read_chunk_neighbours": f"{_chunks()} SELECT doc_id, chunk_id, CAST(least(700, length({_trim('text')})) AS INTEGER) AS n FROM c WHERE chunk_id BETWEEN 0 AND 2 AND doc_id IN (SELECT doc_id FROM c WHERE chunk_id = 1)",
    "render_markdown": f"WITH t AS {_TALK}, m AS (SELECT *, {_MD} AS md FROM t) SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE md <> '') || chr(10) AS markdown FROM m GROUP BY doc_id",
    "parse_markdown": f"""WITH t AS {_TALK}, e AS (SELECT doc_id, pos, 0 AS part, 'paragraph' AS type, NULL AS level, '{_NOTE}' AS text FROM t WHERE type = 'table' AND starts_with(fixed, '>')
      UNION ALL SELECT doc_id, pos, 1, type, level, CASE WHEN type IN ('table', 'list', 'figure') THEN NULL ELSE {_trim('text')} END FROM t
      UNION ALL SELECT doc_id, pos, 2, 'paragraph', NULL, '*' || text || '*' FROM t WHERE type = 'figure')
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS INTEGER) AS ord, type, level, text FROM e""",
    "heading_body_sizes": _BODY,
    "classify_headings": f"""WITH hd AS MATERIALIZED {_HEADS}, b AS ({_BODY.replace(_HEADS, 'hd')}), j AS MATERIALIZED (SELECT *, {_SHAPED} AS is_heading FROM hd JOIN b USING (page))
      SELECT page, ord, 1 AS is_heading, CAST(least(6, dense_rank() OVER (PARTITION BY page ORDER BY round(size * 2) / 2 DESC)) AS INTEGER) AS level FROM j WHERE is_heading UNION ALL SELECT page, ord, 0, NULL FROM j WHERE NOT is_heading""",
    "body_size": f"SELECT doc, body_size FROM {_BODY_SIZE}",
    "demote_small": f"""SELECT page, ord, (NOT coalesce(body_size > 0 AND size < body_size * 1.02 AND ({_depth('t')}) IS NULL, FALSE))::INT AS kept FROM (SELECT page, ord, doc, size, CASE WHEN ord % 2 = 0 THEN text ELSE {_NO_LABEL} END AS t FROM {_PARAS} WHERE bold) LEFT JOIN {_BODY_SIZE} USING (doc)""",
    "demote_bibliography": f"""WITH q AS (SELECT page, ord, CASE WHEN ord % 53 = 0 THEN ' References ' ELSE text END AS t FROM {_HEADS} WHERE bold), z AS (SELECT *, lower({_trim('t')}) IN ('references', 'bibliography', 'works cited', 'literature', 'literatur', 'literaturverzeichnis', 'quellen') AS bib FROM q)
      SELECT page, ord, (NOT (max(bib::INT) OVER (PARTITION BY page ORDER BY ord) = 1 AND NOT bib AND ({_depth('t')}) IS NOT NULL))::INT AS kept FROM z""",
    "furniture_keys": f"SELECT doc, page, ord, k AS key FROM {_KEYED}",
    "furniture_found": _FOUND,
    "strip_furniture": f"SELECT doc, page, ord, type FROM {_KEYED} q WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM ({_FOUND}) f WHERE f.doc = q.doc AND f.key = q.k)",
    "size_tiers": f"""WITH RECURSIVE z AS (SELECT page, list_reverse_sort(list(size)) AS xs FROM {_HEADS} GROUP BY page),
      f AS (SELECT page, xs, 1 AS i, [xs[1]] AS t FROM z UNION ALL SELECT page, xs, i + 1, CASE WHEN xs[i + 1] > t[-1] * 0.94 THEN t ELSE list_append(t, xs[i + 1]) END FROM f WHERE i < len(xs))
      SELECT page, array_to_string(t, ',') AS tiers FROM f WHERE i = len(xs)""",
    "normalize_levels": f"""WITH RECURSIVE z AS (SELECT page, list_reverse_sort(list(size)) AS xs FROM {_HEADS} GROUP BY page),
      f AS (SELECT page, xs, 1 AS i, [xs[1]] AS t FROM z UNION ALL SELECT page, xs, i + 1, CASE WHEN xs[i + 1] > t[-1] * 0.94 THEN t ELSE list_append(t, xs[i + 1]) END FROM f WHERE i < len(xs)),
      h AS (SELECT page, ord, size, CASE WHEN page % 2 = 0 THEN text ELSE {_NO_LABEL} END AS tx FROM {_HEADS}),
      d AS (SELECT *, {_depth('tx')} AS dp FROM h), n AS (SELECT page, max((dp IS NOT NULL)::INT) AS num FROM d GROUP BY page)
      SELECT page, ord, CAST(CASE WHEN len(xs) > 1 AND len(t) > 1 THEN CASE WHEN dp IS NOT NULL THEN least(dp + num, 6) ELSE least(6, coalesce(list_position(list_transform(t, lambda q: size > q * 0.94), TRUE), len(t))) END ELSE 1 END AS INTEGER) AS new_level
      FROM d JOIN n USING (page) JOIN f USING (page) WHERE i = len(xs)""",
    "box_algebra": f"""WITH b AS MATERIALIZED {_BOXES} SELECT m.page, m.ord, round({_over('m', 'n')}, 4) AS overlap, round({_cover('m', 'n')}, 4) AS coverage,
      array_to_string([round(greatest(m.x + 1, 0.0), 2), round(greatest(m.y + 1, 0.0), 2), round(least(m.x + m.w - 1, 400.0) - greatest(m.x + 1, 0.0), 2), round(least(m.y + m.h - 1, 90.0) - greatest(m.y + 1, 0.0), 2)], ',') AS box FROM b m JOIN (SELECT *, ord + 1 AS next FROM b) n ON n.page = m.page AND n.next = m.ord""",
    "box_union_agg": f"WITH {_AB} SELECT page, round(min(x), 4) AS x, round(min(y), 4) AS y, round(max(x + w) - min(x), 4) AS w, round(max(y + h) - min(y), 4) AS h FROM b GROUP BY page",
    "coverage_anti": f"WITH {_AB} SELECT m.page, m.ord FROM b m WHERE m.ord % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM b n WHERE n.page = m.page AND n.ord % 4 = 0 AND {_cover('m', 'n')} >= 0.6)",
    "claim_first": f"WITH {_AB} SELECT m.page, m.ord AS a_ord, min(n.ord) AS claim FROM b m JOIN b n ON n.page = m.page WHERE m.ord % 4 <> 0 AND n.ord % 4 = 0 AND {_cover('m', 'n')} > 0.5 GROUP BY 1, 2",
    "table_match": f"WITH {_AB}, q AS (SELECT m.page, m.ord, min(n.ord) AS match FROM b m JOIN b n ON n.page = m.page WHERE m.ord % 4 <> 0 AND n.ord % 4 = 0 AND ({_cover('m', 'n')} > 0.3 OR {_cover('n', 'm')} > 0.3) GROUP BY 1, 2) SELECT b.page, b.ord AS a_ord, match FROM b LEFT JOIN q USING (page, ord) WHERE b.ord % 4 <> 0",
    "caption_nearest": f"WITH {_AB}, j AS (SELECT m.page, m.ord AS a_ord, n.ord AS o, n.y - (m.y + m.h) AS gap FROM b m JOIN b n ON n.page = m.page WHERE m.ord % 5 = 0 AND n.ord % 5 <> 0 AND n.y - (m.y + m.h) >= -2 AND n.y - (m.y + m.h) < 24 AND n.x + n.w / 2 > m.x AND n.x + n.w / 2 < m.x + m.w), r AS (SELECT *, row_number() OVER (PARTITION BY page, a_ord ORDER BY gap, o) AS rk FROM j) SELECT page, a_ord, o AS caption, round(gap, 4) AS gap FROM r WHERE rk = 1",
    "splice_order": f"WITH {_AB}, q AS (SELECT m.page, m.ord, min(n.ord) AS before FROM b m JOIN b n ON n.page = m.page WHERE m.ord % 5 = 0 AND n.ord % 5 <> 0 AND n.y >= m.y + m.h AND n.x < m.x + m.w AND n.x + n.w > m.x GROUP BY 1, 2) SELECT b.page, b.ord AS a_ord, before FROM b LEFT JOIN q USING (page, ord) WHERE b.ord % 5 = 0",
    "segments": f"WITH {_AB}, r AS (SELECT *, max(x + w) OVER (PARTITION BY page, l_linenumber ORDER BY x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), i AS (SELECT *, CAST(sum(coalesce(x - reach > 12, FALSE)::INT) OVER (PARTITION BY page, l_linenumber ORDER BY x, ord) AS BIGINT) AS segment FROM r) SELECT page, l_linenumber, segment, round(min(x), 4) AS x, round(max(x + w), 4) AS x1, count(*) AS n FROM i GROUP BY 1, 2, 3",
    "corridors": f"WITH {_AB}, r AS (SELECT *, max(x + w) OVER (PARTITION BY page, l_linenumber ORDER BY x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b) SELECT page, l_linenumber, round(reach, 4) AS low, round(x, 4) AS high FROM r WHERE x - reach >= 9",
    "row_blocks": f"WITH {_AB}, r AS (SELECT *, coalesce(col <> lag(col) OVER v OR y - lag(y + h) OVER v > 8.0, FALSE) AS n FROM b WINDOW v AS (PARTITION BY page ORDER BY y, ord)) SELECT page, ord, CAST(sum(n::INT) OVER (PARTITION BY page ORDER BY y, ord) AS BIGINT) AS block FROM r",
    "row_cluster": f"""WITH RECURSIVE {_AB}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, ord) AS i FROM b),
      f AS (SELECT page, i, ord, 1 AS row, y AS y0, y + h AS y1 FROM n WHERE i = 1 UNION ALL SELECT n.page, n.i, n.ord, f.row + (NOT least(n.y + n.h, y1) - greatest(n.y, y0) > n.h * 0.45)::INT,
        CASE WHEN least(n.y + n.h, y1) - greatest(n.y, y0) > n.h * 0.45 THEN least(y0, n.y) ELSE n.y END, CASE WHEN least(n.y + n.h, y1) - greatest(n.y, y0) > n.h * 0.45 THEN greatest(y1, n.y + n.h) ELSE n.y + n.h END FROM f JOIN n ON n.page = f.page AND n.i = f.i + 1)
      SELECT page, ord, row FROM f""",
    "coalesce_regions": f"""WITH RECURSIVE {_AB}, n AS (SELECT *, l_returnflag <> 'R' AS m, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM b),
      f AS (SELECT page, i, ord, 1 AS region, m, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM n WHERE i = 1
      UNION ALL SELECT page, i, ord, region + (NOT j)::INT, m, CASE WHEN j THEN least(x0, x) ELSE x END, CASE WHEN j THEN least(y0, y) ELSE y END, CASE WHEN j THEN greatest(x1, x + w) ELSE x + w END, CASE WHEN j THEN greatest(y1, y + h) ELSE y + h END FROM (
        SELECT n.page, n.i, n.ord, f.region, n.m, f.x0, f.y0, f.x1, f.y1, n.x, n.y, n.w, n.h, f.m AND n.m AND abs(x0 - n.x) < 300 AND greatest(x1, n.x + n.w) - least(x0, n.x) < greatest(x1 - x0, n.w) * 1.2 AND n.y - y1 >= -2 AND n.y - y1 < 24 AND greatest(y1, n.y + n.h) - least(y0, n.y) <= 60 AS j FROM f JOIN n ON n.page = f.page AND n.i = f.i + 1))
      SELECT page, ord, region FROM f""",
    "page_gutter": f"WITH {_GUTTER} SELECT page, gutter FROM gg",
    "reading_order": f"""WITH RECURSIVE {_GUTTER}, h1 AS MATERIALIZED (SELECT sp.*, CASE WHEN gutter IS NULL OR x + w / 2 < gutter THEN 0 ELSE 1 END AS s1 FROM sp LEFT JOIN gg USING (page) WHERE x IS NOT NULL), {_gutter('h1', 'page, s1', 'hh')},
      b AS MATERIALIZED (SELECT h1.*, s1 * 2 + CASE WHEN gutter IS NULL OR x + w / 2 < gutter THEN 0 ELSE 1 END AS side FROM h1 LEFT JOIN hh USING (page, s1)),
      n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page, side ORDER BY y, x, ord) AS i, 5.0 AS tol FROM b),
      f AS (SELECT page, side, i, ord, x, y AS top, 1 AS row FROM n WHERE i = 1 UNION ALL SELECT n.page, n.side, n.i, n.ord, n.x, CASE WHEN n.y - top > tol THEN n.y ELSE top END, row + (n.y - top > tol)::INT FROM f JOIN n ON n.page = f.page AND n.side = f.side AND n.i = f.i + 1),
      e AS (SELECT page, side, row, x, ord FROM f UNION ALL SELECT page, 4, 0, 0.0, ord FROM sp WHERE x IS NULL)
      SELECT page, ord, side, CAST(row_number() OVER (PARTITION BY page ORDER BY side, row, x, ord) AS INTEGER) AS rank FROM e""",
    "paragraphs": f"WITH {_PARAGRAPHS} SELECT page, ord, paragraph FROM l7",
    "paragraph_texts": f"WITH {_PARAGRAPHS}, z AS (SELECT page, paragraph, count(*) AS lines, string_agg(text, '' ORDER BY ord) AS t FROM l7 GROUP BY 1, 2) SELECT page, paragraph, lines, replace(regexp_replace(t, '(\\p{{L}})-(\\p{{Ll}})', '\\1\\2', 'g'), '', ' ') AS text FROM z",
    "column_measure": f"SELECT page, ord, max(w) OVER (PARTITION BY page, col) AS measure FROM {_LINES}",
    "contents_lists": f"WITH {_ENTRY} SELECT page_id, ord, title || ' · p. ' || tail AS item, depth - 1 AS depth FROM e6 WHERE n >= 3",
    "list_numbering": f"""WITH q AS MATERIALIZED {_ITEMS} SELECT doc_id, ord, depth, CAST((SELECT count(*) FROM q y WHERE y.doc_id = x.doc_id AND y.depth = x.depth AND y.ord <= x.ord AND y.ord > coalesce((SELECT max(z.ord) FROM q z WHERE z.doc_id = x.doc_id AND z.depth < x.depth AND z.ord < x.ord), 0)) AS INTEGER) AS number FROM q x""",
    "flatten_spans": f"""SELECT doc_id, string_agg(CASE WHEN i % 3 = 2 THEN '|' || a || '|' || b ELSE a || '|' || b || '|' || c END, '/' ORDER BY i) || CASE WHEN count(*) % 3 = 1 THEN '/||' ELSE '' END AS grid FROM {_ROWS} GROUP BY doc_id""",
    "math_display": "SELECT p_partkey, 'x' || translate(CAST(p_size AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉') || '⁄α² of ' || p_name AS text FROM part",
    "table_width": "SELECT l_orderkey AS doc_id, 3 AS width, CAST(count(*) AS INTEGER) AS height FROM lineitem GROUP BY 1",
    "table_confidence": f"""SELECT doc_id, (s)::INT AS suspect, (u)::INT AS doubtful, (s AND u)::INT AS flagged FROM (
      SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN count(*) FILTER (WHERE i % 3 = 0) ELSE 0 END) * 1.0 / count(*) > 0.34 AS s,
        sum(CASE WHEN a <> '' THEN 1 ELSE 0 END + 1 + CASE WHEN doc_id % 2 = 0 AND i % 3 = 0 THEN 0 ELSE 1 END) * 1.0 / sum(CASE WHEN doc_id % 2 = 0 AND i % 3 = 0 THEN 2 ELSE 3 END) < 0.55 AS u FROM {_ROWS} GROUP BY doc_id)""",
    "render_table": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '> ⚠︎ Table structure is uncertain; verify against the source page.' || chr(10) || chr(10) ELSE '' END || string_agg('| ' || a || ' | ' || b || ' | ' || c || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY i) AS markdown FROM {_ROWS} GROUP BY doc_id",
    "bullet_lists": f"""WITH m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum((a <> '')::INT) OVER (PARTITION BY doc_id) AS marks, sum((a <> '' OR i = 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS item FROM {_ROWS}),
      g AS (SELECT doc_id, n, marks, item, string_agg(b, ' ' ORDER BY i) AS t FROM m GROUP BY 1, 2, 3, 4) SELECT doc_id, CASE WHEN n >= 2 AND marks > 0 THEN string_agg(t, '|' ORDER BY item) END AS items FROM g GROUP BY doc_id, n, marks""",
    "page_event_stream": "SELECT user_id, event_type, count(*) AS n, round(sum(value), 3) AS total, max(ts) AS last_ts FROM events GROUP BY 1, 2",
    "glyph_scan": f"""SELECT page, ord, round(x, 3) AS x, round(y, 3) AS y, round(w, 3) AS w, round(h, 3) AS h FROM (SELECT page, ord, greatest(x0, 0.0) AS x, greatest(t, 0.0) AS y, least(x0 + w0, 600.0) - greatest(x0, 0.0) AS w, least(t + h, 120.0) - greatest(t, 0.0) AS h FROM (
      SELECT page, ord, x - 20 AS x0, w * 4 AS w0, h, 120.0 - y - h AS t FROM {_BOXES} WHERE ord % 10 <> 0 AND w * 4 < 300)) WHERE w > 0 AND h > 0""",
    "text_in_rect": f"""WITH {_AB} SELECT r.page, r.ord, string_agg('w' || b.ord, ' ' ORDER BY b.ord) AS text, max(b.l_linenumber)::DOUBLE AS size, (sum(CASE WHEN b.l_returnflag <> 'N' THEN length('w' || b.ord) ELSE 0 END) > 0.8 * sum(length('w' || b.ord)))::INT AS bold
      FROM b r JOIN b ON b.page = r.page WHERE r.ord % 25 = 0 AND b.x + b.w / 2 BETWEEN r.x AND r.x + r.w * 3 AND b.y + 5 BETWEEN r.y AND r.y + 20 GROUP BY r.page, r.ord""",
    "contents_exclude": f"WITH {_AB}, t AS (SELECT page, ord AS first_line, ord + l_linenumber AS end_line FROM b WHERE ord % 4 = 0), c AS (SELECT page, ord AS first_line, ord + 1 AS end_line FROM b WHERE ord % 4 <> 0) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = t.page AND t.first_line < c.end_line AND c.first_line < t.end_line)",
    "vision_blocks": f"WITH v AS (SELECT *, CASE WHEN ord = 5 THEN 'title' WHEN ord % 6 = 0 THEN 'table' ELSE 'paragraph' END AS kind FROM {_BOXES}) SELECT m.page, m.ord, m.kind FROM v m WHERE m.kind <> 'paragraph' OR NOT EXISTS (SELECT 1 FROM v n WHERE n.page = m.page AND n.kind <> 'paragraph' AND {_cover('m', 'n')} >= CASE WHEN n.kind = 'title' THEN 0.9 ELSE 0.6 END)",
    "place_headings": f"WITH {_AB}, r AS (SELECT *, row_number() OVER (PARTITION BY page, l_linenumber ORDER BY ord) = 1 AND l_linenumber <= 2 AS head FROM b) SELECT page, ord, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN head THEN l_linenumber END AS level FROM r",
    "column_gutters": f"WITH {_COLUMNS} SELECT page, round(center, 4) AS center, round(half, 4) AS half FROM gt",
    "arrange_rows": f"""WITH RECURSIVE {_ARRANGED}
      SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY section, CASE WHEN col = -1 THEN 2 ELSE col END, y, x, row) AS INTEGER) AS line, col AS "column", section, x, y, x1, y1, size, n FROM z""",
    "extract_pages": f"""WITH {_PARAGRAPHS}, {_PAGE_BLOCKS}
      SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS INTEGER) AS ord, type, level, {_trim('text')} AS text FROM k WHERE {_trim('text')} <> ''""",
    "finish_documents": f"""WITH s AS MATERIALIZED (SELECT *, CASE WHEN type = 'heading' OR length(text) <= 40 THEN 'heading' ELSE 'paragraph' END AS kind FROM {_KEYED}),
      kept AS MATERIALIZED (SELECT *, CASE WHEN kind = 'heading' THEN 9 + length(text) % 3 * 1.5 ELSE 9.0 END AS size FROM s WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM ({_FOUND}) f WHERE f.doc = s.doc AND f.key = s.k)),
      hd AS MATERIALIZED (SELECT kept.doc, page, ord, size, {_depth('text')} AS dp, lower({_trim('text')}) IN ('references', 'bibliography', 'works cited', 'literature', 'literatur', 'literaturverzeichnis', 'quellen') AS bib, body FROM kept LEFT JOIN (SELECT doc, 9.0 AS body FROM kept WHERE kind = 'paragraph' AND length(text) > 0 GROUP BY doc) USING (doc) WHERE kind = 'heading'),
      lg AS (SELECT *, NOT coalesce(size < body * 1.02 AND dp IS NULL, FALSE) AS large FROM hd), fb AS (SELECT doc, min([page, ord]) AS first FROM lg WHERE large AND bib GROUP BY doc),
      rl AS MATERIALIZED (SELECT lg.*, large AND NOT coalesce([page, ord] > first AND NOT bib AND dp IS NOT NULL, FALSE) AS own FROM lg LEFT JOIN fb USING (doc)),
      ti AS (SELECT doc, list_reverse_sort(list_distinct(list(size))) AS t, count(*) AS n, max((dp IS NOT NULL)::INT) AS num FROM rl WHERE own GROUP BY doc)
      SELECT doc, page, ord, CASE WHEN own THEN 'heading' ELSE 'paragraph' END AS type, CAST(CASE WHEN own THEN CASE WHEN n > 1 AND len(t) > 1 THEN CASE WHEN dp IS NOT NULL THEN least(dp + num, 6) ELSE least(6, coalesce(list_position(list_transform(t, lambda q: size > q * 0.94), TRUE), len(t))) END ELSE 1 END END AS INTEGER) AS level FROM rl LEFT JOIN ti USING (doc)
      UNION ALL SELECT doc, page, ord, 'paragraph', NULL FROM kept WHERE kind = 'paragraph'""",
    "figure_pages": f"WITH {_AB}, p AS (SELECT page, max(x) AS width, max(y) AS height FROM b GROUP BY page) SELECT b.page, printf('images/p%03d-fig%02d.png', b.page + 1, ord) AS path, round(x, 3) AS x, round(y, 3) AS y, round(w, 3) AS w, round(h, 3) AS h, round(width, 3) AS width, round(height, 3) AS height FROM b JOIN p USING (page) WHERE ord % 20 = 0",
    "document_report": f"""WITH t AS {_TALK}, p AS (SELECT conv_id AS doc_id, count(DISTINCT turn) AS pages, sum(turn * 0.25) AS s FROM conversations GROUP BY 1), r AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE type = 'heading') AS headings, count(*) FILTER (WHERE type = 'table') AS tables, count(*) FILTER (WHERE type = 'figure') AS figures, sum(length(text)) AS c FROM t GROUP BY doc_id)
      SELECT doc_id, pages, blocks, headings, tables, figures, round(c / pages, 4) AS per_page, round(s, 4) AS seconds, round(s / pages, 4) AS seconds_per_page FROM p JOIN r USING (doc_id)""",
    "json_document": f"""WITH t AS {_TALK}, b AS (SELECT doc_id, page_index, string_agg(coalesce(js, '{{' || CASE WHEN level IS NOT NULL THEN '"level":' || level || ',' ELSE '' END || '"text":' || to_json(text) || ',"type":"' || type || '"}}'), ',' ORDER BY pos) AS blocks FROM t GROUP BY 1, 2)
      SELECT doc_id, '{{"pages":[' || string_agg('{{"blocks":[' || blocks || '],"index":' || page_index || '}}', ',' ORDER BY page_index) || ']}}' AS json FROM b GROUP BY doc_id""",
    "jsonl_chunks": f"""{_chunks()} SELECT doc_id, chunk_id, '{{"blockTypes":' || to_json(types) || ',"estimatedTokens":' || tokens || ',"headingPath":' || to_json(path) || ',"id":' || chunk_id || CASE WHEN next_id IS NOT NULL THEN ',"nextID":' || next_id ELSE '' END || ',"pages":' || to_json(pages) || ',"partCount":' || part_count || ',"partIndex":' || part || CASE WHEN previous_id IS NOT NULL THEN ',"previousID":' || previous_id ELSE '' END || ',"sectionID":"' || section_id || '","text":' || to_json(text) || '}}' AS json FROM c""",
    "document_event_stream": f"""WITH b AS MATERIALIZED (SELECT doc_id, page_index, count(*) AS blocks, CAST(sum({_words('text')}) AS BIGINT) AS words FROM {_BLOCKS} GROUP BY 1, 2),
      d AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(words) AS BIGINT) AS words FROM b GROUP BY 1)
      SELECT doc_id, 0 AS seq, 'started' AS event, n AS page_index, NULL AS blocks, NULL AS words FROM d
      UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS INTEGER), 'page', page_index, blocks, words FROM b UNION ALL SELECT doc_id, n + 1, 'finished', n, blocks, words FROM d
      UNION ALL SELECT doc_id, 0, 'failed', NULL, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d)""",
    "page_stream": f"""WITH b AS MATERIALIZED (SELECT doc_id, page_index, count(*) AS blocks, CAST(sum({_words('text')}) AS BIGINT) AS words FROM {_BLOCKS} GROUP BY 1, 2),
      d AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(words) AS BIGINT) AS words FROM b GROUP BY 1)
      SELECT doc_id, 0 AS seq, 'started' AS event, n AS page_index, NULL AS blocks, NULL AS words FROM d
      UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS INTEGER), 'page', page_index, blocks, words FROM b UNION ALL SELECT doc_id, n + 1, 'finished', n, blocks, words FROM d""",
    "embedded_fonts": f"""SELECT doc_id, max((coalesce(before, 0) < 2000 AND ord % 40 >= 36)::INT) AS fonts FROM (SELECT doc_id, ord, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_BLOCKS}) GROUP BY doc_id""",
    "box_decode": f"WITH {_AB} SELECT page, ord, round(x / 1000 * 600, 2) AS x, round((1 - y / 1000 - h / 1000) * 800, 2) AS y, round(w / 1000 * 600, 2) AS w, round(h / 1000 * 800, 2) AS h FROM b",
    "encode_path": "SELECT page_id, replace(replace(replace(url, '?', '%3F'), '#', '%23'), ' ', '%20') || '%20%C3%A9%231' AS path FROM pages",
    "glyph_lines": f"WITH RECURSIVE {_GLYPH_LINES} SELECT page, ord, text, col, size, bold::INT AS bold, round(x, 3) AS x, round(y, 3) AS y, round(w, 3) AS w, round(h, 3) AS h, glyphs, segments FROM gl",
    "glyph_blocks": f"""WITH gq AS MATERIALIZED (WITH RECURSIVE {_GLYPH_LINES} SELECT * FROM gl), {_PARAGRAPHS.replace(_LINES, 'gq')}, {_PAGE_BLOCKS}
      SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS INTEGER) AS ord, type, level, {_trim('text')} AS text FROM k WHERE {_trim('text')} <> ''""",
    "model_answers": f"""WITH a AS (SELECT doc_id, {_trim("'```md' || chr(10) || replace(text, '`', chr(39)) || ' $ x^2 $' || chr(10) || '```'")} AS t FROM documents),
      f AS (SELECT doc_id, {_trim("regexp_extract(t, '(?s)^```[^\\n]*\\n(.*?)\\n?```$', 1)")} AS t FROM a),
      m AS (SELECT doc_id, replace(replace(t, '$$', chr(57345) || chr(57345)), chr(57345) || '$', chr(57345) || chr(57345)) AS t FROM f)
      SELECT doc_id, replace(regexp_replace(t, '\\$[ \\t\\x0B-\\r\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]*([^$\\x{{E001}}\\n]*?)[ \\t\\x0B-\\r\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]*([$\\x{{E001}}])', '$\\1\\2', 'g'), chr(57345), '$') AS text FROM m""",
    "routed_pages": f"""WITH RECURSIVE {_PARAGRAPHS.replace(_LINES, f'(SELECT * FROM {_LINES} WHERE page % 7 <> 3)')}, {_PAGE_BLOCKS},
      bx AS MATERIALIZED (SELECT page, paragraph, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM l7 GROUP BY 1, 2),
      rg AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS INTEGER) AS ord, 'text' AS kind, k.level, bx.x, bx.y, bx.w, bx.h FROM k JOIN g USING (page, line) JOIN bx USING (page, paragraph) WHERE page % 3 = 1 AND {_trim('k.text')} <> ''
        UNION ALL SELECT page, ord, CASE WHEN ord % 20 = 0 THEN 'table' ELSE 'text' END, NULL, x, y, w, h FROM {_BOXES} WHERE page % 7 = 3 AND page % 2 = 0 AND ord % 10 = 0),
      n AS MATERIALIZED (SELECT *, kind = 'text' AND level IS NULL AS m, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM rg),
      f AS (SELECT page, i, ord, 1 AS region, m, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM n WHERE i = 1
      UNION ALL SELECT page, i, ord, region + (NOT j)::INT, m, CASE WHEN j THEN least(x0, x) ELSE x END, CASE WHEN j THEN least(y0, y) ELSE y END, CASE WHEN j THEN greatest(x1, x + w) ELSE x + w END, CASE WHEN j THEN greatest(y1, y + h) ELSE y + h END FROM (
        SELECT n.page, n.i, n.ord, f.region, n.m, f.x0, f.y0, f.x1, f.y1, n.x, n.y, n.w, n.h, f.m AND n.m AND abs(x0 - n.x) < 600.0::DOUBLE * 0.1 AND greatest(x1, n.x + n.w) - least(x0, n.x) < greatest(x1 - x0, n.w) * 1.2 AND n.y - y1 >= -2 AND n.y - y1 < 24 AND greatest(y1, n.y + n.h) - least(y0, n.y) <= 120 AS j FROM f JOIN n ON n.page = f.page AND n.i = f.i + 1)),
      jr AS (SELECT page, region, arg_min(kind, ord) AS kind, max(level) AS level, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM f JOIN n USING (page, ord) GROUP BY 1, 2)
      SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS INTEGER) AS ord, type, level, {_trim('text')} AS text, 'textLayer' AS engine FROM k WHERE {_trim('text')} <> '' AND page % 3 <> 1
      UNION ALL SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY region) - 1 AS INTEGER), CASE WHEN level IS NOT NULL THEN 'heading' ELSE 'paragraph' END, level, kind || ' ' || CAST(floor(w - 2 * -6.0) AS INTEGER) || 'x' || CAST(floor(h - 2 * -6.0) AS INTEGER), 'reader-layout' FROM jr
      UNION ALL SELECT DISTINCT page, 0, 'paragraph', NULL::INTEGER, 'page 600x2000', 'reader' FROM {_BOXES} WHERE page % 7 = 3 AND (page % 2 = 1 OR page NOT IN (SELECT page FROM rg))""",
    "vision_page": f"""WITH v AS (SELECT *, CASE WHEN ord = 5 THEN 'title' WHEN ord % 6 = 0 THEN 'table' WHEN ord % 11 = 0 THEN 'list' ELSE 'paragraph' END AS kind, 'Text ' || l_partkey AS text, CAST(1 + ord % 2 AS INTEGER) AS lines FROM {_BOXES}),
      q AS MATERIALIZED (SELECT m.*, h / lines AS size, FALSE AS bold FROM v m WHERE m.kind <> 'paragraph' OR NOT EXISTS (SELECT 1 FROM v n WHERE n.page = m.page AND n.kind <> 'paragraph' AND {_cover('m', 'n')} >= CASE WHEN n.kind = 'title' THEN 0.9 ELSE 0.6 END)),
      ce AS (SELECT page, ord, i // 2 AS row, i % 2 AS col, 'c' || ord || '.' || i || ':' || CASE WHEN i = 0 THEN 2 ELSE 1 END || ':' || CASE WHEN i = 3 AND l_suppkey % 2 = 0 THEN 2 ELSE 1 END AS c, CASE WHEN i = 3 AND l_suppkey % 2 = 0 THEN 2 ELSE 1 END AS wide FROM q, range(0, 6) r(i) WHERE kind = 'table'),
      cr AS (SELECT page, ord, row, string_agg(c, '|' ORDER BY col) AS cells, sum(wide) AS width FROM ce WHERE NOT (ord % 12 = 0 AND row = 1) GROUP BY 1, 2, 3),
      cw AS (SELECT q.page, q.ord, r.row, coalesce(cells, '') AS cells, coalesce(width, 0) AS width FROM q CROSS JOIN range(0, 3) r(row) LEFT JOIN cr ON cr.page = q.page AND cr.ord = q.ord AND cr.row = r.row WHERE kind = 'table'),
      ct AS (SELECT page, ord, string_agg(cells, '/' ORDER BY row) AS rows, CAST(max(width) <= 1 OR count(*) FILTER (WHERE width <> mx) / count(*)::DOUBLE > 0.34 AS INTEGER) AS suspect FROM (SELECT *, max(width) OVER (PARTITION BY page, ord) AS mx FROM cw) GROUP BY 1, 2),
      bd AS (SELECT page, coalesce({_MEDIAN.format('list(size) FILTER (WHERE lines > 1)')}, {_MEDIAN.format('list(size)')}) AS body FROM q WHERE kind = 'paragraph' GROUP BY page),
      j AS MATERIALIZED (SELECT *, {_SHAPED} AS is_heading FROM q JOIN bd USING (page) WHERE kind = 'paragraph'),
      k AS (SELECT page, ord, text, 'heading' AS type, dense_rank() OVER (PARTITION BY page ORDER BY round(size * 2) / 2 DESC) AS rk FROM j WHERE is_heading)
      SELECT page, ord, 'table' AS type, NULL::INTEGER AS level, NULL AS text, rows, suspect, NULL AS items, NULL::INTEGER AS ordered FROM ct
      UNION ALL SELECT page, ord, 'list', NULL, NULL, NULL, NULL, '0 item 0|1 item 0.0.0|1 item 0.0.1|0 item 2', CAST(l_suppkey % 2 = 0 AS INTEGER) FROM q WHERE kind = 'list'
      UNION ALL SELECT page, ord, 'heading', 1, text, NULL, NULL, NULL, NULL FROM q WHERE kind = 'title'
      UNION ALL SELECT page, ord, type, CAST(least(6, least(6, rk) + (page IN (SELECT page FROM q WHERE kind = 'title'))::INT) AS INTEGER), text, NULL, NULL, NULL, NULL FROM k
      UNION ALL SELECT page, ord, 'paragraph', NULL, text, NULL, NULL, NULL, NULL FROM j WHERE NOT is_heading""",
}

# the same passes, with a document for every 64 ids
ORACLES["streamed_documents"] = ORACLES["finish_documents"].replace("FROM documents", "FROM sheets").replace("WITH s AS", "WITH sheets AS (SELECT * REPLACE (doc_id // 64 AS source) FROM documents), s AS", 1)
