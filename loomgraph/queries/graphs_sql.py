"""SQL for the queries on graphs."""

from __future__ import annotations

from ..sources.graph_files import BASE, RDF, RDFS
from .corpora import LINES, STAR_EDGES, STAR_NODES

_G = f"n AS ({STAR_NODES}), e AS ({STAR_EDGES})"
_INC = "inc AS (SELECT event_id AS major, 'u' || (user_id % 997) AS id, event_type AS type, 'T' || (event_id % 13) AS title, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS content, 'k' || (event_id % 4) AS k, 'v' || event_id AS v, 'u' || (user_id % 31) AS target, 'chunk' || (event_id % 5) AS chunk FROM events)"
_KS = ", ".join(f"arg_max(v, CASE WHEN k = 'k{i}' THEN major END) FILTER (WHERE k = 'k{i}') AS k{i}" for i in range(4))
_UPSERT = f"SELECT id, arg_max(type, major) AS type, arg_max(title, major) AS title, arg_max(content, major) FILTER (WHERE content IS NOT NULL) AS content, {_KS}"
_PART = "SELECT 'node' AS part, id FROM {n} UNION ALL SELECT 'edge', source || ' ' || type || ' ' || target FROM {e}"
# Forms of templates and of numbered objects, as in operators/graph.py.
# Forms of templates, as in graph.py.
_TEMPLATE = r"(regexp_matches({c}, 'P\s*\(\s*[A-Za-z]\\?[_A-Za-z0-9]*\s*=\s*[A-Za-z0-9_{{}}\\]+\s*\)\s*=\s*p\s*\(') OR regexp_matches({c}, 'P\\left\(\s*[A-Za-z]\\?[_A-Za-z0-9]*\s*=\s*[A-Za-z0-9_{{}}\\]+\s*\\right\)\s*=\s*p\\left\(') OR regexp_matches({c}, '(^|[^A-Za-z0-9_])f_?[A-Za-z]\s*\(\s*[A-Za-z]\s*\)') OR regexp_matches({c}, 'p_?[A-Za-z]\s*\(\s*[A-Za-z]\s*\)') OR (contains({c}, '\infty') AND regexp_matches({c}, '-\s*\\infty') AND regexp_matches({c}, '<\s*[A-Za-z]')))"
_INDEXED = r"(regexp_matches({c}, '\\Omega_\{{?\d+\}}?') OR (regexp_matches({c}, '[A-Za-z]_\{{?\d+\}}?') AND length(regexp_replace({c}, '\s+', '', 'g')) <= 25))"
_T, _I = _TEMPLATE.format(c="content"), _INDEXED.format(c="content")
_DEG = "ends AS (SELECT source AS id, type FROM e UNION ALL SELECT target, type FROM e), deg AS (SELECT id, count(*) AS degree, sum(CASE WHEN type <> 'Contains' THEN 1 ELSE 0 END)::BIGINT AS strong FROM ends GROUP BY id)"
_PRUNE = f"{_G}, {_DEG}, noise AS (SELECT n.id FROM n LEFT JOIN deg ON deg.id = n.id WHERE type = 'Formula' AND label IS NULL AND coalesce(strong, 0) = 0 AND ({_T} OR {_I} OR length(trim(content)) < 120)), kn AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM noise)), ke AS (SELECT * FROM e WHERE source IN (SELECT id FROM kn) AND target IN (SELECT id FROM kn))"


def _view(hidden: str, isolated: bool) -> str:
    ctes = f"{_G}, n1 AS (SELECT * FROM n WHERE type NOT IN ({hidden})), e1 AS (SELECT * FROM e" + (" WHERE source IN (SELECT id FROM n1) AND target IN (SELECT id FROM n1))" if hidden != "''" else ")")
    if isolated:
        return f"WITH {ctes} {_PART.format(n='n1', e='e1')}"
    return f"WITH {ctes}, n2 AS (SELECT * FROM n1 WHERE id IN (SELECT source FROM e1 UNION SELECT target FROM e1)), e2 AS (SELECT * FROM e1 WHERE source IN (SELECT id FROM n2) AND target IN (SELECT id FROM n2)) {_PART.format(n='n2', e='e2')}"


#: Pairs of ids that are one: by labels, and by EquivalentTo between concepts that both are nodes.
_PAIRS = f"""{_G}, c AS (SELECT id FROM n WHERE type IN ('Definition', 'Notation', 'Construction')), pairs AS (SELECT id AS a, 'tex:' || label AS b FROM n WHERE label IS NOT NULL
UNION SELECT source, target FROM e WHERE type = 'EquivalentTo' AND source IN (SELECT id FROM c) AND target IN (SELECT id FROM c)), sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r), comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id),
grp AS (SELECT comp.id, component, n.major FROM comp JOIN n ON n.id = comp.id), canon AS (SELECT component, arg_min(id, CASE WHEN id LIKE 'tex:%' THEN major ELSE major + 1000000000000 END) AS canonical FROM grp GROUP BY component),
alias AS (SELECT grp.id, canonical FROM grp JOIN canon ON canon.component = grp.component),
re AS (SELECT type, coalesce(s.canonical, source) AS source, coalesce(t.canonical, target) AS target, evidence, chunk, major FROM e LEFT JOIN alias s ON s.id = source LEFT JOIN alias t ON t.id = target)"""
_ASKED = "q AS (SELECT CAST(n_nationkey AS BIGINT) * 65536 AS chunk_seq, n_name, n_nationkey AS k, lower('Supplier nation ' || n_name) AS raw FROM nation)"
_WORDS = r"""w0 AS (SELECT chunk_seq, k, regexp_split_to_array(lower(regexp_replace(n_name || ' world ' || k || ' ' || ' ' || '{sup' || (k + 1) || '} and ' || ' ' || '{reg' || (k % 5) || '} of Supplier nation ' || n_name, '[^a-zA-Z0-9]+', ' ', 'g')), ' ') AS ws FROM q),
w1 AS (SELECT chunk_seq, k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0), w2 AS (SELECT chunk_seq, k, w, min(i) AS i FROM w1 WHERE length(w) >= 4 GROUP BY chunk_seq, k, w), w3 AS (SELECT *, row_number() OVER (PARTITION BY chunk_seq ORDER BY i) AS r FROM w2)"""
_SCORES = f"""{_G}, {_ASKED}, {_WORDS}, sc AS (SELECT q.chunk_seq, n.id, n.major, (CASE WHEN label IN ('sup' || (k + 1), 'reg' || (k % 5)) THEN 20 ELSE 0 END) + (CASE WHEN n.id = 'tex:sup' || (k + 1) OR n.id = 'tex:reg' || (k % 5) THEN 20 ELSE 0 END)
+ coalesce((SELECT 2 * count(*) FROM w3 WHERE w3.chunk_seq = q.chunk_seq AND r <= 41 AND contains(lower(title), w3.w)), 0) + (CASE WHEN replace(path, '/', ' / ') = 'world / ' || k THEN 3 ELSE 0 END) AS score FROM q, n),
rk AS (SELECT *, row_number() OVER (PARTITION BY chunk_seq ORDER BY score DESC, major) - 1 AS place FROM sc), shown AS (SELECT chunk_seq, place, id, score::BIGINT AS score FROM rk WHERE place < 30)"""


def _enc(c: str) -> str:
    out = f"url_encode({c})"
    for code, char in (("%2A", "*"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def _xml(c: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        c = f"replace({c}, '{char}', '{name}')"
    return c


def _uri(c: str) -> str:
    return f"'{BASE}node:' || {_enc(c)}"


_STMT = f"'{BASE}stmt:' || {_enc('source || chr(124) || type || chr(124) || target')}"
_TRIPLES = f"""SELECT {_uri('id')} AS s, '{RDF}type' AS p, '{BASE}' || type AS o, false AS literal FROM n UNION ALL SELECT {_uri('id')}, '{RDFS}label', title, true FROM n
UNION ALL SELECT {_uri('id')}, '{BASE}content', content, true FROM n WHERE content <> '' UNION ALL SELECT {_uri('id')}, '{BASE}latexLabel', label, true FROM n WHERE label <> ''
UNION ALL SELECT {_uri('source')}, '{BASE}' || type, {_uri('target')}, false FROM e
UNION ALL SELECT {_STMT}, '{RDF}type', '{RDF}Statement', false FROM e WHERE evidence <> '' UNION ALL SELECT {_STMT}, '{RDF}subject', {_uri('source')}, false FROM e WHERE evidence <> ''
UNION ALL SELECT {_STMT}, '{RDF}predicate', '{BASE}' || type, false FROM e WHERE evidence <> '' UNION ALL SELECT {_STMT}, '{RDF}object', {_uri('target')}, false FROM e WHERE evidence <> ''
UNION ALL SELECT {_STMT}, '{BASE}evidence', evidence, true FROM e WHERE evidence <> ''"""
# Signs of mathematics, as in normalize.py.
_MATH = r"regexp_matches(text, '\\begin\{(equation|align|aligned|gather|multline)\}') OR regexp_matches(text, '(?s)\$\$.*\$\$') OR regexp_matches(text, '(?s)\\\[.*\\\]') OR regexp_matches(text, '\\(frac|sum|int|prod|mathbb|mathbf|mathrm|left|right|cdot|leq|geq|neq|infty)\b') OR (regexp_matches(text, '[=<>]') AND regexp_matches(text, '[a-zA-Z\\]')) OR (regexp_matches(text, '[0-9]') AND regexp_matches(text, '[_^]'))"

ORACLES = {
    "node_upsert": f"WITH {_INC} {_UPSERT}, min(major) AS major FROM inc GROUP BY id",
    "node_upsert_null_overwrites": f"WITH {_INC} SELECT id, content FROM (SELECT id, content, row_number() OVER (PARTITION BY id ORDER BY major DESC) AS r FROM inc) WHERE r = 1",
    "edge_upsert": f"WITH {_INC} SELECT type, id AS source, target, arg_max(content, major) FILTER (WHERE content IS NOT NULL) AS evidence, CASE WHEN major % 2 = 0 THEN chunk ELSE '' END AS chunk, {_KS}, min(major) AS major FROM inc GROUP BY type, id, target, CASE WHEN major % 2 = 0 THEN chunk ELSE '' END",
    "edge_dedupe": f"WITH {_INC}, r AS (SELECT type, id AS source, target, content AS evidence, CASE WHEN major % 2 = 0 THEN chunk ELSE '' END AS chunk, major FROM inc), x AS (SELECT *, row_number() OVER (PARTITION BY type, source, target, chunk ORDER BY major DESC) AS k, min(major) OVER (PARTITION BY type, source, target, chunk) AS first FROM r) SELECT type, source, target, evidence, chunk, first AS major FROM x WHERE k = 1",
    "incremental_equals_batch": f"WITH {_INC} {_UPSERT} FROM inc GROUP BY id",
    "stream_upsert": f"WITH {_INC} {_UPSERT}, min(major) AS major FROM inc GROUP BY id",
    "node_patch": f"""WITH {_G}, p AS (SELECT 'cus:' || (o_custkey % 2000) AS id, arg_max('title ' || o_orderkey, o_orderkey) AS title, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
SELECT n.id, coalesce(p.title, n.title) AS title, CASE WHEN k % 2 = 0 THEN 'text ' || k ELSE n.content END AS content, status, chunk FROM n LEFT JOIN p ON p.id = n.id""",
    "degree_any_strong": f"WITH {_G}, {_DEG} SELECT id, degree, strong FROM deg",
    "template_formula": f"WITH {_G} SELECT id, {_T} AS template, {_I} AS indexed FROM n WHERE type = 'Formula'",
    "prune_graph": f"WITH {_PRUNE} {_PART.format(n='kn', e='ke')}",
    "prune_stats": f"WITH {_PRUNE} SELECT (SELECT count(*) FROM noise) AS dropped_nodes, (SELECT count(*) FROM e) - (SELECT count(*) FROM ke) AS dropped_edges",
    "view_no_examples": _view("'Example'", True),
    "view_no_exercises": _view("'Exercise'", True),
    "view_no_isolated": _view("''", False),
    "view_bare": _view("'Example', 'Exercise'", False),
    "view_elements": f"WITH {_G}, i AS (SELECT *, row_number() OVER (ORDER BY major) - 1 AS k FROM e) SELECT 'node' AS kind, id, type || ': ' || title AS label, type, title, coalesce(content, '') AS content, NULL AS source, NULL AS target, NULL AS evidence, chunk AS \"chunkId\" FROM n UNION ALL SELECT 'edge', source || '-' || type || '-' || target || '-' || k, type, type, NULL, NULL, source, target, coalesce(evidence, ''), NULL FROM i",
    "components": "WITH p AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS a, 'o' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS b FROM orders) SELECT DISTINCT a AS id, a AS component FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT id, min(id) OVER (PARTITION BY g) FROM (SELECT k, 'p' || lpad(CAST(k AS VARCHAR), 12, '0') AS id, k // 50 AS g FROM (SELECT p_partkey AS k FROM part UNION SELECT p_partkey + 1 FROM part WHERE p_partkey % 50 <> 49))",
    "components_in_batches": "WITH p AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS a, 'o' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS b FROM orders) SELECT DISTINCT a AS id, a AS component FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT id, min(id) OVER (PARTITION BY g) FROM (SELECT k, 'p' || lpad(CAST(k AS VARCHAR), 12, '0') AS id, k // 50 AS g FROM (SELECT p_partkey AS k FROM part UNION SELECT p_partkey + 1 FROM part WHERE p_partkey % 50 <> 49))",
    "freeze_alias": f"WITH RECURSIVE {_PAIRS} SELECT id, canonical FROM alias",
    "freeze_nodes": f"""WITH RECURSIVE {_PAIRS}, r AS (SELECT coalesce(a.canonical, n.id) AS id, type, title, content, label, major FROM n LEFT JOIN alias a ON a.id = n.id)
SELECT id, arg_max(type, major) AS type, arg_max(title, length(title) * 1000000000000 - major) AS title, arg_max(content, length(content) * 1000000000000 - major) FILTER (WHERE content IS NOT NULL) AS content, arg_max(label, major) FILTER (WHERE label IS NOT NULL) AS label, min(major) AS major FROM r GROUP BY id""",
    "freeze_edges": f"WITH RECURSIVE {_PAIRS} SELECT DISTINCT type, source, target, coalesce(chunk, '') AS chunk FROM re WHERE source <> target",
    "alias_apply": f"WITH RECURSIVE {_PAIRS} SELECT 'node' AS part, coalesce(a.canonical, CASE WHEN label IS NULL THEN n.id ELSE 'tex:' || label END) AS id, major FROM n LEFT JOIN alias a ON a.id = CASE WHEN label IS NULL THEN n.id ELSE 'tex:' || label END UNION ALL SELECT 'edge', source || ' ' || type || ' ' || target, major FROM re WHERE source <> target",
    "llm_normalize": "SELECT 'node' AS part, event_id AS chunk, CASE event_id % 5 WHEN 1 THEN 'a' ELSE 'n' END || event_id AS id, CASE event_id % 5 WHEN 1 THEN 'Lemma' ELSE 'Odd' END AS type, CASE event_id % 5 WHEN 4 THEN 'c' END AS content, CASE event_id % 5 WHEN 4 THEN 'l' || event_id END AS extra FROM events WHERE event_id % 5 IN (1, 4) UNION ALL SELECT 'edge', event_id, 'a b' || event_id, 'Uses', 'e', NULL FROM events WHERE event_id % 5 = 2",
    "looks_like_math": f"WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS place, text FROM documents UNION ALL SELECT path || ' ' || o1 || ' ' || o2 || ' ' || o3, line FROM ({LINES}) l) SELECT place, coalesce({_MATH}, false) AS math, coalesce(contains(text, '...') OR contains(text, '…') OR contains(text, '略'), false) AS ellipsis FROM t",
    "quality_filter": f"""WITH {_G}, f AS (SELECT *, {_MATH.replace('text', 'content')} AS math FROM n WHERE type = 'Formula') SELECT id, 'suspicious' AS reason FROM f WHERE (NOT math AND label IS NULL) OR (label IS NULL AND content = 'g_' || chr(123) || '1' || chr(125) || '(' || repeat('s', 150))
UNION ALL SELECT 'triv:' || p_partkey, 'trivial' FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'told:' || p_partkey, 'suspicious' FROM part WHERE p_partkey % 10 = 1""",
    "dangling_edges": f"WITH {_G} SELECT type, source, target FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)",
    "complete_by_label": "SELECT s_suppkey AS k, chr(92) || 'label{q' || s_suppkey || '} a = ' || s_suppkey AS q, chr(92) || 'label{r' || s_suppkey || '} l' AS r, 'x ' || chr(92) || 'begin{align*}' || chr(92) || 'label{q' || s_suppkey || '} a = ' || s_suppkey || chr(92) || 'end{align*} y ' || chr(92) || 'begin{lemma}' || chr(92) || 'label{r' || s_suppkey || '} l ' || chr(92) || 'end{lemma} ' || chr(92) || 'label{z} tail' AS z, NULL::VARCHAR AS missing FROM supplier",
    "recover_prefix_suffix": r"""WITH d AS (SELECT doc_id, text, CASE WHEN contains(text[11:30] || text[61:75], '…') THEN NULL ELSE string_split(text[11:30] || '...' || text[61:75], '...') END AS p FROM documents),
x AS (SELECT doc_id, text, regexp_replace(p[1], '^\s+|\s+$', '', 'g') AS h, regexp_replace(p[len(p)], '^\s+|\s+$', '', 'g') AS t FROM d), y AS (SELECT *, strpos(text, h) AS a FROM x), z AS (SELECT *, strpos(text[a + length(h):], t) AS b FROM y)
SELECT doc_id, CASE WHEN length(h) >= 10 AND length(t) >= 10 AND a > 0 AND b > 0 THEN regexp_replace(text[a:a + length(h) + b + length(t) - 2], '^\s+|\s+$', '', 'g') END AS found FROM z""",
    "recover_prefix_suffix_all": r"""WITH d AS (SELECT doc_id, text, CASE WHEN contains(text[11:30] || text[61:75], '…') THEN NULL ELSE string_split(text[11:30] || '...' || text[61:75], '...') END AS p FROM documents),
x AS (SELECT doc_id, text, regexp_replace(p[1], '^\s+|\s+$', '', 'g') AS h, regexp_replace(p[len(p)], '^\s+|\s+$', '', 'g') AS t FROM d), y AS (SELECT *, strpos(text, h) AS a FROM x), z AS (SELECT *, strpos(text[a + length(h):], t) AS b FROM y)
SELECT doc_id, CASE WHEN length(h) >= 10 AND length(t) >= 10 AND a > 0 AND b > 0 THEN regexp_replace(text[a:a + length(h) + b + length(t) - 2], '^\s+|\s+$', '', 'g') END AS found FROM z""",
    "title_repair": "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 1 THEN 'by q' || p_partkey WHEN 2 THEN '关于群 (q' || p_partkey || ') 的结论' ELSE 'Formula (q' || p_partkey || ')' END AS title FROM part",
    "query_words": f"WITH {_ASKED}, {_WORDS} SELECT q.chunk_seq, 'sup' || (q.k + 1) || ',reg' || (q.k % 5) AS labels, (SELECT string_agg(w, ',' ORDER BY r) FROM w3 WHERE w3.chunk_seq = q.chunk_seq AND r <= 41) AS words, 'world / ' || q.k AS hint FROM q",
    "relevance_topk": f"WITH {_SCORES} SELECT chunk_seq, place, id, score FROM shown",
    "summary_edges": f"WITH {_SCORES}, t AS (SELECT DISTINCT chunk_seq, type, source, target, e.major FROM e JOIN shown ON shown.id = source OR shown.id = target), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_seq ORDER BY major) - 1 AS place FROM t) SELECT chunk_seq, place, type, source, target FROM r WHERE place < 20",
    "concept_registry": f"WITH {_G}, c AS (SELECT *, row_number() OVER (ORDER BY major) - 1 AS place, count(*) OVER () AS total FROM n WHERE type IN ('Definition', 'Notation', 'Construction')) SELECT total, place, '- ' || id || ' | ' || type || ' | ' || title || coalesce(' label=' || label, '') AS line FROM c WHERE place < 220",
    "align_label_rule": f"WITH {_G} SELECT id AS alias, 'tex:' || label AS canonical FROM n WHERE type IN ('Definition', 'Notation', 'Construction') AND label <> ''",
    "align_cards": f"WITH {_G} SELECT (row_number() OVER (ORDER BY major) - 1) // 20 AS batch, id, title, replace(path, '/', ' / ') AS section, coalesce(content, '') AS evidence FROM n WHERE type IN ('Definition', 'Notation', 'Construction') AND label IS NULL AND id NOT LIKE 'tex:%'",
    "align_accept": "SELECT DISTINCT o_custkey // 80 AS batch, 'c' || o_custkey AS alias, 'c' || (o_custkey + o_orderkey % 5) AS canonical FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 100) / 100.0 >= 0.88 AND (o_custkey + o_orderkey % 5) // 80 = o_custkey // 80 AND o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey + o_orderkey % 5 IN (SELECT c_custkey FROM customer)",
    "uri_encode": f"WITH d AS (SELECT doc_id, text AS t FROM documents), x AS (SELECT doc_id, t, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS s FROM d) SELECT doc_id, {_enc('t')} AS encoded, CASE WHEN t IS NOT NULL THEN true END AS same, md5({_xml('t')}) AS xml, md5(CASE WHEN s = '' OR (s LIKE '$$%$$' AND length(s) >= 4) THEN s ELSE '$$' || chr(10) || s || chr(10) || '$$' END) AS shown FROM x",
    "uri_encode_whole": f"WITH d AS (SELECT doc_id, text AS t FROM documents), x AS (SELECT doc_id, t, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS s FROM d) SELECT doc_id, md5({_enc('t')}) AS encoded, CASE WHEN t IS NOT NULL THEN true END AS same, md5({_xml('t')}) AS xml, md5(CASE WHEN s = '' OR (s LIKE '$$%$$' AND length(s) >= 4) THEN s ELSE '$$' || chr(10) || s || chr(10) || '$$' END) AS shown FROM x",
    "export_json_rows": f"WITH {_G} SELECT 'node' AS part, major, id, type, title, content, label, NULL AS target, NULL AS evidence, chunk FROM n UNION ALL SELECT 'edge', major, NULL, type, NULL, NULL, NULL, target, evidence, chunk FROM e",
    "export_triples": f"WITH {_G} {_TRIPLES}",
    "export_owl_rows": f"""WITH {_G} SELECT CAST(0 AS BIGINT) AS part, '  <owl:Class rdf:about="{BASE}' || type || '"/>' AS xml FROM n GROUP BY type UNION ALL SELECT 1, '  <owl:ObjectProperty rdf:about="{BASE}' || type || '"/>' FROM e GROUP BY type
UNION ALL SELECT 2, '  <owl:NamedIndividual rdf:about="' || {_uri('id')} || '">' || chr(10) || '    <rdf:type rdf:resource="{BASE}' || type || '"/>' || chr(10) || '    <rdfs:label>' || {_xml('title')} || '</rdfs:label>' || CASE WHEN content <> '' THEN chr(10) || '    <latexkg:content>' || {_xml('content')} || '</latexkg:content>' ELSE '' END || chr(10) || '  </owl:NamedIndividual>' FROM n
UNION ALL SELECT 3, '  <rdf:Description rdf:about="' || {_uri('source')} || '">' || chr(10) || '    <latexkg:' || type || ' rdf:resource="' || {_uri('target')} || '"/>' || chr(10) || '  </rdf:Description>' FROM e""",
    "import_json": f"WITH {_G} SELECT 'node' AS part, id, type, CASE WHEN major % 3 = 0 THEN 'again ' ELSE '' END || title AS title, label, chunk FROM n UNION ALL SELECT 'edge', source, type, target, evidence, chunk FROM e",
    "import_triples": f"WITH {_G}, x AS (SELECT DISTINCT source AS id FROM e WHERE source NOT IN (SELECT id FROM n)) SELECT 'node' AS part, id, type, title, nullif(content, '') AS content, label FROM n UNION ALL SELECT 'node', id, 'Conclusion', id, NULL, NULL FROM x UNION ALL SELECT 'edge', source, type, target, NULL, NULL FROM e",
    "turtle_roundtrip": f"WITH {_G}, x AS (SELECT DISTINCT source AS id FROM e WHERE source NOT IN (SELECT id FROM n)) SELECT 'node' AS part, id, type, title, nullif(content, '') AS content, label FROM n UNION ALL SELECT 'node', id, 'Conclusion', id, NULL, NULL FROM x UNION ALL SELECT 'edge', source, type, target, NULL, NULL FROM e",
    "snapshot_list": "SELECT id, nodes, edges, note FROM (SELECT 's' || event_id AS id, ts, event_id AS nodes, user_id AS edges, event_type AS note FROM events WHERE event_id % 50 <> 0 AND event_id % 7 <> 0 ORDER BY ts DESC, 's' || event_id DESC LIMIT 20)",
    "snapshot_roundtrip": _view("'Example'", True),
    "snapshot_keep_latest": "WITH m AS (SELECT 's' || event_id AS id, ts FROM events WHERE event_id % 50 <> 0 AND event_id % 7 <> 0) SELECT id FROM m WHERE id <> (SELECT id FROM m ORDER BY ts DESC, id DESC LIMIT 1)",
    "zip_scan": """WITH p AS (SELECT page_id, html, row_number() OVER (ORDER BY page_id) - 1 AS k FROM pages WHERE page_id % 10 <> 0)
SELECT 'file' AS part, 'p' || page_id || '/main.TEX' AS path, md5(html) AS digest, 2 * k AS file_seq FROM p
UNION ALL SELECT 'file', 'main.tex', md5('p' || CASE WHEN page_id % 3 = 0 THEN chr(65533) ELSE chr(233) END || ' ' || page_id), 2 * k + 1 FROM p
UNION ALL SELECT 'asset', 'p' || page_id || '/fig.Png', 'png ' || md5('\\x89PNG'::BLOB), -1 FROM p
UNION ALL SELECT 'asset', 'shared.png', 'png ' || md5(CAST(max(page_id) AS VARCHAR)), -1 FROM p HAVING count(*) > 0
UNION ALL SELECT 'warning', 'ignored, not a zip archive: a' || page_id || '.rar', NULL, -1 FROM pages WHERE page_id % 10 = 0
UNION ALL SELECT 'warning', 'read with replacements, not utf-8: main.tex of a' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.zip', NULL, -1 FROM p WHERE page_id % 3 = 0""",
    "llm_stub_pipeline": """SELECT 'node' AS part, 'tex:sup' || s_suppkey AS id, 'Definition' AS type, s_name AS title FROM supplier UNION ALL SELECT 'node', 'thm' || s_suppkey, 'Theorem', 'On ' || s_name FROM supplier
UNION ALL SELECT 'edge', 'thm' || s_suppkey, 'Uses', 'tex:sup' || s_suppkey FROM supplier UNION ALL SELECT 'edge', 'thm' || s_suppkey, 'Uses', 'tex:sup' || (s_suppkey - 1) FROM supplier WHERE s_suppkey - 1 IN (SELECT s_suppkey FROM supplier)""",
    "repair_restore": f"WITH {_G} SELECT 'repaired' AS part, id, CASE WHEN trim(coalesce(content, '')) <> '' AND NOT contains(content, 'BUILDING') THEN upper(content) ELSE content END AS content, CASE WHEN trim(coalesce(content, '')) <> '' AND NOT contains(content, 'BUILDING') THEN 'true' END AS fixed FROM n UNION ALL SELECT 'restored', id, content, CASE WHEN trim(coalesce(content, '')) <> '' AND NOT contains(content, 'BUILDING') THEN 'false' END FROM n",
}
