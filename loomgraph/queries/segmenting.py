"""Queries on segmentation and extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HEADINGS
from ..operators import extract as ex
from ..operators import segment as sg
from ..storage import dealt, stored
from .corpora import LINES, files, sql

BS = "\\"
#: Files and their lines without comments, for the other SQL to go on from.
_FILES = f"lines AS ({LINES}), files AS (SELECT path, string_agg(line, chr(10) ORDER BY o1, o2, o3) AS content FROM lines GROUP BY path)"
_STRIP = r"regexp_replace({}, '(?s)^((?:[^\\%]|\\.)*)%.*$', '\1')"
_LINES = f"{_FILES}, split AS (SELECT path, string_split(content, chr(10)) AS parts FROM files), raw AS (SELECT path, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM split), clean AS (SELECT path, pos, {_STRIP.format('line')} AS line FROM raw)"
# Heading commands, as in segment.py.
_HEAD = r"'^\\(chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{(.+?)\}\s*$'"
_LEVEL = "CASE regexp_extract(line, " + _HEAD + ", 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in HEADINGS.items()) + " END"
_HEADS = f"{_LINES}, heads AS (SELECT path, pos, line, {_LEVEL} AS level, CASE WHEN regexp_matches(line, {_HEAD}) THEN trim(regexp_replace(regexp_extract(line, {_HEAD}, 2), '\\s+', ' ', 'g')) END AS heading FROM clean)"
_LASTS = ", ".join(f"last_value(CASE WHEN level = {n} THEN pos END IGNORE NULLS) OVER w AS p{n}, last_value(CASE WHEN level = {n} THEN heading END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 6))
_OPEN = ", ".join(f"CASE WHEN p{n} > greatest(-1, {', '.join(['-1', *[f'coalesce(p{k}, -1)' for k in range(1, n)]])}) THEN t{n} END AS h{n}" for n in range(1, 6))
_STACK = f"{_HEADS}, lasts AS (SELECT *, {_LASTS} FROM heads WINDOW w AS (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)), stack AS (SELECT path, pos, line, {_OPEN} FROM lasts)"


def _chunks_sql(level: int) -> str:
    """CTEs up to chunks: id, file, title, path_text, text, n (its number)."""
    chosen = "CASE " + " ".join(f"WHEN h{n} IS NOT NULL THEN {n}" for n in range(level, 0, -1)) + " ELSE 0 END" if level else "0"
    title = "coalesce(" + ", ".join([*[f"h{n}" for n in range(level, 0, -1)], "path"]) + ")"
    path = "path || " + " || ".join(f"CASE WHEN lv >= {n} AND h{n} IS NOT NULL THEN ' / ' || h{n} ELSE '' END" for n in range(1, 6))
    return f"""{_STACK}, chosen AS (SELECT *, {chosen} AS lv, {title} AS title FROM stack), keyed AS (SELECT path, pos, line, lv, title, {path} AS path_text FROM chosen),
marks AS (SELECT *, CASE WHEN lag(path_text) OVER (PARTITION BY path ORDER BY pos) = path_text AND lag(lv) OVER (PARTITION BY path ORDER BY pos) = lv THEN 0 ELSE 1 END AS starts FROM keyed),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM marks),
texts AS (SELECT path AS file, run, min(title) AS title, min(path_text) AS path_text, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS text FROM runs GROUP BY path, run),
chunks AS (SELECT 'chunk:' || file || ':' || (row_number() OVER (ORDER BY file, run) - 1) AS id, file, title, path_text, text, row_number() OVER (ORDER BY file, run) - 1 AS n FROM texts WHERE text <> '')"""


def chunks_of(spark: SparkSession, sf_dir: str, granularity: str = "section") -> DataFrame:
    return sg.chunk_files(files(spark, sf_dir), granularity)


def strip_comments_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(sql(spark, sf_dir, "SELECT doc_id, text FROM documents"))
    lines = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), sg.strip_comment)).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("digest"), F.length("line").cast("long").alias("n"))


def strip_comments_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.md5(sg.strip_comments(F.col("content"))).alias("digest"), F.length(sg.strip_comments(F.col("content"))).cast("long").alias("n"))


def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.with_heading(sg.lines_of(files(spark, sf_dir))).filter("level is not null").select("path", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "heading")


def heading_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.with_stack(sg.with_heading(sg.lines_of(files(spark, sf_dir)))).select("path", F.col("pos").cast("long").alias("pos"), "h1", "h2", "h3", "h4", "h5")


def _chunk_query(granularity: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = chunks_of(spark, sf_dir, granularity)
        return c.select("id", "file", "title", F.array_join("section_path", " / ").alias("path_text"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))

    return query


def chunk_section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks as chunk_section from lines in blocks, as files that no task holds are read; no file is put together."""
    lines = sql(spark, sf_dir, LINES).select("path", "o1", "o2", "o3", F.posexplode(F.split("line", "\n", -1)).alias("k", "line"))
    pos = ((F.col("o1") * 4 + F.col("o2")) * 10_000_000_000 + F.col("o3") + 1) * 100 + F.col("k")
    placed = lines.select("path", F.lit(0).cast("long").alias("file_seq"), pos.cast("long").alias("pos"), sg.strip_comment(F.col("line")).alias("line"))
    c = sg.chunk_lines(placed.withColumn("block", F.floor(F.col("pos") / 20_000)))
    return c.select("id", "file", "title", F.array_join("section_path", " / ").alias("path_text"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = sql(spark, sf_dir, "SELECT lower(c_mktsegment) || '/' || (c_custkey % 97) || '.tex' AS path, '' AS content, c_custkey AS file_seq FROM customer")
    return sg.order_files(paths).select("path", "file_seq", F.col("rank").cast("long").alias("rank"))


def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.preview_titles(chunks_of(spark, sf_dir)).select("total", F.col("place").cast("long").alias("place"), "title")


def token_count_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(sql(spark, sf_dir, "SELECT doc_id, text FROM documents")).select("doc_id", F.size(sg.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def token_windows_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sql(spark, sf_dir, "SELECT 'd' || doc_id AS id, '' AS file, '' AS title, array('') AS section_path, text, doc_id * 65536 AS chunk_seq FROM documents")
    return sg.split_windows(docs, 200).select("id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def parsed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.parsed(chunks_of(spark, sf_dir))


def env_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parsed_corpus(spark, sf_dir).select(F.col("id").alias("chunk"), F.posexplode("envs").alias("place", "e"))
    return e.select("chunk", F.col("place").cast("long").alias("place"), "e.id", "e.type", "e.title", "e.label", F.md5("e.content").alias("digest"))


def env_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parsed_corpus(spark, sf_dir).select(F.array_join("section_path", " / ").alias("section"), F.explode("envs").alias("e"))
    return e.groupBy("section", F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def formula_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks_of(spark, sf_dir).select(F.col("id").alias("chunk"), F.posexplode(ex.formulas(F.col("text"))).alias("place", "f"))
    return c.select("chunk", F.col("place").cast("long").alias("place"), F.col("f.body").alias("body"), F.col("f.label").alias("label"), F.col("f.start").cast("long").alias("start"), F.col("f.inside").alias("inside"))


def formula_outside_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = parsed_corpus(spark, sf_dir).select(F.col("id").alias("chunk"), F.posexplode("maths").alias("place", "f"))
    return f.select("chunk", F.col("place").cast("long").alias("place"), "f.id", "f.title", "f.content")


def ref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select(F.col("id").alias("chunk"), F.posexplode(ex.references(F.col("text"))).alias("place", "label")).select("chunk", F.col("place").cast("long").alias("place"), "label")


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ex.label_index(ex.raw_nodes(parsed_corpus(spark, sf_dir)))
    return found.select("label", "id", F.shiftright("first_seq", 16).alias("first_chunk"))


def example_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ex.raw_nodes(parsed_corpus(spark, sf_dir)).filter(F.col("type").isin("Example", "Exercise"))
    return n.select("id", *[F.col("meta")[k].alias(k) for k in ("problem", "solution", "answer")])


def nearest_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.binding_edges(parsed_corpus(spark, sf_dir)).select("type", "source", "target")


def section_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ex.raw_nodes(parsed_corpus(spark, sf_dir)).filter("id like 'sec:%'")
    return n.select("id", "type", "title", "content")


def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.contains_edges(parsed_corpus(spark, sf_dir)).select("source", "target", F.col("meta")["chunkId"].alias("chunk"))


def _with_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = stored(parsed_corpus(spark, sf_dir), "parsed")
    return p, ex.label_index(ex.raw_nodes(p))


def dependson_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.reference_edges(*_with_labels(spark, sf_dir)).select("source", "target", "evidence", F.col("meta")["chunkId"].alias("chunk"))


def dependson_edges_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ex.reference_edges(*_with_labels(spark, sf_dir), label_scope="global")
    return e.groupBy(F.col("meta")["chunkId"].alias("chunk"), "target").agg(F.count(F.lit(1)).alias("n"))


def derivedfrom_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.derivation_edges(*_with_labels(spark, sf_dir)).select("source", "target", "evidence", F.col("meta")["chunkId"].alias("chunk"))


def full_heuristic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of nodes and edges by type of the whole extraction: the flagship."""
    made = ex.extract(stored(chunks_of(spark, sf_dir), "chunks"))
    nodes = made.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("part"), "type", "n")
    return nodes.unionByName(made.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("part"), "type", "n"))


# Fixed values, as in extract.py.
_ENVS = ("theorem", "lemma", "corollary", "definition", "example", "exercise", "axiom", "proposition", "conclusion")
_ALT = "|".join(rf"\\begin\{{{e}\}}.*?\\end\{{{e}\}}" for e in _ENVS)
# Fixed values, as in extract.py.
_LAB = r"'\\label\{([^}]+)\}'"
_ENV = f"""{_chunks_sql(2)}, blocks AS (SELECT id AS chunk, n, regexp_extract_all(text, '(?is){_ALT}') AS b FROM chunks),
each AS (SELECT chunk, n, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS place FROM blocks),
envs AS (SELECT chunk, n, place, block, lower(regexp_extract(block, '(?is)^\\\\begin\\{{([a-z]+)\\}}', 1)) AS env, regexp_replace(regexp_replace(regexp_replace(block, '(?is)^\\\\begin\\{{[a-z]+\\}}', ''), '(?is)\\\\end\\{{[a-z]+\\}}$', ''), '^\\s+|\\s+$', '', 'g') AS body FROM each),
named AS (SELECT *, nullif(regexp_extract(body, {_LAB}, 1), '') AS label, upper(env[1]) || env[2:] AS type,
    nullif(regexp_extract(block, '\\\\begin\\{{[a-zA-Z*]+\\}}\\s*\\[([^\\]]+)\\]', 1), '') AS own FROM envs),
env_nodes AS (SELECT chunk, n, place, CASE WHEN label IS NULL THEN chunk || ':' || env || ':' || place ELSE 'tex:' || label END AS id, type, coalesce(own, type || ' ' || (place + 1)) AS title, label, body, env FROM named)"""
# Displayed mathematics, as in extract.py.
_FORMS = (r"\\begin\{equation\}(.*?)\\end\{equation\}", r"\\begin\{align\}(.*?)\\end\{align\}", r"\$\$(.*?)\$\$", r"\\\[(.*?)\\\]")


def _spans_sql(name: str, pattern: str) -> str:
    """CTEs name_s: chunk, n, place, m, start of each match, by the pieces between."""
    return f"""{name}_a AS (SELECT id AS chunk, n, regexp_extract_all(text, '(?is)(?:.*?)(?:{pattern})') AS p FROM chunks), {name}_b AS (SELECT chunk, n, unnest(p) AS piece, generate_subscripts(p, 1) AS place FROM {name}_a),
{name}_c AS (SELECT *, sum(length(piece)) OVER (PARTITION BY chunk ORDER BY place) AS stop, regexp_extract(piece, '(?is)^.*?({pattern})$', 1) AS m FROM {name}_b),
{name}_s AS (SELECT chunk, n, place, m, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM {name}_c)"""


_WORKED = _spans_sql("w", r"\\begin\{example\}.*?\\end\{example\}|\\begin\{exercise\}.*?\\end\{exercise\}")
_FORM = (
    f"{_ENV}, {_WORKED}, "
    + ", ".join(_spans_sql(f"f{i}", p.replace("(.*?)", ".*?")) for i, p in enumerate(_FORMS))
    + ", every AS ("
    + " UNION ALL ".join(f"SELECT chunk, n, {i} AS kind, place, start, trim(regexp_extract(m, '(?is)^{p}$', 1)) AS body FROM f{i}_s" for i, p in enumerate(_FORMS))
    + f"""), forms AS (SELECT chunk, n, row_number() OVER (PARTITION BY chunk ORDER BY kind, place) - 1 AS place, body, nullif(regexp_extract(body, {_LAB}, 1), '') AS label, start,
    EXISTS (SELECT 1 FROM w_s WHERE w_s.chunk = every.chunk AND every.start >= w_s.start AND every.start <= w_s.stop) AS inside FROM every WHERE body <> ''),
kept AS (SELECT *, CASE WHEN label IS NULL THEN row_number() OVER (PARTITION BY chunk, label IS NULL ORDER BY place) - 1 END AS k FROM forms WHERE label IS NOT NULL OR NOT inside),
form_nodes AS (SELECT chunk, n, row_number() OVER (PARTITION BY chunk ORDER BY place) - 1 AS place, CASE WHEN label IS NULL THEN chunk || ':formula:' || k ELSE 'tex:' || label END AS id,
    CASE WHEN label IS NULL THEN 'Formula ' || (k + 1) ELSE 'Formula (' || label || ')' END AS title, body, label FROM kept)"""
)
# Fixed values, as in extract.py.
_REFS = r"""ref_a AS (SELECT id AS chunk, n, regexp_extract_all(text, '\\(eqref|ref|autoref|cref)\{([^}]+)\}', 2) AS r FROM chunks), ref_b AS (SELECT chunk, n, trim(unnest(r)) AS label, generate_subscripts(r, 1) AS i FROM ref_a),
refs AS (SELECT chunk, n, label, row_number() OVER (PARTITION BY chunk ORDER BY min(i)) - 1 AS place FROM ref_b GROUP BY chunk, n, label)"""
_ALL = f"""{_FORM}, {_REFS}, labels AS (SELECT label, 'tex:' || label AS id, min(n) AS first_chunk FROM (SELECT label, n FROM env_nodes UNION ALL SELECT label, n FROM form_nodes) WHERE label IS NOT NULL GROUP BY label),
members AS (SELECT e.chunk, e.n, e.id AS member, 'sec:' || c.path_text AS section FROM (SELECT chunk, n, id FROM env_nodes UNION ALL SELECT chunk, n, id FROM form_nodes) e JOIN chunks c ON c.id = e.chunk),
deps AS (SELECT m.member AS source, l.id AS target, 'reference: ' || r.label AS evidence, m.chunk FROM members m JOIN refs r ON r.chunk = m.chunk JOIN labels l ON l.label = r.label AND l.first_chunk <= r.n WHERE m.member <> l.id)"""
# Fixed values, as in extract.py.
_SAID = r"""said_a AS (SELECT id AS chunk, n, regexp_extract_all(text, '(?i)derived\s+from\s+\\ref\{[^}]+\}') AS s FROM chunks), said AS (SELECT chunk, n, unnest(s) AS evidence FROM said_a),
derived AS (SELECT m.member AS source, l.id AS target, s.evidence, m.chunk FROM members m JOIN said s ON s.chunk = m.chunk JOIN labels l ON l.label = regexp_extract(s.evidence, '\{([^}]+)\}', 1) AND l.first_chunk <= s.n WHERE m.member <> l.id)"""
_CORE = """bound AS (SELECT type AS kind, id AS source, last_value(CASE WHEN type NOT IN ('Example', 'Exercise') THEN id END IGNORE NULLS) OVER (PARTITION BY chunk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target, chunk FROM env_nodes)"""
_TAIL = "CASE WHEN contains(path_text, ' / ') THEN path_text[strpos(path_text, ' / ') + 3:] ELSE title END"

QUERIES = {
    f.__name__: f
    for f in (
        strip_comments_docs, strip_comments_corpus, heading_parse, heading_stack, chunk_section_lines, file_order, chunk_preview, token_count_docs, token_windows_docs, env_extract, env_type_counts, formula_extract,
        formula_outside_examples, ref_extract, label_index, example_split, nearest_core, section_nodes, contains_edges, dependson_edges, dependson_edges_global, derivedfrom_edges, full_heuristic_graph,
    )
}
QUERIES |= {f"chunk_{g}": _chunk_query(g) for g in ("file", "chapter", "section", "subsection")}

# Tokens and white space, as in segment.py.
_TOKEN = r"\\[a-zA-Z]+|[a-zA-Z0-9_]+|[\x{4e00}-\x{9fff}]|[^\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x0B]"
_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x0B]*"
ORACLES = {
    "strip_comments_docs": f"WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), raw AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM s), c AS (SELECT doc_id, pos, {_STRIP.format('line')} AS line FROM raw) SELECT doc_id, pos, md5(line) AS digest, length(line) AS n FROM c",
    "strip_comments_corpus": f"WITH {_LINES}, t AS (SELECT path, string_agg(line, chr(10) ORDER BY pos) AS t FROM clean GROUP BY path) SELECT path, md5(t) AS digest, length(t) AS n FROM t",
    "heading_parse": f"WITH {_HEADS} SELECT path, pos, CAST(level AS BIGINT) AS level, heading FROM heads WHERE level IS NOT NULL",
    "heading_stack": f"WITH {_STACK} SELECT path, pos, h1, h2, h3, h4, h5 FROM stack",
    "file_order": "SELECT path, file_seq, row_number() OVER (ORDER BY path, file_seq) - 1 AS rank FROM (SELECT lower(c_mktsegment) || '/' || (c_custkey % 97) || '.tex' AS path, c_custkey AS file_seq FROM customer)",
    "chunk_preview": f"WITH {_chunks_sql(2)}, t AS (SELECT {_TAIL} AS title, min(n) AS first_n FROM chunks GROUP BY 1) SELECT (SELECT count(*) FROM chunks) AS total, place, title FROM (SELECT title, row_number() OVER (ORDER BY first_n) - 1 AS place FROM t) WHERE place < 10",
    "token_count_docs": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}')) AS n_tokens FROM documents",
    "token_windows_docs": f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPACE}(?:{_TOKEN})') AS t FROM documents), w AS (SELECT doc_id, text, t, unnest(CASE WHEN len(t) > 200 THEN range(0, CAST(ceil((len(t) - 200) / 100.0) AS BIGINT) + 1) ELSE [-1] END) AS w FROM t),
c AS (SELECT 'd' || doc_id || CASE WHEN w < 0 THEN '' ELSE ':w' || w END AS id, CASE WHEN w < 0 THEN text ELSE regexp_replace(array_to_string(t[w * 100 + 1:w * 100 + 200], ''), '^{_SPACE}', '') END AS text FROM w) SELECT id, md5(text) AS digest, length(text) AS n FROM c""",
    "env_extract": f"WITH {_ENV} SELECT chunk, place, id, type, title, label, md5(body) AS digest FROM env_nodes",
    "env_type_counts": f"WITH {_ENV} SELECT c.path_text AS section, e.type, count(*) AS n FROM env_nodes e JOIN chunks c ON c.id = e.chunk GROUP BY c.path_text, e.type",
    "formula_extract": f"WITH {_FORM} SELECT chunk, place, body, label, start, inside FROM forms",
    "formula_outside_examples": f"WITH {_FORM} SELECT chunk, place, id, title, body AS content FROM form_nodes",
    "ref_extract": f"WITH {_chunks_sql(2)}, {_REFS} SELECT chunk, place, label FROM refs",
    "label_index": f"WITH {_ALL} SELECT label, id, first_chunk FROM labels",
    "example_split": f"""WITH {_ENV}, x AS (SELECT id, body, regexp_extract(body, '(?is)\\\\begin\\{{solution\\}}(.*?)\\\\end\\{{solution\\}}', 1) AS s, regexp_extract(body, '(?is)\\\\begin\\{{answer\\}}(.*?)\\\\end\\{{answer\\}}', 1) AS a, strpos(body, chr(10) || '解答：' || chr(10)) AS m FROM env_nodes WHERE type IN ('Example', 'Exercise'))
SELECT id, CASE WHEN s <> '' THEN trim(regexp_replace(body, '(?is)\\\\begin\\{{(solution|answer)\\}}.*?\\\\end\\{{(solution|answer)\\}}', '', 'g')) ELSE trim(body[1:m - 1]) END AS problem, CASE WHEN s <> '' THEN s ELSE trim(body[m:], chr(10) || ' ') END AS solution, a AS answer FROM x""",
    "nearest_core": f"WITH {_ENV}, {_CORE} SELECT CASE kind WHEN 'Exercise' THEN 'AppliesTo' ELSE 'AssistsIn' END AS type, source, target FROM bound WHERE kind IN ('Example', 'Exercise') AND target IS NOT NULL",
    "section_nodes": f"WITH {_chunks_sql(2)} SELECT 'sec:' || path_text AS id, 'Conclusion' AS type, {_TAIL} AS title, '' AS content FROM chunks",
    "contains_edges": f"WITH {_ALL} SELECT section AS source, member AS target, chunk FROM members",
    "dependson_edges": f"WITH {_ALL} SELECT source, target, evidence, chunk FROM deps",
    "dependson_edges_global": f"WITH {_ALL} SELECT m.chunk, l.id AS target, count(*) AS n FROM members m JOIN refs r ON r.chunk = m.chunk JOIN labels l ON l.label = r.label WHERE m.member <> l.id GROUP BY m.chunk, l.id",
    "derivedfrom_edges": f"WITH {_ALL}, {_SAID} SELECT source, target, evidence, chunk FROM derived",
    "full_heuristic_graph": f"""WITH {_ALL}, {_SAID}, {_CORE}, nodes AS (SELECT 'sec:' || path_text AS id, 'Conclusion' AS type, n, -1 AS o FROM chunks UNION ALL SELECT id, type, n, place FROM env_nodes UNION ALL SELECT id, 'Formula', n, 1000000 + place FROM form_nodes),
one AS (SELECT id, arg_max(type, n * 10000000 + o) AS type FROM nodes GROUP BY id), edges AS (SELECT DISTINCT type, source, target, chunk FROM (SELECT CASE kind WHEN 'Exercise' THEN 'AppliesTo' ELSE 'AssistsIn' END AS type, source, target, chunk FROM bound WHERE kind IN ('Example', 'Exercise') AND target IS NOT NULL
UNION ALL SELECT 'Contains', section, member, chunk FROM members UNION ALL SELECT 'DependsOn', source, target, chunk FROM deps UNION ALL SELECT 'DerivedFrom', source, target, chunk FROM derived))
SELECT 'node' AS part, type, count(*) AS n FROM one GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type""",
}
ORACLES |= {f"chunk_{g}": f"WITH {_chunks_sql(n)} SELECT id, file, title, path_text, md5(text) AS digest, length(text) AS n FROM chunks" for g, n in (("file", 0), ("chapter", 1), ("section", 2), ("subsection", 3))}
ORACLES["chunk_section_lines"] = ORACLES["chunk_section"]
