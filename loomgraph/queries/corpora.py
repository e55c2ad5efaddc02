"""Inputs made of the star schema, in SQL that Spark and DuckDB both run: LaTeX files and a graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, META, NODES, Graph, columns_like, seq, source_of
from ..storage import dealt_to

_B = "chr(92)"
#: (path, o1, o2, o3, line): lines of a file for each nation and block of keys, so that files stay small and
#: grow in number with the tables: a section for the nation, definitions and formulas for suppliers, examples
#: and exercises for customers.
LINES = f"""
SELECT path, o1, o2, o3, line FROM (
  WITH sup AS (SELECT s_nationkey AS k, CAST(floor(s_suppkey / 50) AS BIGINT) AS b, s_suppkey, s_name FROM supplier),
    cus AS (SELECT c_nationkey AS k, CAST(floor(c_custkey / 750) AS BIGINT) AS b, c_custkey FROM customer),
    fil AS (SELECT k, b, lower(r_name) || '/n' || k || '/' || lpad(CAST(b AS VARCHAR(20)), 9, '0') || '.tex' AS path, r_name, n_name
      FROM (SELECT k, b FROM sup UNION SELECT k, b FROM cus) blocks JOIN nation ON n_nationkey = k JOIN region ON n_regionkey = r_regionkey)
  SELECT path, 0 AS o1, 0 AS o2, CAST(0 AS BIGINT) AS o3, '% about ' || r_name AS line FROM fil
  UNION ALL SELECT path, 0, 0, 1, 'Preface, 100' || {_B} || '% sure % not shown' FROM fil
  UNION ALL SELECT path, 0, 0, 2, {_B} || 'chapter{{' || r_name || '}}' FROM fil
  UNION ALL SELECT path, 1, 0, 0, {_B} || 'section{{' || n_name || '}}  ' FROM fil
  UNION ALL SELECT path, 1, 0, 1, 'On ' || n_name || ', 5' || {_B} || '% of all % hidden' || {_B} || 'section{{x}}' FROM fil
  UNION ALL SELECT path, 1, 1, s_suppkey * 10, {_B} || 'begin{{definition}}[' || s_name || ']' || {_B} || 'label{{def:s' || s_suppkey || '}} A member. ' || {_B} || 'end{{definition}}' FROM sup JOIN fil ON sup.k = fil.k AND sup.b = fil.b
  UNION ALL SELECT path, 1, 1, s_suppkey * 10 - 1, {_B} || 'subsection*{{Part  ' || s_suppkey || '}}' FROM sup JOIN fil ON sup.k = fil.k AND sup.b = fil.b WHERE s_suppkey % 4 = 0
  UNION ALL SELECT path, 1, 1, s_suppkey * 10 + 1,
    CASE s_suppkey % 3 WHEN 0 THEN '$$x_{{' || s_suppkey || '}} = ' || s_suppkey || '$$' WHEN 1 THEN {_B} || 'begin{{equation}}' || {_B} || 'label{{eq:s' || s_suppkey || '}} y = ' || s_suppkey || {_B} || 'end{{equation}}'
    ELSE {_B} || '[ z < ' || s_suppkey || ' ' || {_B} || ']' END FROM sup JOIN fil ON sup.k = fil.k AND sup.b = fil.b
  UNION ALL SELECT path, 1, 2, c_custkey * 10,
    CASE WHEN c_custkey % 2 = 0
      THEN {_B} || 'begin{{example}} uses ' || {_B} || 'ref{{def:s' || (c_custkey % 150 + 1) || '}} $$a_' || c_custkey || '$$ ' || {_B} || 'begin{{solution}}Take ' || c_custkey || '.' || {_B} || 'end{{solution}} '
        || CASE WHEN c_custkey % 10 = 0 THEN {_B} || 'begin{{answer}}So ' || c_custkey || '.' || {_B} || 'end{{answer}} ' ELSE '' END || {_B} || 'end{{example}}'
      ELSE {_B} || 'begin{{exercise}}[Task ' || c_custkey || '] derived from ' || {_B} || 'ref{{def:s' || (c_custkey % 130 + 1) || '}}' || chr(10) || '解答：' || chr(10) || 'see ' || c_custkey || chr(10) || {_B} || 'end{{exercise}}' END FROM cus JOIN fil ON cus.k = fil.k AND cus.b = fil.b
)"""

#: Nodes of a graph: id, type, title, content, label, path (parts with /), chunk, major.
STAR_NODES = """
SELECT 'reg:' || r_regionkey AS id, 'Definition' AS type, r_name AS title, CAST(NULL AS VARCHAR(10)) AS content, CASE WHEN r_regionkey % 2 = 0 THEN 'reg' || r_regionkey END AS label,
    'world' AS path, 'chunk:w:' || r_regionkey AS chunk, CAST(r_regionkey AS BIGINT) AS major FROM region
UNION ALL SELECT 'nat:' || n_nationkey, 'Notation', n_name, 'nation of region ' || n_regionkey, CAST(NULL AS VARCHAR(10)), 'world/' || n_regionkey, 'chunk:w:' || n_regionkey, 100 + n_nationkey FROM nation
UNION ALL SELECT 'tex:sup' || s_suppkey, 'Theorem', s_name, 'holds for ' || s_suppkey, 'sup' || s_suppkey, 'world/' || s_nationkey, 'chunk:n:' || s_nationkey, 1000 + s_suppkey FROM supplier
UNION ALL SELECT 'cus:' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Example' ELSE 'Exercise' END, c_name, 'about "' || c_mktsegment || '" & <more>', CAST(NULL AS VARCHAR(10)), 'world/' || c_nationkey, 'chunk:n:' || c_nationkey, 1000000 + c_custkey FROM customer
UNION ALL SELECT 'par:' || p_partkey, 'Formula', 'F ' || p_size,
    CASE WHEN p_partkey % 16 = 12 THEN 'P' || chr(92) || 'left( X = x ' || chr(92) || 'right) = p' || chr(92) || 'left(x) ' || repeat('q', 120) ELSE CASE p_partkey % 8 WHEN 0 THEN 'f_X(x) dx and more of it' WHEN 1 THEN 'x_{12} = 3' WHEN 2 THEN chr(92) || 'Omega_5 ' || repeat('w ', 80) WHEN 3 THEN 'y = ' || repeat('z', 150) WHEN 4 THEN 'P(X = x) = p(x) ' || repeat('q', 120)
      WHEN 5 THEN '-' || chr(92) || 'infty < t < ' || chr(92) || 'infty ' || repeat('r', 120) WHEN 6 THEN 'g_{1}(' || repeat('s', 150) ELSE 'xf_X(x) ' || repeat('u', 150) END END,
    CASE WHEN p_partkey % 40 = 3 THEN 'par' || p_partkey END, 'world/parts', 'chunk:p:' || (p_partkey % 10), 10000000 + p_partkey FROM part
"""
#: Edges of the graph: type, source, target, evidence, chunk, major.
STAR_EDGES = """
SELECT 'Contains' AS type, 'reg:' || n_regionkey AS source, 'nat:' || n_nationkey AS target, CAST(NULL AS VARCHAR(10)) AS evidence, 'chunk:w:' || n_regionkey AS chunk, CAST(n_nationkey AS BIGINT) AS major FROM nation
UNION ALL SELECT 'EquivalentTo', 'nat:' || n_nationkey, 'nat:' || (n_nationkey + 5), 'same "thing"', CAST(NULL AS VARCHAR(10)), 100 + n_nationkey FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'EquivalentTo', 'nat:' || n_nationkey, 'reg:' || n_regionkey, CAST(NULL AS VARCHAR(10)), CAST(NULL AS VARCHAR(10)), 200 + n_nationkey FROM nation WHERE n_nationkey % 10 = 4
UNION ALL SELECT 'DependsOn', 'tex:sup' || s_suppkey, 'nat:' || s_nationkey, 'in ' || s_nationkey, 'chunk:n:' || s_nationkey, 1000 + s_suppkey FROM supplier
UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'AssistsIn' ELSE 'AppliesTo' END, 'cus:' || c_custkey, 'nat:' || c_nationkey, CAST(NULL AS VARCHAR(10)), 'chunk:n:' || c_nationkey, 1000000 + c_custkey FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'Uses', 'par:' || p_partkey, 'tex:sup' || (p_partkey % 90 + 1), CAST(NULL AS VARCHAR(10)), 'chunk:p:' || (p_partkey % 10), 10000000 + p_partkey FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'Contains', 'reg:' || (p_partkey % 5), 'par:' || p_partkey, CAST(NULL AS VARCHAR(10)), 'chunk:p:' || (p_partkey % 10), 20000000 + p_partkey FROM part
UNION ALL SELECT 'Proves', 'par:' || p_partkey, 'none:' || p_partkey, CAST(NULL AS VARCHAR(10)), 'chunk:p:' || (p_partkey % 10), 30000000 + p_partkey FROM part WHERE p_partkey % 50 = 7
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations", "pages")


def sql(spark: SparkSession, sf_dir: str, text: str, deal: tuple[str, ...] = ()) -> DataFrame:
    """``text`` over the tables of a folder, each named where it stands by its file; no view is registered. Tables of ``deal`` are dealt() before anything is made of their rows."""
    names = "|".join(TABLES)
    cores = {t: dealt_to(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in deal}

    def named(m: re.Match) -> str:
        rows = f"parquet.`{sf_dir}/{m[2]}.parquet`"
        n = cores.get(m[2])
        return f"{m[1]} {f'(SELECT /*+ REPARTITION({n}) */ * FROM {rows})' if n else rows} AS {m[2]}"

    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({names})\b", named, text))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LaTeX files; a file's lines are put together in their order."""
    lines = sql(spark, sf_dir, LINES)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o1", "o2", "o3", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("path").agg(text.alias("content")).withColumn("file_seq", F.lit(0).cast("long"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    large = ("customer", "supplier", "part")
    n = sql(spark, sf_dir, STAR_NODES, large)
    meta = F.when(F.col("chunk").isNotNull(), F.create_map(F.lit("chunkId"), F.col("chunk"))).cast(META)
    nodes = n.select("id", "type", "title", "content", source_of(F.lit(None), F.col("label"), F.split("path", "/")).alias("source"), meta.alias("meta"), seq("major").alias("seq"))
    edges = sql(spark, sf_dir, STAR_EDGES, large).select(F.lit(None).cast("string").alias("id"), "type", "source", "target", "evidence", meta.alias("meta"), seq("major").alias("seq"))
    return Graph(columns_like(nodes, NODES), columns_like(edges, EDGES))
