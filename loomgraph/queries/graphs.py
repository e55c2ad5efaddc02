"""Queries on graphs: upserts, components, pruning, views, retrieval, alignment, files, with their SQL."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display_math, uri_component, uri_decode, xml_escape
from ..model import Graph, ModelConfig, Selection, columns_like, EDGES, NODES, seq
from ..operators import align as al
from ..operators import graph as g
from ..operators import normalize as no
from ..operators import repair as rp
from ..operators import retrieve as rt
from ..plans import pipeline
from ..plans.snapshots import SnapshotStore, all_but_latest, newest
from ..sources import graph_files as gf
from ..sources import uploads
from ..storage import dealt, fresh_folder, stored
from ..streaming.ingest import GraphTable, upsert_stream
from .corpora import LINES, sql, star_graph


def _flat_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "type", "title", "content", F.col("source.latexLabel").alias("label"), F.array_join("source.sectionPath", "/").alias("path"), F.col("meta")["chunkId"].alias("chunk"), F.col("seq.major").alias("major"))


def _flat_edges(edges: DataFrame) -> DataFrame:
    return edges.select("type", "source", "target", "evidence", F.col("meta")["chunkId"].alias("chunk"), F.col("seq.major").alias("major"))


# ---- upserts ---------------------------------------------------------------------------------------

#: Events as increments to nodes: the user is the node, event ids are the order.
_INCREMENTS = "SELECT event_id AS major, 'u' || (user_id % 997) AS id, event_type AS type, 'T' || (event_id % 13) AS title, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS content, 'k' || (event_id % 4) AS k, 'v' || event_id AS v, 'u' || (user_id % 31) AS target, 'chunk' || (event_id % 5) AS chunk FROM events"


def _increments(spark: SparkSession, sf_dir: str) -> Graph:
    inc = sql(spark, sf_dir, _INCREMENTS)
    nodes = inc.select("id", "type", "title", "content", F.lit(None).alias("source"), F.create_map("k", "v").alias("meta"), seq("major").alias("seq"))
    edges = inc.select(F.lit(None).alias("id"), "type", F.col("id").alias("source"), "target", F.col("content").alias("evidence"), F.when(F.col("major") % 2 == 0, F.create_map(F.lit("chunkId"), "chunk", "k", "v")).otherwise(F.create_map("k", "v")).alias("meta"), seq("major").alias("seq"))
    return Graph(columns_like(nodes.withColumn("source", F.lit(None).cast(NODES["source"].dataType)), NODES), columns_like(edges, EDGES))


def _upserted(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "type", "title", "content", *[F.col("meta")[f"k{i}"].alias(f"k{i}") for i in range(4)], F.col("seq.major").alias("major"))


def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(g.upsert_nodes(_increments(spark, sf_dir).nodes))


def node_upsert_null_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.upsert_nodes(_increments(spark, sf_dir).nodes, null_overwrites=True).select("id", "content")


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.upsert_edges(_increments(spark, sf_dir).edges)
    return e.select("type", "source", "target", "evidence", F.coalesce(F.col("meta")["chunkId"], F.lit("")).alias("chunk"), *[F.col("meta")[f"k{i}"].alias(f"k{i}") for i in range(4)], F.col("seq.major").alias("major"))


def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.last_edges(_increments(spark, sf_dir).edges)
    return e.select("type", "source", "target", "evidence", F.coalesce(F.col("meta")["chunkId"], F.lit("")).alias("chunk"), F.col("seq.major").alias("major"))


def incremental_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = _increments(spark, sf_dir)
    top = inc.nodes.agg(F.max("seq.major")).first()[0] or 0
    parts = [Graph(inc.nodes.filter((F.col("seq.major") >= top * i // 3) & (F.col("seq.major") < (top * (i + 1) // 3 if i < 2 else top + 1))), inc.edges.limit(0)) for i in range(3)]
    return _upserted(pipeline.merged_in_waves(parts).nodes).drop("major")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through Structured Streaming: increments from files, upserted by micro-batch."""
    base = fresh_folder(spark, "stream")
    _increments(spark, sf_dir).nodes.repartition(3).write.parquet(f"{base}/in")
    table = GraphTable(spark, f"{base}/graph")
    source = spark.readStream.schema(NODES).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    upsert_stream(source, table, lambda batch, own: Graph(batch, Graph.empty(spark).edges), f"{base}/checkpoint").awaitTermination()
    return _upserted(table.read().nodes)


def node_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    patches = sql(spark, sf_dir, "SELECT 'cus:' || (o_custkey % 2000) AS id, 'title ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'text ' || o_orderkey END AS content, o_orderkey AS nth, o_orderstatus AS status FROM orders")
    patches = patches.withColumn("meta", F.create_map(F.lit("status"), "status"))
    n = g.patch_nodes(graph.nodes, patches)
    return n.select("id", "title", "content", F.col("meta")["status"].alias("status"), F.col("meta")["chunkId"].alias("chunk"))


# ---- degrees, pruning, views ---------------------------------------------------------------------


def degree_any_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(star_graph(spark, sf_dir).edges).select("id", "degree", "strong")


def template_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).nodes.filter("type = 'Formula'").select("id", g.is_template(F.col("content")).alias("template"), g.is_problem_indexed(F.col("content")).alias("indexed"))


def prune_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pruned, _ = g.prune(star_graph(spark, sf_dir))
    return pruned.nodes.select(F.lit("node").alias("part"), "id").unionByName(pruned.edges.select(F.lit("edge").alias("part"), F.concat_ws(" ", "source", "type", "target").alias("id")))


def prune_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    pruned, dropped = g.prune(graph)
    counts = dropped.agg(F.count(F.lit(1)).alias("dropped_nodes"))
    edges = graph.edges.agg(F.count(F.lit(1)).alias("n")).join(pruned.edges.agg(F.count(F.lit(1)).alias("kept")), F.lit(True)).select((F.col("n") - F.col("kept")).alias("dropped_edges"))  # two single rows
    return counts.join(edges, F.lit(True))


def _view(**flags):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = g.view(star_graph(spark, sf_dir), **flags)
        return v.nodes.select(F.lit("node").alias("part"), "id").unionByName(v.edges.select(F.lit("edge").alias("part"), F.concat_ws(" ", "source", "type", "target").alias("id")))

    return query


def view_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.view_elements(star_graph(spark, sf_dir))
    return e.select("kind", *[F.col("data")[k].alias(k) for k in ("id", "label", "type", "title", "content", "source", "target", "evidence", "chunkId")])


# ---- components and aliases ----------------------------------------------------------------------


#: Customers and orders as a graph of many stars, each order's key with its customer's, and parts as chains of 50; nth deals them to batches.
_PAIRS = """SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR(20)), 12, '0') AS a, 'o' || lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0') AS b, o_orderkey AS nth FROM orders
      UNION ALL SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR(20)), 12, '0'), 'p' || lpad(CAST(p_partkey + CASE WHEN p_partkey % 50 = 49 THEN 0 ELSE 1 END AS VARCHAR(20)), 12, '0'), p_partkey FROM part"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.components(sql(spark, sf_dir, _PAIRS).select("a", "b")).select("id", "component")


def components_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the pairs put in by three batches: each joins components of the ones before."""
    pairs, made = sql(spark, sf_dir, _PAIRS), g.Components.empty(spark)
    for i in range(3):
        made = made.add(pairs.filter(F.col("nth") % 3 == i).select("a", "b"))
    return made.current()


def freeze_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.alias_table(star_graph(spark, sf_dir)).select("id", "canonical")


def freeze_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen, _ = g.freeze(star_graph(spark, sf_dir))
    return _flat_nodes(frozen.nodes).select("id", "type", "title", "content", "label", "major")


def freeze_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen, _ = g.freeze(star_graph(spark, sf_dir))
    return frozen.edges.select("type", "source", "target", F.coalesce(F.col("meta")["chunkId"], F.lit("")).alias("chunk"))


def alias_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    later = g.apply_alias(graph, stored(g.alias_table(graph), "alias"))
    return later.nodes.select(F.lit("node").alias("part"), "id", F.col("seq.major").alias("major")).unionByName(later.edges.select(F.lit("edge").alias("part"), F.concat_ws(" ", "source", "type", "target").alias("id"), F.col("seq.major").alias("major")))


# ---- normal forms and filters --------------------------------------------------------------------

_RESPONSES = """SELECT event_id AS chunk_seq, CASE event_id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN '{"nodes": [{"id": "a' || event_id || '", "type": "Lemma", "title": "t", "content": 7, "meta": ' || props || '}, {"id": 5, "type": "Lemma", "title": "t"}], "edges": []}'
  WHEN 2 THEN '{"nodes": [], "edges": [{"type": "Uses", "source": "a", "target": "a"}, {"type": "Uses", "source": "a", "target": "b' || event_id || '", "evidence": "e"}]}' WHEN 3 THEN '[1]' ELSE '{"nodes": [{"id": "n' || event_id || '", "type": "Odd", "title": "x", "content": "c", "source": {"file": "f", "latexLabel": "l' || event_id || '"}}]}' END AS response FROM events"""


def llm_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = no.normalized(sql(spark, sf_dir, _RESPONSES))
    nodes = made.nodes.select(F.lit("node").alias("part"), F.col("seq.major").alias("chunk"), "id", "type", "content", F.col("source.latexLabel").alias("extra"))
    return nodes.unionByName(made.edges.select(F.lit("edge").alias("part"), F.col("seq.major").alias("chunk"), F.concat_ws(" ", "source", "target").alias("id"), "type", F.col("evidence").alias("content"), F.lit(None).cast("string").alias("extra")))


def looks_like_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts of documents and of lines of LaTeX."""
    texts = sql(spark, sf_dir, f"SELECT CAST(doc_id AS VARCHAR(20)) AS place, text FROM documents UNION ALL SELECT path || ' ' || o1 || ' ' || o2 || ' ' || o3, line FROM ({LINES}) l")
    return texts.select("place", no.looks_like_math(F.col("text")).alias("math"), no.has_ellipsis(F.coalesce("text", F.lit(""))).alias("ellipsis"))


#: Nodes that are trivial (a title of type and number), told (a formula with a sentence as title), or told in words of their chunk, which stay.
_POOR = """SELECT 'triv:' || p_partkey AS id, 'Theorem' AS type, 'Theorem ' || p_partkey AS title, 'it holds' AS content, 40000000 + p_partkey AS major FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'told:' || p_partkey, 'Formula', '这是一个关于群的叙述性标题', 'x = ' || p_partkey, 40000000 + p_partkey FROM part WHERE p_partkey % 10 = 1
UNION ALL SELECT 'said:' || p_partkey, 'Formula', '这是一个关于环的叙述性标题', 'x = ' || p_partkey, 40000000 + p_partkey FROM part WHERE p_partkey % 10 = 2
UNION ALL SELECT 'tex:triv' || p_partkey, 'Theorem', 'Theorem ' || p_partkey, 'it holds', 40000000 + p_partkey FROM part WHERE p_partkey % 10 = 3
UNION ALL SELECT 'long:' || p_partkey, 'Lemma', 'Lemma ' || p_partkey, 'it holds for all of the many members there are', 40000000 + p_partkey FROM part WHERE p_partkey % 10 = 4"""


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trivial and suspicious nodes of the star graph and of _POOR, with a chunk for each node's place."""
    poor = sql(spark, sf_dir, _POOR).withColumn("seq", seq("major"))
    nodes = star_graph(spark, sf_dir).nodes.unionByName(columns_like(poor.withColumns({"source": F.lit(None), "meta": F.lit(None)}), NODES))
    texts = sql(spark, sf_dir, """SELECT 10000000 + p_partkey AS chunk_seq, 'text F ' || p_size || chr(92) || 'begin{example}g_{1}(' || repeat('s', 150) || chr(92) || 'end{example}' AS text FROM part
      UNION ALL SELECT 40000000 + p_partkey, CASE WHEN p_partkey % 10 = 2 THEN '说：这是一个关于环的叙述性标题。' ELSE 'nothing' END FROM part""")
    return no.judged(nodes, texts).filter("reason is not null").select("id", "reason")


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    return g.between(graph.edges, graph.nodes).select("type", "source", "target")


def complete_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT s_suppkey AS k, 'x ' || chr(92) || 'begin{align*}' || chr(92) || 'label{q' || s_suppkey || '} a = ' || s_suppkey || chr(92) || 'end{align*} y ' || chr(92) || 'begin{lemma}' || chr(92) || 'label{r' || s_suppkey || '} l ' || chr(92) || 'end{lemma} ' || chr(92) || 'label{z} tail' AS chunk FROM supplier")
    label = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    return rows.select("k", no.block_of_label(F.col("chunk"), label("q")).alias("q"), no.block_of_label(F.col("chunk"), label("r")).alias("r"), no.block_of_label(F.col("chunk"), F.lit("z")).alias("z"), no.block_of_label(F.col("chunk"), F.lit("none")).alias("missing"))


def recover_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a text holds what stands between two pieces of it; empty and short texts give a row, too."""
    docs = sql(spark, sf_dir, "SELECT doc_id, text FROM documents")
    content = F.concat(F.substring("text", 11, 20), F.lit("..."), F.substring("text", 61, 15))
    return docs.select("doc_id", no.between_ends(F.col("text"), content).alias("found"))


def recover_prefix_suffix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recover_prefix_suffix, for all documents: empty and short texts, too, give a row."""
    docs = sql(spark, sf_dir, "SELECT doc_id, text FROM documents")
    content = F.concat(F.substring("text", 11, 20), F.lit("..."), F.substring("text", 61, 15))
    return docs.select("doc_id", no.between_ends(F.col("text"), content).alias("found"))


def title_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql(spark, sf_dir, "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '这是一个关于群的叙述性标题' WHEN 1 THEN 'by q' || p_partkey WHEN 2 THEN '关于群 (q' || p_partkey || ') 的结论' ELSE p_name END AS title FROM part")
    return rows.select("k", no.stable_title(F.lit("Formula"), F.col("title"), F.concat(F.lit("q"), F.col("k").cast("string"))).alias("title"))


# ---- retrieval and alignment ---------------------------------------------------------------------

_ASKED = "SELECT n_nationkey * 65536 AS chunk_seq, 'chunk:' || n_nationkey AS id, 'a.tex' AS file, n_name AS title, 'world/' || n_nationkey AS path, chr(92) || 'ref{sup' || (n_nationkey + 1) || '} and ' || chr(92) || 'label{reg' || (n_nationkey % 5) || '} of Supplier nation ' || n_name AS text FROM nation"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, _ASKED).select("id", "file", "title", F.split("path", "/").alias("section_path"), "text", F.col("chunk_seq").cast("long").alias("chunk_seq"))


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = rt.queries(_asked(spark, sf_dir))
    return q.select("chunk_seq", F.array_join("labels", ",").alias("labels"), F.array_join("words", ",").alias("words"), "hint")


def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rt.shown_nodes(star_graph(spark, sf_dir), _asked(spark, sf_dir), 30)
    return s.select("chunk_seq", F.col("place").cast("long").alias("place"), "id", F.col("score").cast("long").alias("score"))


def summary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    shown = stored(rt.shown_nodes(graph, _asked(spark, sf_dir), 30), "shown")
    return rt.shown_edges(graph, shown, 20).select("chunk_seq", F.col("place").cast("long").alias("place"), "type", "source", "target")


def concept_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.concept_registry(star_graph(spark, sf_dir).nodes).select("total", F.col("place").cast("long").alias("place"), "line")


def align_label_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.label_rule(star_graph(spark, sf_dir).nodes).select("alias", "canonical")


def align_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.cards(star_graph(spark, sf_dir).nodes, 20).select("batch", "id", "title", "section", "evidence")


def align_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = sql(spark, sf_dir, "SELECT CAST(floor(c_custkey / 80) AS BIGINT) AS batch, 'c' || c_custkey AS id FROM customer")
    decisions = sql(spark, sf_dir, "SELECT CAST(floor(o_custkey / 80) AS BIGINT) AS batch, ' c' || o_custkey AS alias, 'c' || (o_custkey + o_orderkey % 5) AS canonical, (o_orderkey % 100) / 100.0D AS confidence FROM orders")
    return al.accepted(decisions, asked).select("batch", "alias", "canonical").distinct()


# ---- files -------------------------------------------------------------------------------------------


def uri_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(sql(spark, sf_dir, "SELECT doc_id, text AS t FROM documents"))
    return rows.select("doc_id", uri_component(F.col("t")).alias("encoded"), (uri_decode(uri_component(F.col("t"))) == F.col("t")).alias("same"), F.md5(xml_escape(F.col("t"))).alias("xml"), F.md5(display_math(F.col("t"))).alias("shown"))


def uri_encode_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As uri_encode, of whole texts; of the long encoded ones the digest."""
    rows = sql(spark, sf_dir, "SELECT doc_id, text AS t FROM documents")
    encoded = uri_component(F.col("t"))
    return rows.select("doc_id", F.md5(encoded).alias("encoded"), (uri_decode(encoded) == F.col("t")).alias("same"), F.md5(xml_escape(F.col("t"))).alias("xml"), F.md5(display_math(F.col("t"))).alias("shown"))


def export_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = gf.json_rows(star_graph(spark, sf_dir))
    read = lambda p: F.get_json_object("json", p)
    return j.select("part", F.col("seq.major").alias("major"), read("$.id").alias("id"), read("$.type").alias("type"), read("$.title").alias("title"), read("$.content").alias("content"), read("$.source.latexLabel").alias("label"), read("$.target").alias("target"), read("$.evidence").alias("evidence"), read("$.meta.chunkId").alias("chunk"))


def export_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gf.triples(star_graph(spark, sf_dir)).select("s", "p", "o", "literal")


def export_owl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gf.owl_rows(star_graph(spark, sf_dir)).select(F.col("part").cast("long").alias("part"), "xml")


def import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph in documents of JSON, 40 numbers of nodes in each; each third node comes again, with another title, in a later one."""
    graph = star_graph(spark, sf_dir)
    again = graph.nodes.filter("seq.major % 3 = 0").select("seq", F.to_json(F.struct("id", "type", F.concat(F.lit("again "), "title").alias("title"))).alias("json"), F.lit(1).alias("turn"))
    nodes = gf.json_rows(graph).filter("part = 'node'").select("seq", "json", F.lit(0).alias("turn")).unionByName(again)
    documents = nodes.groupBy("turn", F.expr("seq.major div 40").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "json"))), lambda x: x["json"]), ",").alias("list"))
    of_nodes = documents.select(F.struct("turn", "block").alias("doc"), F.concat(F.lit('{"version": 1, "graph": {"nodes": ['), "list", F.lit('], "edges": []}}')).alias("value"))
    of_edges = gf.json_rows(graph).filter("part = 'edge'").select(F.struct(F.lit(2).alias("turn"), F.col("seq.major").alias("block")).alias("doc"), F.concat(F.lit('{"nodes": [], "edges": ['), "json", F.lit("]}")).alias("value"))
    made = gf.from_json(of_nodes.unionByName(of_edges))
    return _flat_nodes(g.upsert_nodes(made.nodes)).select(F.lit("node").alias("part"), "id", "type", "title", "label", "chunk").unionByName(_flat_edges(made.edges).select(F.lit("edge").alias("part"), F.col("source").alias("id"), "type", F.col("target").alias("title"), F.col("evidence").alias("label"), "chunk"))


def import_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = gf.triples(star_graph(spark, sf_dir)).withColumn("place", F.col("part") * 1_000_000_000 + F.col("seq.major") * 10 + F.col("nth"))
    made = gf.graph_of_triples(t)
    return _flat_nodes(made.nodes).select(F.lit("node").alias("part"), "id", "type", "title", "content", "label").unionByName(_flat_edges(made.edges).select(F.lit("edge").alias("part"), F.col("source").alias("id"), "type", F.col("target").alias("title"), F.col("evidence").alias("content"), F.lit(None).cast("string").alias("label")))


def turtle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph written as Turtle files and read from them, cut at statement ends."""
    path = f"{fresh_folder(spark, 'turtle')}/graph.ttl"
    gf.write_graph(star_graph(spark, sf_dir), path)
    made = gf.read_graph(spark, path)
    return _flat_nodes(made.nodes).select(F.lit("node").alias("part"), "id", "type", "title", "content", "label").unionByName(_flat_edges(made.edges).select(F.lit("edge").alias("part"), F.col("source").alias("id"), "type", F.col("target").alias("title"), F.col("evidence").alias("content"), F.lit(None).cast("string").alias("label")))


_METAS = "SELECT CASE WHEN event_id % 50 <> 0 THEN 's' || event_id END AS id, CASE WHEN event_id % 7 <> 0 THEN ts END AS createdAt, event_id AS nodes, user_id AS edges, event_type AS note FROM events"


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(sql(spark, sf_dir, _METAS)).select("id", "nodes", "edges", "note")


def snapshot_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_but_latest(sql(spark, sf_dir, _METAS)).select("id")


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph saved, then without its examples saved as the difference, and that loaded."""
    store, graph = SnapshotStore(spark, fresh_folder(spark, "snapshots")), star_graph(spark, sf_dir)
    store.save(graph)
    back, _ = store.load(store.save(g.view(graph, show_examples=False)))
    return back.nodes.select(F.lit("node").alias("part"), "id").unionByName(back.edges.select(F.lit("edge").alias("part"), F.concat_ws(" ", "source", "type", "target").alias("id")))


def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each page, with two .tex files, an image, another file and a folder, scanned.

    main.tex and shared.png are in all archives under one path, and each third main.tex is Latin-1.
    """
    pages = sql(spark, sf_dir, "SELECT page_id, html FROM pages")

    def pack(batches):
        for b in batches:
            out = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(f"p{page}/main.TEX", html)
                    z.writestr(f"p{page}/fig.Png", b"\x89PNG")
                    z.writestr("main.tex", f"p\u00e9 {page}".encode("latin-1" if page % 3 == 0 else "utf-8"))
                    z.writestr("shared.png", str(page).encode())
                    z.writestr(f"p{page}/notes.txt", "no")
                    z.mkdir(f"p{page}/empty")
                out.append((f"a{page:09d}.zip" if page % 10 else f"a{page}.rar", data.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    found = uploads.split_uploads(stored(pages.mapInPandas(pack, "path string, content binary"), "archives"))
    none = F.lit(None).cast("string").alias("digest")
    files = found["files"].select(F.lit("file").alias("part"), "path", F.md5("content").alias("digest"), "file_seq")
    assets = found["assets"].select(F.lit("asset").alias("part"), "path", F.concat_ws(" ", "ext", F.md5("bytes")).alias("digest"), F.lit(-1).cast("long").alias("file_seq"))
    return files.unionByName(assets).unionByName(found["warnings"].select(F.lit("warning").alias("part"), F.col("warning").alias("path"), none, F.lit(-1).cast("long").alias("file_seq")))


def llm_stub_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model-backed run over suppliers as chunks, in waves, with a stub that answers by what a chunk says; an edge to nowhere is in each answer."""
    chunks = sql(spark, sf_dir, "SELECT 'chunk:a:' || s_suppkey AS id, 'a.tex' AS file, s_name AS title, chr(92) || 'begin{definition}' || chr(92) || 'label{sup' || s_suppkey || '} ' || s_name || ' is a member.' || chr(92) || 'end{definition}' AS text, s_suppkey * 65536 AS chunk_seq FROM supplier")
    chunks = chunks.select("id", "file", "title", F.array(F.lit("a.tex"), "title").alias("section_path"), "text", F.col("chunk_seq").cast("long").alias("chunk_seq"))

    def answer(prompt: str) -> str:
        k, name = re.findall(r"\\label\{sup(\d+)\} (.*) is a member", prompt)[-1]
        if "Phase 1" in prompt:
            return json.dumps({"nodes": [{"id": f"tex:sup{k}", "type": "Definition", "title": name, "content": f"{name} is a member.", "source": {"file": "a.tex", "latexLabel": f"sup{k}"}}], "edges": []})
        uses = [{"type": "Uses", "source": f"thm{k}", "target": t} for t in (f"tex:sup{k}", f"tex:sup{int(k) - 1}", "gone")]
        return json.dumps({"nodes": [{"id": f"thm{k}", "type": "Theorem", "title": f"On {name}", "content": f"what holds for member {k}"}], "edges": uses})

    run = pipeline.build_with_model(stored(chunks, "chunks"), answer, Selection(), ModelConfig(parallelism=8), wave=500, concept_wave=500)
    made = run.graph.nodes.select(F.lit("node").alias("part"), "id", "type", "title")
    return made.unionByName(run.graph.edges.select(F.lit("edge").alias("part"), F.col("source").alias("id"), "type", F.col("target").alias("title")))


def repair_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star_graph(spark, sf_dir).nodes

    def fix(text: str) -> str:
        if "BUILDING" in text:
            raise ValueError("refused")
        return text.upper()

    fixed = stored(rp.repair(nodes, fix), "fixed")
    back = rp.restore(fixed)
    pick = lambda df, part: df.select(F.lit(part).alias("part"), "id", "content", F.col("meta")["mathjaxFixed"].alias("fixed"))
    return pick(fixed, "repaired").unionByName(pick(back, "restored"))


QUERIES = {
    f.__name__: f
    for f in (
        node_upsert, node_upsert_null_overwrites, edge_upsert, edge_dedupe, incremental_equals_batch, stream_upsert, node_patch, degree_any_strong, template_formula, prune_graph, prune_stats, view_elements, components, components_in_batches,
        freeze_alias, freeze_nodes, freeze_edges, alias_apply, llm_normalize, looks_like_math, quality_filter, dangling_edges, complete_by_label, recover_prefix_suffix, recover_prefix_suffix_all, title_repair, query_words, relevance_topk, summary_edges,
        concept_registry, align_label_rule, align_cards, align_accept, uri_encode, uri_encode_whole, export_json_rows, export_triples, export_owl_rows, import_json, import_triples, turtle_roundtrip, snapshot_list, snapshot_keep_latest, snapshot_roundtrip, zip_scan,
        llm_stub_pipeline, repair_restore,
    )
}
QUERIES |= {"view_no_examples": _view(show_examples=False), "view_no_exercises": _view(show_exercises=False), "view_no_isolated": _view(show_isolated=False), "view_bare": _view(show_examples=False, show_exercises=False, show_isolated=False)}
