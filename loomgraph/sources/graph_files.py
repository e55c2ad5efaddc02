"""Graphs as JSON, Turtle and OWL (write only)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import or_empty, uri_component, uri_decode, xml_escape
from ..model import EDGES, META, NODES, Graph, columns_like, seq, source_of
from ..storage import numbered
from .turtle import ARROW_TRIPLES, TRIPLES, Statements, parse_turtle, triples_of_files  # noqa: F401

# Namespaces of the files.
BASE = "https://example.org/latexkg#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

_NODE = "struct<id:string,type:string,title:string,content:string,source:struct<file:string,lineHint:int,latexLabel:string,sectionPath:array<string>>,meta:map<string,string>>"
_EDGE = "struct<id:string,type:string,source:string,target:string,evidence:string,meta:map<string,string>>"
_LISTS = f"nodes array<{_NODE}>, edges array<{_EDGE}>"


# ---- JSON ------------------------------------------------------------------------------------------


def from_json(texts: DataFrame) -> Graph:
    """The graph in ``texts`` (value: a JSON document; doc, which orders them, if there is one), ``{graph: {nodes, edges}}`` or ``{nodes, edges}``.

    seq is the document's number and the place in its list. Of rows with neither form it raises.
    """
    read = in_order(texts).select("doc_no", F.from_json("value", f"struct<graph:struct<{_colons()}>,{_colons()}>").alias("j"))
    wrapped = F.col("j.graph.nodes").isNotNull() & F.col("j.graph.edges").isNotNull()
    own = F.col("j.nodes").isNotNull() & F.col("j.edges").isNotNull()
    bad = F.raise_error(F.lit("expected {graph:{nodes,edges}} or {nodes,edges}"))
    g = read.select(
        "doc_no",
        F.when(wrapped, F.col("j.graph.nodes")).when(own, F.col("j.nodes")).otherwise(bad.cast(f"array<{_NODE}>")).alias("nodes"),
        F.when(wrapped, F.col("j.graph.edges")).when(own, F.col("j.edges")).otherwise(bad.cast(f"array<{_EDGE}>")).alias("edges"),
    )
    each = lambda name: g.select("doc_no", F.posexplode(name).alias("place", "x")).select("x.*", seq("doc_no", "place").alias("seq"))
    nodes, edges = each("nodes"), each("edges")
    return Graph(columns_like(nodes, NODES), columns_like(edges, EDGES))


def _colons() -> str:
    return f"nodes:array<{_NODE}>,edges:array<{_EDGE}>"


def json_rows(graph: Graph) -> DataFrame:
    """(part, seq, json): a line of JSON for each node and edge, in the fields' order, without nulls."""
    nodes = graph.nodes.select(F.lit("node").alias("part"), "seq", F.to_json(F.struct("id", "type", "title", "content", "source", "meta")).alias("json"))
    edges = graph.edges.select(F.lit("edge").alias("part"), "seq", F.to_json(F.struct("id", "type", "source", "target", "evidence", "meta")).alias("json"))
    return nodes.unionByName(edges)


def to_json_text(graph: Graph) -> str:
    """One document with two spaces of indentation; for graphs that fit in the driver (write_graph's rows don't ask that)."""
    rows = json_rows(graph).orderBy("part", "seq").collect()
    part = lambda p: [json.loads(r["json"]) for r in rows if r["part"] == p]
    return json.dumps({"version": 1, "graph": {"nodes": part("node"), "edges": part("edge")}}, indent=2, ensure_ascii=False)


# ---- RDF ---------------------------------------------------------------------------------------------


def node_uri(node_id: Column) -> Column:
    return F.concat(F.lit(f"{BASE}node:"), uri_component(node_id))


def node_id_of(uri: Column) -> Column:
    """The id in a node's URI; null for other URIs."""
    return F.when(uri.startswith(f"{BASE}node:"), uri_decode(F.substring(uri, F.lit(len(BASE) + 6), F.length(uri))))


def statement_uri(source: Column, kind: Column, target: Column) -> Column:
    """The URI of the statement that carries an edge's evidence; parallel edges of other chunks share it."""
    return F.concat(F.lit(f"{BASE}stmt:"), uri_component(F.concat_ws("|", source, kind, target)))


def triples(graph: Graph) -> DataFrame:
    """(s, p, o, literal, part, seq, nth): statements on nodes, then on edges; empty texts make none."""
    t = lambda s, p, o, lit: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(lit).alias("literal"))
    if_any = lambda c, x: F.when(or_empty(c) != "", x)
    u, n = node_uri(F.col("id")), F.lit
    content, file, label = F.col("content"), F.col("source.file"), F.col("source.latexLabel")
    about_nodes = F.array(
        t(u, n(f"{RDF}type"), F.concat(n(BASE), "type"), False), t(u, n(f"{RDFS}label"), F.col("title"), True),
        if_any(content, t(u, n(f"{BASE}content"), content, True)), if_any(file, t(u, n(f"{BASE}sourceFile"), file, True)), if_any(label, t(u, n(f"{BASE}latexLabel"), label, True)),
    )
    s, o, p, said = node_uri(F.col("source")), node_uri(F.col("target")), F.concat(n(BASE), "type"), F.col("evidence")
    st = statement_uri(F.col("source"), F.col("type"), F.col("target"))
    about_edges = F.array(
        t(s, p, o, False),
        *[if_any(said, x) for x in (t(st, n(f"{RDF}type"), n(f"{RDF}Statement"), False), t(st, n(f"{RDF}subject"), s, False), t(st, n(f"{RDF}predicate"), p, False), t(st, n(f"{RDF}object"), o, False), t(st, n(f"{BASE}evidence"), said, True))],
    )
    made = lambda df, arr, part: df.select(F.lit(part).alias("part"), "seq", F.posexplode(F.array_compact(arr)).alias("nth", "t")).select("t.*", "part", "seq", "nth")
    return made(graph.nodes, about_nodes, 0).unionByName(made(graph.edges, about_edges, 1))


def turtle_lines(graph: Graph) -> DataFrame:
    """(line, part, seq, nth): a statement of Turtle for each triple."""
    quoted = F.col("o")
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(char), F.lit(code))
    o = F.when(F.col("literal"), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return triples(graph).select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("line"), "part", "seq", "nth")


def graph_of_triples(t: DataFrame) -> Graph:
    """Nodes and edges of triples (s, p, o, literal, place): the last value of a field wins; a missing type is Conclusion, a missing title the id.

    place is a number or a pair (major, minor). Blank nodes are neither nodes nor ends.
    """
    at = F.col("place") if isinstance(t.schema["place"].dataType, T.StructType) else seq("place")
    t = t.withColumn("sid", node_id_of(F.col("s"))).filter("sid is not null")
    here = F.struct("place")
    is_type = (F.col("p") == f"{RDF}type") & ~F.col("literal") & F.col("o").startswith(BASE)
    field = lambda p, c=F.col("o"): F.max_by(c, F.when((F.col("p") == p) & F.col("literal"), here))
    tail = F.substring(F.col("o"), F.lit(len(BASE) + 1), F.length("o"))
    nodes = t.groupBy("sid").agg(
        F.max_by(tail, F.when(is_type, here)).alias("type"), field(f"{RDFS}label").alias("title"), field(f"{BASE}content").alias("content"),
        field(f"{BASE}sourceFile").alias("file"), field(f"{BASE}latexLabel").alias("label"), F.min("place").alias("place"),
    )
    source = F.when(F.col("file").isNotNull() | F.col("label").isNotNull(), source_of(F.col("file"), F.col("label"), F.lit(None).cast("array<string>")))
    nodes = nodes.select(
        F.col("sid").alias("id"), F.when(or_empty(F.col("type")) == "", "Conclusion").otherwise(F.col("type")).alias("type"), F.when(or_empty(F.col("title")) == "", F.col("sid")).otherwise(F.col("title")).alias("title"),
        "content", source.alias("source"), F.lit(None).cast(META).alias("meta"), at.alias("seq"),
    )
    known = F.col("p").isin(f"{BASE}content", f"{BASE}sourceFile", f"{BASE}latexLabel") & F.col("literal")
    e = t.filter(F.col("p").startswith(BASE) & ~F.col("literal") & ~known).withColumn("tid", node_id_of(F.col("o"))).filter("tid <> ''")
    edges = e.select(
        F.lit(None).cast("string").alias("id"), F.substring(F.col("p"), F.lit(len(BASE) + 1), F.length("p")).alias("type"), F.col("sid").alias("source"), F.col("tid").alias("target"),
        F.lit(None).cast("string").alias("evidence"), F.lit(None).cast(META).alias("meta"), at.alias("seq"),
    )
    return Graph(columns_like(nodes, NODES), columns_like(edges, EDGES))


def from_turtle(texts: DataFrame) -> Graph:
    """The graph in ``texts`` (value: a Turtle document; doc, which orders them, if there is one), each parsed by one task; triples_of_files() cuts large ones."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                found = Statements(r["value"] or "", scope=f"d{r['doc_no']}.").out
                rows = [{"s": s, "p": p, "o": o, "literal": literal, "place": {"major": r["doc_no"], "minor": i}} for i, (s, p, o, literal) in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, ARROW_TRIPLES)

    return graph_of_triples(in_order(texts).mapInArrow(run, TRIPLES))


def in_order(texts: DataFrame) -> DataFrame:
    """(value, doc_no): documents by ``doc``, without it by what they say."""
    order = ["doc", "value"] if "doc" in texts.columns else ["value"]
    return numbered(texts.select(*order), order, "doc_no").select("value", "doc_no")


def owl_rows(graph: Graph) -> DataFrame:
    """(part, seq, xml): elements of RDF/XML: classes, properties (each in order of first use), individuals, relations."""
    first = lambda df, part, tag: df.groupBy("type").agg(F.min("seq").alias("seq")).select(F.lit(part).alias("part"), "seq", F.concat(F.lit(f'  <owl:{tag} rdf:about="{BASE}'), "type", F.lit('"/>')).alias("xml"))
    content = F.when(or_empty(F.col("content")) != "", F.concat(F.lit("\n    <latexkg:content>"), xml_escape(F.col("content")), F.lit("</latexkg:content>"))).otherwise("")
    individual = F.concat(
        F.lit('  <owl:NamedIndividual rdf:about="'), node_uri(F.col("id")), F.lit(f'">\n    <rdf:type rdf:resource="{BASE}'), "type",
        F.lit('"/>\n    <rdfs:label>'), xml_escape(F.col("title")), F.lit("</rdfs:label>"), content, F.lit("\n  </owl:NamedIndividual>"),
    )
    relation = F.concat(F.lit('  <rdf:Description rdf:about="'), node_uri(F.col("source")), F.lit('">\n    <latexkg:'), "type", F.lit(' rdf:resource="'), node_uri(F.col("target")), F.lit('"/>\n  </rdf:Description>'))
    return (
        first(graph.nodes, 0, "Class")
        .unionByName(first(graph.edges, 1, "ObjectProperty"))
        .unionByName(graph.nodes.select(F.lit(2).alias("part"), "seq", individual.alias("xml")))
        .unionByName(graph.edges.select(F.lit(3).alias("part"), "seq", relation.alias("xml")))
    )


_OWL_HEAD = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF\n  xmlns:rdf="{RDF}"\n  xmlns:rdfs="{RDFS}"\n  xmlns:owl="{OWL}"\n  xmlns:latexkg="{BASE}">\n  <owl:Ontology rdf:about="{BASE}"/>'


# ---- files -------------------------------------------------------------------------------------------


def format_of(path: str) -> str:
    end = path.lower().rsplit(".", 1)[-1]
    found = {"json": "json", "ttl": "turtle", "turtle": "turtle", "xml": "owl", "owl": "owl"}.get(end)
    if not found:
        raise ValueError(f"no format for {path}; known are .json, .ttl, .turtle and, to write, .owl and .xml")
    return found


def read_graph(spark: SparkSession, path: str, kind: str | None = None) -> Graph:
    """A graph from a .json, .ttl or .turtle file (or folder of such parts)."""
    kind = kind or format_of(path)
    if kind not in ("json", "turtle"):
        raise ValueError(f"{kind} is not read")
    if kind == "turtle":
        return graph_of_triples(triples_of_files(spark, path))
    texts = spark.read.text(path, wholetext=True)
    return from_json(texts.select("value", F.col("_metadata.file_path").alias("doc")))


def write_graph(graph: Graph, path: str, kind: str | None = None) -> None:
    """Write a graph as a folder of text parts in order, by its extension.

    Lines of JSON are put in one document by a head and a tail; the sort is by ranges, so no task
    and not the driver holds the graph.
    """
    kind = kind or format_of(path)
    if kind == "json":
        rows = json_rows(graph).withColumn("p", F.when(F.col("part") == "node", 1).otherwise(3)).select("p", "seq", F.col("json").alias("line"))
        last = rows.groupBy("p").agg(F.max("seq").alias("seq")).withColumn("last", F.lit(True))
        rows = rows.join(F.broadcast(last), ["p", "seq"], "left").withColumn("line", F.when(F.col("last"), F.col("line")).otherwise(F.concat("line", F.lit(","))))
        frame = [(0, '{"version": 1, "graph": {"nodes": ['), (2, '], "edges": ['), (4, "]}}")]
    elif kind == "turtle":
        rows = turtle_lines(graph).withColumn("p", F.col("part") + 1).withColumn("seq", F.struct(F.col("seq.major").alias("major"), (F.col("seq.minor") * 8 + F.col("nth")).alias("minor")))
        frame = [(0, f"@prefix latexkg: <{BASE}>.\n@prefix rdf: <{RDF}>.\n@prefix rdfs: <{RDFS}>.\n@prefix owl: <{OWL}>.")]
    else:
        rows = owl_rows(graph).select((F.col("part") + 1).alias("p"), "seq", F.col("xml").alias("line"))
        frame = [(0, _OWL_HEAD), (9, "</rdf:RDF>")]
    kind_of_seq = "struct<major: bigint, minor: bigint>"
    ends = graph.nodes.sparkSession.createDataFrame([(p, (0, 0), line) for p, line in frame], f"p int, seq {kind_of_seq}, line string")
    every = ends.unionByName(rows.select(F.col("p").cast("int").alias("p"), F.col("seq").cast(kind_of_seq).alias("seq"), "line"))
    every.orderBy("p", "seq").select("line").write.mode("overwrite").text(path)
