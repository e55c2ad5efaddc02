"""What a model-backed extractor returns: normal shape, completion from the chunk, quality filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import END, WS, is_narrative, once, or_empty, trim
from ..model import EDGES, ENTITY_TYPES, NODES, RELATION_TYPES, Graph, columns_like, seq
from ..storage import stored, stored_together
from .extract import worked_meta
from .graph import patch_nodes

# Environments that are sought for a labeled block, in this order.
BLOCKS = ("theorem", "lemma", "corollary", "definition", "example", "exercise", "axiom", "proposition", "conclusion", "equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*")
AROUND, LONGEST, SHORT = 4000, 60_000, 20


def normalized(responses: DataFrame, strict: bool = False) -> Graph:
    """The graph in ``responses`` (chunk_seq, response: JSON text).

    Nodes need an id, type and title that are strings, edges a type and two ends that are strings
    and differ; optional fields of another type are null; an edge's own id is not used. Text that is
    no JSON gives nothing. ``strict`` also asks for the vocabularies' types.
    """
    v = responses.select("chunk_seq", F.expr("try_parse_json(response)").alias("v"))
    text = lambda of, p: F.expr(f"if(schema_of_variant(variant_get({of}, '$.{p}', 'variant')) = 'STRING', try_variant_get({of}, '$.{p}', 'string'), null)")
    each = lambda p: v.select("chunk_seq", F.posexplode_outer(F.expr(f"try_variant_get(v, '$.{p}', 'array<variant>')")).alias("place", "x")).filter("x is not null")
    meta = F.expr("transform_values(try_variant_get(x, '$.meta', 'map<string,variant>'), (k, m) -> coalesce(if(schema_of_variant(m) = 'STRING', try_variant_get(m, '$', 'string'), null), to_json(m)))")
    has_source = F.expr("schema_of_variant(variant_get(x, '$.source', 'variant')) like 'OBJECT%'")
    source = F.when(
        has_source,
        F.struct(
            text("x", "source.file").alias("file"), F.expr("try_variant_get(x, '$.source.lineHint', 'int')").alias("lineHint"),
            text("x", "source.latexLabel").alias("latexLabel"), F.expr("try_variant_get(x, '$.source.sectionPath', 'array<string>')").alias("sectionPath"),
        ),
    )
    nodes = each("nodes").select(text("x", "id").alias("id"), text("x", "type").alias("type"), text("x", "title").alias("title"), text("x", "content").alias("content"), source.alias("source"), meta.alias("meta"), seq("chunk_seq", "place").alias("seq"))
    nodes = nodes.filter("id is not null and type is not null and title is not null")
    edges = each("edges").select(F.lit(None).cast("string").alias("id"), text("x", "type").alias("type"), text("x", "source").alias("source"), text("x", "target").alias("target"), text("x", "evidence").alias("evidence"), meta.alias("meta"), seq("chunk_seq", "place").alias("seq"))
    edges = edges.filter("type is not null and source is not null and target is not null and source <> target")
    if strict:
        nodes, edges = nodes.filter(F.col("type").isin(*ENTITY_TYPES)), edges.filter(F.col("type").isin(*RELATION_TYPES))
    return Graph(columns_like(nodes, NODES), columns_like(edges, EDGES))


# ---- completion from the chunk -------------------------------------------------------------------


def node_label(node_id: Column, label: Column) -> Column:
    """The trimmed label, else what follows ``tex:`` in the id, else null."""
    own = trim(or_empty(label))
    return F.when(own != "", own).when(node_id.startswith("tex:"), F.substring(node_id, F.lit(5), F.length(node_id)))


def has_ellipsis(c: Column) -> Column:
    return c.contains("...") | c.contains("…") | c.contains("略")


def block_of_label(chunk: Column, label: Column) -> Column:
    """The first block that holds the label, by kind of environment; else the text around the label; null without it."""
    mark = F.concat(F.lit("\\label{"), label, F.lit("}"))
    found = []
    for env in BLOCKS:
        name = env.replace("*", r"\*")
        bodies = F.transform(F.regexp_extract_all(chunk, F.lit(rf"(?is)\\begin\{{{name}\}}(.*?)\\end\{{{name}\}}"), F.lit(1)), trim)
        found.append(F.try_element_at(F.filter(bodies, lambda b: F.contains(b, mark)), F.lit(1)))
    at = F.position(mark, chunk)
    begin = F.greatest(F.lit(1), at - AROUND)
    around = trim(F.substring(chunk, begin, at + AROUND - begin))
    return F.coalesce(*found, F.when(at > 0, around))


def between_ends(chunk: Column, content: Column) -> Column:
    """The chunk's text from what precedes the first ellipsis to what follows the last, both of 10 characters or more; null if they aren't there."""
    marker = F.when(content.contains("…"), F.lit("…")).otherwise(F.lit("..."))
    parts = F.split(content, F.concat(F.lit("\\Q"), marker, F.lit("\\E")), -1)
    head, tail = trim(F.element_at(parts, 1)), trim(F.element_at(parts, -1))
    start = F.position(head, chunk)
    stop = F.position(tail, chunk, start + F.length(head))
    found = trim(F.substring(chunk, start, stop + F.length(tail) - start))
    fits = (F.size(parts) >= 2) & (F.length(head) >= 10) & (F.length(tail) >= 10) & (start > 0) & (stop > 0)
    return F.when(fits & (F.length(found) <= LONGEST), found)


def stable_title(kind: Column, title: Column, label: Column) -> Column:
    """``Formula (label)`` for formulas whose title reads like a sentence or lacks the label."""
    t = trim(or_empty(title))
    return F.when((kind == "Formula") & (is_narrative(t) | ~F.contains(t, label)), F.concat(F.lit("Formula ("), label, F.lit(")"))).otherwise(title)


def completions(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Patches (id, title, content, meta, nth) for nodes whose content is cut short, from their chunk (by chunk_seq)."""
    made = with_texts(nodes, chunks, "inner").withColumns(sought()).filter("_block <> '' or _span <> ''")
    patch = patch_of_sought()
    return made.select("id", patch["title"].alias("title"), patch["content"].alias("content"), F.lit(None).cast("map<string,string>").alias("meta"), F.col("seq").alias("nth"))


def with_texts(nodes: DataFrame, chunks: DataFrame, how: str) -> DataFrame:
    """``nodes`` with _text, that of their chunk."""
    return nodes.join(chunks.select(F.col("chunk_seq").alias("_c"), F.col("text").alias("_text")), F.col("seq.major") == F.col("_c"), how).drop("_c")


@once
def sought() -> dict[str, Column]:
    """_label, and what _text holds for a node that is cut short: _block by its label, _span by its content's ends."""
    content = trim(or_empty(F.col("content")))
    label = node_label(F.col("id"), F.col("source.latexLabel"))
    short = has_ellipsis(content) | (F.length(content) < SHORT)
    return {"_label": label, "_block": F.when(label.isNotNull() & short, block_of_label(F.col("_text"), label)), "_span": F.when(label.isNull() & has_ellipsis(content), between_ends(F.col("_text"), content))}


@once
def patch_of_sought() -> Column:
    """The new title and content of a node with sought(); null if nothing was found."""
    by_label = F.col("_block") != ""
    title = F.when(by_label, stable_title(F.col("type"), F.col("title"), F.col("_label")))
    return F.when(by_label | (F.col("_span") != ""), F.struct(title.alias("title"), F.when(by_label, F.col("_block")).otherwise(F.col("_span")).alias("content")))


def completed(graph: Graph, chunks: DataFrame) -> Graph:
    """Patches stay within the chunk whose response they come from."""
    patches = completions(graph.nodes, chunks)
    key = lambda df, c: df.withColumn("id", F.concat(c.cast("string"), F.lit("\n"), "id"))  # noqa: E731  ids of other chunks are others
    nodes = patch_nodes(key(graph.nodes, F.col("seq.major")), key(patches, F.col("nth.major")))
    return Graph(columns_like(nodes.withColumn("id", F.expr("substring(id, locate('\n', id) + 1)")), NODES), graph.edges)


@once
def worked() -> Column:
    return worked_meta(F.col("type"), F.col("content"), F.col("meta"))


def annotated(nodes: DataFrame) -> DataFrame:
    """Examples and exercises with problem, solution and answer in meta."""
    return columns_like(nodes.withColumn("meta", worked()), NODES)


# ---- filters -------------------------------------------------------------------------------------

# What counts as mathematics.
_MATH = (
    r"\\begin\{(equation|align|aligned|gather|multline)\}",
    r"(?s)\$\$.*\$\$",
    r"(?s)\\\[.*\\\]",
    rf"\\(frac|sum|int|prod|mathbb|mathbf|mathrm|left|right|cdot|leq|geq|neq|infty){END}",
)


def looks_like_math(c: Column) -> Column:
    c = or_empty(c)
    found = c.rlike(_MATH[0]) | c.rlike(_MATH[1]) | c.rlike(_MATH[2]) | c.rlike(_MATH[3])
    return found | (c.rlike("[=<>]") & c.rlike(r"[a-zA-Z\\]")) | (c.rlike("[0-9]") & c.rlike(r"[_^]"))


def is_trivial(node_id: Column, kind: Column, title: Column, content: Column, label: Column) -> Column:
    """Unlabeled, with a title of type and number only and a little content without commands."""
    t, c = trim(or_empty(title)), trim(or_empty(content))
    # Titles of type and number, and commands.
    generic = t.rlike(rf"(?i)^(Theorem|Lemma|Corollary|Definition|Axiom|Proposition|Conclusion)[{WS}]*[0-9]+\z")
    short = (F.length(c) > 0) & (F.length(c) < 40) & ~c.rlike(rf"\\(begin|frac|sum|int|label|ref){END}")
    return label.isNull() & ~node_id.startswith("tex:") & ~kind.isin("Example", "Exercise", "Formula") & generic & short


def is_inside_worked(chunk: Column, content: Column) -> Column:
    """Whether the content, of 8 characters or more, is part of an example or exercise of the chunk."""
    # Fixed value: examples and exercises.
    blocks = F.regexp_extract_all(chunk, F.lit(r"(?is)\\begin\{(example|exercise)\}(.*?)\\end\{\1\}"), F.lit(2))
    return (F.length(content) >= 8) & F.exists(blocks, lambda b: F.contains(b, content))


def judged(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``nodes`` with reason: null for those that stay, else ``trivial`` or ``suspicious``."""
    return with_texts(nodes, chunks, "left").withColumn("reason", reason_of()).drop("_text")


@once
def reason_of() -> Column:
    """Why a node with _text does not stay; null if it does."""
    label, text = F.col("source.latexLabel"), or_empty(F.col("_text"))
    content, title = trim(or_empty(F.col("content"))), trim(or_empty(F.col("title")))
    grounded = looks_like_math(content) | (F.length(or_empty(label)) > 0)
    inside = label.isNull() & ~F.col("id").startswith("tex:") & is_inside_worked(text, content)
    told = is_narrative(title) & ~((title != "") & F.contains(text, title))
    return F.when(is_trivial(F.col("id"), F.col("type"), F.col("title"), F.col("content"), label), "trivial").when((F.col("type") == "Formula") & (~grounded | inside | told), "suspicious")


def filtered(graph: Graph, chunks: DataFrame, existing: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The graph without trivial and suspicious nodes and without edges whose ends are neither kept (in the chunk) nor in ``existing``; and warnings (chunk_seq, warning).

    The judged nodes and the edges are written once; what is kept and what is said read them.
    """
    return of_judged(*stored_together(judged=judged(graph.nodes, chunks), edges=graph.edges), existing)


def finished(graph: Graph, chunks: DataFrame, existing: DataFrame) -> tuple[Graph, DataFrame]:
    """completed(), annotated() and filtered() of a written graph in one: nodes meet their chunk's text once, and patches by the order of a chunk's nodes with one id."""
    own = Window.partitionBy("seq.major", "id")
    last = F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("seq"))).over(own)
    found = with_texts(graph.nodes, chunks, "left").withColumns(sought()).withColumn("_p", patch_of_sought())
    patched = found.repartition(found.sparkSession.sparkContext.defaultParallelism, "seq.major").withColumn("_p", last)  # few rows that take long each
    patched = patched.withColumns({"title": F.coalesce("_p.title", "title"), "content": F.coalesce("_p.content", "content")})
    marked = patched.withColumn("meta", worked().cast(NODES["meta"].dataType)).select(*NODES.fieldNames(), reason_of().alias("reason"))
    return of_judged(stored(marked, "judged"), graph.edges, existing)


def of_judged(marked: DataFrame, edges: DataFrame, existing: DataFrame | None) -> tuple[Graph, DataFrame]:
    """filtered() of judged() nodes and edges, both written."""
    kept = columns_like(marked.filter("reason is null"), NODES)
    ends = kept.select(F.col("seq.major").alias("_c"), F.col("id").alias("_id")).distinct()
    old = None if existing is None else existing.select(F.col("id").alias("_id")).distinct()
    edges = edges.withColumn("_ok", F.lit(True))
    for end in ("source", "target"):
        here = ends.withColumn("_here", F.lit(True))
        edges = edges.join(here, (edges["seq.major"] == here["_c"]) & (edges[end] == here["_id"]), "left").drop("_c", "_id")
        known = F.coalesce("_here", F.lit(False))
        if old is not None:
            before = old.withColumn("_old", F.lit(True))
            edges = edges.join(before, edges[end] == before["_id"], "left").drop("_id")
            known = known | F.coalesce("_old", F.lit(False))
        edges = edges.withColumn("_ok", F.col("_ok") & known).drop("_here", "_old")
    edges = stored(edges, "marked-edges")
    said = marked.filter("reason is not null").select(F.col("seq.major").alias("chunk_seq"), F.concat(F.lit("dropped "), "reason", F.lit(" "), "type", F.lit(": "), "title", F.lit(" ("), "id", F.lit(")")).alias("warning"))
    lost = edges.filter("not _ok").groupBy(F.col("seq.major").alias("chunk_seq")).agg(F.concat(F.lit("dropped "), F.count(F.lit(1)).cast("string"), F.lit(" dangling edges")).alias("warning"))
    return Graph(kept, columns_like(edges.filter("_ok"), EDGES)), said.unionByName(lost)

