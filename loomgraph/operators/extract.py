"""Deterministic extraction of entities and relations from chunks.

Everything that stays within a chunk is an array expression over the chunk's row, so extraction has
no shuffle until its edges meet the labels of other chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, all_groups, cut_first, group, let, or_empty, running_max, running_sum, spans, trim, within
from ..model import EDGES, ENVIRONMENTS, META, NODES, Graph, Selection, columns_like, no_meta, seq, source_of
from ..storage import stored
from .graph import upsert_edges, upsert_nodes

_NAMES = "|".join(ENVIRONMENTS)
_ENV = rf"\\begin\{{({_NAMES})\}}([\s\S]*?)\\end\{{\%d\}}"
# Displayed mathematics, in the order in which formulas are numbered.
FORMULAS = (r"\\begin\{equation\}([\s\S]*?)\\end\{equation\}", r"\\begin\{align\}([\s\S]*?)\\end\{align\}", r"\$\$([\s\S]*?)\$\$", r"\\\[([\s\S]*?)\\\]")
# Labels, references, derivations.
LABEL = r"\\label\{([^}]+)\}"
REFERENCE = r"\\(eqref|ref|autoref|cref)\{([^}]+)\}"
DERIVED = r"(?i)(derived[{ws}]+from[{ws}]+(\\ref\{{([^}}]+)\}}))".format(ws=WS)
# Entities that examples and exercises bind to, and marks of solutions and answers.
CORES = ("Theorem", "Lemma", "Corollary", "Definition", "Axiom", "Proposition", "Conclusion")
WORKED = ("Example", "Exercise")
SOLUTION = rf"\n[{WS}]*(解答|解|证明)[{WS}]*[:：]?[{WS}]*\n"
ANSWER = rf"\n[{WS}]*(答案)[{WS}]*[:：]?[{WS}]*\n"


def first_label(text: Column) -> Column:
    return trim(group(text, LABEL, 1))


def bracket_title(block: Column) -> Column:
    r"""The title in brackets after the first \begin of the block that has one."""
    # Fixed value: the title's pattern.
    return trim(group(block, rf"\\begin\{{[a-zA-Z*]+\}}[{WS}]*\[([^\]]+)\]", 1))


def references(text: Column) -> Column:
    """Distinct labels that the text refers to, in order."""
    return F.array_distinct(F.transform(all_groups(text, REFERENCE, 2), trim))


def environments(text: Column, entities: tuple[str, ...]) -> Column:
    """Theorem-like blocks of the selected types in order: an array of (env, type, title, body, label)."""
    found = all_groups(text, "(?is)" + _ENV % 1, 0)
    kind = F.create_map(*[F.lit(x) for pair in ENVIRONMENTS.items() for x in pair])

    def fields(block: Column) -> Column:
        env = F.lower(F.regexp_extract(block, "(?is)" + _ENV % 1, 1))
        parts = F.struct(env.alias("env"), trim(F.regexp_extract(block, "(?is)" + _ENV % 1, 2)).alias("body"))
        return let(parts, lambda x: F.struct(x["env"].alias("env"), F.element_at(kind, x["env"]).alias("type"), bracket_title(block).alias("title"), x["body"].alias("body"), first_label(x["body"]).alias("label")))

    return F.filter(F.transform(found, fields), lambda e: e["type"].isin(*entities))


def formulas(text: Column) -> Column:
    """Displayed formulas by pattern and place: an array of (body, label, start, inside); inside: in an example or exercise."""
    # Fixed value: examples and exercises.
    worked = spans(text, r"\\begin\{(example|exercise)\}[\s\S]*?\\end\{\3\}")

    def of(pattern: str) -> Column:
        def fields(s: Column) -> Column:
            body = trim(F.regexp_extract(s["match"], f"(?is){pattern}", 1))
            return let(body, lambda x: F.struct(x.alias("body"), first_label(x).alias("label"), s["start"].alias("start")))

        return F.filter(F.transform(spans(text, pattern), fields), lambda f: f["body"] != "")

    def placed(found: Column) -> Column:
        held = within(F.transform(found, lambda f: f["start"]), worked)
        return F.zip_with(found, held, lambda f, inside: F.struct(f["body"].alias("body"), f["label"].alias("label"), f["start"].alias("start"), inside.alias("inside")))

    return let(F.concat(*[of(pattern) for pattern in FORMULAS]), placed)


def split_worked(content: Column) -> Column:
    """(problem, solution, answer) of an example or exercise, null if it has no such parts.

    Environments come first; without them, lines with the marks for a solution or an answer.
    """
    c = trim(or_empty(content))
    # Environments of solutions and answers.
    solution_env, answer_env = r"(?is)\\begin\{solution\}(.*?)\\end\{solution\}", r"(?is)\\begin\{answer\}(.*?)\\end\{answer\}"
    has = c.rlike(solution_env) | c.rlike(answer_env)
    by_env = F.struct(
        trim(cut_first(cut_first(c, F.regexp_extract(c, solution_env, 0)), F.regexp_extract(c, answer_env, 0))).alias("problem"),
        trim(F.regexp_extract(c, solution_env, 1)).alias("solution"),
        trim(F.regexp_extract(c, answer_env, 1)).alias("answer"),
    )
    s, a = F.regexp_instr(c, F.lit(SOLUTION)), F.regexp_instr(c, F.lit(ANSWER))  # from 1; 0: none
    end = F.length(c) + 1
    first = F.least(F.when(s > 0, s).otherwise(end), F.when(a > 0, a).otherwise(end))
    stop = F.when(a > s, a).otherwise(end)
    by_mark = F.struct(
        trim(F.substring(c, F.lit(1), first - 1)).alias("problem"),
        F.when(s > 0, trim(F.substring(c, s, stop - s))).otherwise("").alias("solution"),
        F.when(a > 0, trim(F.substring(c, a, end - a))).otherwise("").alias("answer"),
    )
    return F.when(c == "", None).when(has, by_env).when((s > 0) | (a > 0), by_mark)


def worked_meta(kind: Column, content: Column, meta: Column) -> Column:
    """meta with problem, solution and answer for examples and exercises that have them."""
    parts = split_worked(content)
    added = F.create_map(F.lit("problem"), parts["problem"], F.lit("solution"), parts["solution"], F.lit("answer"), parts["answer"])
    kept = F.map_filter(F.coalesce(meta, F.create_map().cast(META)), lambda k, v: ~k.isin("problem", "solution", "answer"))
    return F.when(kind.isin(*WORKED) & parts.isNotNull(), F.map_concat(kept, added)).otherwise(meta)


def parsed(chunks: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """``chunks`` with section_id, envs and maths (arrays of what becomes nodes, numbered and named), refs and said (what the text refers to and says it is derived from)."""
    path = F.col("section_path")
    envs = environments(F.col("text"), selection.entities)
    named = F.transform(
        envs,
        lambda e, i: F.struct(
            F.when(e["label"].isNotNull(), F.concat(F.lit("tex:"), e["label"])).otherwise(F.concat("id", F.lit(":"), e["env"], F.lit(":"), i.cast("string"))).alias("id"),
            e["type"].alias("type"),
            F.coalesce(e["title"], F.concat(e["type"], F.lit(" "), (i + 1).cast("string"))).alias("title"),
            e["body"].alias("content"),
            e["label"].alias("label"),
        ),
    )
    maths = F.filter(formulas(F.col("text")), lambda f: f["label"].isNotNull() | ~f["inside"]) if "Formula" in selection.entities else F.slice(F.array(F.struct(F.lit("").alias("body"), F.lit("").alias("label"))), 1, 0)
    one = lambda i, title, f: F.struct(i.alias("id"), F.lit("Formula").alias("type"), title.alias("title"), f["body"].alias("content"), f["label"].alias("label"))

    def numbered(own: Column) -> Column:
        # A formula without a label takes a number: its id has it from 0, its title from 1.
        counts = running_sum(F.transform(own, lambda f: f["label"].isNull().cast("int")))

        def named_one(f: Column, k: Column) -> Column:
            labeled = one(F.concat(F.lit("tex:"), f["label"]), F.concat(F.lit("Formula ("), f["label"], F.lit(")")), f)
            plain = one(F.concat("id", F.lit(":formula:"), (k - 1).cast("string")), F.concat(F.lit("Formula "), k.cast("string")), f)
            return F.when(f["label"].isNotNull(), labeled).otherwise(plain)

        return F.zip_with(own, counts, named_one)

    said = F.arrays_zip(all_groups(F.col("text"), DERIVED, 1).alias("said"), all_groups(F.col("text"), DERIVED, 3).alias("label"))
    return chunks.withColumns({"section_id": F.concat(F.lit("sec:"), F.array_join(path, " / ")), "envs": named, "maths": let(maths, numbered), "refs": references(F.col("text")), "said": said})


def raw_nodes(p: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """Nodes of parsed chunks before merging: the section's, environments, formulas."""
    tail = F.array_join(F.slice("section_path", 2, F.greatest(F.size("section_path") - 1, F.lit(0))), " / ")
    section = F.struct(
        F.col("section_id").alias("id"), F.lit("Conclusion").alias("type"), F.when(tail == "", F.col("title")).otherwise(tail).alias("title"),
        F.lit("").alias("content"), F.lit(None).cast("string").alias("label"),
    )
    first = F.array(section) if "Conclusion" in selection.entities else F.slice(F.array(section), 1, 0)
    each = p.select("id", "file", "section_path", "chunk_seq", F.posexplode(F.concat(first, "envs", "maths")).alias("place", "n"))
    nodes = each.select(
        "n.id", "n.type", "n.title", "n.content", source_of(F.col("file"), F.col("n.label"), F.col("section_path")).alias("source"),
        worked_meta(F.col("n.type"), F.col("n.content"), no_meta()).alias("meta"), seq("chunk_seq", "place").alias("seq"),
    )
    return columns_like(nodes, NODES)


def label_index(nodes: DataFrame) -> DataFrame:
    """(label, id, first_seq): the node that a label names (the last one wins) and the chunk that has it first."""
    labeled = nodes.filter(F.col("source.latexLabel") != "").select(F.col("source.latexLabel").alias("label"), "id", "seq")
    return labeled.groupBy("label").agg(F.max_by("id", "seq").alias("id"), F.min("seq.major").alias("first_seq"))


def _edges(df: DataFrame, kind: Column, source: str, target: str, evidence: Column, minor: Column) -> DataFrame:
    made = df.select(
        F.lit(None).cast("string").alias("id"), kind.alias("type"), F.col(source).alias("source"), F.col(target).alias("target"), evidence.cast("string").alias("evidence"),
        F.create_map(F.lit("chunkId"), F.col("chunk_id")).alias("meta"), seq(F.col("chunk_seq"), minor).alias("seq"),
    )
    return columns_like(made, EDGES)


#: Kinds of edges of a chunk follow each other: the minor part of seq starts anew by so much.
BLOCK = 1 << 40


def binding_edges(p: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """Examples and exercises to the nearest core environment before them in the chunk."""
    place = running_max(F.transform("envs", lambda e, i: F.when(e["type"].isin(*CORES), i).otherwise(-1)))
    before = let(place, lambda at: F.transform(at, lambda _, i: F.when(i > 0, F.get(at, i - 1)).otherwise(-1)))
    last = F.zip_with("envs", before, lambda e, k: F.struct(e["id"].alias("id"), e["type"].alias("type"), F.when(k >= 0, F.get(F.col("envs"), k)["id"]).alias("core")))
    bound = p.select(F.col("id").alias("chunk_id"), "chunk_seq", F.posexplode(last).alias("place", "e")).select("*", "e.*").filter("core is not null")
    kind = F.lit(None).cast("string")
    if "AssistsIn" in selection.relations:
        kind = F.when(F.col("type").isin(*WORKED), F.lit("AssistsIn"))
    if "AppliesTo" in selection.relations:
        kind = F.when(F.col("type") == "Exercise", F.lit("AppliesTo")).otherwise(kind)
    bound = bound.withColumn("kind", kind).filter(F.col("type").isin(*WORKED) & F.col("kind").isNotNull())
    return _edges(bound, F.col("kind"), "id", "core", F.lit(None), F.col("place"))


def members(p: DataFrame) -> DataFrame:
    """(chunk_id, chunk_seq, section_id, place, member): each node of a chunk but its section's."""
    each = p.select(F.col("id").alias("chunk_id"), "chunk_seq", "section_id", F.posexplode(F.concat("envs", "maths")).alias("place", "n"))
    return each.select("chunk_id", "chunk_seq", "section_id", "place", F.col("n.id").alias("member")).filter("member <> section_id")


def contains_edges(p: DataFrame) -> DataFrame:
    return _edges(members(p), F.lit("Contains"), "section_id", "member", F.lit(None), F.col("place") + BLOCK)


def reference_edges(p: DataFrame, labels: DataFrame, label_scope: str = "seen") -> DataFrame:
    """Each node of a chunk to each known label that the chunk refers to.

    With scope ``seen`` a label is known from the chunk that has it on; with ``global`` everywhere.
    """
    refs = p.select(F.col("id").alias("chunk_id"), "chunk_seq", F.posexplode("refs").alias("nth", "label"))
    known = _known(refs, labels, label_scope)
    made = members(p).drop("chunk_seq").join(known, "chunk_id").filter("member <> target")
    return _edges(made, F.lit("DependsOn"), "member", "target", F.concat(F.lit("reference: "), "label"), F.col("place") * (1 << 20) + F.col("nth") + 2 * BLOCK)


def derivation_edges(p: DataFrame, labels: DataFrame, label_scope: str = "seen") -> DataFrame:
    """Each node of a chunk to each label that the chunk says something is derived from."""
    refs = p.select(F.col("id").alias("chunk_id"), "chunk_seq", F.posexplode("said").alias("nth", "m")).select("chunk_id", "chunk_seq", "nth", F.col("m.said").alias("said"), F.col("m.label").alias("label"))
    made = members(p).drop("chunk_seq").join(_known(refs, labels, label_scope), "chunk_id").filter("member <> target")
    return _edges(made, F.lit("DerivedFrom"), "member", "target", F.col("said"), F.col("place") * (1 << 20) + F.col("nth") + 3 * BLOCK)


def _known(refs: DataFrame, labels: DataFrame, label_scope: str) -> DataFrame:
    index = labels.select("label", F.col("id").alias("target"), "first_seq")
    joined = refs.join(index, "label")
    return (joined.filter("first_seq <= chunk_seq") if label_scope == "seen" else joined).drop("first_seq")


def raw_edges(p: DataFrame, labels: DataFrame, selection: Selection = Selection(), label_scope: str = "seen") -> DataFrame | None:
    """Edges of parsed chunks before merging; None if no relation is selected. What is not selected is not planned."""
    parts = []
    if {"AssistsIn", "AppliesTo"} & set(selection.relations):
        parts.append(binding_edges(p, selection))
    if "Contains" in selection.relations and "Conclusion" in selection.entities:
        parts.append(contains_edges(p))
    if "DependsOn" in selection.relations:
        parts.append(reference_edges(p, labels, label_scope))
    if "DerivedFrom" in selection.relations:
        parts.append(derivation_edges(p, labels, label_scope))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def extract(chunks: DataFrame, selection: Selection = Selection(), label_scope: str = "seen", known: DataFrame | None = None) -> Graph:
    """The graph of all chunks. ``known`` has nodes from before, whose labels may be referred to.

    Parsed chunks are written once, so the text is gone through once for nodes, labels and all kinds of edges.
    """
    p = stored(parsed(chunks, selection), "parsed")
    nodes = raw_nodes(p, selection)
    labels = stored(label_index(nodes), "labels")
    if known is not None:
        old = label_index(known).withColumn("first_seq", F.lit(-1).cast("long"))
        both = labels.withColumn("new", F.lit(1)).unionByName(old.withColumn("new", F.lit(0)))
        labels = both.groupBy("label").agg(F.max_by("id", "new").alias("id"), F.min("first_seq").alias("first_seq"))
    edges = raw_edges(p, labels, selection, label_scope)
    edges = chunks.sparkSession.createDataFrame([], EDGES) if edges is None else edges
    return Graph(upsert_nodes(nodes), upsert_edges(edges))


def extract_into(chunks: DataFrame, labeled, selection: Selection = Selection()) -> Graph:
    """Raw nodes and edges of a batch of chunks; ``labeled`` gives the nodes (id, source, seq) of the graph before that have some labels (label)."""
    p = stored(parsed(chunks, selection), "parsed")
    nodes = raw_nodes(p, selection)
    asked = p.select(F.explode(F.concat("refs", "said.label")).alias("label")).distinct()
    labels = stored(label_index(nodes.select("id", "source", "seq").unionByName(labeled(asked))), "labels")
    edges = raw_edges(p, labels, selection)
    return Graph(nodes, chunks.sparkSession.createDataFrame([], EDGES) if edges is None else edges)
