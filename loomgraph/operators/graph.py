"""Operators on graphs: ordered upserts, components, merging of aliases, pruning, views."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import START, WS, or_empty, squeeze, trim
from ..model import CONCEPT_TYPES, EDGES, META, NODES, STRONG_RELATIONS, Graph, columns_like, seq
from ..storage import broadcast_if_small, numbered, stored


# ---- upserts ---------------------------------------------------------------------------------------


def upserted(rows: DataFrame, keys: list[str], fields: list[Column]) -> DataFrame:
    """One row for each key: ``fields`` (named aggregates by seq), seq of the first, and meta merged key-wise.

    Each row becomes one entry for its fields and one for each entry of meta. They are reduced by
    (keys, entry), then by keys, so ``rows`` is read once and no key's rows meet unreduced.
    """
    none = F.lit(None).cast("string")
    entry = F.array(F.struct(none.alias("k"), none.alias("v")))
    more = F.transform(F.map_entries("meta"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    values = [c for c in rows.columns if c not in (*keys, "seq", "meta")]
    each = rows.select(*rows.columns, F.explode(F.concat(entry, F.coalesce(more, F.slice(entry, 1, 0)))).alias("_e"))
    each = each.select(*keys, "seq", F.col("_e.k").alias("_k"), F.col("_e.v").alias("_v"), *[F.when(F.col("_e.k").isNull(), F.col(c)).alias(c) for c in values])
    first = each.groupBy(*keys, "_k").agg(*fields, F.max_by("_v", "seq").alias("_v"), F.min("seq").alias("seq"))
    first = first.select(*keys, "_k", "_v", "seq", F.struct(*[c for c in first.columns if c not in (*keys, "_k", "_v", "seq")]).alias("_f"))
    entries = F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v"))))
    merged = first.groupBy(*keys).agg(F.max_by("_f", F.col("_k").isNull()).alias("_f"), F.min("seq").alias("seq"), entries.alias("_m"))
    return merged.select(*keys, "_f.*", "seq", F.when(F.size("_m") > 0, F.map_from_entries("_m")).alias("meta"))


def _last(name: str, null_overwrites: bool) -> Column:
    by = F.col("seq") if null_overwrites else F.when(F.col(name).isNotNull(), F.col("seq"))
    return F.max_by(name, by).alias(name)


def upsert_nodes(rows: DataFrame, null_overwrites: bool = False) -> DataFrame:
    """One node for each id: in the place of the first, with the last's fields; meta merges by key.

    A null content or source leaves the earlier one; with ``null_overwrites`` it erases it.
    """
    fields = [F.max_by("type", "seq").alias("type"), F.max_by("title", "seq").alias("title"), _last("content", null_overwrites), _last("source", null_overwrites)]
    return columns_like(upserted(rows, ["id"], fields), NODES)


def edge_key(meta: Column) -> Column:
    """The part of an edge's identity besides its ends and type: its chunk, if it names one."""
    return F.coalesce(meta["chunkId"], F.lit(""))


def upsert_edges(rows: DataFrame, null_overwrites: bool = False) -> DataFrame:
    """One edge for each source, type, target and chunk, merged like nodes.

    The chunk is the same in all rows of an edge, so it is taken out of meta before that is merged, and put back.
    """
    keyed = rows.withColumn("chunk", edge_key(F.col("meta")))
    keyed = keyed.withColumn("meta", F.when(F.col("chunk") != "", F.map_filter("meta", lambda k, v: k != "chunkId")).otherwise(F.col("meta")))
    made = upserted(keyed, ["source", "type", "target", "chunk"], [_last("id", null_overwrites), _last("evidence", null_overwrites)])
    own = F.array(F.struct(F.lit("chunkId").alias("key"), F.col("chunk").alias("value")))
    entries = F.concat(F.coalesce(F.map_entries("meta"), F.slice(own, 1, 0)), own)
    return columns_like(made.withColumn("meta", F.when(F.col("chunk") != "", F.map_from_entries(F.array_sort(entries))).otherwise(F.col("meta"))), EDGES)


def last_edges(rows: DataFrame) -> DataFrame:
    """One edge for each source, type, target and chunk: the last, in the place of the first; nothing merges."""
    last = rows.withColumn("chunk", edge_key(F.col("meta"))).groupBy("source", "type", "target", "chunk").agg(
        F.max_by(F.struct("id", "evidence", "meta"), "seq").alias("e"), F.min("seq").alias("seq")
    )
    return columns_like(last.select("source", "type", "target", "e.*", "seq"), EDGES)


def compacted(rows: DataFrame, keys: list[str], fields: list[str], schema: T.StructType) -> DataFrame:
    """The fewest of the rows that upsert to the same as all of them do, together with any rows to come.

    For each key: the first row (for its place), the last, the last with each field, and a row for
    each entry of meta; what others of them hold is null.
    """
    empty = {c: F.lit(None).cast(schema[c].dataType) for c in (*fields, "meta")}
    whole = lambda keep: F.struct(*[(F.col(f.name) if f.name not in empty or f.name == keep else empty[f.name]).alias(f.name) for f in schema])
    picks = [F.min_by(whole(None), "seq"), F.max_by(whole(None), "seq"), *[F.max_by(whole(c), F.when(F.col(c).isNotNull(), F.col("seq"))) for c in fields]]
    kept = rows.groupBy(*keys).agg(F.array_compact(F.array(*picks)).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    entries = rows.filter("meta is not null").select("*", F.explode("meta").alias("k", "v"))
    last = entries.groupBy(*keys, "k").agg(F.max_by(F.struct(*[F.col(f.name) for f in schema if f.name not in empty], "v"), "seq").alias("r"))
    metas = last.select("r.*", "k").withColumns({**{c: empty[c] for c in fields}, "meta": F.create_map("k", "v")})
    return columns_like(kept, schema).unionByName(columns_like(metas, schema))


def compact_nodes(rows: DataFrame) -> DataFrame:
    return compacted(rows, ["id"], ["content", "source"], NODES)


def compact_edges(rows: DataFrame) -> DataFrame:
    """As for nodes; the chunk that is part of the key stays with each row."""
    keyed = rows.withColumn("_chunk", edge_key(F.col("meta")))
    made = compacted(keyed.select(*rows.columns, "_chunk"), ["source", "type", "target", "_chunk"], ["id", "evidence"], T.StructType([*EDGES.fields, T.StructField("_chunk", T.StringType())]))
    named = F.when(F.col("_chunk") != "", F.map_concat(F.map_filter(F.coalesce("meta", F.create_map().cast(META)), lambda k, v: k != "chunkId"), F.create_map(F.lit("chunkId"), F.col("_chunk")))).otherwise(F.col("meta"))
    return columns_like(made.withColumn("meta", named), EDGES)


def after(graph: Graph, offset: Column) -> tuple[DataFrame, DataFrame]:
    later = lambda df: df.withColumn("seq", seq(F.col("seq.major") + offset, F.col("seq.minor")))
    return later(graph.nodes), later(graph.edges)


def sizes(graph: Graph) -> dict[str, int]:
    """In one pass: how many nodes, concepts and edges there are, and top, the first place (seq.major) after all of theirs."""
    of = lambda df, kind, concept: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(concept).alias("concepts"), F.max("seq.major").alias("top"))
    both = of(graph.nodes, "node", F.col("type").isin(*CONCEPT_TYPES)).unionByName(of(graph.edges, "edge", F.lit(False)))
    n, e = sorted(both.collect(), key=lambda r: r["kind"], reverse=True)
    return {"nodes": n["n"], "edges": e["n"], "concepts": n["concepts"], "top": max(-1 if r["top"] is None else r["top"] for r in (n, e)) + 1}


def merge_graphs(old: Graph, new: Graph, null_overwrites: bool = False, top: int | None = None) -> Graph:
    """``new`` upserted into ``old``: all that ``new`` has comes after what ``old`` has, which ends before ``top``, if that is known."""
    if top is None:
        top = sizes(old)["top"]
    nodes, edges = after(new, F.lit(top))
    return Graph(upsert_nodes(old.nodes.unionByName(nodes), null_overwrites), upsert_edges(old.edges.unionByName(edges), null_overwrites))


def merge_few(old: Graph, new: Graph, null_overwrites: bool, top: int) -> Graph:
    """merge_graphs() where ``new`` is a wave's and ``old`` comes from merge_graphs(): what ``new`` doesn't touch is taken over as it is and not shuffled."""
    nodes, edges = after(new, F.lit(top))
    chunk = edge_key(F.col("meta")).alias("_chunk")

    def merged_rows(own: DataFrame, more: DataFrame, keys: list, upsert: Callable) -> DataFrame:
        names = [f"_k{i}" for i in range(len(keys))]
        touched = F.broadcast(more.select(*[k.alias(n) for k, n in zip(keys, names)]).distinct())
        keyed = own.withColumns(dict(zip([f"_o{n}" for n in names], keys)))
        on = [F.col(f"_o{n}") == F.col(n) for n in names]
        part = lambda how: keyed.join(touched, on, how).select(*own.columns)
        return part("left_anti").unionByName(upsert(part("left_semi").unionByName(more), null_overwrites))

    return Graph(merged_rows(old.nodes, nodes, [F.col("id")], upsert_nodes), merged_rows(old.edges, edges, [F.col("source"), F.col("type"), F.col("target"), chunk], upsert_edges))


def patch_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """``nodes`` with the patches' non-null title, content and meta entries; unknown ids are ignored.

    ``patches`` has id, title, content, meta; of several for an id the last by the column ``nth`` counts, if there is one.
    """
    nth = F.col("nth") if "nth" in patches.columns else F.lit(0)
    last = patches.groupBy("id").agg(F.max_by(F.struct("title", "content", "meta"), nth).alias("_p"))
    joined = nodes.join(last, "id", "left")
    kept = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.coalesce(F.map_keys("_p.meta"), F.array().cast("array<string>")), k))
    meta = F.when(F.col("_p.meta").isNotNull(), F.map_concat(kept, "_p.meta")).otherwise(F.col("meta"))
    return columns_like(joined.withColumns({"title": F.coalesce("_p.title", "title"), "content": F.coalesce("_p.content", "content"), "meta": meta}), NODES)


# ---- components and aliases ----------------------------------------------------------------------


#: An id with more edges than HUB in a round has them dealt into so many parts.
SALTS, HUB = 16, 100_000
#: A task merges so many edges at once; once no more are left, one task ends the work.
MERGED = 500_000


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) for all ids in ``pairs`` (a, b): component is the smallest id that it reaches.

    Each task first merges the edges that it has into stars, so chains within a task are one step. Few edges of many tasks meet in
    tasks of up to MERGED, which merge them again: an id that many tasks link keeps an edge a task. Then an id
    whose only edge leads to a smaller one is a leaf: it takes that one's component in the end and is left out of what follows, so rounds
    go over what tasks share alone. While more than MERGED edges are left, rounds of large and small stars point the neighbours of each id to the
    smallest of them, and tasks merge again; rounds grow with the logarithm of the longest chain.
    Each is a written table. When MERGED edges or fewer are left, which their count tells, one task merges them.
    """
    edges = stored(merged(pairs.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v")), "pairs")
    left, levels = edges.count(), []
    if left > MERGED:
        leaves, edges = peeled(stored(merged(edges.coalesce(-(-left // max(1, MERGED)))), "pairs"))
        levels.append(leaves)
        while (left := edges.count()) > MERGED:
            leaves, edges = peeled(stored(large_stars(edges), "pairs"))
            levels.append(leaves)
    if left:
        edges = stored(merged(edges.coalesce(1)), "pairs")
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for leaves in reversed(levels):
        found = broadcast_if_small(ends.select(F.col("id").alias("component"), F.col("component").alias("_c")))
        ends = stored(ends.unionByName(leaves.join(found, "component", "left").select("id", F.coalesce("_c", "component").alias("component"))), "ends")
    alone = stored(pairs.filter("a = b").select(F.col("a").alias("id")).distinct(), "alone")
    linked = stored(ends.join(broadcast_if_small(alone), "id", "left_semi").select("id"), "linked")
    roots = ends.select(F.col("component").alias("id")).unionByName(alone.join(broadcast_if_small(linked), "id", "left_anti")).distinct()
    return ends.unionByName(roots.select("id", F.col("id").alias("component")))


def peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves (id, component: the one neighbour, which is smaller), and the other edges (v, u) as small stars, merged."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    around = ends.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("_most"), F.count("v").alias("n"), F.count(F.lit(1)).alias("_all")).filter("m is not null")
    around = stored(around.select("u", "m", "n", ((F.col("m") == F.col("_most")) & (F.col("n") == F.col("_all"))).alias("leaf")), "around")
    leaves = around.filter("leaf").select(F.col("u").alias("id"), F.col("m").alias("component"))
    return leaves, stored(merged(small_stars(edges, around.filter("not leaf").drop("leaf"))), "pairs")


def large_stars(edges: DataFrame) -> DataFrame:
    """The larger neighbours of each id to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each id u of ``least`` (u, m: its smallest neighbour, n) and its smaller neighbours to m: an edge for each id and each other neighbour."""
    others = with_least(edges, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m of their u from ``least`` (u, m, n). Edges of hubs, and hubs alone, are dealt by a salt of their other ends."""
    least = stored(least, "least")
    hubs = stored(least.filter(F.col("n") > HUB).select("u", F.lit(SALTS).alias("salts")), "hubs")
    few = broadcast_if_small(least)
    if few is not least or hubs.isEmpty():
        return edges.join(few.drop("n"), "u")
    dealt_edges = edges.join(broadcast_if_small(hubs), "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HUB, SALTS - 1).otherwise(0)))).drop("n")
    return dealt_edges.join(every, ["u", "salt"]).drop("salt")


def merged(edges: DataFrame) -> DataFrame:
    """Edges (v, u) of each task as stars: each id to the smallest that it reaches among up to MERGED edges."""

    def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        n = sum(b.num_rows for b in batches)
        ends = pa.concat_arrays([b.column(c) for c in ("v", "u") for b in batches]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[ends.indices.to_numpy()]
        v, u = codes[:n], codes[n:]
        up = np.arange(len(order))
        while len(u):
            a, b = up[v], up[u]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up, up[up]):
                up = up[up]
            differ = up[v] != up[u]
            v, u = v[differ], u[differ]
        own = np.flatnonzero(up != np.arange(len(up)))
        return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(order[x])) for x in (up[own], own)], names=["v", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > MERGED:
                held = [stars(held)]
                if held[0].num_rows > MERGED // 2:  # all different ids: nothing more to merge with
                    yield held[0]
                    held = []
                size = sum(b.num_rows for b in held)
        if size:
            yield stars(held)

    return edges.select("v", "u").mapInArrow(run, edges.select("v", "u").schema)


@dataclass(frozen=True)
class Components:
    """Components of a graph whose pairs come in batches.

    ``labels`` (id, component) has each id as it was first named, ``moved`` (id, component) what has become
    of the components that later pairs joined. A batch adds rows for its new ids and for the components that it
    touches; no other id's row is written again.
    """

    labels: DataFrame
    moved: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, kind: str = "string") -> Components:
        none = spark.createDataFrame([], f"id {kind}, component {kind}")
        return cls(none, none)

    def current(self) -> DataFrame:
        """(id, component) of all ids: the smallest id that each reaches."""
        now = self.moved.select(F.col("id").alias("component"), F.col("component").alias("_now"))
        return self.labels.join(now, "component", "left").select("id", F.coalesce("_now", "component").alias("component"))

    def of(self, ids: DataFrame) -> DataFrame:
        """current() for ``ids`` (id) alone."""
        return Components(self.labels.join(broadcast_if_small(ids), "id", "left_semi"), self.moved).current()

    def add(self, pairs: DataFrame) -> Components:
        """With the links of ``pairs`` (a, b)."""
        pairs = stored(pairs.select("a", "b"), "new-pairs")
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "new-ids")
        known = stored(self.of(ids), "known")
        named = lambda df, end: df.join(known.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end, "left")
        ends = named(named(pairs, "a"), "b").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
        found = stored(components(ends), "joined")
        new = ids.join(known, "id", "left_anti").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        now = found.filter("id <> component")
        touched = self.moved.join(now.select(F.col("id").alias("component"), F.col("component").alias("_now")), "component", "left").select("id", F.coalesce("_now", "component").alias("component"))
        roots = known.select(F.col("component").alias("id")).distinct().join(now, "id")
        return Components(self.labels.unionByName(stored(new, "labels")), stored(touched.unionByName(roots.select("id", "component")), "moved"))


def union_pairs(graph: Graph, aligned: DataFrame | None = None) -> DataFrame:
    """(a, b): nodes and the id that their label stands for; concepts that an edge calls equivalent; aligned concepts."""
    label = F.col("source.latexLabel")
    by_label = graph.nodes.filter(label != "").select(F.col("id").alias("a"), F.concat(F.lit("tex:"), label).alias("b"))
    concepts = graph.nodes.filter(F.col("type").isin(*CONCEPT_TYPES)).select("id").distinct()
    asked = graph.edges.filter("type = 'EquivalentTo'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    if aligned is not None:
        asked = asked.unionByName(aligned.select(F.col("alias").alias("a"), F.col("canonical").alias("b")))
    both = asked.join(concepts.withColumnRenamed("id", "a"), "a", "left_semi").join(concepts.withColumnRenamed("id", "b"), "b", "left_semi")
    return by_label.unionByName(both)


def alias_table(graph: Graph, aligned: DataFrame | None = None) -> DataFrame:
    """(id, canonical) of the nodes that have an alias group: its first ``tex:`` node, else its first node.

    Ids that no node has take part in groups, but get no row and are never canonical.
    """
    places = graph.nodes.select("id", "seq")
    groups = stored(components(union_pairs(graph, aligned)).join(places, "id"), "alias-groups")
    first = groups.groupBy("component").agg(F.min_by("id", F.struct((~F.col("id").startswith("tex:")).alias("plain"), F.col("seq"))).alias("canonical"))
    return groups.join(first, "component").select("id", "canonical")


def rewrite(df: DataFrame, column: str, alias: DataFrame) -> DataFrame:
    """``column`` of ``df`` with its canonical id where it has one."""
    named = alias.select(F.col("id").alias("_id"), F.col("canonical").alias("_canonical"))
    return df.join(named, df[column] == F.col("_id"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_id", "_canonical")


def merge_aliases(nodes: DataFrame, alias: DataFrame) -> DataFrame:
    """Nodes of a group in one: later fields win, type included; the longest title and content (ties: the earlier); source and meta merge."""
    rows = rewrite(nodes, "id", alias)
    longest = lambda c: F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(0)).alias("n"), (-F.col("seq.major")).alias("a"), (-F.col("seq.minor")).alias("b"))).alias(c)
    field = lambda f: F.max_by(F.col(f"source.{f}"), F.when(F.col(f"source.{f}").isNotNull(), F.col("seq"))).alias(f)
    fields = [F.max_by("type", "seq").alias("type"), longest("title"), longest("content"), field("file"), field("lineHint"), field("latexLabel"), field("sectionPath"), F.max(F.col("source").isNotNull()).alias("_has")]
    merged = upserted(rows, ["id"], fields)
    merged = merged.withColumn("source", F.when(F.col("_has"), F.struct("file", "lineHint", "latexLabel", "sectionPath")))
    return columns_like(merged, NODES)


def rewrite_edges(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Ends by alias; loops go."""
    return columns_like(rewrite(rewrite(edges, "source", alias), "target", alias).filter("source <> target"), EDGES)


def freeze(graph: Graph, aligned: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The graph with each alias group as one node, and the alias table that later batches go through."""
    alias = stored(alias_table(graph, aligned), "alias")
    return Graph(merge_aliases(graph.nodes, alias), last_edges(rewrite_edges(graph.edges, alias))), alias


def apply_alias(graph: Graph, alias: DataFrame) -> Graph:
    """A later batch under the frozen names: a labeled node goes by its label's id, others by their own."""
    label = F.col("source.latexLabel")
    own = F.when(label != "", F.concat(F.lit("tex:"), label)).otherwise(F.col("id"))
    return Graph(columns_like(rewrite(graph.nodes.withColumn("id", own), "id", alias), NODES), rewrite_edges(graph.edges, alias))


# ---- degrees, pruning, views ---------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, strong): ends of edges at each id, also if no node has it; a loop counts twice. strong: without Contains."""
    strong = F.col("type").isin(*STRONG_RELATIONS)
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), strong.cast("int").alias("s")).filter("id <> ''")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("s").alias("strong"))


# Formulas that are templates.
_TEMPLATES = (
    rf"P[{WS}]*\([{WS}]*[A-Za-z]\\?[_A-Za-z0-9]*[{WS}]*=[{WS}]*[A-Za-z0-9_{{}}\\]+[{WS}]*\)[{WS}]*=[{WS}]*p[{WS}]*\(",
    rf"P\\left\([{WS}]*[A-Za-z]\\?[_A-Za-z0-9]*[{WS}]*=[{WS}]*[A-Za-z0-9_{{}}\\]+[{WS}]*\\right\)[{WS}]*=[{WS}]*p\\left\(",
    rf"{START}f_?[A-Za-z][{WS}]*\([{WS}]*[A-Za-z][{WS}]*\)",
    rf"p_?[A-Za-z][{WS}]*\([{WS}]*[A-Za-z][{WS}]*\)",
)


def is_template(c: Column) -> Column:
    """Common forms of probabilities and densities, and domains without bounds."""
    t = squeeze(or_empty(c))
    found = t.rlike(_TEMPLATES[0]) | t.rlike(_TEMPLATES[1]) | t.rlike(_TEMPLATES[2]) | t.rlike(_TEMPLATES[3])
    return found | (t.contains("\\infty") & t.rlike(rf"-[{WS}]*\\infty") & t.rlike(rf"<[{WS}]*[A-Za-z]"))


def is_problem_indexed(c: Column) -> Column:
    """Objects numbered within a problem, like Omega_5, or E_7 in something short."""
    t = F.regexp_replace(or_empty(c), f"[{WS}]+", "")
    return t.rlike(r"\\Omega_\{?\d+\}?") | (t.rlike(r"[A-Za-z]_\{?\d+\}?") & (F.length(t) <= 25))


def is_noise(strong: Column) -> Column:
    """Formulas without a label or a strong relation that are templates, indexed or short."""
    label = F.coalesce(F.col("source.latexLabel"), F.lit("")) == ""
    content, title = trim(or_empty(F.col("content"))), trim(or_empty(F.col("title")))
    poor = is_template(content) | is_template(title) | is_problem_indexed(content) | is_problem_indexed(title) | (F.length(content) < 120)
    return (F.col("type") == "Formula") & label & ~F.col("id").startswith("tex:") & (F.coalesce(strong, F.lit(0)) == 0) & poor


def marked_noise(graph: Graph) -> DataFrame:
    strong = degrees(graph.edges).select("id", "strong")
    return graph.nodes.join(strong, "id", "left").withColumn("noise", F.coalesce(is_noise(F.col("strong")), F.lit(False))).drop("strong")


def prune(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph without noise and without edges that miss an end; the dropped nodes' ids (by place).

    The marked nodes are written once; nodes, edges and dropped ids read them by columns.
    """
    marked = stored(marked_noise(graph), "marked")
    kept = columns_like(marked.filter("not noise"), NODES)
    return Graph(kept, between(graph.edges, kept)), marked.filter("noise").select("id", "seq")


def prune_stats(graph: Graph) -> dict:
    """What prune() drops: counts, and the ids in order (for small graphs)."""
    pruned, dropped = prune(graph)
    ids = [r["id"] for r in dropped.orderBy("seq").collect()]
    return {"dropped_nodes": ids, "dropped_edges": graph.edges.count() - pruned.edges.count()}


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes. The nodes' ids are written once; while they are few they are broadcast, else ends with more than HUB edges alone are."""
    ids = stored(nodes.select(F.col("id").alias("_n")).distinct(), "ids")
    few = broadcast_if_small(ids)
    if few is not ids:
        return edges.join(few, edges["source"] == few["_n"], "left_semi").join(few, edges["target"] == few["_n"], "left_semi")
    for end in ("source", "target"):
        named = edges.groupBy(F.col(end).alias("_n")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB)
        hubs = F.broadcast(stored(named.join(ids.withColumn("_is", F.lit(True)), "_n", "left").select(F.col("_n").alias("_h"), F.coalesce("_is", F.lit(False)).alias("_is")), "hubs"))
        marked = edges.join(hubs, edges[end] == hubs["_h"], "left").drop("_h")
        others = marked.filter("_is is null")
        edges = marked.filter("_is").unionByName(others.join(ids, others[end] == ids["_n"], "left_semi")).drop("_is")
    return edges


def view(graph: Graph, show_examples: bool = True, show_exercises: bool = True, show_isolated: bool = True) -> Graph:
    """The graph without hidden types, and without nodes that then have no edge. With all shown nothing changes."""
    nodes, edges = graph.nodes, graph.edges
    hidden = [t for t, shown in (("Example", show_examples), ("Exercise", show_exercises)) if not shown]
    if hidden:
        nodes = nodes.filter(~F.col("type").isin(*hidden))
        edges = between(edges, nodes)
    if show_isolated:
        return Graph(nodes, edges)
    # Ends of the edges that are left are never isolated, so only edges that dangled all along go with the nodes.
    shown = stored(edges, "shown-edges")
    ends = shown.select(F.explode(F.array("source", "target")).alias("id")).filter("id <> ''").distinct()
    joined = nodes.join(ends, "id", "left_semi").select(*graph.nodes.columns)
    return Graph(joined, shown if hidden else between(shown, nodes))


def view_elements(graph: Graph) -> DataFrame:
    """(kind, data): elements for a graph viewer, nodes before edges, as maps; a node's meta may replace any entry."""
    own = F.create_map(
        F.lit("id"), "id", F.lit("label"), F.concat("type", F.lit(": "), "title"), F.lit("type"), "type", F.lit("title"), "title", F.lit("content"), or_empty(F.col("content"))
    )
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(meta), k))
    nodes = graph.nodes.select(F.lit("node").alias("kind"), F.map_concat(kept, meta).alias("data"), "seq")
    number = place_of(graph.edges)
    name = F.coalesce("id", F.concat_ws("-", "source", "type", "target", F.col("place").cast("string")))
    edges = number.select(
        F.lit("edge").alias("kind"),
        F.create_map(F.lit("id"), name, F.lit("source"), "source", F.lit("target"), "target", F.lit("label"), "type", F.lit("type"), "type", F.lit("evidence"), or_empty(F.col("evidence"))).alias("data"),
        "seq",
    )
    return nodes.unionByName(edges)


def place_of(rows: DataFrame) -> DataFrame:
    """``rows`` with place: their number from 0 by seq."""
    return numbered(rows, ["seq"], "place")
