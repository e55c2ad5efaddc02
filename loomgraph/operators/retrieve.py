"""Retrieval for prompts: what of the graph is relevant to a chunk, and the registry of concepts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import END, WS, all_groups, once, or_empty, trim
from ..model import CONCEPT_TYPES, Graph
from ..storage import broadcast_if_small, stored, stored_together
from .extract import LABEL, REFERENCE

WORDS, HEAD, SHORTEST = 41, 600, 4
NODES_SHOWN, EDGES_SHOWN, CONCEPTS_SHOWN = 120, 120, 220
#: So many chunks at most, as in a wave, are held by each task that goes over the graph, and it goes over so many rows at least.
FEW, ROWS = 1000, 5_000


def queries(chunks: DataFrame) -> DataFrame:
    """(chunk_seq, labels, words, hint): labels that the chunk has or refers to, words of its title, path and head, the end of its path."""
    text = F.col("text")
    labels = F.array_distinct(F.transform(F.concat(all_groups(text, REFERENCE, 2), all_groups(text, LABEL, 1)), trim))
    raw = F.concat_ws(" ", "title", F.array_join("section_path", " "), F.substring(text, 1, HEAD))
    raw = F.regexp_replace(F.regexp_replace(raw, f"[{WS}]+", " "), rf"\\[a-zA-Z]+{END}", " ")
    split = F.split(F.lower(F.regexp_replace(raw, r"[^\p{L}\p{N}]+", " ")), " ")
    words = F.slice(F.array_distinct(F.filter(split, lambda w: F.length(w) >= SHORTEST)), 1, WORDS)
    return chunks.select("chunk_seq", labels.alias("labels"), words.alias("words"), path_end(F.col("section_path")).alias("hint"))


def path_end(path: Column) -> Column:
    """The last two parts of a path."""
    return F.array_join(F.when(F.size(path) > 2, F.slice(path, -2, 2)).otherwise(path), " / ")


def by_terms(nodes: DataFrame, *more: str) -> DataFrame:
    """(id, seq, t, label, end): what nodes are found by. Their titles in lower case, labels, and ends of paths; and the columns ``more``."""
    end = path_end(F.coalesce("source.sectionPath", F.array().cast("array<string>")))
    return nodes.select("id", "seq", F.lower(or_empty(F.col("title"))).alias("t"), F.col("source.latexLabel").alias("label"), end.alias("end"), *more)


def scored(nodes: DataFrame, asked: DataFrame, most: int = NODES_SHOWN) -> DataFrame:
    """scored_by() of a graph's nodes."""
    return scored_by(*stored_together(found_by=by_terms(nodes), asked=asked), most)


def scored_by(n: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(chunk_seq, id, seq, score) of nodes ``n`` (by_terms) with a score for a chunk of ``asked``, both written, among them each chunk's ``most`` best ones.

    Each part of the score is found by a join of its own, so no node is paired with a chunk that it
    has nothing to do with: by label, by id, and by words. A word counts if
    the title contains it, in other words too, so the titles' words are cut into all their parts of
    4 characters, joined with the first 4 of each sought word, and then verified. Words that are in more than ``most`` titles
    pair no nodes with chunks by themselves: nodes with the same of these words and the same end of their path score alike, but for
    what else they are found by, so the first ``most`` of them will do. Nodes found so are looked up by the end of their path. Of those that have nothing but that in common with a chunk, a section's
    first ``most`` will do: whichever of these are found otherwise, too, come before all of its others.
    """
    labels = asked.select("chunk_seq", F.explode("labels").alias("l"))
    found = ["chunk_seq", "id", "seq", "end"]
    by_label = n.filter("label <> ''").join(labels, F.col("label") == F.col("l")).select(*found, F.lit(20).alias("score"))
    by_id = n.filter(F.col("id").startswith("tex:")).withColumn("own", F.expr("substring(id, 5)")).join(labels, F.col("own") == F.col("l")).select(*found, F.lit(20).alias("score"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t") - (SHORTEST - 1))), lambda i: F.substring("t", i, F.lit(SHORTEST))))
    words = asked.select("chunk_seq", F.explode("words").alias("w")).withColumn("gram", F.substring("w", 1, SHORTEST))
    distinct = broadcast_if_small(words.select("w", "gram").distinct())  # titles meet words once, whatever number of chunks asks for them
    titles = stored(n.withColumn("gram", F.explode(grams)).join(distinct, "gram").filter(F.contains("t", F.col("w"))).select("id", "seq", "end", "w").distinct(), "titles")
    counts = titles.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rare, frequent = counts.filter(F.col("n") <= most), counts.filter(F.col("n") > most)
    by_word = titles.join(words.select("chunk_seq", "w").join(rare, "w", "left_semi"), "w").select(*found, F.lit(2).alias("score"))
    often = titles.join(frequent, "w", "left_semi").groupBy("id", "seq").agg(F.max("end").alias("end"), F.array_sort(F.collect_set("w")).alias("often"))
    alike = Window.partitionBy("often", "end").orderBy("seq")
    first_alike = often.withColumn("_r", F.row_number().over(alike)).filter(F.col("_r") <= most).drop("_r")
    sets = first_alike.select("often").distinct().withColumn("w", F.explode("often")).join(words.select("chunk_seq", "w"), "w").select("often", "chunk_seq").distinct()
    by_often = first_alike.join(sets, "often").select(*found, F.lit(0).alias("score"))
    others = by_label.unionByName(by_id).unionByName(by_word).unionByName(by_often).groupBy("chunk_seq", "id", "seq").agg(F.sum("score").alias("score"), F.max("end").alias("end"))
    hints = broadcast_if_small(asked.select("chunk_seq", "hint"))
    shared = 2 * F.coalesce(F.size(F.array_intersect("often", "words")), F.lit(0))
    others = others.join(often.select("id", "seq", "often"), ["id", "seq"], "left").join(broadcast_if_small(asked.select("chunk_seq", "words", "hint")), "chunk_seq")
    others = others.select("chunk_seq", "id", "seq", (F.col("score") + F.when(F.col("often").isNotNull(), shared).otherwise(0) + F.when((F.col("end") != "") & (F.col("end") == F.col("hint")), 3).otherwise(0)).cast("int").alias("score"))
    first = Window.partitionBy("end").orderBy("seq")
    of_sections = n.filter("end <> ''").join(hints.select(F.col("hint").alias("end")).distinct(), "end", "left_semi").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most)
    by_path = of_sections.join(hints, F.col("end") == F.col("hint")).select("chunk_seq", "id", "seq", F.lit(3).alias("score"))
    return others.unionByName(by_path).groupBy("chunk_seq", "id", "seq").agg(F.max("score").alias("score"))


def shown_nodes(graph: Graph, chunks: DataFrame, most: int = NODES_SHOWN) -> DataFrame:
    """(chunk_seq, place, id, score): for each chunk the nodes of highest score (ties: the earlier), then the graph's first ones with 0.

    A chunk never needs more than the first ``most`` nodes to fill up, so only those are paired with chunks.
    """
    n, asked = stored_together(found_by=by_terms(graph.nodes), asked=queries(chunks))
    best = stored(scored_by(n, asked, most), "scored")
    first = n.select("id", "seq").orderBy("seq").limit(most)  # at most `most` rows
    fill = asked.select("chunk_seq").join(F.broadcast(first), F.lit(True)).join(best.select("chunk_seq", "id"), ["chunk_seq", "id"], "left_anti").withColumn("score", F.lit(0))
    order = Window.partitionBy("chunk_seq").orderBy(F.desc("score"), "seq")
    every = best.unionByName(fill.select("chunk_seq", "id", "seq", "score")).withColumn("place", F.row_number().over(order))
    return every.filter(F.col("place") <= most).select("chunk_seq", (F.col("place") - 1).alias("place"), "id", "score")


def shown_edges(graph: Graph, shown: DataFrame, most: int = EDGES_SHOWN) -> DataFrame:
    """(chunk_seq, place, type, source, target): the first edges with an end among a chunk's shown nodes."""
    of = shown.select("chunk_seq", F.col("id").alias("_id"))
    e = graph.edges.select("type", "source", "target", "seq")
    touched = e.join(of, e["source"] == of["_id"]).unionByName(e.join(of, e["target"] == of["_id"])).drop("_id").distinct()
    order = Window.partitionBy("chunk_seq").orderBy("seq")
    return touched.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("chunk_seq", (F.col("place") - 1).alias("place"), "type", "source", "target")


class Asked:
    """What a few chunks ask for (queries()), by what nodes are found by."""

    def __init__(self, rows: list):
        self.chunks, self.grams = [r["chunk_seq"] for r in rows], {}
        by = lambda values: {x: np.array(own) for x, own in _places(values).items()}
        self.words, self.labels, self.hints = by([r["words"] or [] for r in rows]), by([r["labels"] or [] for r in rows]), by([[r["hint"]] if r["hint"] else [] for r in rows])
        for w in self.words:
            self.grams.setdefault(w[:SHORTEST], set()).add(len(w))

    def marks(self, node_id: str, t: str, label: str | None, end: str) -> tuple:
        """What a node is found by; nodes with the same marks score alike for each chunk."""
        words = frozenset(w for i in range(len(t) - SHORTEST + 1) for n in self.grams.get(t[i : i + SHORTEST], ()) if (w := t[i : i + n]) in self.words)
        own = node_id[4:] if node_id.startswith("tex:") else None
        return words, label if label and label in self.labels else None, own if own in self.labels else None, end if end in self.hints else None

    def scores(self, marks: tuple) -> np.ndarray:
        """The score of a node with these marks for each chunk."""
        words, label, own, end = marks
        score = np.zeros(len(self.chunks), np.int32)
        for found, by, worth in ((words, self.words, 2), ([label], self.labels, 20), ([own], self.labels, 20), ([end], self.hints, 3)):
            for x in found:
                if x is not None:
                    score[by[x]] += worth
        return score


def _places(values: list) -> dict:
    """Of each value of the lists the numbers of those that hold it."""
    at: dict = {}
    for i, own in enumerate(values):
        for x in own:
            at.setdefault(x, []).append(i)
    return at


def best_of(rows: list[tuple], asked: Asked, most: int, block: int = 1 << 13) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of ``rows`` (seq, marks, ...), by seq, for each chunk the ``most`` best ones: their numbers and scores."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked.chunks]
    for start in range(0, len(rows), block):
        kinds: dict = {}
        kind = np.array([kinds.setdefault(r[1], len(kinds)) for r in rows[start : start + block]], np.int64)
        scores = np.stack([asked.scores(m) for m in kinds])
        number = np.arange(start, start + len(kind))
        for c, (before, had) in enumerate(best):
            row, score = np.concatenate([before, number]), np.concatenate([had, scores[kind, c]])
            if len(row) > most:
                first = np.argpartition(row - score * len(rows), most)[:most]
                row, score = row[first], score[first]
            best[c] = row, score
    return best


def best_nodes(nodes: DataFrame, asked: Asked, most: int) -> DataFrame:
    """(chunk_seq, own: score below 0, seq, id, line): of each task's nodes (by_terms and line) those of highest score for each chunk (ties: the earlier), ``most`` of them.

    A task keeps the first ``most`` nodes of those with the same marks, and scores what it has kept whenever that has doubled; so it holds
    what is shown to its chunks, and as much again.
    """
    chunks = np.array(asked.chunks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, limit = {}, 0, 1 << 13

        def ordered():
            return sorted((r for own in kept.values() for r in sorted(own, key=lambda r: r[0])[:most]), key=lambda r: r[0])

        for b in batches:
            for major, minor, node_id, t, label, end, line in zip(*(b.column(c).to_pylist() for c in ("major", "minor", "id", "t", "label", "end", "line"))):
                marks = asked.marks(node_id, t, label, end)
                own = kept.setdefault(marks, [])
                own.append(((major, minor), marks, node_id, line))
                n += 1
                if len(own) > 2 * most:
                    own.sort(key=lambda r: r[0])
                    n -= len(own) - most
                    del own[most:]
            if n > limit:
                rows, kept = ordered(), {}
                used = np.unique(np.concatenate([first for first, _ in best_of(rows, asked, most)])) if len(rows) > most else range(len(rows))
                for i in used:
                    kept.setdefault(rows[i][1], []).append(rows[i])
                n = len(used)
                limit = max(1 << 13, 2 * n)
        rows = ordered()
        if not rows:
            return
        found = best_of(rows, asked, most)
        columns = [pa.array([x[k] for x, *_ in rows], pa.int64()) for k in (0, 1)] + [pa.array([r[k] for r in rows], pa.string()) for k in (2, 3)]
        yield from arrays(chunks, found, columns, _NODE_SHOWN)

    flat = nodes.select(F.col("seq.major").alias("major"), F.col("seq.minor").alias("minor"), "id", "t", "label", "end", "line")
    return flat.mapInArrow(run, f"chunk_seq long, own array<struct<{', '.join(f'{c}: {k}' for c, k in _NODE_SHOWN.items())}>>")


#: What a task gives of a shown node, and of a shown edge.
_NODE_SHOWN = {"score": "long", "major": "long", "minor": "long", "id": "string", "line": "string"}
_EDGE_SHOWN = {"major": "long", "minor": "long", "line": "string"}


def arrays(chunks: np.ndarray, found: list[tuple], columns: list[pa.Array], fields: dict, block: int = 50) -> Iterator[pa.RecordBatch]:
    """A row for each chunk with an array of ``fields``: of ``found`` (numbers of rows, scores if there are any) the scores, below 0, and the rows of ``columns``."""
    for i in range(0, len(found), block):
        part = found[i : i + block]
        take = pa.array(np.concatenate([own[0] for own in part]))
        scores = [pa.array(-np.concatenate([own[1] for own in part]).astype(np.int64))] if len(part[0]) > 1 else []
        items = pa.StructArray.from_arrays([*scores, *(c.take(take) for c in columns)], names=list(fields))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(own[0]) for own in part])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(chunks[i : i + block]), pa.ListArray.from_arrays(offsets, items)], names=["chunk_seq", "own"])


def first_edges(edges: DataFrame, shown: dict[str, np.ndarray], chunks: list[int], most: int) -> DataFrame:
    """(chunk_seq, own: seq, line): of each task's edges the first ``most`` with an end among a chunk's shown nodes; ``shown`` has of a node's id the numbers of its chunks."""
    places = np.array(chunks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at, n, limit = [], [], 0, 1 << 20

        def first(rows, at):
            order = sorted(range(len(rows)), key=lambda i: rows[i][0])
            chunk = np.concatenate([at[i] for i in order])
            row = np.repeat(np.array(order), [len(at[i]) for i in order])
            by = np.argsort(chunk, kind="stable")
            chunk, row = chunk[by], row[by]
            nth = np.arange(len(chunk)) - np.searchsorted(chunk, chunk)
            return chunk[nth < most], row[nth < most]

        for b in batches:
            for major, minor, source, target, line in zip(*(b.column(c).to_pylist() for c in ("major", "minor", "source", "target", "line"))):
                one, other = shown.get(source), shown.get(target)
                if one is None and other is None:
                    continue
                own = other if one is None else one if other is None or other is one else np.union1d(one, other)
                rows.append(((major, minor), line))
                at.append(own)
                n += len(own)
            if n > limit:
                chunk, row = first(rows, at)
                back: dict = {}
                for c, r in zip(chunk.tolist(), row.tolist()):
                    back.setdefault(r, []).append(c)
                rows, at, n = [rows[r] for r in back], [np.array(own) for own in back.values()], len(chunk)
                limit = max(1 << 20, 2 * n)
        if rows:
            chunk, row = first(rows, at)
            columns = [pa.array([x[k] for x, _ in rows], pa.int64()) for k in (0, 1)] + [pa.array([line for _, line in rows], pa.string())]
            own, at = np.unique(chunk, return_index=True)
            yield from arrays(places[own], [(r,) for r in np.split(row, at[1:])], columns, _EDGE_SHOWN)

    flat = edges.select(F.col("seq.major").alias("major"), F.col("seq.minor").alias("minor"), "source", "target", F.concat(F.lit("- ("), "type", F.lit(") "), "source", F.lit(" -> "), "target").alias("line"))
    return flat.mapInArrow(run, f"chunk_seq long, own array<struct<{', '.join(f'{c}: {k}' for c, k in _EDGE_SHOWN.items())}>>")


@once
def node_line() -> Column:
    """A node as a line of a summary."""
    label = F.when(F.col("source.latexLabel").isNotNull(), F.concat(F.lit(" label="), "source.latexLabel")).otherwise("")
    path = F.col("source.sectionPath")
    section = F.when(F.size(path) > 0, F.concat(F.lit(" sec="), F.array_join(F.when(F.size(path) > 2, F.slice(path, -2, 2)).otherwise(path), "/"))).otherwise("")
    return F.concat(F.lit("- "), "id", F.lit(" | "), "type", F.lit(" | "), "title", label, section)


def summary_text(counts: dict) -> Column:
    """The text of a summary from node_n, node_lines, edge_n, edge_lines and the graph's counts."""
    return trim(F.concat_ws(
        "\n", F.concat(F.lit(f"nodes({counts['nodes']}) showing "), F.coalesce("node_n", F.lit(0)).cast("string"), F.lit(":")), "node_lines", F.lit(""),
        F.concat(F.lit(f"edges({counts['edges']}) showing "), F.coalesce("edge_n", F.lit(0)).cast("string"), F.lit(":")), "edge_lines",
    ))


def summaries(graph: Graph, chunks: DataFrame, most: int = NODES_SHOWN, counts: dict | None = None) -> DataFrame:
    """(chunk_seq, summary): the shown nodes and edges as lines of text. ``counts`` are the graph's, if they are known."""
    counts = counts or graph.counts()
    few = queries(chunks).limit(FEW + 1).collect()
    return summaries_of_many(graph, chunks, most, counts) if len(few) > FEW else summaries_of_few(graph, chunks, few, most, counts)


def summaries_of_few(graph: Graph, chunks: DataFrame, asked: list, most: int, counts: dict) -> DataFrame:
    """summaries() for the FEW chunks of ``asked`` or less, which each task holds: nodes and edges are gone through once, and nothing of them is shuffled but what a task shows."""
    asked = Asked(asked)
    tasks = lambda df, n: df.coalesce(max(1, -(-n // ROWS)))
    first = lambda df, n: df.groupBy("chunk_seq").agg(F.slice(F.sort_array(F.flatten(F.collect_list("own"))), 1, n).alias("own"))  # noqa: E731  at most `n` rows a chunk and task
    lines = lambda: F.array_join(F.transform("own", lambda x: x["line"]), "\n")
    terms = by_terms(graph.nodes.withColumn("line", node_line()), "line")
    shown = stored(first(best_nodes(tasks(terms, counts["nodes"]), asked, most), most), "shown")
    number = {c: i for i, c in enumerate(asked.chunks)}
    ids = {}
    for r in shown.select("chunk_seq", "own.id").collect():  # `most` ids of each of a few chunks
        for x in r["id"]:
            ids.setdefault(x, []).append(number[r["chunk_seq"]])
    ids = {x: np.array(sorted(own)) for x, own in ids.items()}
    edges = first(first_edges(tasks(graph.edges, counts["edges"]), ids, asked.chunks, EDGES_SHOWN), EDGES_SHOWN)
    nodes = shown.select("chunk_seq", lines().alias("node_lines"), F.size("own").alias("node_n"))
    edges = edges.select("chunk_seq", lines().alias("edge_lines"), F.size("own").alias("edge_n"))
    return chunks.select("chunk_seq").join(nodes, "chunk_seq", "left").join(edges, "chunk_seq", "left").select("chunk_seq", summary_text(counts).alias("summary"))


def summaries_of_many(graph: Graph, chunks: DataFrame, most: int, counts: dict) -> DataFrame:
    """summaries() for any number of chunks, by joins."""
    shown = stored(shown_nodes(graph, chunks, most), "shown")
    line = graph.nodes.select("id", node_line().alias("line"))
    ordered = lambda df: df.groupBy("chunk_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))  # noqa: E731  at most `most` rows a chunk
    nodes = ordered(shown.join(line, "id")).withColumnsRenamed({"lines": "node_lines", "n": "node_n"})
    arrows = shown_edges(graph, shown).withColumn("line", F.concat(F.lit("- ("), "type", F.lit(") "), "source", F.lit(" -> "), "target"))
    edges = ordered(arrows).withColumnsRenamed({"lines": "edge_lines", "n": "edge_n"})
    joined = chunks.select("chunk_seq").join(nodes, "chunk_seq", "left").join(edges, "chunk_seq", "left")
    return joined.select("chunk_seq", summary_text(counts).alias("summary"))


def concept_registry(nodes: DataFrame, most: int = CONCEPTS_SHOWN) -> DataFrame:
    """(total, place, line): the first concepts as lines, and how many there are."""
    total = nodes.filter(F.col("type").isin(*CONCEPT_TYPES)).count()
    first = concept_lines(nodes, most)
    return first.select(F.lit(total).cast("long").alias("total"), (F.row_number().over(Window.orderBy("seq")) - 1).alias("place"), "line")


def concept_lines(nodes: DataFrame, most: int) -> DataFrame:
    """(seq, line): the first concepts as lines, in order."""
    label = F.when(F.col("source.latexLabel").isNotNull(), F.concat(F.lit(" label="), "source.latexLabel")).otherwise("")
    concepts = nodes.filter(F.col("type").isin(*CONCEPT_TYPES))
    return concepts.orderBy("seq").limit(most).select("seq", F.concat(F.lit("- "), "id", F.lit(" | "), "type", F.lit(" | "), "title", label).alias("line"))


def registry_text(nodes: DataFrame, most: int = CONCEPTS_SHOWN, total: int | None = None) -> str:
    """concept_registry() as text; ``total`` is the number of concepts, if it is known."""
    if total is None:
        rows = concept_registry(nodes, most).orderBy("place").collect()  # at most `most` lines
        total = rows[0]["total"] if rows else 0
    else:
        rows = concept_lines(nodes, most).select("line").collect() if total else []
    return "\n".join([f"concepts({total}) showing {len(rows)}:", *[r["line"] for r in rows]]) if rows else ""
