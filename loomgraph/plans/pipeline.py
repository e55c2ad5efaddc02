"""From files to a graph: one pass with the deterministic extractor, or two phases with a model.

The model-backed run works in waves of chunks in order: a wave's prompts see the graph as it is after
the wave before, and its answers are upserted by their chunk's place, so the result depends neither
on which answer came first nor on how many were open at once.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CONCEPT_RELATIONS, CONCEPT_TYPES, Graph, ModelConfig, Selection
from ..operators.align import Aligner, align, nothing
from ..operators.extract import extract
from ..operators.graph import apply_alias, freeze, merge_few, merge_graphs, prune, sizes, upsert_edges, upsert_nodes
from ..operators.normalize import finished, normalized
from ..operators.retrieve import registry_text, summaries
from ..operators.segment import chunk_files
from ..storage import stored, stored_together
from .extractors import Extractor, prompts, remembered, responses
from .snapshots import SnapshotStore

SHOWN, EVERY = 160, 10


@dataclass
class Run:
    """A graph, what was warned of, and how the run went: (stage, chunks done, nodes, edges)."""

    graph: Graph
    warnings: list[str] = field(default_factory=list)
    progress: list[tuple] = field(default_factory=list)
    status: str = "done"
    error: str | None = None

    def message(self) -> str:
        """The first two warnings, and how many there are."""
        if not self.warnings:
            return "done"
        more = f"… ({len(self.warnings)} in all)" if len(self.warnings) > 2 else ""
        return "done; warnings: " + "; ".join(self.warnings[:2]) + more


def build(files: DataFrame, granularity: str = "section", max_tokens: int | None = 12_000, selection: Selection = Selection(), label_scope: str = "seen", clean: bool = True) -> Run:
    """The graph of files by the deterministic extractor, in one pass over all selected types."""
    chunks = stored(chunk_files(files, granularity, max_tokens), "chunks")
    graph = extract(chunks, selection, label_scope)
    graph = Graph(*stored_together(nodes=graph.nodes, edges=graph.edges))
    run = Run(graph, progress=[("extract", chunks.count(), *graph.counts().values())])
    return _cleaned(run) if clean else run


def _cleaned(run: Run) -> Run:
    pruned, dropped = prune(run.graph)
    run.graph = Graph(*stored_together(nodes=pruned.nodes, edges=pruned.edges))
    n = dropped.count()
    if n:
        run.warnings.append(f"dropped {n} formulas as noise")
    run.progress.append(("prune", 1, *run.graph.counts().values()))
    return run


def between(chunks: DataFrame, places: list[int]) -> DataFrame:
    """The chunks of a wave: those from its first to its last place."""
    return chunks.filter(F.col("chunk_seq").between(places[0], places[-1]))


def extract_wave(chunks: DataFrame, graph: Graph, extractor: Extractor, selection: Selection, phase: int, size: dict, parallelism: int, strict: bool) -> tuple[Graph, DataFrame]:
    """A wave's chunks through the extractor: asked, put in normal form, completed, annotated, filtered; and warnings (chunk_seq, warning). ``size`` has the graph's sizes()."""
    registry = registry_text(graph.nodes, total=size["concepts"])
    asked = prompts(chunks, summaries(graph, chunks, SHOWN, size), selection, phase, registry, frozen=phase == 2)
    answered = stored(responses(asked, extractor, parallelism, strict), "responses")
    made = normalized(answered.filter("response is not null"))
    kept, said = finished(Graph(*stored_together(nodes=made.nodes, edges=made.edges)), chunks, graph.nodes)
    return kept, answered.filter("warning is not null").select("chunk_seq", "warning").unionByName(said.select("chunk_seq", "warning"))


def build_with_model(
    chunks: DataFrame,
    extractor: Extractor,
    selection: Selection = Selection(),
    config: ModelConfig = ModelConfig(),
    aligner: Aligner = nothing,
    start: Graph | None = None,
    snapshots: SnapshotStore | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    null_overwrites: bool = False,
    wave: int | None = None,
    concept_wave: int = 1,
    answers: str | None = None,
) -> Run:
    """Two phases: concepts chunk by chunk, alignment and freezing of names, then the rest in waves.

    Prompts of phase 1 see what the chunk before gave; with ``concept_wave`` over 1 they see what the wave of so many chunks
    before gave, and a wave's prompts are asked side by side. A wave of phase 2 is ``wave`` chunks, without it as many as prompts
    are open at once. ``answers`` names a folder in which answers are kept (remembered()): a run that is started anew gets from there what it has asked before.

    A failure in phase 1 or of the alignment ends the run with the status ``error`` and what was
    committed; in phase 2 it is a warning. ``cancelled`` is asked between waves; what was committed
    stays. Snapshots are taken every 10 chunks of phase 2; a failure to
    write one is ignored.
    """
    spark = chunks.sparkSession
    extractor = remembered(extractor, answers, config.model) if answers else extractor
    places = [r["chunk_seq"] for r in chunks.select("chunk_seq").orderBy("chunk_seq").collect()]  # one model call a chunk bounds this
    run = Run(start or Graph.empty(spark))
    with ThreadPoolExecutor(1) as pool:
        told: list = []  # warnings of each wave, which nothing waits for
        try:
            return _in_waves(run, chunks, places, extractor, selection, config, aligner, snapshots, cancelled, null_overwrites, wave, concept_wave, told, pool)
        finally:
            run.warnings[:0] = [w for said in told for w in ([said] if isinstance(said, str) else said.result())]


def _warnings(said: DataFrame) -> list[str]:
    return [r["warning"] for r in said.orderBy("chunk_seq", "warning").collect()]  # what a wave's few chunks caused


def _in_waves(run: Run, chunks: DataFrame, places: list[int], extractor: Extractor, selection: Selection, config: ModelConfig, aligner: Aligner, snapshots: SnapshotStore | None, cancelled: Callable[[], bool], null_overwrites: bool, wave: int | None, concept_wave: int, told: list, pool: ThreadPoolExecutor) -> Run:
    """build_with_model() from the chunks' places on; ``told`` takes warnings, as texts and as lists to come."""
    collect = inheritable_thread_target(chunks.sparkSession)(_warnings)
    size, whole = sizes(run.graph), True

    def merged(made: Graph) -> Graph:
        nonlocal whole
        whole, first = False, whole
        return (merge_graphs if first else merge_few)(run.graph, made, null_overwrites, size["top"])

    def took(graph: Graph, stage: str, done: int) -> None:
        nonlocal size
        run.graph = Graph(*stored_together(nodes=graph.nodes, edges=graph.edges))
        size = sizes(run.graph)
        run.progress.append((stage, done, size["nodes"], size["edges"]))

    def failed(why: str) -> Run:
        run.status, run.error = "error", why
        return run

    first = Selection(tuple(t for t in selection.entities if t in CONCEPT_TYPES), tuple(r for r in selection.relations if r in CONCEPT_RELATIONS), selection.notes)
    step = max(1, int(concept_wave))
    for i in range(0, len(places), step):
        if cancelled():
            run.status = "stopped"
            return run
        own = places[i : i + step]
        try:
            made, said = extract_wave(between(chunks, own), run.graph, extractor, first, 1, size, min(step, config.parallelism), strict=True)
        except Exception as e:
            return failed(f"phase 1, chunk {i + 1}: {e}")
        told.append(pool.submit(collect, said))
        took(merged(made), "phase 1", i + len(own))
    try:
        aligned = stored(align(run.graph.nodes, aligner), "aligned")
    except Exception as e:
        return failed(f"alignment: {e}")
    run.progress.append(("align", aligned.count(), size["nodes"], size["edges"]))
    frozen, alias = freeze(run.graph, aligned)
    took(frozen, "freeze", 1)
    whole = True

    rest = Selection(tuple(t for t in selection.entities if t not in CONCEPT_TYPES), selection.relations, selection.notes)
    step = max(1, int(wave or min(32, config.parallelism or 1)))
    for i in range(0, len(places), step):
        if cancelled():
            run.status = "stopped"
            return run
        own = places[i : i + step]
        made, said = extract_wave(between(chunks, own), run.graph, extractor, rest, 2, size, min(step, config.parallelism), strict=False)
        told.append(pool.submit(collect, said))
        took(merged(apply_alias(made, alias)), "phase 2", i + len(own))
        if snapshots is not None and (i + len(own)) // EVERY > i // EVERY:
            try:
                snapshots.save(run.graph, selection, note=f"auto@{(i + len(own)) // EVERY * EVERY}", model=config)
            except Exception as e:  # a full disk must not end the run
                told.append(f"no snapshot: {e}")
    return _cleaned(run)


def merged_in_waves(increments: list[Graph]) -> Graph:
    """Increments upserted one after the other; equal to all at once."""
    graph = increments[0]
    graph = Graph(upsert_nodes(graph.nodes), upsert_edges(graph.edges))
    for more in increments[1:]:
        graph = merge_graphs(graph, more)
    return graph
