"""A graph kept up to date from a stream of chunks.

Each micro-batch is extracted and upserted by its chunks' places. The table holds compacted
increments rather than merged rows, so batches may come in any order, twice, or cut in another way,
and lead to the same graph. A batch writes a run of its own and then a state of the table that names
it, so it costs its own size. Once FAN runs of a tier are there, one run of the next tier takes
their place: a row is written again as often as the logarithm of the number of batches. A batch is known by
its source, which is the id of its streaming query, and its number there; sources don't meet.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import EDGES, NODES, Graph, Selection
from ..operators.extract import extract_into
from ..operators.graph import compact_edges, compact_nodes, upsert_edges, upsert_nodes
from ..storage import broadcast_if_small, delete_folder, stored
from .commits import CommitLog

#: Runs of a tier that become one of the next.
FAN = 8


def with_number(ranges: list[list[int]], n: int) -> list[list[int]]:
    """Ranges (first, last) of whole numbers, in order, and ``n`` among them."""
    out: list[list[int]] = []
    for first, last in sorted([*ranges, [n, n]]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


class GraphTable:
    """A graph under a folder: ``runs/<name>/nodes`` and ``edges``, and ``log`` of states that say which runs are the table.

    A state has runs (name, tier), the numbers of batches put in by source, and the runs that the last merges replaced.
    These stay for readers until the next merge.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.log = CommitLog(spark, f"{self.path}/log")

    def runs(self) -> list[dict]:
        return self.log.state()[1].get("runs", [])

    def batches(self) -> dict[str, list[list[int]]]:
        """Ranges of the batches' numbers that the table holds, by source."""
        return self.log.state()[1].get("batches", {})

    def _rows(self, runs: list[dict]) -> Graph:
        if not runs:
            return Graph.empty(self.spark)
        at = [f"{self.path}/runs/{r['name']}" for r in runs]
        read = self.spark.read
        return Graph(read.schema(NODES).parquet(*[f"{p}/nodes" for p in at]), read.schema(EDGES).parquet(*[f"{p}/edges" for p in at]))

    def increments(self) -> Graph:
        return self._rows(self.runs())

    def read(self) -> Graph:
        rows = self.increments()
        return Graph(upsert_nodes(rows.nodes), upsert_edges(rows.edges))

    def labeled(self, labels: DataFrame) -> DataFrame:
        """(id, source, seq) of the table's nodes whose label is one of ``labels`` (label); of other nodes ids and labels are read, but nothing moves."""
        rows = self.increments().nodes.select("id", "source", "seq")
        wanted = broadcast_if_small(stored(labels.select("label").filter("label <> ''").distinct(), "wanted"))
        ids = rows.select("id", F.col("source.latexLabel").alias("label")).join(wanted, "label", "left_semi").select("id").distinct()
        own = rows.join(broadcast_if_small(stored(ids, "labeled")), "id", "left_semi")
        last = own.groupBy("id").agg(F.max_by("source", F.when(F.col("source").isNotNull(), F.col("seq"))).alias("source"), F.min("seq").alias("seq"))
        return last.join(wanted, F.col("source.latexLabel") == F.col("label"), "left_semi")

    def _write(self, rows: Graph) -> str:
        name = uuid.uuid4().hex
        compact_nodes(rows.nodes).write.parquet(f"{self.path}/runs/{name}/nodes")
        compact_edges(rows.edges).write.parquet(f"{self.path}/runs/{name}/edges")
        return name

    def upsert(self, made: Graph, batch: int, source: str = "") -> None:
        """Put in batch ``batch`` of ``source``; one that is in already is left out."""
        held = lambda state: any(a <= batch <= b for a, b in state.get("batches", {}).get(source, []))
        if held(self.log.state()[1]):
            return
        name = self._write(made)

        def add(state: dict) -> dict | None:
            if held(state):
                return None
            state.setdefault("runs", []).append({"name": name, "tier": 0})
            numbers = state.setdefault("batches", {})
            numbers[source] = with_number(numbers.get(source, []), batch)
            return state

        if name not in [r["name"] for r in self.log.commit(add).get("runs", [])]:
            delete_folder(self.spark, f"{self.path}/runs/{name}")  # another writer had the batch first
        self.merge_runs()

    def merge_runs(self) -> None:
        """Merge tiers that have ``fan`` runs, the lowest first, until none has."""
        while True:
            runs = self.runs()
            full = [t for t in sorted({r["tier"] for r in runs}) if sum(r["tier"] == t for r in runs) >= self.fan]
            if not full:
                return
            old = [r for r in runs if r["tier"] == full[0]]
            names = {r["name"] for r in old}
            name = self._write(self._rows(old))
            gone: list[str] = []

            def replace(state: dict, names=names, name=name, tier=full[0], gone=gone) -> dict | None:
                if not names <= {r["name"] for r in state["runs"]}:
                    return None  # another writer merged them
                state["runs"] = [r for r in state["runs"] if r["name"] not in names] + [{"name": name, "tier": tier + 1}]
                gone[:] = state.get("replaced", [])
                state["replaced"] = sorted(names)
                return state

            self.log.commit(replace)
            if name not in [r["name"] for r in self.runs()]:
                gone.append(name)
            for run in gone:
                delete_folder(self.spark, f"{self.path}/runs/{run}")


def source_of_batch(batch: DataFrame, checkpoint: str) -> str:
    """The id of the streaming query that the batch comes from: it is the checkpoint's own, and another one's is another."""
    own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if own:
        return own
    return json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def upsert_stream(batches: DataFrame, table: GraphTable, make, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that turns each micro-batch into a graph by ``make`` (of the batch and the table) and upserts it."""

    def each(batch: DataFrame, number: int) -> None:
        table.upsert(make(batch, table), number, source_of_batch(batch, checkpoint))

    writer = batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def extract_stream(chunks: DataFrame, table: GraphTable, checkpoint: str, selection: Selection = Selection(), once: bool = True) -> StreamingQuery:
    """Extraction from a stream of chunks; labels of the graph so far are known."""
    return upsert_stream(chunks, table, lambda batch, own: extract_into(batch, own.labeled, selection), checkpoint, once)
