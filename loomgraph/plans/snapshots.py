"""Versioned snapshots of a graph with its settings: a folder of Parquet tables for each.

A snapshot is whole, or has what differs from the one before it: the rows that are new and the hashes of
those that went. So snapshots taken along a run write as much as changed. A chain has at most CHAIN differences;
then comes a whole one again.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, NODES, Graph, ModelConfig, Selection, columns_like
from ..storage import delete_folder

META_FIELDS = "id string, createdAt timestamp, nodes long, edges long, note string, settings string, chain string"
SHOWN = 20
#: Differences in a row before a whole snapshot is written again.
CHAIN = 9


def newest(metas: DataFrame, most: int | None = SHOWN) -> DataFrame:
    """Snapshots by time, the newest first; those without an id or a time are left out."""
    found = metas.filter("id is not null and createdAt is not null").orderBy(F.desc("createdAt"), F.desc("id"))
    return found if most is None else found.limit(most)


def all_but_latest(metas: DataFrame) -> DataFrame:
    """(id) of the snapshots that keeping the latest only removes."""
    latest = newest(metas, 1).select(F.col("id").alias("_latest"))
    return metas.filter("id is not null and createdAt is not null").join(latest, F.col("id") == F.col("_latest"), "left_anti").select("id")


def counted(df: DataFrame) -> DataFrame:
    """(h, n, row): the different rows of a table by their hash, and how often each is there."""
    whole = F.struct(*df.columns)
    return df.select(F.md5(F.to_json(whole, {"ignoreNullFields": "false"})).alias("h"), whole.alias("row")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"))


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` (h, n, row) that ``old`` (h, n) has not or not so often, and those that went, with n = 0."""
    before = old.select("h", F.col("n").alias("_n"))
    both = new.join(before, "h", "full").filter(~F.col("n").eqNullSafe(F.col("_n")))
    return both.select("h", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "row")


def last_of(steps: list[DataFrame]) -> DataFrame:
    """(h, n, row) after a chain of steps: of each hash the last one counts."""
    out = steps[0].withColumn("_step", F.lit(0))
    for i, step in enumerate(steps[1:], 1):
        out = out.unionByName(step.withColumn("_step", F.lit(i)))
    return out.groupBy("h").agg(F.max_by(F.struct(*[c for c in steps[0].columns if c != "h"]), "_step").alias("s")).select("h", "s.*").filter("n > 0")


class SnapshotStore:
    """Snapshots under a folder: ``<id>/meta``, and ``<id>/nodes`` and ``<id>/edges`` with rows as last_of() takes them. None is overwritten; meta is written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _ids(self) -> list[str]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(folder)]
        return [i for i in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{i}/meta/_SUCCESS"))]

    def metas(self) -> DataFrame:
        """One row for each whole snapshot; unfinished ones don't show."""
        ids = self._ids()
        if not ids:
            return self.spark.createDataFrame([], META_FIELDS)
        return self.spark.read.schema(META_FIELDS).parquet(*[f"{self.path}/{i}/meta" for i in ids])

    def list(self, most: int | None = SHOWN) -> DataFrame:
        return newest(self.metas(), most)

    def _steps(self, chain: list[str], table: str, narrow: bool = False) -> list[DataFrame]:
        kind = "h string, n long" + ("" if narrow else f", row {(NODES if table == 'nodes' else EDGES).simpleString()}")
        return [self.spark.read.schema(kind).parquet(f"{self.path}/{i}/{table}") for i in chain]

    def _write(self, name: str, graph: Graph, chain: list[str]) -> None:
        for table, df in (("nodes", columns_like(graph.nodes, NODES)), ("edges", columns_like(graph.edges, EDGES))):
            rows = counted(df)
            if chain:
                rows = difference(rows, last_of(self._steps(chain, table, narrow=True)))
            rows.write.parquet(f"{self.path}/{name}/{table}")

    def save(self, graph: Graph, selection: Selection = Selection(), view: dict | None = None, model: ModelConfig | None = None, note: str | None = None) -> str:
        """Write a snapshot; its id. Of a store's newest snapshot that is not at the end of a chain it is written as a difference. The model's key is not written."""
        name = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:12]}"
        before = self.list(1).first()
        chain = json.loads(before["chain"]) if before and before["chain"] else []
        chain = chain if len(chain) <= CHAIN else []
        self._write(name, graph, chain)
        settings = json.dumps({"selection": selection.__dict__, "view": view or {}, "model": model.public() if model else {}})
        self._write_meta(name, [*chain, name], settings, note)
        return name

    def _write_meta(self, name: str, chain: list[str], settings: str, note: str | None) -> None:
        counts = self._graph(chain).counts()
        meta = self.spark.createDataFrame([(name, counts["nodes"], counts["edges"], note, settings, json.dumps(chain))], "id string, nodes long, edges long, note string, settings string, chain string")
        meta.select("id", F.current_timestamp().alias("createdAt"), "nodes", "edges", "note", "settings", "chain").coalesce(1).write.parquet(f"{self.path}/{name}/meta")

    def _graph(self, chain: list[str]) -> Graph:
        each = lambda table: last_of(self._steps(chain, table)).select(F.explode(F.array_repeat("row", F.col("n").cast("int"))).alias("r")).select("r.*")
        return Graph(each("nodes"), each("edges"))

    def load(self, name: str) -> tuple[Graph, dict]:
        """(graph, settings); restoring takes selection and view from them, not the model."""
        if name not in self._ids():
            raise KeyError(f"no snapshot {name}")
        meta = self.metas().filter(F.col("id") == name).first()
        return self._graph(json.loads(meta["chain"])), json.loads(meta["settings"])

    def keep_latest(self) -> None:
        """Remove all snapshots but the newest. One that is a difference is written whole first, under an id of its own."""
        latest = self.list(1).first()
        if latest and len(json.loads(latest["chain"])) > 1:
            graph, _ = self.load(latest["id"])
            name = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:12]}"
            self._write(name, graph, [])
            self._write_meta(name, [name], latest["settings"], latest["note"])
        for r in all_but_latest(self.metas()).collect():  # a row a snapshot
            delete_folder(self.spark, f"{self.path}/{r['id']}")

    def clear(self) -> None:
        delete_folder(self.spark, self.path)
