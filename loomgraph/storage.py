"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session takes a folder under the temp folder; on a cluster, whose
    executors would each write to a disk of their own, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-shared")).rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """``df`` as Parquet in a new folder of the shared folder; its path."""
    path = fresh_folder(df.sparkSession, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, safe from lost executors; removed when the driver ends."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, partition_by))


def stored_together(**tables: DataFrame) -> list[DataFrame]:
    """stored() of several tables by their names, side by side: a small one takes longer to plan than to write."""
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda t: stored(t[1], t[0])), tables.items()))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes; for Parquet the size of its files by the columns read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """A stored table, marked for broadcast if its files have no more than ``most`` bytes (ids in a hash table take some 40 times that); otherwise joins shuffle it."""
    return F.broadcast(df) if plan_bytes(df) <= most else df


#: Rows of a table that are dealt to one task at most.
ROWS = 50_000


def dealt_to(df: DataFrame) -> int:
    """The number of tasks to deal ``df`` to if it is read from few files, which few tasks would read (one row group, up to a million rows, is one task's); else 0.

    That is the number of cores, or more where a task would get over ROWS rows, so what is made of a task's rows stays bounded. Files' footers have the count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) >= cores * (512 << 20):
        return 0
    return max(cores, -(-df.count() // ROWS)) if 0 < len(df.inputFiles()) * 4 <= cores else 0


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores if few tasks would read it."""
    n = dealt_to(df)
    return df.repartition(n) if n else df


def numbered(rows: DataFrame, order: list, to: str) -> DataFrame:
    """``rows`` with ``to``: their places from 0 by ``order``. Ranges are numbered in parallel; their counts, a row for each, are summed and joined."""
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranges = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_in": inner}), "ranges")
    return ranges.join(starts(ranges, F.lit(1)), "_part").withColumn(to, (F.col("_start") + F.col("_in")).cast("long")).drop("_part", "_in", "_start")


def starts(ranges: DataFrame, amount) -> DataFrame:
    """(_part, _start): the sum of ``amount`` over the ranges before each, from their sums, a row for each task that wrote them."""
    table, at = [], 0
    for r in sorted(ranges.groupBy("_part").agg(F.sum(amount).alias("n")).collect(), key=lambda r: r["_part"]):
        table.append((r["_part"], at))
        at += r["n"]
    return F.broadcast(ranges.sparkSession.createDataFrame(table, "_part int, _start long"))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_folder(spark, path)
        except Exception:  # the session has ended; what is left is the shared folder's owner's
            return
