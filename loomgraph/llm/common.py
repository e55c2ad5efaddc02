"""What the operators share: batches for Python, text normal forms, samples, joins behind checks of size."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import broadcast_if_small, dealt, plan_bytes  # noqa: F401
from ..storage import fresh_folder as fresh_dir  # noqa: F401
from ..storage import stored as cut
from ..storage import written as put  # noqa: F401


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(seed: str, *cols: Column) -> Column:
    """A uniform number in [0, 1) of 52 bits from MD5, the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def if_small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A written table, marked for broadcast if its files have no more than ``most`` bytes; otherwise joins shuffle it."""
    return broadcast_if_small(cut(df, "side"), most)


def without(docs: DataFrame, ids: DataFrame, most: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids``; null doc_ids stay."""
    return docs.join(if_small(ids.select("doc_id").distinct(), most), "doc_id", "left_anti").select(*docs.columns)


def hashed_sample(rows: DataFrame, key: str, seed: str, most: int) -> DataFrame:
    """The distinct (doc_id, ``key``) of ``rows`` and r, 1 to ``most``: for each value of ``key`` those of the smallest hashes of their doc_id.

    Pairs over a cut, set by the key's count so that more than ``most`` pass it, are left out before
    the ranking, so no task ranks all documents of a common value.
    """
    pairs = rows.select("doc_id", key).distinct()
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    counts = if_small(pairs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
    few = pairs.join(counts, F.col(key) == F.col("_key")).filter(h < (2 * most + 100) / F.col("_n") * float(1 << 40)).drop("_key", "_n")
    w = Window.partitionBy(key).orderBy(h, "doc_id")
    return few.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)


def sampled(rows: DataFrame, key: str, seed: str, most_each: int, most: int, among: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, ``key``, text, ...) of at most ``most_each`` documents of each value of ``key`` and ``most`` in all, and r.

    With ``among`` (doc_id, ``key``) they are chosen from those, and no text moves but the chosen ones'. Of rows that repeat a doc_id and key one is taken: that of the smallest hash of its text.
    """
    ids = hashed_sample(rows if among is None else among, key, seed, most_each).orderBy("r", key).limit(most)
    ids = F.broadcast(cut(ids.coalesce(1), "sample-ids").withColumnsRenamed({"doc_id": "_id", key: "_key"}))  # at most `most` rows
    chosen = rows.join(ids, (F.col("doc_id") == F.col("_id")) & (F.col(key) == F.col("_key"))).drop("_id", "_key")
    others = [c for c in chosen.columns if c not in ("doc_id", key)]
    return chosen.groupBy("doc_id", key).agg(F.min_by(F.struct(*others), F.xxhash64("text")).alias("_r")).select("doc_id", key, "_r.*")


#: Bytes of a batch that goes to Python; Spark's own bound is 64 MB, which with long texts takes much of a worker's memory.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds Arrow batches by BATCH_BYTES for what is written within; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    now = (before or "").rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def mapped(df: DataFrame, run, schema: str, name: str) -> DataFrame:
    """``df`` through ``run`` on Arrow batches, as a written table; the rows stay in their partitions and order."""
    with small_batches(df.sparkSession):
        return cut(df.mapInArrow(run, schema), name)


def mapped_pandas(df: DataFrame, run, schema: str, name: str) -> DataFrame:
    """``df`` through ``run`` on pandas batches, as a written table; the rows stay in their partitions and order."""
    with small_batches(df.sparkSession):
        return cut(df.mapInPandas(run, schema), name)


def pieces(df: DataFrame, bytes_each: int) -> int:
    """Into how many pieces of about ``bytes_each`` to deal a table; the session's number where its size is unknown."""
    size = plan_bytes(df)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return default if size >= 1 << 60 else max(1, -(-size // bytes_each))


def store(uri: str):
    """(filesystem, path) of a folder in the shared store, for binary files that Spark has no writer for."""
    import pyarrow.fs as pf

    return pf.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def put_file(uri: str, name: str, data: bytes) -> None:
    """Write a file whole: under a name of its own first, then moved, so a task that dies leaves no half file."""
    fs, path = store(uri)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def read_columns(uri: str, columns: list[str]) -> list:
    """Columns of a written table as numpy arrays, in a task or the driver, for tables of bounded size."""
    import numpy as np
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, path = store(uri)
    files = sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".parquet"))
    parts = [pq.ParquetFile(fs.open_input_file(f)).read(columns) for f in files]
    return [np.concatenate([p.column(c).to_numpy() for p in parts]) if parts else np.empty(0) for c in columns]
