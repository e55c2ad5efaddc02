"""Sharding by a two-pass external shuffle (op 4).

Pass one scatters the records: a hash of the doc_id names the shard (jump consistent hashing, so
one more shard takes rows only into itself) and a second seeded hash one of the shard's buckets, of
a size that fits in memory. Pass two puts a bucket's rows in a fixed order, shuffles them by
Fisher-Yates with a seed of its own and writes them as one file. A row's slot is its place in the
bucket after the rows of the shard's earlier buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pieces, small_batches, text_or_empty

#: Parquet bytes of input to a bucket.
BUCKET_BYTES = 16 << 20
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a hashed key by consistent hashing: from n to n + 1 shards a key stays or goes to shard n.

    Shard n takes a key from the n before it with probability 1 / (n + 1), decided by a hash of
    (key, n); the last that takes it has it.
    """
    takes = F.filter(
        F.sequence(F.lit(1), F.lit(shards - 1)),
        lambda n: F.pmod(F.xxhash64(key, n.cast("int")), F.lit(1 << 40)) * (n + 1).cast("long") < F.lit(1 << 40),
    )
    return F.coalesce(F.try_element_at(takes, F.lit(-1)), F.lit(0)) if shards > 1 else F.lit(0)


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform order of n rows: numpy's Fisher-Yates with a seeded generator."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


#: Columns of the operator's own while it works, and the names that users' columns like them have meanwhile.
OWN = {"shard": "_own_shard", "slot": "_own_slot", "_bucket": "_own_bucket", "_bucket_slot": "_own_bucket_slot", "_tie": "_own_tie", "_n": "_own_n", "_before": "_own_before"}


def write_shards(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """The written rows of ``docs`` with shard, _bucket and _bucket_slot; read back from the shard files.

    Files lie in folders shard=K. Null texts are written as null and count no bytes. A null doc_id
    is a key of its own. Rows that repeat a doc_id are in one shard (the doc_id decides), each with
    a slot of its own; the bucket depends on all columns, so rows of one id are spread over the
    shard's buckets. Only rows alike in every column, the doc_id included, share a bucket: nothing
    tells them apart, and a place that didn't depend on the rows alone would change with the scan.
    An empty table gives an empty result.
    Columns of ``docs`` pass through; those named like the operator's own are named _own_... .
    """
    docs = docs.withColumnsRenamed({k: v for k, v in OWN.items() if k in docs.columns})
    each = max(1, -(-pieces(docs, BUCKET_BYTES) // shards))
    key = F.xxhash64(F.lit(seed), "doc_id")
    scattered = docs.withColumn("_tie", F.xxhash64(*docs.columns))
    scattered = scattered.withColumn("shard", jump_shard(key, shards).cast("int"))
    scattered = scattered.withColumn("_bucket", (F.col("shard") * each + F.pmod(F.xxhash64(F.lit(seed + 1), "_tie"), F.lit(each))).cast("int"))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        t = pa.Table.from_batches(own)
        t = t.take(pc.sort_indices(t, [("_bucket", "ascending"), ("doc_id", "ascending"), ("_tie", "ascending")])).drop_columns(["_tie"])
        of = t.column("_bucket").to_numpy()
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        start = 0
        for end in ends.tolist():
            n = end - start
            one = t.slice(start, n).take(pa.array(fisher_yates(n, seed * 1_000_003 + int(of[start])))).append_column("_bucket_slot", pa.array(np.arange(n, dtype=np.int64)))
            start = end
            yield from one.combine_chunks().to_batches(max_chunksize=2000)

    order = [c for c in scattered.columns if c != "_tie"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.select(*order).schema) + ", _bucket_slot long"
    with small_batches(docs.sparkSession):
        return cut(scattered.select(*order, "_tie").repartitionById(shards * each, F.col("_bucket")).mapInArrow(shuffle, kinds), "shards", partition_by="shard")


def with_slots(written: DataFrame) -> DataFrame:
    """Adds slot: gapless from 0 in each shard, in the order of its buckets; without _bucket and _bucket_slot."""
    counts = written.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return written.join(offsets, "_bucket").withColumn("slot", F.col("_bucket_slot") + F.col("_before")).drop("_before", "_bucket_slot", "_bucket")


def sharded(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """``docs`` as written, with shard and slot.

    A user's columns come back under their names with their values; those named ``shard`` and
    ``slot`` come back as ``_own_shard`` and ``_own_slot``, as the shard and slot have these names.
    """
    back = {v: k for k, v in OWN.items() if k not in ("shard", "slot") and k in docs.columns}
    return with_slots(write_shards(docs, shards, seed)).withColumnsRenamed(back)


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each written row.

    law is ``key``: doc_id and the number of shards decide. size is the text's UTF-8 bytes (null:
    none) and 16; grown_shard the shard with one more.
    Texts of any length are taken whole.
    """
    written = with_slots(write_shards(docs.select("doc_id", "text"), shards, seed))
    return written.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        jump_shard(F.xxhash64(F.lit(seed), "doc_id"), shards + 1).cast("int").alias("grown_shard"),
    )
