"""Exact dedup by a heavy-hitter split (op 8), in DataFrame functions only.

A Misra-Gries summary (Spark's ``approx_top_k``, the frequent-items sketch) over the digests finds
the frequent ones. A sketch that tracks M items is off by 3.5 n/M rows at most, merged ones as well,
so M = 8 x ``tracked`` keeps every digest with more than n/tracked rows, and the 2 x ``tracked``
largest estimates hold them all. These candidates are counted exactly; those verified are
broadcast, and their rows never meet in one task. Each digest that is left has at most n/tracked
rows and takes the ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, dealt, text_or_empty

#: What equal texts may differ by: runs of these become one space.
SPACES = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 in lowercase hex of the text with white space runs as one space."""
    norm = F.regexp_replace(text_or_empty(), SPACES, " ")
    return docs.select("doc_id", F.sha2(norm, 256).alias("digest"))


#: Items that the sketch tracks and candidates that are counted, for each of ``tracked``.
SKETCH, CANDIDATES = 8, 2


def heavy_candidates(d: DataFrame, tracked: int) -> DataFrame:
    """Digests among which are all that have more than rows/tracked rows: at most 2 x ``tracked`` of them.

    Summaries are made for each of 64 slices of the tasks and then combined, so no task merges the
    summaries of all tasks.
    """
    size = SKETCH * tracked
    slices = d.groupBy(F.expr("pmod(spark_partition_id(), 64)").alias("slice")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {size})").alias("summary")
    )
    top = slices.groupBy(F.expr("slice < 0")).agg(  # grouped, so that no rows give no summary
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {size}), {CANDIDATES * tracked})").alias("top")
    )
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest"))


def exact_dedup(docs: DataFrame, tracked: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Rows that repeat a doc_id
    count one by one in group_size; those with the smallest doc_id of a group are all marked kept.
    A null doc_id never stays while its group has another; an empty table gives an empty result.
    Columns other than doc_id and text are ignored.
    Texts of any length are taken whole.
    """
    d = cut(digests(dealt(docs.select("doc_id", "text"))), "digests")
    candidates = F.broadcast(heavy_candidates(d, tracked))
    heavy = (
        d.join(candidates, "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    heavy = F.broadcast(cut(heavy, "heavy"))  # at most 2 x `tracked` rows
    marked = d.join(heavy, "digest", "left")
    same = Window.partitionBy("digest")
    light = (
        d.join(heavy, "digest", "left_anti")
        .withColumn("keep_id", F.min("doc_id").over(same))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
    )
    return (
        marked.filter("group_size is not null")
        .unionByName(light)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.expr("doc_id <=> keep_id").alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )
