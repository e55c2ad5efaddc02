"""Benchmark decontamination by size-partitioned MinHash containment (op 10), in DataFrame functions only.

A document leaks an item if it holds at least ``threshold`` of the item's distinct word shingles.
The Jaccard similarity of a short item and a long document is near 0, so a common MinHash index
misses it. Here the items are partitioned by size (powers of two of their shingle counts), and an
item's sketch is its k smallest shingle hashes, with k = the items' largest number of shingles in
that partition that a leak may lack, plus one. A document that holds ``threshold`` of the shingles
must then hold one of the sketch, so the search loses nothing. Candidates are verified by exact
containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, broadcast_if_small, cut, dealt, if_small, text_or_empty, without

SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in lower case (A-Z only); an empty array if it has none."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def shingles(tokens: Column, n: int, make) -> Column:
    """``make`` of each run of n words, repeats included; of all words if there are fewer; none without words."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (n - 1)))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: make(F.slice(tokens, i, n)))).otherwise(F.array())


def hashed(run: Column) -> Column:
    return F.xxhash64(run)


def joined(run: Column) -> Column:
    return F.array_join(run, " ")


def runs(n: int, short: list[int], make, tokens: Column) -> Column:
    """``make`` of each run of n words, and of each of the ``short`` lengths; a text under n words has no run of n."""
    of = lambda k: F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: make(F.slice(tokens, i, k)))).otherwise(F.array())
    every = [of(k) for k in (n, *short)]
    return every[0] if len(every) == 1 else F.concat(*every)


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """(item_id, k, size, shingle, hash) of the items' distinct shingles: of k = n words, or of all words where an item has fewer."""
    base = items.filter("item_id is not null").select("item_id", words(text_or_empty()).alias("w")).filter(F.size("w") > 0)
    own = base.select("item_id", F.least(F.size("w"), F.lit(n)).alias("k"), F.explode(shingles(F.col("w"), n, joined)).alias("shingle")).distinct()
    sized = own.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    return cut(sized.withColumn("hash", F.xxhash64(F.split("shingle", " "))), "items")


def sketches(sized: DataFrame, threshold: float) -> DataFrame:
    """(hash, item_id): of each item the smallest hashes, as many as its size partition asks for.

    A partition is a power of two: its items have at most ``upper`` shingles, of which a leak may
    lack ``upper`` * (1 - threshold); one hash more is sought, so a leak holds at least one of them.
    """
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double"))))
    depth = F.floor(upper * (1 - threshold) + 1e-9) + 1
    smallest = Window.partitionBy("item_id").orderBy(F.xxhash64(F.lit("minhash"), "hash"), "hash")
    return sized.withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= depth).select("hash", "item_id")


def leaks(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of each document and item it leaks.

    Words are separated by ASCII white space and compared in lower case (A-Z). Items without words
    have no shingle and are never found; an item with fewer than ``n`` words is one shingle of all
    its words, sought in documents among their runs of that length. Null texts count as empty, null
    ids take no part. Rows that repeat an id count as one set of shingles. Empty tables give an
    empty result. Other columns are ignored. Sketches and shingles of the items are broadcast while
    their files have no more than ``broadcast_bytes``; beyond, the joins shuffle.
    Texts of any length are taken whole.
    """
    sized = item_shingles(items, n)
    short = sorted(r["k"] for r in sized.filter(F.col("k") < n).select("k").distinct().collect())  # at most n - 1 rows
    sketch = if_small(sketches(sized, threshold), broadcast_bytes)
    base = dealt(docs.filter("doc_id is not null").select("doc_id", "text")).select("doc_id", words(text_or_empty()).alias("w"))
    seen = base.select("doc_id", F.explode(runs(n, short, hashed, F.col("w"))).alias("hash"))  # of runs of any length: words hold no space
    candidates = cut(seen.join(sketch, "hash").select("doc_id", "item_id").distinct(), "candidates")
    suspects = if_small(candidates.select("doc_id").distinct(), broadcast_bytes)
    texts = docs.select("doc_id", "text").join(suspects, "doc_id", "left_semi").select("doc_id", words(text_or_empty()).alias("w"))
    held = texts.select("doc_id", F.explode(F.array_distinct(runs(n, short, joined, F.col("w")))).alias("shingle"))
    of = broadcast_if_small(sized.select("shingle", "item_id", "size"), broadcast_bytes)
    shared = held.join(of, "shingle").groupBy("doc_id", "item_id", "size").agg(F.countDistinct("shingle").alias("shared"))
    found = shared.join(candidates, ["doc_id", "item_id"], "left_semi").filter(F.col("shared") >= F.ceil(F.col("size") * threshold - 1e-9))
    return found.select("doc_id", "item_id", "shared", F.col("size").alias("item_shingles"), (F.col("shared") / F.col("size")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the documents that leak an item; rows of a null doc_id stay."""
    return without(docs, leaks(docs, items, **parameters).select("doc_id"))
