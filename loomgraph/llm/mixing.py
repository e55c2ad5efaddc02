"""Mixing sources to target weights by Poisson replication (op 5).

The mean repetition rate of a source is its share of the target over its size. Each document's
count comes from inverting the Poisson distribution at a number in [0, 1) hashed from the seed,
the doc_id and the text, so it depends on nothing else. Documents are exploded by their count and dealt over the
cluster by a hash of (seed, doc_id, text, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small, unit_hash

#: A rate over this is the sum of that many independent equal parts, so exp(-rate) stays far from 0.
PART = 8.0
#: Steps of a part's distribution; beyond, the tail has less than 2^-52.
STEPS = 48


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, total: float = 1.0) -> DataFrame:
    """(source, size, rate): mean repetition of each source's documents.

    Size is counted in documents. ``weights`` names the target share of each source (sources not
    named get none); without it shares are proportional to size ** ``power``, which flattens the
    mixture. ``total`` is the size of the mixture as a multiple of the input's.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(share)
    shares = cut(sizes.withColumn("share", share), "shares")
    all_share, all_size = shares.agg(F.sum("share"), F.sum("size")).first()
    scale = total * all_size / all_share if all_share else 0.0
    return shares.select("source", "size", (F.col("share") / F.col("size") * F.lit(scale)).alias("rate"))


def with_steps(rates: DataFrame) -> DataFrame:
    """Adds parts and cdf: the distribution of a part of the rate, as an array of its first steps."""
    part = F.col("rate") / F.col("parts")
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("c")),
        lambda acc, k: F.struct(
            (acc["p"] * part / k).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * part / k)).alias("c"),
        ),
        lambda acc: acc["c"],
    )
    return rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("cdf", cdf)


def poisson_count(seed: str, row: Column) -> Column:
    """Copies of a document: for each part the number of steps of its distribution at or below a hashed number."""
    numbers = F.transform(F.sequence(F.lit(1), F.col("_mix.parts")), lambda k: unit_hash(seed, row, k))
    return F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("_mix.cdf"), lambda c: c <= u)))


def drawn_by(docs: DataFrame) -> Column:
    """What a row draws by: its doc_id and the MD5 of its text, if it has one."""
    text = F.coalesce("text", F.lit("")) if "text" in docs.columns else F.lit("")
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix", power: float = 0.7, total: float = 1.0, most_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with the columns mix_copy (from 1), mix_copies, mix_key; rows repeated by their count and dealt anew.

    Null sources form a source of their own. A document of count 0 leaves. Rows draw by doc_id and text, nulls of
    either as empty: rows of a null or repeated doc_id draw apart if their texts differ, and rows alike in both draw the same count. Rows are dealt to partitions by the hash mix_key and sorted by
    it there, which is a global shuffle; partitions hold rows of all sources. An empty table gives an empty result. Columns of
    ``docs`` pass through; those named like the new ones are replaced (replicated() keeps them). The rates are broadcast while
    their files have no more than ``most_bytes``; beyond, the join shuffles and splits hot sources.
    Texts of any length are taken whole.
    """
    docs = docs.drop("mix_copy", "mix_copies", "mix_key", "_mix", "_mix_source")
    rates = with_steps(source_rates(docs, weights, power, total))
    rates = rates.select(F.col("source").alias("_mix_source"), F.struct("parts", "cdf").alias("_mix"))
    rates = if_small(rates, most_bytes)
    counted = docs.join(rates, F.expr("source <=> _mix_source")).withColumn("mix_copies", poisson_count(seed, drawn_by(docs)))
    copies = counted.filter("mix_copies > 0").select(*docs.columns, F.explode(F.expr("sequence(1, mix_copies)")).alias("mix_copy"), "mix_copies")
    return copies.withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id", "text" if "text" in docs.columns else F.lit(""), "mix_copy")).repartition("mix_key").sortWithinPartitions("mix_key", "doc_id", "mix_copy")


def replicated(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of mix_sources() with the columns of ``docs`` alone, those named like its own included."""
    names = {c: f"_own_{c}" for c in ("mix_copy", "mix_copies", "mix_key") if c in docs.columns}
    mixed = mix_sources(docs.withColumnsRenamed(names), **parameters)
    return mixed.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
