"""From the documents table to training shards, in five stages of the training-data operators.

Null, empty and blank texts leave with the classifier, as they have no words. Very long texts pass
whole. A null lang or source is a value of its own. Rows that repeat a doc_id are judged by their
texts one by one; the near-dedup stage drops all rows of a doc_id whose text has a copy of a smaller
id; rows of a null doc_id pass it and the decontamination. Ties go by the smallest doc_id. An empty
table gives an empty result. Further columns pass through with their values, whatever their names;
only ``shard`` and ``slot`` come out as ``_own_shard`` and ``_own_slot``, as the last stage adds
columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontamination, mixing, quality, sharding, simhash
from loomgraph.llm.common import cut


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Texts with 0.8 and more of their five-word shingles in common mostly differ in more than 3 bits
    of 64. The stage takes fingerprints of three-word shingles, which near copies share more of, and
    a second one of mixed hashes: texts link if either differs in 8 bits or fewer and both together
    in 18 of 128. The README has what share of pairs that links, by their similarity.
    """
    return simhash.keep_one_of_each(docs, limit=8, total=18)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources' shares are flattened."""
    return mixing.replicated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, as written to the shards' files; columns of these names are _own_shard and _own_slot."""
    return sharding.sharded(docs, shards=40)


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_to_weights),
    ("sharding", shard),
]

#: No SQL: stages 1, 2 and 5 use models, fingerprints and shuffles that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
