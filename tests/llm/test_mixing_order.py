"""Mixed rows are shuffled within their partitions too."""

from loomgraph.llm import mixing
from pyspark.sql import functions as F


def test_partitions_are_shuffled(spark):
    docs = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.floor(F.col("id") / 1000).cast("string").alias("source"))
    mixed = mixing.mix_sources(docs).withColumn("part", F.spark_partition_id()).collect()
    for part in {r["part"] for r in mixed}:
        keys = [r["mix_key"] for r in mixed if r["part"] == part]
        assert keys == sorted(keys)
    names = [r["source"] for r in mixing.replicated(docs).collect()]
    changes = sum(a != b for a, b in zip(names, names[1:]))
    assert changes > 0.6 * len(names)  # three in four, were it not for chance


def test_null_and_repeated_ids(spark):
    """Rows without an id, or of one id, draw by their texts: as many come out as their number and rate say."""
    docs = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix_sources(docs)
    assert 3700 < mixed.count() < 4300 and 1700 < mixed.filter("doc_id is null").count() < 2300
    assert mixed.select("mix_key").distinct().count() > 0.99 * mixed.count()
    assert mixing.mix_sources(docs.drop("text").limit(10)).select("mix_copies").distinct().count() <= 2
