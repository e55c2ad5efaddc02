"""Files are ranked by ranges, not in one task."""

from pyspark.sql import functions as F

from loomgraph.operators import segment as sg


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_files_by_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = spark.range(500).select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("b", "A", "a", "B", "é", "10", "9")]), (F.col("id") % 7 + 1).cast("int")), F.lit("/"), F.col("id") % 11, F.lit(".tex")).alias("path"), (F.lit(500) - F.col("id")).alias("file_seq"))
        ranked = sg.order_files(files)
        assert "SinglePartition" not in plan(ranked)
        got = [(r["path"], r["file_seq"]) for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
        assert sorted(r["rank"] for r in ranked.collect()) == list(range(500))
        assert got == [(r["path"], r["file_seq"]) for r in files.orderBy(F.expr("path COLLATE UNICODE"), "file_seq").collect()]
        assert sg.order_files(files.limit(0)).count() == 0
        summed = sg.summed_before(files.withColumn("n", F.col("file_seq") % 5), "n", "before").orderBy(F.expr("path COLLATE UNICODE"), "file_seq").collect()
        at = 0
        for r in summed:
            assert r["before"] == at
            at += r["n"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
