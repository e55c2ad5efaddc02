"""Tables of one file with one row group: all cores take part in what is made of their rows."""

from pyspark.sql import functions as F

from loomgraph.queries.corpora import star_graph
from loomgraph.storage import dealt


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_star_graph(spark):
    sizes = rows_by_task(star_graph(spark, "/root/testdata/sf0.001").nodes.filter("type = 'Formula'"))
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 2


def test_one_large_file(spark, monkeypatch):
    """A file over 32 MB a core is dealt, too."""
    monkeypatch.setattr("loomgraph.storage.plan_bytes", lambda df: spark.sparkContext.defaultParallelism * (40 << 20))
    assert len(rows_by_task(dealt(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))) == spark.sparkContext.defaultParallelism


def test_bounded_rows(spark, monkeypatch):
    """A table with more rows than its cores may take at once is dealt to more tasks."""
    monkeypatch.setattr("loomgraph.storage.ROWS", 30)
    sizes = rows_by_task(dealt(spark.read.parquet("/root/testdata/sf0.001/part.parquet")))
    assert len(sizes) == -(-sum(sizes) // 30) > spark.sparkContext.defaultParallelism and max(sizes) <= 45
