"""Files of lines in blocks: chunks are those of whole files, wherever blocks end."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import segment


def text_of(seed, n):
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        kind = rng.randrange(9)
        name = rng.choice(["section", "chapter", "subsection*", "paragraph", "section"])
        lines.append(f"\\{name}{{{rng.choice('ABC')}}}" if kind == 0 else "" if kind == 1 else f"line {i} % note" if kind == 2 else f"word {i}")
    return "\n".join(lines)


def rows(df):
    return [tuple(r) for r in df.orderBy("chunk_seq").collect()]


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
@pytest.mark.parametrize("granularity", ["section", "file", "paragraph"])
def test_blocks(spark, size, granularity):
    files = spark.createDataFrame([(f"f{i}.tex", text_of(i, 160), i % 2) for i in range(3)] + [("f1.tex", text_of(9, 90), 7), ("e.tex", "", 0)], "path string, content string, file_seq long")
    lines = segment.lines_of(files).withColumn("block", F.floor(F.col("pos") / size))
    assert rows(segment.chunk_lines(lines, granularity)) == rows(segment.chunk_files(files, granularity))
    by = ["path", "file_seq", "pos"]
    stack = lambda df: df.select(*by, *[f"h{n}" for n in segment.LEVELS]).orderBy(*by).collect()
    assert stack(segment.with_stack(segment.with_heading(lines))) == stack(segment.with_stack(segment.with_heading(lines.drop("block"))))


def test_files_read_in_splits(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"big{i}.tex").write_text(text_of(i, 900))
    (tmp_path / "notes.txt").write_text("no")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        lines = segment.read_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.tex").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    assert rows(segment.chunk_lines(lines)) == rows(segment.chunk_files(whole)) and lines.count() == 1800
