"""The queries' SQL, and the pipeline: each stage on the one before, its decisions in effect."""

import corpus_pipeline
import pytest
from oracle import compare

from loomgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("n", range(1, 14))
def test_registered(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        sizes.append(out.count())
        if name != "mixing sources to target weights":
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = out
    assert sizes[0] > sizes[1] > sizes[3] > 0 and sizes[1] >= sizes[2] >= sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1] and set(last.columns) == {*columns, "shard", "slot"}


def test_stages_take_odd_documents(spark, odd_docs, none):
    docs = odd_docs.withColumnRenamed("size", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, none.withColumnRenamed("size", "n_chars")):
            out = stage(spark, d, SF)
            assert set(d.columns) <= set(out.columns), name
            assert out.count() <= 3 * d.count() + 5, name
            back = out.drop("shard", "slot").withColumnsRenamed({"_own_shard": "shard", "_own_slot": "slot"}) if name == "sharding" else out
            assert back.select(*d.columns).distinct().exceptAll(d.distinct()).count() == 0, name  # no value is lost or changed
    near = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert near == {1, 4, 7, 8, 9, None}
