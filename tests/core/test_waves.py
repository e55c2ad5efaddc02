"""What a wave of a model-backed run does in one pass: the same as the operators it is made of, in fewer jobs."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.model import EDGES, NODES, Graph
from loomgraph.operators import graph as g
from loomgraph.operators import normalize as no
from loomgraph.operators import retrieve as rt
from loomgraph.queries import graphs

CHUNKS = "id string, file string, title string, section_path array<string>, text string, chunk_seq long"


def sample(spark, seed, n=150, start=0):
    rng = random.Random(seed)
    words = ["group", "rings", "abelian", "Galois", "größe", "abel", "abelians", "x"]
    ids = [rng.choice(["n", "tex:l"]) + str(i) for i in range(start, start + n)]
    nodes = [
        (x, rng.choice(["Lemma", "Definition"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice([None, "c"]),
         rng.choice([None, (None, None, rng.choice([None, f"l{rng.randrange(n)}", ""]), rng.choice([None, [], ["a", f"s{rng.randrange(3)}"]]))]), rng.choice([None, {}, {"k": str(i), "chunkId": "c"}]), (rng.randrange(40), i))
        for i, x in enumerate(ids)
    ]
    edges = [(None, rng.choice(["Uses", "Proves"]), *rng.sample(ids, 2), rng.choice([None, "e"]), rng.choice([None, {"chunkId": "c"}, {"k": "v"}]), (rng.randrange(40), i)) for i in range(2 * n)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)), ids


def test_summaries_of_few_chunks(spark):
    """One pass over nodes and edges shows what the joins show; with many tasks, few and no nodes, and frequent words and ties."""
    graph, _ = sample(spark, 1)
    texts = ["\\ref{l3} of the größe", "\\label{l7}\\ref{l7} group abelian", "the group rings group", "nothing", ""]
    chunks = spark.createDataFrame([(f"c{i}", "a.tex", f"galois {i}" if i % 2 else "", ["a", f"s{i % 4}"] if i % 3 else [], t, i * 65536) for i, t in enumerate(texts)], CHUNKS)
    for most, one in ((5, graph), (400, graph), (7, Graph(graph.nodes.repartition(9), graph.edges.repartition(7))), (4, Graph(graph.nodes.limit(3), graph.edges)), (4, Graph.empty(spark))):
        size = one.counts() | {"nodes": 1 << 20, "edges": 1 << 20}  # as many tasks as there are partitions
        few = rt.summaries_of_few(one, chunks, rt.queries(chunks).collect(), most, size).orderBy("chunk_seq").collect()
        assert few == rt.summaries_of_many(one, chunks, most, size).orderBy("chunk_seq").collect()


def test_best_in_blocks():
    rng = random.Random(3)
    rows = [{"chunk_seq": i, "labels": [f"l{i}"], "words": rng.sample(["aaaa", "aaaab", "bbbb", "cccc"], 2), "hint": "h" if i % 2 else ""} for i in range(6)]
    asked = rt.Asked(rows)
    nodes = [((i, 0), asked.marks(f"tex:l{i % 9}", rng.choice(["xaaaabx", "bbbbcccc", "", "aaa"]), rng.choice([None, "", "l2"]), rng.choice(["", "h"]))) for i in range(50)]
    scores = np.stack([asked.scores(m) for _, m in nodes])
    for c, (own, had) in enumerate(rt.best_of(nodes, asked, 4, block=7)):
        want = sorted(range(50), key=lambda i: (-scores[i, c], i))[:4]
        assert sorted(own.tolist()) == sorted(want) and had.tolist() == scores[own, c].tolist()


def test_finished(spark):
    text = "\\begin{lemma}\\label{a} All of the block of the lemma\\end{lemma} and ten letters then the middle and the last ten \\begin{example} it is 3 = x here \\end{example}"
    chunks = spark.createDataFrame([(f"c{i}", "a.tex", "t", ["s"], text, i * 65536) for i in range(2)], CHUNKS)
    rows = [("n1", "Lemma", "t", "short", "a"), ("n1", "Lemma", "u", "ten letters ... the last ten", None), ("tex:a", "Formula", "", "x ... y", None), ("f", "Formula", "told", "it is 3 = x here", None), ("t", "Lemma", "Lemma 3", "it holds", None),
            ("w", "Example", "e", "\\begin{solution}yes it does\\end{solution} and twenty letters more", None), ("z", "Lemma", "z", None, "none")]
    nodes = [(i, k, t, c, None if label is None else (None, None, label, None), {"k": "v"}, (65536 * chunk, n)) for chunk in (0, 1, 2) for n, (i, k, t, c, label) in enumerate(rows)]
    edges = [(None, "Uses", a, b, None, None, (65536 * (n % 3), n)) for n, (a, b) in enumerate([("n1", "w"), ("n1", "t"), ("old", "w"), ("z", "gone"), ("f", "n1"), ("w", "z")] * 3)]
    made = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    old = made.nodes.limit(1).withColumn("id", F.lit("old"))
    by_steps = no.completed(made, chunks)
    want, want_said = no.filtered(Graph(no.annotated(by_steps.nodes), by_steps.edges), chunks, existing=old)
    got, said = no.finished(made, chunks, old)
    for a, b in ((got.nodes, want.nodes), (got.edges, want.edges), (said, want_said)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert any("ten letters then" in (r["content"] or "") for r in got.nodes.collect()) and said.count() > 3


def test_merge_few(spark):
    """What a wave doesn't touch stays as it is; the rest is as if all were upserted."""
    first, ids = sample(spark, 5, 60)
    old = g.merge_graphs(Graph.empty(spark), first)
    for seed, start in ((6, 30), (7, 500)):
        new, _ = sample(spark, seed, 20, start)
        for nulls in (False, True):
            want, got = g.merge_graphs(old, new, nulls), g.merge_few(old, new, nulls, g.sizes(old)["top"])
            for a, b in ((got.nodes, want.nodes), (got.edges, want.edges)):
                assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_jobs_of_a_wave(spark, tmp_path):
    """A run of 1,000 chunks has four waves, whatever they hold; their jobs are what takes its time."""
    table = "s_suppkey int, s_name string, s_nationkey int, s_acctbal double"
    spark.createDataFrame([(i, f"Supplier#{i:09d}", 0, 0.0) for i in range(1000)], table).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sparkContext.setJobGroup("waves", "waves")
    try:
        made = graphs.llm_stub_pipeline(spark, str(tmp_path))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("waves"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert made.groupBy("part").count().orderBy("part").collect() == [("edge", 1999), ("node", 2000)]
    assert jobs < 270, jobs
