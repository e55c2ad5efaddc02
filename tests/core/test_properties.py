"""Properties that hold for any graph and any text, on random ones."""

import itertools
import random
import re

import pytest

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.model import CHUNKS, EDGES, NODES, Graph
from loomgraph.operators import graph as g
from loomgraph.operators import segment


def random_graph(spark, seed):
    rng = random.Random(seed)
    types = ["Definition", "Notation", "Formula", "Example", "Exercise", "Lemma"]
    ids = [f"{rng.choice(['', 'tex:'])}n{i}" for i in range(40)]
    nodes = [(i, rng.choice(types), rng.choice(["", "t", "title"]), rng.choice([None, "x_1", "long " * 30]), rng.choice([None, ("f", None, rng.choice([None, f"n{rng.randint(0, 45)}"]), ["f"])]), rng.choice([None, {"k": str(k)}]), (k, 0)) for k, i in enumerate(ids)]
    edges = [(None, rng.choice(["Contains", "EquivalentTo", "DependsOn"]), rng.choice([*ids, "gone"]), rng.choice([*ids, "gone2"]), rng.choice([None, "e"]), rng.choice([None, {"chunkId": "c"}]), (k, 0)) for k in range(60)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def flat(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_graphs(spark, seed):
    graph = random_graph(spark, seed)
    once = Graph(g.upsert_nodes(graph.nodes), g.upsert_edges(graph.edges))
    twice = Graph(g.upsert_nodes(once.nodes.unionByName(once.nodes)), g.upsert_edges(once.edges.unionByName(once.edges)))
    assert flat(once.nodes) == flat(twice.nodes) and flat(once.edges) == flat(twice.edges)

    seen = g.view(once, False, False, False)
    again = g.view(seen, False, False, False)
    assert flat(seen.nodes) == flat(again.nodes) and flat(seen.edges) == flat(again.edges)
    assert set(flat(seen.nodes)) <= set(flat(once.nodes)) and seen.nodes.filter("type in ('Example', 'Exercise')").count() == 0

    pruned, dropped = g.prune(once)
    assert once.nodes.join(dropped, "id").filter("type <> 'Formula'").count() == 0
    assert pruned.nodes.count() + dropped.count() == once.nodes.count() and flat(g.between(pruned.edges, pruned.nodes)) == flat(pruned.edges)

    frozen, alias = g.freeze(once)
    names = {r["id"]: r["canonical"] for r in alias.collect()}
    assert all(names.get(c, c) == c for c in names.values())
    assert frozen.edges.filter("source = target").count() == 0 and not {r["id"] for r in frozen.nodes.collect()} & {i for i, c in names.items() if i != c}
    assert frozen.nodes.count() == once.nodes.count() - sum(i != c for i, c in names.items())


def test_components_against_union_find(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = [(f"v{rng.randint(0, 60)}", f"v{rng.randint(0, 60)}") for _ in range(45)]
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        got = {r["id"]: r["component"] for r in g.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
        assert got == {x: root(x) for x in parent}


def test_windows_overlap(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["\\alpha", "ab", "中", " ", "\n", "(", "_x9 ", "é"]) for _ in range(120)) for _ in range(20)]
    chunks = spark.createDataFrame([(f"c{i}", "f", "t", ["f"], t, i << 16) for i, t in enumerate(texts)], CHUNKS)
    counts = lambda df: df.selectExpr("id", "chunk_seq >> 16 as c", "chunk_seq & 65535 as w", "text").withColumn("t", segment.tokens(df["text"]))
    rows = counts(segment.split_windows(chunks, 30)).collect()
    whole = {r["c"]: [t.strip() for t in r["t"]] for r in counts(chunks).collect()}
    for c in whole:
        own = sorted((r for r in rows if r["c"] == c), key=lambda r: r["w"])
        assert all(len(r["t"]) <= 30 for r in own)
        for i, r in enumerate(own):
            assert [t.strip() for t in r["t"]] == whole[c][i * 15 : i * 15 + 30]
        assert own[-1]["w"] * 15 + 30 >= len(whole[c])


def test_running_results(spark):
    """Sums and largest so far, over and under the length at which arrays are cut."""
    for n in (0, 1, 255, 256, 257, 3000):
        x = [(i * 7919) % 101 for i in range(n)]
        r = spark.createDataFrame([(x,)], "x array<int>").select(text.running_sum(F.col("x")).alias("s"), text.running_max(F.col("x")).alias("m")).first()
        assert r["s"] == list(itertools.accumulate(x)) and r["m"] == list(itertools.accumulate(x, max))


def test_within_ranges(spark):
    rng = random.Random(2)
    for n in (0, 3, 700):
        cuts = sorted(rng.sample(range(5000), 2 * n))
        ranges, places = list(zip(cuts[::2], cuts[1::2])), [rng.randrange(5000) for _ in range(2 * n + 2)] + [e for _, e in zip(range(3), cuts)]
        df = spark.createDataFrame([(places, ranges)], "p array<int>, r array<struct<start:int,end:int>>")
        assert df.select(text.within(F.col("p"), F.col("r"))).first()[0] == [any(a <= p <= b for a, b in ranges) for p in places]


def test_windows_in_runs_of_tokens(spark):
    """Windows of even and odd sizes against tokens one by one; an even size takes runs of half a window, not a string a token."""
    text = " \u00a0\\alpha x_1 \u4e00\u4e8c, \\ \U0001f600 y  " * 9 + "\n\u2028"
    space = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2028\u2029\u202f\u205f\u3000\ufeff"
    one = re.findall(rf"[{space}]*(?:\\[a-zA-Z]+|[a-zA-Z0-9_]+|[^{space}])", text)
    for size in (1, 2, 5, 8, 30, len(one), len(one) + 1):
        c = spark.createDataFrame([("c", "f", "t", ["f"], text, 0)], "id string, file string, title string, section_path array<string>, text string, chunk_seq long")
        made = segment.split_windows(c, size)
        got = [r["text"] for r in made.orderBy("chunk_seq").collect()]
        stride = max(1, size // 2)
        want = [text] if len(one) <= size else ["".join(one[w * stride : w * stride + size]).lstrip(space) for w in range(-(-(len(one) - size) // stride) + 1)]
        assert got == want
    assert "{1,4}" in segment.split_windows(c, 8)._jdf.queryExecution().optimizedPlan().toString()


def test_trim_is_built_in(spark):
    """trim looks at a text's ends alone, with no regular expression over the whole, and takes what the browser's trim takes."""
    space = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(chr(i) for i in range(0x2000, 0x200B))
    texts = ["", space, "a", f"{space}a{space}b \U0001f600{space}", "\u200ba\u200b", "\x1ca\x85", "\u00e9 ", None, *[f"{c}x{c}y{c}" for c in space]]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(text.trim(F.col("t")).alias("t"))
    assert [r["t"] for r in made.collect()] == [t if t is None else t.strip(space) for t in texts]
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
