"""Components: any shape of graph, hubs dealt over salts, pairs in batches."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph as g


def reached(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def shapes(seed):
    rng = random.Random(seed)
    chain = [f"k{i:03d}" for i in range(120)]
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [("hub", f"s{i}") for i in range(150)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    pairs += [("é", "z"), ("\U0001f600", "é"), ("self", "self"), ("k005", "k005"), ("s3", "hub"), ("a", "s7")]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("merged,hub", [(500_000, 100_000), (3, 10), (0, 10), (40, 10**6)])
def test_shapes(spark, monkeypatch, merged, hub):
    """With few edges merged at once the rounds do the work; with a low limit of hubs their edges are dealt."""
    monkeypatch.setattr(g, "MERGED", merged)
    monkeypatch.setattr(g, "HUB", hub)
    pairs = shapes(merged)
    got = {r["id"]: r["component"] for r in g.components(spark.createDataFrame(pairs, "a string, b string").repartition(3)).collect()}
    assert got == reached(pairs)


def test_numbers_and_none(spark):
    pairs = [(i, i * 7 % 40 + 1) for i in range(-5, 40)]
    got = {r["id"]: r["component"] for r in g.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == reached(pairs)
    assert g.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_batches(spark):
    """After each batch the same as all pairs so far; rows of ids that it doesn't touch are the ones before."""
    pairs = shapes(5)
    made, so_far = g.Components.empty(spark), []
    for i in range(4):
        new = pairs[i * 90 : (i + 1) * 90 if i < 3 else None]
        before, labels = {r["id"]: r["component"] for r in made.current().collect()}, made.labels.collect()
        made, so_far = made.add(spark.createDataFrame(new, "a string, b string")), so_far + new
        now = reached(so_far)
        assert {r["id"]: r["component"] for r in made.current().collect()} == now
        assert set(labels) <= set(made.labels.collect()) and made.labels.count() == len(now)
        assert made.moved.groupBy("id").count().filter("count > 1").isEmpty()
        asked = [x for x in list(before)[:3]]
        if asked:
            assert {r["id"]: r["component"] for r in made.of(spark.createDataFrame([(x,) for x in asked], "id string")).collect()} == {x: now[x] for x in asked}
    assert made.moved.filter(F.col("id") == F.col("component")).isEmpty()


def test_leaves_take_no_rounds(spark, monkeypatch):
    """Stars of any size over several tasks, and chains within a task, are done without a round."""
    monkeypatch.setattr(g, "MERGED", 10)
    monkeypatch.setattr(g, "large_stars", lambda edges: pytest.fail("a round"))
    pairs = [(f"a{i % 7}", f"b{i:03d}") for i in range(200)]
    got = {r["id"]: r["component"] for r in g.components(spark.createDataFrame(pairs, "a string, b string").repartition(5)).collect()}
    assert got == reached(pairs)


def test_hubs_dealt(spark, monkeypatch):
    """With tables that are never broadcast, so that hubs go by salts."""
    monkeypatch.setattr(g, "MERGED", 3)
    monkeypatch.setattr(g, "HUB", 10)
    monkeypatch.setattr(g, "broadcast_if_small", lambda df: df)
    pairs = shapes(3)[:250]
    got = {r["id"]: r["component"] for r in g.components(spark.createDataFrame(pairs, "a string, b string").repartition(3)).collect()}
    assert got == reached(pairs)


def test_a_small_star_is_an_edge_for_each_id_and_other_neighbour(spark):
    """Ids that many tasks link have many edges; small stars have a row for each edge, not two."""
    pairs = sorted({(f"a{i % 7}", f"b{i * 5 % 40:02d}") for i in range(160)})
    edges = spark.createDataFrame(pairs, "v string, u string")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n"))
    got = [tuple(r) for r in g.small_stars(edges, least).select("v", "u").collect()]
    smallest = {u: min(v for v, w in pairs if w == u) for _, u in pairs}
    assert len(got) == len(pairs)
    assert set(got) == {(smallest[u], u) for _, u in pairs} | {(smallest[u], v) for v, u in pairs if v != smallest[u]}


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Groups of near copies link their ids in many tasks; while all edges fit one task, no edge is dealt to its ends."""
    monkeypatch.setattr(g, "peeled", None)
    pairs = [(i % (40 - k), i) for k in range(30) for i in range(40)]
    got = {r["id"]: r["component"] for r in g.components(spark.createDataFrame(pairs, "a long, b long").repartition(16)).collect()}
    assert got == reached(pairs)
