"""Edges between nodes too many to broadcast: the ends of many edges are dealt with apart, no task gets a hub's edges by a shuffle."""

import pytest

from loomgraph.operators import graph as g


@pytest.mark.parametrize("hub", [10**6, 20, 0])
def test_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(g, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(g, "HUB", hub)
    pairs = [("hub", f"n{i % 60}") for i in range(100)] + [("none", f"n{i}") for i in range(50)] + [(f"n{i}", "hub") for i in range(70)] + [("n1", "gone"), (None, "n1"), ("n2", None)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = {"hub", *[f"n{i}" for i in range(40)]}
    got = g.between(edges, spark.createDataFrame([(x,) for x in sorted(nodes)], "id string")).collect()
    assert sorted((r["source"], r["target"]) for r in got) == sorted(p for p in pairs if set(p) <= nodes)


def test_limit(spark):
    """Ids whose hash table would take some 640 MB are not broadcast."""
    from loomgraph.storage import broadcast_if_small, plan_bytes, stored

    ids = stored(spark.range(1_500_000).selectExpr("sha2(cast(id as string), 256) as id").limit(200_000), "many-ids")
    assert 4 << 20 < plan_bytes(ids) < 64 << 20 and broadcast_if_small(ids) is ids
