"""Connected components over a table of links, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that it reaches.

    Edges from a node to itself are ignored.
    """
    found = components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b"))
    return found.withColumnRenamed("id", "node")
