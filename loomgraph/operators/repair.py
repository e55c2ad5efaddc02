"""Repair of formulas that a renderer refuses, by a pluggable function, and its undoing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, trim
from ..model import NODES, columns_like
from .graph import patch_nodes

Repairer = Callable[[str], str]


def as_it_is(content: str) -> str:
    return content


def repair_prompt(content: str) -> str:
    """What a model is asked about a formula that the renderer refuses."""
    return "\n".join([
        "Rewrite this LaTeX so that MathJax 3 renders it, with the same meaning and as few changes as can be.",
        "Close delimiters, replace commands that it lacks, put displays into mathematics; add nothing of your own.",
        'Answer with JSON alone: {"content": "..."}',
        "LaTeX:",
        content,
    ])


def prompted(ask: Callable[[str], str]) -> Repairer:
    """A repairer that asks a model (from prompt to JSON text) and takes the answer's ``content``."""

    def repairer(content: str) -> str:
        found = json.loads(ask(repair_prompt(content)))
        fixed = found.get("content") if isinstance(found, dict) else None
        if not isinstance(fixed, str) or not fixed:
            raise ValueError("the model gave no content")
        return fixed

    return repairer


def repairs(nodes: DataFrame, repairer: Repairer = as_it_is) -> DataFrame:
    """(id, content, error) of each node that has content: the repaired one, or why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for node_id, content in zip(b["id"], b["content"], strict=True):
                try:
                    fixed = repairer(content)
                    if not isinstance(fixed, str) or not fixed:
                        raise ValueError("no content came back")
                    rows.append((node_id, fixed, None))
                except Exception as e:  # one node's failure leaves the others alone
                    rows.append((node_id, None, str(e)))
            yield pd.DataFrame(rows, columns=["id", "content", "error"])

    return nodes.filter(trim(or_empty(F.col("content"))) != "").select("id", "content").mapInPandas(run, "id string, content string, error string")


def repair(nodes: DataFrame, repairer: Repairer = as_it_is) -> DataFrame:
    """``nodes`` with repaired contents; meta keeps the first original and says that it was repaired. Failures change nothing."""
    done = repairs(nodes, repairer).filter("error is null")
    old = nodes.select(F.col("id").alias("_id"), F.coalesce(F.col("meta")["originalContent"], F.col("content")).alias("_old"))
    meta = F.create_map(F.lit("originalContent"), F.col("_old"), F.lit("mathjaxFixed"), F.lit("true"))
    patches = done.join(old, done["id"] == old["_id"]).select("id", F.lit(None).cast("string").alias("title"), "content", meta.alias("meta"))
    return patch_nodes(nodes, patches)


def restore(nodes: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """``nodes`` with their originals back; of all that have one, or of ``ids``."""
    original = F.col("meta")["originalContent"]
    wanted = original.isNotNull() & (F.lit(True) if ids is None else F.col("id").isin(*ids))
    patches = nodes.filter(wanted).select("id", F.lit(None).cast("string").alias("title"), original.alias("content"), F.create_map(F.lit("mathjaxFixed"), F.lit("false")).alias("meta"))
    return columns_like(patch_nodes(nodes, patches), NODES)
