"""Alignment of concepts: labels decide, and for unlabeled concepts a pluggable aligner in batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, squeeze, trim
from ..model import CONCEPT_TYPES
from .graph import place_of
from .retrieve import path_end

BATCH, LEAST_BATCH, MOST_BATCH, CONFIDENCE, EVIDENCE = 80, 20, 120, 0.88, 180
DECISION = "alias string, canonical string, confidence double, reason string"
Aligner = Callable[[pd.DataFrame], pd.DataFrame]


def evidence_of(content: Column) -> Column:
    """The content's first characters in one line."""
    return F.substring(squeeze(or_empty(content)), 1, EVIDENCE)


def label_rule(nodes: DataFrame) -> DataFrame:
    """(alias, canonical): a labeled concept is its label's id."""
    label = F.col("source.latexLabel")
    return nodes.filter(F.col("type").isin(*CONCEPT_TYPES) & (label != "")).select(F.col("id").alias("alias"), F.concat(F.lit("tex:"), label).alias("canonical"))


def cards(nodes: DataFrame, batch: int = BATCH) -> DataFrame:
    """(batch, id, type, title, section, evidence) of unlabeled concepts, in order, so many a batch."""
    size = max(LEAST_BATCH, min(MOST_BATCH, int(batch)))
    plain = nodes.filter(F.col("type").isin(*CONCEPT_TYPES) & F.col("source.latexLabel").isNull() & ~F.col("id").startswith("tex:"))
    section = path_end(F.coalesce("source.sectionPath", F.array().cast("array<string>")))
    return place_of(plain).select(F.floor(F.col("place") / size).alias("batch"), "id", "type", "title", section.alias("section"), evidence_of(F.col("content")).alias("evidence"), "place")


def accepted(decisions: DataFrame, asked: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(batch, alias, canonical, confidence): sure decisions between two ids of the batch; ``decisions`` has batch and the decision's fields."""
    d = decisions.withColumns({"alias": trim(F.col("alias")), "canonical": trim(F.col("canonical"))})
    d = d.filter((F.col("alias") != "") & (F.col("canonical") != "") & (F.col("alias") != F.col("canonical")) & (F.col("confidence") >= confidence))
    ids = asked.select("batch", "id").distinct()
    for c in ("alias", "canonical"):
        d = d.join(ids.withColumnRenamed("id", c), ["batch", c], "left_semi")
    return d.select("batch", "alias", "canonical", "confidence")


def nothing(batch: pd.DataFrame) -> pd.DataFrame:
    """The default aligner: no two concepts are the same."""
    return pd.DataFrame(columns=["alias", "canonical", "confidence", "reason"])


def align_prompt(batch: pd.DataFrame) -> str:
    """What a model is asked about a batch of cards."""
    lines = [f"- id: {c.id}; type: {c.type}; title: {c.title}; section: {c.section}; evidence: {c.evidence or 'none'}" for c in batch.itertuples()]
    return "\n".join([
        "These cards name mathematical concepts. Say which of them are one and the same concept, object or notation.",
        "Leave a pair out in any doubt; being related or alike is not enough. Both ids must be of these cards.",
        f"Give a confidence from 0 to 1; leave out what is under {CONFIDENCE}.",
        *lines,
        'Answer with JSON alone: {"decisions": [{"alias": "id", "canonical": "id", "confidence": 0.0, "reason": "short"}]}',
    ])


def prompted(ask: Callable[[str], str]) -> Aligner:
    """An aligner that asks a model (from prompt to JSON text); decisions of another shape are left out."""

    def aligner(batch: pd.DataFrame) -> pd.DataFrame:
        found = json.loads(ask(align_prompt(batch)))
        decisions = found.get("decisions") if isinstance(found, dict) else None
        rows = [d for d in decisions or [] if isinstance(d, dict) and isinstance(d.get("alias"), str) and isinstance(d.get("canonical"), str) and isinstance(d.get("confidence"), int | float)]
        return pd.DataFrame([(d["alias"], d["canonical"], float(d["confidence"]), str(d.get("reason") or "")) for d in rows], columns=["alias", "canonical", "confidence", "reason"])

    return aligner


def align(nodes: DataFrame, aligner: Aligner = nothing, batch: int = BATCH) -> DataFrame:
    """(alias, canonical) by labels and by the aligner, which gets a batch of cards as a pandas frame."""
    asked = cards(nodes, batch)

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        got = aligner(own.sort_values("place").drop(columns=["batch", "place"])).reindex(columns=["alias", "canonical", "confidence", "reason"])
        texts = {c: got[c].astype(object) for c in ("alias", "canonical", "reason")}
        return got.assign(**texts, confidence=got["confidence"].astype(float), batch=key[0])

    decided = asked.groupBy("batch").applyInPandas(run, DECISION + ", batch long")
    sure = accepted(decided, asked).groupBy("alias").agg(F.max_by("canonical", F.struct("confidence", "canonical")).alias("canonical"))
    return label_rule(nodes).unionByName(sure)
