"""Tables and vocabularies.

Rows have no order in Spark, but the graph's merges depend on it. So nodes and edges carry ``seq``,
a pair (major, minor): the chunk and the place in it, or the place in an imported list and 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of entities and relations.
ENTITY_TYPES = ("Theorem", "Lemma", "Corollary", "Definition", "Notation", "Construction", "Formula", "Example", "Exercise", "Axiom", "Proposition", "Conclusion")
RELATION_TYPES = ("Proves", "DependsOn", "DerivedFrom", "Contains", "EquivalentTo", "AppliesTo", "Uses", "AssistsIn")
# What phase 1 extracts, and the relations it may use.
CONCEPT_TYPES = ("Definition", "Notation", "Construction")
CONCEPT_RELATIONS = ("EquivalentTo", "DependsOn", "Uses")
#: Relations that keep a formula from being pruned.
STRONG_RELATIONS = tuple(r for r in RELATION_TYPES if r != "Contains")
# Theorem-like environments and the entities they hold.
ENVIRONMENTS = {
    "theorem": "Theorem", "lemma": "Lemma", "corollary": "Corollary", "definition": "Definition", "example": "Example",
    "exercise": "Exercise", "axiom": "Axiom", "proposition": "Proposition", "conclusion": "Conclusion",
}
# Heading commands and their levels (a file is level 0), granularities, extensions of images.
HEADINGS = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 5}
GRANULARITIES = {"file": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg")

SEQ = T.StructType([T.StructField("major", T.LongType()), T.StructField("minor", T.LongType())])
SOURCE = T.StructType([T.StructField("file", T.StringType()), T.StructField("lineHint", T.IntegerType()), T.StructField("latexLabel", T.StringType()), T.StructField("sectionPath", T.ArrayType(T.StringType()))])
META = T.MapType(T.StringType(), T.StringType())
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("file_seq", T.LongType())])
CHUNKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("file", T.StringType()), T.StructField("title", T.StringType()), T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("chunk_seq", T.LongType())])
NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("source", SOURCE), T.StructField("meta", META), T.StructField("seq", SEQ)])
EDGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("evidence", T.StringType()), T.StructField("meta", META), T.StructField("seq", SEQ)])


@dataclass(frozen=True)
class Graph:
    """A directed typed multigraph: two tables."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    def counts(self) -> dict[str, int]:
        return {"nodes": self.nodes.count(), "edges": self.edges.count()}

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)


@dataclass(frozen=True)
class Selection:
    """What to extract, and notes for a model-backed extractor."""

    entities: tuple[str, ...] = ENTITY_TYPES
    relations: tuple[str, ...] = RELATION_TYPES
    notes: str = ""


@dataclass(frozen=True)
class ModelConfig:
    """Settings of a model-backed extractor. The key is kept out of repr and of snapshots."""

    protocol: str = "openai"
    base_url: str = ""
    model: str = ""
    api_key: str = field(default="", repr=False)
    temperature: float = 0.2
    top_p: float = 0.9
    max_tokens: int = 100_000
    parallelism: int = 4
    enabled: bool = True

    def public(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "api_key"}


def seq(major: Column | str, minor: Column | str | int = 0) -> Column:
    minor = F.lit(minor) if isinstance(minor, int) else F.col(minor) if isinstance(minor, str) else minor
    major = F.col(major) if isinstance(major, str) else major
    return F.struct(major.cast("long").alias("major"), minor.cast("long").alias("minor"))


def source_of(file: Column, label: Column, path: Column) -> Column:
    return F.struct(file.cast("string").alias("file"), F.lit(None).cast("int").alias("lineHint"), label.cast("string").alias("latexLabel"), path.alias("sectionPath"))


def no_meta() -> Column:
    return F.lit(None).cast(META)


def columns_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
