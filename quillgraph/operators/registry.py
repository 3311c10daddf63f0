"""Declared vector predicates: dimensions and metric, insertion with a check, deletion by marks, compaction.

Vectors of a predicate are a staged table (s, vec, deleted). Rows that don't fit the declaration are refused, not dropped
silently: insert() returns them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..plans.store import stage
from .solutions import Solutions
from .vector import DEFAULT_K, proximity_graph, search

#: Names of metrics in declarations.
NAMES = {"cosine": "cosine", "euclidean": "euclid", "dot": "dot", "dotproduct": "dot", "dot_product": "dot"}
SCHEMA = "s string, vec array<float>, deleted boolean"


@dataclass(frozen=True)
class Declared:
    dimensions: int
    metric: str
    m: int


class Registry:
    def __init__(self, spark: SparkSession):
        self.spark, self.declared, self.vectors = spark, {}, {}

    def declare(self, p: str, dimensions: int, metric: str = "cosine", m: int = 16) -> None:
        """A second declaration of a predicate, an unknown metric or no dimension is an error."""
        if p in self.declared:
            raise ValueError(f"{p} is declared already")
        if NAMES.get(metric.lower()) not in METRICS or dimensions < 1:
            raise ValueError(f"{metric} with {dimensions} dimensions can't be declared")
        self.declared[p] = Declared(dimensions, NAMES[metric.lower()], m)
        self.vectors[p] = self.spark.createDataFrame([], SCHEMA)

    def predicates(self) -> list[str]:
        return sorted(self.declared)

    def _of(self, p: str) -> Declared:
        if p not in self.declared:
            raise KeyError(f"{p} is no declared vector predicate")
        return self.declared[p]

    def insert(self, p: str, rows: DataFrame) -> DataFrame:
        """Take rows (s, vec); return those refused: null subjects or vectors, other dimensions, null or non-finite components. A subject's
        new vector replaces its old one; of several in rows the least counts."""
        declared = self._of(p)
        rows = rows.select("s", F.col("vec").cast("array<float>").alias("vec"))
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        good = F.coalesce(F.col("s").isNotNull() & (F.size("vec") == declared.dimensions) & F.forall("vec", fine), F.lit(False))
        new = rows.where(good).groupBy("s").agg(F.min("vec").alias("vec")).withColumn("deleted", F.lit(False))
        self.vectors[p] = stage(self.vectors[p].join(new, "s", "left_anti").unionByName(new), "vectors")
        return rows.where(~good)

    def delete(self, p: str, subjects: DataFrame) -> int:
        """Mark subjects (s) as deleted; how many were there and weren't marked yet."""
        self._of(p)
        marks = subjects.select("s").distinct().withColumn("__gone", F.lit(True))
        rows = self.vectors[p].join(marks, "s", "left")
        n = rows.where("__gone AND NOT deleted").count()
        self.vectors[p] = stage(rows.select("s", "vec", (F.col("deleted") | F.coalesce("__gone", F.lit(False))).alias("deleted")), "vectors")
        return n

    def compact(self, p: str) -> int:
        """Write the vectors anew without those deleted; how many went."""
        self._of(p)
        n = self.vectors[p].where("deleted").count()
        if n:
            self.vectors[p] = stage(self.vectors[p].where("NOT deleted"), "vectors")
        return n

    def live(self, p: str) -> DataFrame:
        self._of(p)
        return self.vectors[p].where("NOT deleted").select("s", "vec")

    def search(self, p: str, query: list[float], k: int | None = DEFAULT_K, threshold: float | None = None, metric: str | None = None, subject: str = "s") -> Solutions:
        """By the declared metric or another."""
        declared = self._of(p)
        if len(query) != declared.dimensions:
            raise ValueError(f"{p} has {declared.dimensions} dimensions, the query {len(query)}")
        return search(self.live(p), query, NAMES[metric.lower()] if metric else declared.metric, k, threshold, subject)

    def edges(self, p: str, layers: int = 2) -> DataFrame:
        return proximity_graph(self.live(p), self._of(p).m, layers)
