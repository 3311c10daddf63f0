"""Property paths over edge DataFrames (s, o): a frontier that grows by joins until nothing is new.

Each round is written to the shared folder, which keeps the lineage short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import stage

REWRITE = 8  # rounds


def sequence(*steps: DataFrame) -> DataFrame:
    """p1/p2/...: pairs connected by one edge of each; a bag."""
    out = steps[0].select("s", "o")
    for nxt in steps[1:]:
        out = out.join(nxt.select(F.col("s").alias("o"), F.col("o").alias("__next")), "o").select("s", F.col("__next").alias("o"))
    return out


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("o").alias("s"), F.col("s").alias("o"))


def alternative(*edges: DataFrame) -> DataFrame:
    out = edges[0].select("s", "o")
    for e in edges[1:]:
        out = out.unionByName(e.select("s", "o"))
    return out


def zero_or_one(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return one(edges, starts).unionByName(identity(edges, starts)).distinct()


def one(edges: DataFrame, starts: DataFrame | None) -> DataFrame:
    return edges.select("s", "o") if starts is None else edges.join(starts.select("s").distinct(), "s", "left_semi").select("s", "o")


def identity(edges: DataFrame, starts: DataFrame | None) -> DataFrame:
    nodes = edges.select("s").unionByName(edges.select(F.col("o").alias("s"))) if starts is None else starts.select("s")
    return nodes.distinct().select("s", F.col("s").alias("o"))


def one_or_more(edges: DataFrame, starts: DataFrame | None = None, until: Column | None = None, depth: int | None = None) -> DataFrame:
    """p+ as a set of pairs, from the given starts or all. A branch stops where `until` (over s and o) holds: such
    ends are reached but not left. depth bounds the number of edges.

    Rounds double: pairs reached so far join the edges, then themselves, so that long chains take few rounds; with
    `until` or `depth`, rounds go edge by edge."""
    edges = stage(edges.select("s", "o").distinct(), "edges")
    if starts is None and until is None and depth is None:
        reached = edges
        n = reached.count()
        while True:
            step = reached.select(F.col("s").alias("o"), F.col("o").alias("far"))
            longer = reached.join(step, "o").select("s", F.col("far").alias("o"))
            reached = stage(reached.unionByName(longer).distinct(), "reached")
            if (now := reached.count()) == n:
                return reached
            n = now
    step = edges.select(F.col("s").alias("o"), F.col("o").alias("far"))
    frontier = stage(one(edges, starts).distinct(), "frontier")
    reached, k = frontier, 1
    parts = 1  # of reached: written as one again from time to time, so that plans stay short
    while depth is None or k < depth:
        open_ends = frontier if until is None else frontier.where(~F.coalesce(until, F.lit(False)))
        frontier = stage(open_ends.join(step, "o").select("s", F.col("far").alias("o")).distinct().join(reached, ["s", "o"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached, parts = reached.unionByName(frontier), parts + 1
        if parts == REWRITE:
            reached, parts = stage(reached, "reached"), 1
        k += 1
    return reached


def zero_or_more(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return one_or_more(edges, starts).unionByName(identity(edges, starts)).distinct()
