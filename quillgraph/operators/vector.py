"""Vector search as patterns, exact nearest-neighbour graphs, and their edges as triples.

Vectors are DataFrames (s, vec). Search scores every vector natively and keeps the best k by one top-k aggregation; the k
best of the whole relation count, before the threshold. The neighbour graph streams all vectors past blocks of them by numpy: a task keeps
the k best of a block, and no other pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import score
from .solutions import Solutions

DEFAULT_K = 500
NEIGHBOUR, HORIZONTAL, DESCEND = (f"<http://ex.org/{n}>" for n in ("hnswNeighbor", "hnswHorizontalNeighbor", "hnswLayerDescend"))


def search(vectors: DataFrame, query: list[float], metric: str = "cosine", k: int | None = DEFAULT_K, threshold: float | None = None, subject: str = "s") -> Solutions:
    """Subjects with score, of the k best; threshold applies to those. k=None: all."""
    rows = vectors.select(F.col("s").alias(subject), score(metric, F.col("vec"), query).alias("score"))
    if k is not None:
        rows = rows.orderBy(F.desc("score"), subject).limit(k)
    return Solutions(rows if threshold is None else rows.where(F.col("score") >= threshold))


def filter_similar(solutions: Solutions, vectors: DataFrame, query: list[float], subject: str, metric: str = "cosine", threshold: float | None = None, k: int | None = None) -> Solutions:
    """Solutions whose bound subject is near the query; adds the score. Without a cap on k only the subjects' own vectors are scored."""
    if k is not None:
        return solutions.join(search(vectors, query, metric, k, threshold, subject))
    mine = vectors.join(solutions.df.select(F.col(subject).alias("s")).distinct(), "s", "left_semi")
    return solutions.join(search(mine, query, metric, None, threshold, subject))


class Nearest:
    """The k best targets so far of a block of queries: exact scores, and the targets' numbers."""

    def __init__(self, names: np.ndarray, x: np.ndarray, k: int):
        self.names, self.x, self.k = names, x, k
        self.rough = x.astype(np.float32)
        self.slack = (x.shape[1] + 8) * 2.0**-24  # what a product of unit vectors in single precision can be off
        self.score, self.who = np.full((len(x), k), -np.inf), np.full((len(x), k), -1)

    def meet(self, first: int, names: np.ndarray, y: np.ndarray) -> None:
        """Targets numbered from first on. A product in single precision tells which may be among the k best, one in double precision is their score."""
        rough = y.astype(np.float32).T
        for lo in range(0, len(self.x), QUERY_ROWS):
            least = (self.score[lo : lo + QUERY_ROWS, -1] - self.slack).astype(np.float32)
            near = np.flatnonzero(self.rough[lo : lo + QUERY_ROWS] @ rough >= least[:, None])
            for at in range(0, len(near), PAIRS):
                i, j = np.divmod(near[at : at + PAIRS], len(y))
                i += lo
                other = self.names[i] != names[j]
                i, j = i[other], j[other]
                self._take(i, first + j, (self.x[i] * y[j]).sum(1))

    def _take(self, i: np.ndarray, who: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.score[i, -1]
        i, who, score = i[good], who[good], score[good]
        rows = np.unique(i)
        i = np.concatenate([np.repeat(rows, self.k), i])
        who, score = np.concatenate([self.who[rows].ravel(), who]), np.concatenate([self.score[rows].ravel(), score])
        order = np.lexsort((who, -score, i))
        nth = np.arange(len(i)) - np.searchsorted(i[order], rows)[np.searchsorted(rows, i[order])]
        kept = order[nth < self.k]
        self.who[rows], self.score[rows] = who[kept].reshape(-1, self.k), score[kept].reshape(-1, self.k)


#: Rows of a product's block, and pairs that are scored at once.
QUERY_ROWS, TARGET_ROWS, PAIRS = 4096, 2048, 1 << 18


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension, of length 1; zero vectors stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest_neighbours(vectors: DataFrame, k: int, block_rows: int = 16_384, slice_rows: int = 1 << 20) -> DataFrame:
    """source, target, similarity: the k nearest (cosine; ties to the smaller target) of each vector. Equal dimensions. A task holds one
    block of queries (of fewer than block_rows where there are cores for more blocks) and the names of a slice of targets, which
    stream past it in the order of their names."""
    n = vectors.count()
    spread = max(512, -(-n // (4 * vectors.sparkSession.sparkContext.defaultParallelism)))
    blocks, slices = max(1, -(-n // min(block_rows, spread))), max(1, -(-n // slice_rows))
    kind = dict(vectors.dtypes)["vec"]
    vec = F.col("vec") if kind in ("array<float>", "array<double>") else F.col("vec").cast("array<double>")
    block, part = (F.pmod(F.xxhash64("s", F.lit(seed)), F.lit(count)).cast("int") for seed, count in ((1, blocks), (2, slices)))
    asks = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.struct((block * slices + i).alias("task"), F.lit(False).alias("target")))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct((i * slices + part).alias("task"), F.lit(True).alias("target")))
    dealt = vectors.where("s IS NOT NULL AND vec IS NOT NULL").select("s", vec.alias("vec"), F.inline(F.concat(asks, meets)))
    dealt = dealt.repartitionById(blocks * slices, F.col("task")).sortWithinPartitions("target", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x, found, targets, first, step = [], [], None, [], 0, 128
        for b in batches:
            asking = b.num_rows - (b.column(3).true_count or 0)  # those come first
            if asking:
                names.append(b.column(0).slice(0, asking))
                x.append(units(b.column(1).slice(0, asking)))
            if asking == b.num_rows or not x:
                continue
            if found is None:
                found = Nearest(np.concatenate([a.to_numpy(zero_copy_only=False) for a in names]), np.concatenate(x), k)
            mine, y = b.column(0).slice(asking), units(b.column(1).slice(asking))
            targets.append(mine)
            mine, lo = mine.to_numpy(zero_copy_only=False), 0
            while lo < len(y):
                found.meet(first + lo, mine[lo : lo + step], y[lo : lo + step])
                lo, step = lo + step, min(2 * step, TARGET_ROWS)
            first += len(y)
        if found is None:
            return
        targets = pa.chunked_array(targets).combine_chunks()
        row, nth = np.nonzero(found.score > -np.inf)
        who, score = found.who[row, nth], found.score[row, nth]
        if (found.names[1:] == found.names[:-1]).any():  # several vectors of one subject have k targets together
            of = np.concatenate([[0], np.cumsum(found.names[1:] != found.names[:-1])])[row]
            order = np.lexsort((who, -score, of))
            order = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
            row, who, score = row[order], who[order], score[order]
        for lo in range(0, len(row), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(found.names[row[at]], pa.string()), targets.take(pa.array(who[at])), pa.array(score[at])], ["source", "target", "similarity"])

    found = dealt.select("s", "vec", "task", "target").mapInArrow(compare, "source string, target string, similarity double")
    if slices == 1:
        return found
    order = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def top_layer(s: F.Column, m: int) -> F.Column:
    """A node's highest layer: geometric, from a hash of its name."""
    u = (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") + 1) / F.lit(float(1 << 32))
    return F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int")


def proximity_graph(vectors: DataFrame, m: int = 16, layers: int = 2) -> DataFrame:
    """source, target, layer, similarity, type: layer 0 has the 2m nearest of all vectors, layer l the m nearest among those that
    reach it; a node has a vertical edge to itself from each layer that it reaches above 0."""
    out = nearest_neighbours(vectors, 2 * m).select("source", "target", F.lit(0).alias("layer"), "similarity", F.lit("horizontal").alias("type"))
    for layer in range(1, layers + 1):
        there = vectors.where(top_layer(F.col("s"), m) >= layer)
        out = out.unionByName(nearest_neighbours(there, m).select("source", "target", F.lit(layer).alias("layer"), "similarity", F.lit("horizontal").alias("type")))
        out = out.unionByName(there.select(F.col("s").alias("source"), F.col("s").alias("target"), F.lit(layer).alias("layer"), F.lit(1.0).alias("similarity"), F.lit("vertical").alias("type")))
    return out


def edge_triples(graph: DataFrame) -> DataFrame:
    """The proximity graph as triples of the three predicates."""
    flat = F.col("type") == "horizontal"
    pairs = graph.groupBy("source", "target").agg(F.max(flat).alias("flat"), F.max(~flat).alias("down"))
    kinds = F.array_compact(F.array(F.lit(NEIGHBOUR), F.when(F.col("flat"), HORIZONTAL), F.when(F.col("down"), DESCEND)))
    return pairs.select(F.col("source").alias("s"), F.explode(kinds).alias("p"), F.col("target").alias("o"))
