"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, and a chi-square stopping test.

Inner product becomes Euclidean distance by one added component (vectors get sqrt(M^2 - |x|^2), with M the largest
norm; queries are scaled to norm M). Vectors are projected on a few Gaussian (2-stable) directions: of a
pair at distance d, the squared projected distance over d^2 has a chi-square distribution. A kd-tree over
the projected space, its top fitted on a bounded sample (`sample_rows`) and all vectors routed through it, gives
cells; cells of more than cell_rows vectors (many equal vectors, say) are dealt over several units, row by row. A query first
searches its home unit, then a few nearby ones, which bounds the distance of its k-th neighbour, then every unit that the
stopping test doesn't rule out. Queries of neighbouring cells form a block, and a unit's vectors go to those blocks only that have a query for it. In a unit, leaves are visited in the order of projected distance, and their vectors verified by exact inner
products, until the next leaf's projected distance passes the chi-square quantile times the k-th distance so far. A true neighbour is
missed with a chance of at most 1 - confidence; recall against brute force is measured in the tests.

Defined cases: vectors that are null, zero, or hold null or non-finite components, null ids, and vectors of another
dimension than the commonest take no part; ties go to the smaller id; with fewer than k candidates all are returned;
several rows of one id are separate candidates, but never of a query of that id, and separate queries, each with a result of its own;
empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stage

LEAF = 256


def chi2_quantile(p: float, m: int) -> float:
    """Of the chi-square distribution with m (even) degrees of freedom, by bisection."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """The top of the kd-tree: a full binary tree of splits in heap order."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        groups = {1: points}
        for i in range(1, 1 << depth):
            p = groups.pop(i)
            if len(p):
                self.axis[i] = np.ptp(p, axis=0).argmax()
                self.at[i] = np.median(p[:, self.axis[i]])
            right = p[:, self.axis[i]] > self.at[i]
            groups[2 * i], groups[2 * i + 1] = p[~right], p[right]

    def cell(self, y: np.ndarray) -> np.ndarray:
        i, rows = np.ones(len(y), np.int64), np.arange(len(y))
        for _ in range(self.depth):
            i = 2 * i + (y[rows, self.axis[i]] > self.at[i])
        return i - (1 << self.depth)


def box_distance(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each of y to each box."""
    out = np.zeros((len(y), len(low)))
    for d in range(y.shape[1]):
        out += np.maximum(0, np.maximum(low[None, :, d] - y[:, None, d], y[:, None, d] - high[None, :, d])) ** 2
    return out


def leaves(y: np.ndarray) -> list[np.ndarray]:
    """A local kd-tree's leaves: row numbers."""
    out, todo = [], [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
        else:
            axis = np.ptp(y[rows], axis=0).argmax()
            rows = rows[np.argsort(y[rows, axis], kind="stable")]
            todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def search(ids: np.ndarray, x: np.ndarray, y: np.ndarray, qid: np.ndarray, q: np.ndarray, qy: np.ndarray, bound: np.ndarray, top: float, limit: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best of these vectors; absent: -inf, and the largest integer.

    bound: squared distances that the k-th neighbour is known not to exceed; top: M; limit: the chi-square quantile."""
    none = np.iinfo(np.int64).max
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), none)
    scale = top / np.linalg.norm(q, axis=1)
    parts = leaves(y)
    low, high = (np.array([f(y[p], axis=0) for p in parts]) for f in (np.min, np.max))
    gap = box_distance(qy, low, high)
    order = gap.argsort(1, kind="stable")
    for step in range(len(parts)):
        kth = np.minimum(bound, 2 * top * top - 2 * scale * best[:, -1])  # the distance of the k-th so far
        go = gap[np.arange(len(q)), order[:, step]] <= limit * np.maximum(kth, 0) + 1e-9
        for leaf in np.unique(order[go, step]):
            a, p = np.flatnonzero(go & (order[:, step] == leaf)), parts[leaf]
            rough = q[a] @ x[p].T
            least = np.maximum(best[a, -1], (2 * top * top - bound[a]) / (2 * scale[a]))
            i, j = np.nonzero((rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (ids[p][None, :] != qid[a][:, None]))
            exact = np.full(rough.shape, -np.inf)
            exact[i, j] = (q[a[i]] * x[p[j]]).sum(1)
            s = np.concatenate([best[a], exact], 1)
            n = np.concatenate([who[a], np.where(exact > -np.inf, ids[p][None, :], none)], 1)
            o = np.lexsort((n, -s), axis=-1)[:, :k]
            best[a], who[a] = np.take_along_axis(s, o, 1), np.take_along_axis(n, o, 1)
    return best, who


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(df: DataFrame, query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, directions: int = 8, confidence: float = 0.98, cell_rows: int = 1024, block_rows: int = 4096, nearby: int = 7, sample_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df, of each row whose id fulfils `query` (a column
    expression over "id")."""
    spark = df.sparkSession
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, fine)).withColumn("norm2", F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)).where("norm2 > 0 AND norm2 < double('inf')")
    common = rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    width, n, top = common["d"], common["n"], math.sqrt(common["m"])
    axes = np.random.default_rng(seed).standard_normal((width + 1, directions))
    limit = chi2_quantile(confidence, directions)

    def project(x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return x @ axes[:-1] + np.sqrt(np.maximum(0, top * top - norm2))[:, None] * axes[-1]

    def with_projection(batches):
        for b in batches:
            y = project(matrix(b.column(1), width), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(y), pa.list_(pa.float64()))], ["id", "v", "y"])

    rows = rows.where(F.size(v) == width).mapInArrow(lean(with_projection), "id long, v array<double>, y array<double>")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "projected")
    sample = np.array([r["y"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(sample_rows, n)).select("y").collect()])
    tree = Tree(sample, min(14, max(0, math.ceil(math.log2(n / cell_rows)))))

    @F.pandas_udf("int")
    def cell(y: pd.Series) -> pd.Series:
        return pd.Series(tree.cell(np.stack(y.to_numpy())).astype("int32"))

    rows = rows.withColumn("cell", cell("y"))
    extent = [f(F.col("y")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(directions)]
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *extent).orderBy("cell").collect()  # 2^14 rows at most
    number = np.array([r["cell"] for r in cells])
    low, high = (np.array([[r[f"{name}{i}"] for i in range(directions)] for r in cells]) for name in ("low", "high"))
    units = np.array([-(-r["n"] // cell_rows) for r in cells])
    first_unit = np.concatenate([[0], np.cumsum(units)])
    # blocks of queries: cells in the tree's order, together up to block_rows; more than that in one cell make several
    of_cell = {r["cell"]: r["count"] for r in rows.where(query).groupBy("cell").count().collect()}  # 2^14 rows at most
    block_of, blocks_of, block, filled = [], [], 0, 0
    for c in number.tolist():
        here = of_cell.get(c, 0)
        if filled and filled + here > block_rows:
            block, filled = block + 1, 0
        block_of.append(block)
        blocks_of.append(max(1, -(-here // block_rows)))
        filled += here
        if blocks_of[-1] > 1:
            block, filled = block + blocks_of[-1], 0
    dealt = [tuple(map(int, x)) for x in zip(number, first_unit, units, block_of, blocks_of, strict=False)]
    unit_table = F.broadcast(spark.createDataFrame(dealt, "cell int, first int, units int, block0 int, blocks int"))
    rows = rows.join(unit_table, "cell").withColumn("unit", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("units"))).cast("int"))
    members = rows.select("unit", "id", "v", "y")
    asked = rows.where(query).withColumn("block", (F.col("block0") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks"))).cast("int"))

    names, kinds = ["row", "query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    answer = "row long, query_id long, vec_id long, score double"

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        ids, x, y = left["id"].to_numpy(), matrix(left["v"], width), matrix(left["y"], directions)
        row, qid, q = right["row"].to_numpy(), right["qid"].to_numpy(), matrix(right["qv"], width)
        qy = (q * (top / np.linalg.norm(q, axis=1))[:, None]) @ axes[:-1]
        best, who = search(ids, x, y, qid, q, qy, right["bound"].to_numpy(), top, limit, k)
        i, j = np.nonzero(best > -np.inf)
        return pa.Table.from_arrays([pa.array(row[i]), pa.array(qid[i]), pa.array(who[i, j]), pa.array(best[i, j])], names)

    home = asked.select(F.col("unit").alias("at"), "row", F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(float("inf")).alias("bound")).groupBy("at")
    found = stage(members.groupBy("unit").cogroup(home).applyInArrow(visit, answer), "found")

    def routes(first: bool):
        """For a query the other units that its bound allows: the `nearby` nearest (first), or all but those."""

        def route(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    q, worst = matrix(part.column(2), width), part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                    scale = top / np.linalg.norm(q, axis=1)
                    bound = np.where(np.isnan(worst), np.inf, 2 * top * top - 2 * scale * worst)  # the squared distance of the k-th so far
                    gap = box_distance((q * scale[:, None]) @ axes[:-1], low, high)
                    allowed = gap <= limit * np.maximum(bound, 0)[:, None] + 1e-9
                    lists = []
                    for g, ok, own in zip(gap, allowed, part.column(5).to_numpy(), strict=True):
                        by_gap = np.argsort(g, kind="stable")
                        at = np.repeat(by_gap, units[by_gap])
                        unit = np.concatenate([np.arange(first_unit[c], first_unit[c] + units[c]) for c in by_gap])
                        at, unit = at[unit != own], unit[unit != own]
                        mine = slice(0, nearby) if first else slice(nearby, None)
                        lists.append(unit[mine][ok[at[mine]]].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(bound), part.column(4), pa.array(lists, pa.list_(pa.int32()))], ["row", "id", "v", "bound", "block", "units"])

        return lean(route)

    # two more rounds: a few nearby units make the bound tight, so that the others have little to tell
    for first in (True, False):
        scores = F.sort_array(F.collect_list("score"), asc=False)  # of k * (nearby + 1) at most
        kth = found.groupBy("row").agg(F.try_element_at(scores, F.lit(k)).alias("kth"))
        routed = asked.select("row", "id", "v", "block", "unit").join(kth, "row", "left").select("row", "id", "v", "kth", "block", "unit")
        routed = routed.mapInArrow(routes(first), "row long, id long, v array<double>, bound double, block int, units array<int>")
        visits = stage(routed.select("row", F.col("id").alias("qid"), F.col("v").alias("qv"), "bound", F.col("block").alias("of"), F.explode("units").alias("at")), "visits")
        meet = visits.select(F.col("at").alias("unit"), F.col("of").alias("block")).distinct()
        more = members.join(meet, "unit").groupBy("unit", "block").cogroup(visits.groupBy("at", "of")).applyInArrow(visit, answer)
        found = found.unionByName(stage(more, "found"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
