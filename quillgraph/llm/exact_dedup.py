"""Exact dedup by a heavy-hitter split.

A Misra-Gries sketch (mergeable, `counters` entries) finds the digests that more than rows / (counters + 1) rows
share. Their exact counts and first rows are verified, and these at most `counters` winners are broadcast: rows
of frequent digests are decided, or dropped, on the map side and never shuffled. All other digests are small by
the sketch's guarantee and take an ordinary shuffle.

Defined cases: null text counts as empty; a null id sorts after all ids; of rows with equal text and equal id
exactly one stays; an empty table gives an empty result; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, lean, stage, whole_row


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ").cast("binary"), 256)


def shrink(counts: dict, k: int) -> dict:
    """The Misra-Gries merge step: subtract the (k+1)-th largest count, keep what is positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {x: n - cut for x, n in counts.items() if n > cut}


def frequent(df: DataFrame, key: str, k: int) -> list:
    """At most k keys, among them every key in more than rows / (k + 1) of the rows."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            for x in b.column(0).value_counts().to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = shrink(counts, k)
        yield pa.RecordBatch.from_pydict({"key": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    parts = df.select(key).mapInArrow(lean(sketch), "key string, n long")
    merged = parts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(k + 1).collect()
    return list(shrink({r["key"]: r["n"] for r in merged}, k))


def frequent_numbers(df: DataFrame, key: str, k: int) -> list[int]:
    """The same for a long column, by arrays."""

    def shrunk(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, at = np.unique(x, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        cut = np.partition(n, -(k + 1))[-(k + 1)] if len(n) > k else 0
        return x[n > cut], n[n > cut] - cut

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            new = b.column(0).drop_null().to_numpy()
            x, n = shrunk(np.concatenate([x, new]), np.concatenate([n, np.ones(len(new), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], ["key", "n"])

    merged = df.select(key).mapInArrow(lean(sketch), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(k + 1).collect()
    return shrunk(np.array([r["key"] for r in merged], np.int64), np.array([r["n"] for r in merged], np.int64))[0].tolist()


def winners(rows: DataFrame, k: int) -> DataFrame:
    """The verified frequent digests of rows (__digest, __id, __row), k rows at most: first id, first row, count."""
    spark = rows.sparkSession
    n = rows.count()
    candidates = spark.createDataFrame([(x,) for x in frequent(rows, "__digest", k)], "__digest string")
    first = F.min(F.struct(F.col("__id").isNull().alias("a"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    exact = rows.join(F.broadcast(candidates), "__digest").groupBy("__digest").agg(first.alias("f"), F.count(F.lit(1)).alias("__size"))
    found = exact.where(F.col("__size") * (k + 1) > n).select("__digest", "f.id", "f.row", "__size").limit(k).collect()
    return spark.createDataFrame([tuple(r) for r in found], f"__digest string, __keep {dict(rows.dtypes)['__id']}, __keep_row long, __size long")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stage(df.select(F.col(id_col).alias("__id"), digest(F.col(text_col)).alias("__digest"), F.monotonically_increasing_id().alias("__row")), "digests")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 512) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256."""
    rows = digests(df, id_col, text_col)
    hot = F.broadcast(winners(rows, counters))
    heavy = rows.join(hot, "__digest").select("__id", F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("__row") == F.col("__keep_row")).alias("kept"), "__digest")
    group = Window.partitionBy("__digest")
    order = group.orderBy(F.col("__id").asc_nulls_last(), "__row")
    light = rows.join(hot.select("__digest"), "__digest", "left_anti").select(
        "__id", F.first("__id").over(order).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"), "__digest"
    )
    return heavy.unionByName(light).select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.col("__digest").alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 512) -> DataFrame:
    """The rows of df that stay, with df's own columns. Copies of frequent texts fall out before the shuffle."""
    hot = F.broadcast(winners(digests(df, id_col, text_col), counters).select("__digest", "__keep"))
    left = df.select(whole_row(df), F.col(id_col).alias("__id"), digest(F.col(text_col)).alias("__digest")).join(hot, "__digest", "left")
    left = left.where(F.col("__keep").isNull() | F.col("__keep").eqNullSafe(F.col("__id")))
    order = Window.partitionBy("__digest").orderBy(F.col("__id").asc_nulls_last())  # each task sends one row of a text at most
    return left.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("row.*")
