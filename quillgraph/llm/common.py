"""Helpers that several corpus operators share: the shared folder, staged tables, bitmaps, hot keys, numbering, prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (as in tests,
    on one machine) a temporary folder; on a cluster without the setting, a folder in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back. It cuts the lineage, so that a lost executor costs no
    recomputation of what came before, and what several jobs read is made once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this worker's allocators hold free to the system: idle workers stay alive beside later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, for mapInArrow; its worker gives memory back when a partition is done."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


MAP_BITS = 29


def bit_map(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], most: int = MAP_BITS) -> np.ndarray:
    """A bitmap of rows by 64-bit hashes of them, two bits each: about 16 bits a row, 2^most (64 MB) at most, so it can be broadcast whatever the
    size of rows. What is in rows is in the map; of other things a few are, more when it is full, so what the map lets through
    must do no harm or be joined afterwards."""
    bits = min(most, max(12, (16 * rows.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.sort(two_places(hashes(b), bits))
            first = np.flatnonzero(np.diff(places >> np.uint64(6), prepend=np.uint64(1 << 63)))
            bit = np.uint64(1) << (places & np.uint64(63))
            words = np.bitwise_or.reduceat(bit, first) if len(first) else bit
            yield pa.RecordBatch.from_arrays([pa.array((places[first] >> np.uint64(6)).view(np.int64)), pa.array(words.view(np.int64))], ["w", "v"])

    words = rows.mapInArrow(lean(mark), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def two_places(h: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([h & mask, h >> np.uint64(32) & mask])


def in_map(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be of rows of the map."""
    places = two_places(h, (64 * len(words)).bit_length() - 1)
    found = (words[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found[: len(h)] & found[len(h) :]


def whole_row(df: DataFrame) -> Column:
    """All columns as one, `row`, beside which nothing can clash; select("row.*") gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, most: int = 512, complete: bool = False) -> DataFrame:
    """rows left-joined with facts (staged, one row a key), hot keys apart.

    weight is a column of facts: how many of the total rows have that key. Fewer than `most` keys can weigh
    total / most or more, so these are broadcast (a proven bound) and their rows are never shuffled; the other
    keys are small, and an ordinary shuffled join takes them. complete: every row has facts, so that without cold facts there
    are no cold rows.
    """
    hot = facts.where(F.col(weight) * most > total)
    cold = facts.where(F.col(weight) * most <= total)
    flag = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    columns = [c for c in facts.columns if c != key]
    a = rows.join(F.broadcast(hot), key)
    if complete and cold.isEmpty():
        return a.select(*rows.columns, *columns)
    b = flag.where(F.col("__hot").isNull()).drop("__hot").join(cold.hint("merge"), key, "left")
    return a.select(*rows.columns, *columns).unionByName(b.select(*rows.columns, *columns))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with each row's number, from 1, in a global order: numbers within range partitions after those of the partitions before, so no task
    has all rows. Rows equal in the order are numbered in any order."""
    dealt = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # a row a partition
    before = [(p, sum(n for q, n in sizes.items() if q < p)) for p in sizes] or [(0, 0)]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    return dealt.join(starts, "__part").withColumn(out, nth).drop("__part", "__before")


WIDE = 4096  # chunks a span of chunks


def running_total(df: DataFrame, group: str | None, chunk: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exact running sum of `value` in a global order (or in each group's), without a window over a whole group.

    The columns group and chunk, not null, cut the order into consecutive chunks of bounded size. Rows are summed
    within chunks, chunks within spans of WIDE chunks, and spans (one row a million rows or so) over the spans before.
    """
    group = group or "__all"
    rows = (df.withColumn("__all", F.lit(0)) if group == "__all" else df).withColumn("__value", value)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = rows.groupBy(group, chunk).agg(F.sum("__value").alias("__sum")).withColumn("__span", F.floor(F.col(chunk) / WIDE))
    spans = totals.groupBy(group, "__span").agg(F.sum("__sum").alias("__sum"))
    spans = spans.select(group, "__span", so_far("__sum", before(group).orderBy("__span")).alias("__ahead"))
    totals = totals.withColumn("__near", so_far("__sum", before(group, "__span").orderBy(chunk))).join(spans, [group, "__span"])
    totals = totals.select(group, chunk, (F.col("__ahead") + F.col("__near")).alias("__before"))
    inside = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inside", F.sum("__value").over(inside))
    return rows.join(totals, [group, chunk]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__inside", "__before", "__value", "__all")
