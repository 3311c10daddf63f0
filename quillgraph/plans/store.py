"""Staged tables, and the stored layout of a graph: Parquet by a hash of the predicate, sorted by predicate and subject.

A predicate's triples lie in one bucket, and within files footers let scans skip other predicates and subjects. Every change writes
a new folder and then a line of the manifest a bucket: which folders make it up from then on. What is read is what the newest whole version
of the manifest names, so a change that fails half-way changes nothing, and a deletion rewrites only the buckets that it
touches. One writer at a time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 32


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket(p) -> F.Column:
    return F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int")


MANIFEST = "version long, b int, folder string"


class Store:
    """A stored set of triples under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # versions

    def _newest(self) -> tuple[int, dict[int, list[str]]]:
        """The newest version, and the folders of each bucket."""
        try:
            log = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing was stored yet
            return 0, {}
        last = log.agg(F.max("version")).first()[0] or 0
        out: dict[int, list[str]] = {}
        for r in log.where((F.col("version") == last) & F.col("b").isNotNull()).collect():  # a row a bucket and folder
            out.setdefault(r["b"], []).append(r["folder"])
        return last, out

    def _commit(self, version: int, folders: dict[int, list[str]]) -> None:
        rows = [(version, b, f) for b, names in folders.items() for f in names] or [(version, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, triples: DataFrame) -> dict[int, list[str]]:
        """Write triples as a new folder; its buckets."""
        folder = f"triples-{uuid.uuid4().hex}"
        rows = triples.select("s", "p", "o").withColumn("b", bucket(F.col("p")))
        # a predicate's rows spread over tasks by subject, so that a common one isn't written by one task
        rows = rows.repartition("b", F.pmod(F.xxhash64("s"), F.lit(64))).sortWithinPartitions("b", "p", "s")
        rows.write.partitionBy("b").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        there = self.spark.read.schema("s string, p string, o string, b int").parquet(f"{self.path}/{folder}").select("b").distinct().collect()
        return {r["b"]: [folder] for r in there}

    def _read(self, folders: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/{f}/b={b}" for b, names in folders.items() for f in names]
        return self.spark.read.schema("s string, p string, o string").parquet(*paths) if paths else self.spark.createDataFrame([], "s string, p string, o string")

    # contents

    def create(self, triples: DataFrame) -> Store:
        """Also replaces what was there."""
        version, _ = self._newest()
        self._commit(version + 1, self._write(triples.dropDuplicates(["s", "p", "o"])))
        return self

    replace = create

    def clear(self) -> int:
        """Returns how many triples went."""
        version, folders = self._newest()
        n = self._read(folders).count()
        self._commit(version + 1, {})
        return n

    def copy_to(self, path: str) -> Store:
        """A backup: the present triples under another path."""
        return Store(self.spark, path).create(self.triples())

    def triples(self, p: str | None = None) -> DataFrame:
        """Of one predicate, only its bucket is read."""
        _, folders = self._newest()
        if p is None:
            return self._read(folders)
        number = self.spark.range(1).select(bucket(F.lit(p))).first()[0]
        return self._read({number: folders.get(number, [])}).where(F.col("p") == p)

    def insert(self, new: DataFrame) -> int:
        """Returns how many were really new."""
        from ..operators.graph import insert

        version, folders = self._newest()
        added = stage(insert(self._read(folders), new)[1], "added")
        if n := added.count():
            more = self._write(added)
            self._commit(version + 1, {b: folders.get(b, []) + more.get(b, []) for b in folders | more})
        return n

    def delete(self, old: DataFrame) -> int:
        """Returns how many went."""
        from ..operators.graph import delete

        version, folders = self._newest()
        old = stage(old.select("s", "p", "o").distinct(), "deleted")
        touched = {r["b"] for r in old.select(bucket(F.col("p")).alias("b")).distinct().collect()} & set(folders)  # BUCKETS at most
        before = self._read({b: folders[b] for b in touched})
        left, gone = delete(before, old)
        if n := gone.count():
            kept = self._write(left)
            self._commit(version + 1, {b: kept.get(b, []) if b in touched else folders[b] for b in folders})
        return n
