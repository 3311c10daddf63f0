"""Continuous loading: N-Triples files or mapped rows as a stream of new triples, and windowed counts over late events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_dir
from ..sources.formats import parse_lines


def stream_ntriples(spark: SparkSession, folder: str) -> DataFrame:
    """s, p, o of the files that come into a folder, each triple once."""
    return parse_lines(spark.readStream.text(folder)).select("s", "p", "o").dropDuplicates(["s", "p", "o"])


def windowed_counts(events: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """start, keys, n, of tumbling windows; events later than `late` behind the newest are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "n")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet in the shared folder; read the result."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
