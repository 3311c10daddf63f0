"""Triples with validity intervals (s, p, o, since, until; null is open): states, overlaps and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T


def _at(t) -> Column:
    return (F.col("since").isNull() | (F.col("since") <= F.lit(t))) & (F.col("until").isNull() | (F.col("until") > F.lit(t)))


def at_time(triples: DataFrame, t) -> DataFrame:
    """What holds at t; triples without an interval always hold."""
    return triples.where(_at(t))


def during(triples: DataFrame, start, end) -> DataFrame:
    """What holds at some time from start to before end."""
    return triples.where((F.col("since").isNull() | (F.col("since") < F.lit(end))) & (F.col("until").isNull() | (F.col("until") > F.lit(start))))


def difference(triples: DataFrame, before, after) -> DataFrame:
    """s, p, o, change: added or removed between two times."""
    a, b = (at_time(triples, t).select("s", "p", "o").distinct() for t in (before, after))
    keys = ["s", "p", "o"]
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def state_of_log(log: DataFrame) -> DataFrame:
    """The triples after a log of changes (s, p, o, seq, deleted): the last change of each counts."""
    last = log.groupBy("s", "p", "o").agg(F.max_by("deleted", "seq").alias("deleted"))
    return last.where(~F.col("deleted")).select("s", "p", "o")


#: Lengths of literals by precision, what completes them to a timestamp, and how long they last.
PRECISION = {4: ("-01-01T00:00:00", "1 year"), 7: ("-01T00:00:00", "1 month"), 10: ("T00:00:00", "1 day"), 13: (":00:00", "1 hour"), 16: (":00", "1 minute"), 19: ("", "1 second"), 23: ("", "1 millisecond")}


def interval(text: Column) -> list[Column]:
    """Start and end (exclusive) of the time that a literal's text means: its precision is that of its format, from 1847 to
    1847-03-15T09:32:00.000. Other texts give nulls."""
    start = end = F.lit(None).cast("timestamp")
    for n, (rest, lasts) in PRECISION.items():
        t = F.concat(text, F.lit(rest)).try_cast("timestamp")
        start = F.when(F.length(text) == n, t).otherwise(start)
        end = F.when(F.length(text) == n, t + F.expr(f"INTERVAL {lasts}")).otherwise(end)
    return [start, end]


def with_intervals(annotations: DataFrame, since: str, until: str) -> DataFrame:
    """s, p, o, since, until of annotations (s: a quoted triple; p; o) by two predicates. A triple with several intervals has them in order:
    the k-th beginning goes with the k-th end."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("s", "p").orderBy("o"))
    marks = annotations.where(F.col("p").isin(since, until)).select("s", "p", "o", nth.alias("k"))
    at = marks.groupBy("s", "k").agg(*(F.max(F.when(F.col("p") == p, T.lex(F.col("o")))).alias(n) for p, n in ((since, "a"), (until, "b"))))
    return at.select(*(x.alias(c) for x, c in zip(T.unquote(F.col("s")), "spo", strict=True)), interval(F.col("a"))[0].alias("since"), interval(F.col("b"))[1].alias("until"))
