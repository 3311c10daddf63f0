"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (by the MD5 of their ids), once for each time they may be taken. A copy's
virtual finish time is the source's running number of tokens up to its end, divided by the source's target. All
copies are range-sorted by virtual finish time, and the mix is the longest beginning whose tokens fit the total budget;
every source then has come equally far towards its target, up to about one document.

Running sums go over chunks of about `chunk_rows` rows (common.running_total), so that no source, however large, is summed in one task. Chunks
of finish times come from counts over CELLS equal parts of their range, so that crowded parts are cut finer. Of a source, each time
of taking takes a beginning of its order, so what is taken is told by one bound a source and time: documents are decided where
they are, with a row a source (those of common sources broadcast, at most 512 of them), and never joined row by row. What
reaches the driver are sums over sources, and one row, the last copy taken.

Defined cases: null text has no words; null sources are one source, last in order; null ids come first; empty documents take
nothing; rows equal in id, source and size are taken alike; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, numbered, running_total, stage, whole_row

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """sizes (source, source_size, ...) with rank, target and budget. Weights repeat over the sources in order; a target stops at `repeats`
    times its source's size and the others share the excess by weight: the common level rises as sources fill up, until no
    more do. A round is one aggregation; there are at most as many as sources that fill up one by one, and few in practice."""
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = numbered(sizes, [F.col("source").asc_nulls_last()], "rank").withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    s = stage(s, "ranked_sources")
    budget = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, filled = None, -1
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        r = s.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if r["n"] == filled or not r["rest"]:
            break
        filled, level = r["n"], (budget - r["cap"]) / r["rest"]
    cap = F.col("cap").cast("double")
    target = cap if not r["rest"] else F.when(F.lit(level) * F.col("weight") <= F.col("cap"), F.lit(level) * F.col("weight")).otherwise(cap)
    return s.select("source", "source_size", "n", "rank", target.alias("target"), F.lit(budget).alias("budget"))


def source_key(source) -> F.Column:
    """A key that isn't null."""
    return F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source.cast("string"), F.lit("")))


def place_of(doc_id) -> F.Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def words_of(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sources(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, repeats: int, chunk_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The sizes of all documents (id, key, size, place); of each source key its size, number, target, and for each time k the last place, id and
    size that is taken (last_k, null if none); and how many documents there are."""
    rows = stage(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"), words_of(F.col(text_col)).alias("size"), place_of(F.col(id_col)).alias("place")), "sizes")
    per_source = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, repeats).withColumn("key", source_key(F.col("source"))).drop("source"), "targets")
    rows, total = rows.drop("source"), rows.count()

    # 2^32 places, cut into chunks of about chunk_rows documents of the source
    place = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    chunk = F.floor(place * F.ceil(F.col("n") / chunk_rows) / F.lit(1 << 32))
    facts = per_source.select("key", "source_size", "n", "rank", "target")
    run = attach(rows, facts, "key", "n", total, complete=True).withColumn("chunk", chunk)
    run = running_total(run, "rank", "chunk", [F.col(c).asc_nulls_first() for c in ("place", "id", "size")], F.col("size"), "run")
    run = stage(run.where("size > 0 AND target > 0").select("key", "rank", "place", "id", "size", "run", "source_size", "target"), "running_sizes")

    finish = lambda k: (F.col("run") + F.col("source_size") * k) / F.col("target")
    copies = run.select("rank", "place", "id", "size", F.explode(F.array(*(finish(k) for k in range(repeats)))).alias("finish"))
    last = copies.agg(F.max("finish")).first()[0]
    budget = per_source.agg(F.max("budget")).first()[0] or 0.0
    order = ["finish", "rank", "place", "id", "size"]
    cut = None
    if last:
        cell = F.least(F.floor(F.col("finish") * (CELLS / last)), F.lit(CELLS - 1))
        copies = copies.withColumn("cell", cell)
        cells = copies.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("parts"))  # CELLS rows at most
        before = F.coalesce(F.sum("parts").over(Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        copies = copies.join(F.broadcast(cells.withColumn("before", before)), "cell")
        within = F.col("finish") * (CELLS / last) - F.col("cell")
        part = F.col("before") + F.greatest(F.lit(0), F.least(F.floor(within * F.col("parts")), F.col("parts") - 1))
        sorted_copies = running_total(copies.withColumn("part", part), None, "part", [F.col(c).asc_nulls_first() for c in order], F.col("size"), "total")
        cut = sorted_copies.where(F.col("total") <= budget).agg(F.max(F.struct(*order)).alias("c")).first()["c"]
    kinds = dict(run.dtypes) | {"finish": "double"}
    mine = f"struct<place: string, id: {kinds['id']}, size: bigint>"
    taken = lambda k: F.lit(False) if cut is None else F.struct(finish(k).alias("finish"), *order[1:]) <= F.struct(*(F.lit(cut[c]).cast(kinds[c]).alias(c) for c in order))
    bounds = run.groupBy("key").agg(*(F.max(F.when(taken(k), F.struct("place", "id", "size"))).cast(mine).alias(f"last_{k}") for k in range(repeats)))
    return rows, stage(facts.join(bounds, "key", "left").drop("rank"), "sources"), total


def times_taken(repeats: int) -> F.Column:
    mine = F.struct("place", "id", "size")
    each = (F.when((F.col("size") > 0) & (mine <= F.col(f"last_{k}")), 1).otherwise(0) for k in range(repeats))
    return sum(each, F.lit(0))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, chunk_rows: int = 256) -> DataFrame:
    """Per row of df: id_col, source, size, source_size, target, taken (words taken, repeats counted)."""
    rows, facts, total = sources(df, id_col, text_col, source_col, weights, share, repeats, chunk_rows)
    out = attach(rows, facts, "key", "n", total, complete=True)
    source = F.when(F.col("key").startswith("+"), F.substring("key", F.lit(2), F.length("key"))).cast(dict(df.dtypes)[source_col])
    return out.select(F.col("id").alias(id_col), source.alias(source_col), "size", "source_size", "target", (F.col("size") * times_taken(repeats)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, chunk_rows: int = 256) -> DataFrame:
    """The rows of df that the mix takes, each as many times as it is taken, with df's own columns."""
    _, facts, total = sources(df, id_col, text_col, source_col, weights, share, repeats, chunk_rows)
    own = df.select(whole_row(df), F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), words_of(F.col(text_col)).alias("size"), place_of(F.col(id_col)).alias("place"))
    times = attach(own, facts, "key", "n", total, complete=True).withColumn("__times", times_taken(repeats)).where("__times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("row.*")
