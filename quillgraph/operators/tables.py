"""Wide tables hidden in triples: characteristic sets, their qualification, materialisation and column statistics.

Property sets are found by one aggregation over nodes. Only sets with their counts reach the driver, the `most`
commonest, to be merged by similarity; nodes and triples never do. Sets beyond these are assigned to the tables so found by a join on
shared properties, of which only counts reach the driver; what resembles no table is merged in the same way in further rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.store import stage


def node_properties(triples: DataFrame) -> DataFrame:
    """node, property: predicates of which the node is subject (p, >) or object (p, <); a set."""
    out = triples.select(F.col("s").alias("node"), F.concat(F.lit(">"), "p").alias("property"))
    back = triples.where(~F.col("o").startswith('"')).select(F.col("o").alias("node"), F.concat(F.lit("<"), "p").alias("property"))
    return out.unionByName(back).distinct()


def characteristic_sets(triples: DataFrame) -> DataFrame:
    """properties (sorted), nodes: how many nodes have exactly these."""
    sets = node_properties(triples).groupBy("node").agg(F.sort_array(F.collect_list("property")).alias("properties"))
    return sets.groupBy("properties").agg(F.count(F.lit(1)).alias("nodes"))


@dataclass
class WideTable:
    properties: frozenset[str]
    sets: list[frozenset[str]]
    nodes: int
    coverage: dict[str, float]
    core: list[str]
    columns: list[str]
    cliff: float
    rest: DataFrame | None = None  # properties of the sets that were assigned by a join


def merged(sets: DataFrame, similar: float, most: int) -> list[tuple]:
    """Sets (properties, nodes) by size, each merged into the first group whose properties it resembles. Of each group: properties, members
    (sets with their nodes), and of the sets assigned by a join their nodes, nodes by property, and the sets (or None)."""
    left = stage(sets, "characteristic_sets")
    groups: list[tuple[set[str], list[tuple[frozenset[str], int]]]] = []
    extra: dict[int, list] = {}
    while rows := left.orderBy(F.desc("nodes"), "properties").limit(most).collect():
        first = len(groups)
        for r in rows:
            s = frozenset(r["properties"])
            home = next((g for g in groups[first:] if len(s & g[0]) >= similar * len(s | g[0])), None)
            if home is None:
                groups.append((set(s), [(s, r["nodes"])]))
            else:
                home[0].update(s)
                home[1].append((s, r["nodes"]))
        if len(rows) < most:
            break
        seen = sets.sparkSession.createDataFrame([(r["properties"],) for r in rows], "properties array<string>")
        left = left.join(F.broadcast(seen), "properties", "left_anti")
        found = stage(resembling(left, {i: groups[i][0] for i in range(first, len(groups))}, similar), "assigned_sets")
        parts = found.select("home", "nodes", F.explode("properties").alias("p")).groupBy("home", "p").agg(F.sum("nodes").alias("n")).groupBy("home").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("by"))
        for r in found.groupBy("home").agg(F.sum("nodes").alias("nodes")).join(parts, "home").collect():
            extra[r["home"]] = [r["nodes"], r["by"], found.where(F.col("home") == r["home"]).select("properties")]
            groups[r["home"]][0].update(r["by"])
        left = stage(left.join(found.select("properties"), "properties", "left_anti"), "characteristic_sets")
    return [(properties, members, *extra.get(i, (0, {}, None))) for i, (properties, members) in enumerate(groups)]


def discover(triples: DataFrame, similar: float = 0.8, least_nodes: int = 10, least_core: int = 5, core: float = 0.5, column: float = 1 / 3, most: int = 10_000) -> list[WideTable]:
    """Sets by size, each merged into the first table whose properties it resembles; tables with enough nodes and core properties."""
    out = []
    for properties, members, more, by, rest in merged(characteristic_sets(triples), similar, most):
        nodes = sum(n for _, n in members) + more
        coverage = {p: (sum(n for s, n in members if p in s) + by.get(p, 0)) / nodes for p in properties}
        main = sorted(p for p, c in coverage.items() if c >= core)
        if nodes >= least_nodes and len(main) >= least_core:
            out.append(WideTable(frozenset(properties), [s for s, _ in members], nodes, coverage, main, sorted(p for p, c in coverage.items() if c >= column), cliff(coverage, core), rest))
    return out


def cliff(coverage: dict[str, float], core: float = 0.5) -> float:
    """How far the core's mean coverage is above the tail's (0.01 at least)."""
    main, tail = [c for c in coverage.values() if c >= core], [c for c in coverage.values() if c < core]
    return sum(main) / max(1, len(main)) / max(sum(tail) / len(tail) if tail else 0.0, 0.01)


def table_health(spark: SparkSession, found: list[WideTable]) -> DataFrame:
    """label, nodes, columns, cliff, status: a table with a cliff below 1 has too mixed a tail."""
    rows = [("|".join(t.core), t.nodes, len(t.columns), t.cliff, "warning" if t.cliff < 1 else "healthy") for t in found]
    return spark.createDataFrame(rows, "label string, nodes long, columns long, cliff double, status string")


def resembling(sets: DataFrame, groups: dict[int, set[str]], similar: float) -> DataFrame:
    """properties, nodes, home: the sets that resemble a group, and the first such group."""
    rows = [(p, i, len(g)) for i, g in groups.items() for p in sorted(g)]
    wanted = sets.sparkSession.createDataFrame(rows, "p string, home int, width int")
    shared = sets.select("properties", "nodes", F.explode("properties").alias("p")).join(wanted, "p").groupBy("properties", "nodes", "home", "width").agg(F.count(F.lit(1)).alias("k"))
    near = shared.where(F.col("k") >= F.lit(similar) * (F.size("properties") + F.col("width") - F.col("k")))
    return near.groupBy("properties", "nodes").agg(F.min("home").alias("home"))


def materialise(triples: DataFrame, table: WideTable) -> DataFrame:
    """node and a column a property (its least value); the nodes of the table's sets. Sorted by node when written."""
    sets = triples.sparkSession.createDataFrame([(sorted(s),) for s in table.sets], "properties array<string>")
    sets = F.broadcast(sets) if table.rest is None else sets.unionByName(table.rest)
    nodes = node_properties(triples).groupBy("node").agg(F.sort_array(F.collect_list("property")).alias("properties")).join(sets, "properties", "left_semi").select("node")
    out = triples.select(F.col("s").alias("node"), F.concat(F.lit(">"), "p").alias("property"), F.col("o").alias("value"))
    back = triples.select(F.col("o").alias("node"), F.concat(F.lit("<"), "p").alias("property"), F.col("s").alias("value"))
    cells = out.unionByName(back).where(F.col("property").isin(table.columns))
    return cells.join(nodes, "node", "left_semi").groupBy("node").pivot("property", table.columns).agg(F.min("value"))


def column_statistics(wide: DataFrame, segment_rows: int = 2048) -> DataFrame:
    """segment, column, least, greatest, nulls, distinct_values, rows: zone maps over segments of that many rows (the last one fewer), in the
    order of the first column. Rows are numbered within range partitions, whose sizes are counted first, so segments don't
    depend on where the partitions are cut; rows equal in the first column go by all others."""
    names = [c for c in wide.columns if c != "node"]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in [wide.columns[0], *wide.columns[1:]]]
    dealt = stage(wide.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # a row a partition
    before = {p: sum(n for q, n in sizes.items() if q < p) for p in sizes}
    starts = F.broadcast(wide.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __before long"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before")
    rows = dealt.join(starts, "__part").withColumn("__segment", F.floor(nth / segment_rows).cast("int"))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names)))
    return rows.select(F.col("__segment").alias("segment"), cells.alias("c")).groupBy("segment", "c.column").agg(F.min("c.value").alias("least"), F.max("c.value").alias("greatest"), F.count(F.when(F.col("c.value").isNull(), 1)).alias("nulls"), F.countDistinct("c.value").alias("distinct_values"), F.count(F.lit(1)).alias("rows"))


def scan(wide: DataFrame, equal: dict[str, str] | None = None, between: dict[str, tuple] | None = None, present: list[str] = ()) -> DataFrame:
    """One filter of all conditions; Parquet and code generation do the rest."""
    where = F.lit(True)
    for c, v in (equal or {}).items():
        where = where & (F.col(f"`{c}`") == v)
    for c, (lo, hi) in (between or {}).items():
        where = where & (F.lit(True) if lo is None else F.col(f"`{c}`") >= lo) & (F.lit(True) if hi is None else F.col(f"`{c}`") <= hi)
    for c in present:
        where = where & F.col(f"`{c}`").isNotNull()
    return wide.where(where)


def two_step_paths(triples: DataFrame) -> DataFrame:
    """first, second, roots, middles, fan_in: pairs of predicates that follow each other, how many roots and middle nodes they join,
    and roots a middle node. A fan-in above 3 means that middle nodes are shared, and a deep table would repeat them. What comes in to a
    node and what goes out of it are counted apart before they meet: a row a node and pair of predicates, however many edges."""
    steps = _steps(triples)
    roots = _path_sets(steps).select(F.explode("paths").alias("path"), "nodes").groupBy("path.first", "path.second").agg(F.sum("nodes").alias("roots"))
    return roots.join(_middles(steps), ["first", "second"]).select("first", "second", "roots", "middles", (F.col("uses") / F.col("middles")).alias("fan_in"))


def _steps(triples: DataFrame) -> DataFrame:
    """s, first, mid, seconds (sorted): each two-step path by its first triple, with all predicates of its middle node; repeated triples count here as often as
    they are given. Triples are made once; literals and subjects that nothing leads to meet no join of nodes."""
    facts = stage(triples.select("s", "p", F.when(~F.col("o").startswith('"'), F.col("o")).alias("o")), "steps")
    links = facts.where("o IS NOT NULL").select("s", F.col("p").alias("first"), F.col("o").alias("mid"))
    asked = facts.select(F.col("s").alias("mid"), "p").join(links.select("mid").distinct().hint("shuffle_hash"), "mid", "left_semi")
    out = asked.distinct().groupBy("mid").agg(F.sort_array(F.collect_list("p")).alias("seconds"))
    return stage(links.join(out, "mid"), "two_steps")


def _path_sets(steps: DataFrame) -> DataFrame:
    """paths (first, second; sorted, a set), nodes: how many roots have exactly these. Paths are spelled out for each kind of root only: roots
    that have the same predicates to middle nodes of the same predicates."""
    roots = steps.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("first", "seconds"))).alias("steps"))
    kinds = roots.groupBy("steps").agg(F.count(F.lit(1)).alias("nodes"))
    paths = F.flatten(F.transform("steps", lambda x: F.transform(x["seconds"], lambda y: F.struct(x["first"].alias("first"), y.alias("second")))))
    return kinds.select(F.sort_array(F.array_distinct(paths)).alias("paths"), "nodes").groupBy("paths").agg(F.sum("nodes").alias("nodes"))


def _middles(steps: DataFrame) -> DataFrame:
    """first, second, middles, uses."""
    into = steps.groupBy("mid", "first", "seconds").agg(F.countDistinct("s").alias("k"))
    kinds = into.groupBy("first", "seconds").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    return kinds.select("first", F.explode("seconds").alias("second"), "n", "k").groupBy("first", "second").agg(F.sum("n").alias("middles"), F.sum("k").alias("uses"))


def discover_paths(triples: DataFrame, similar: float = 0.8, core: float = 0.5, least_paths: int = 2, least_roots: int = 10, most_fan_in: float = 3.0, most: int = 10_000) -> DataFrame:
    """paths (array of first, second), roots, fan_in, kept: groups of roots with like sets of two-step paths. Roots of fewer than
    least_paths don't count; groups merge as property sets do; a group has the paths of at least half its roots, and needs least_paths of
    them and least_roots * 4 roots. kept is false where middle nodes serve more than most_fan_in roots on average."""
    depth = 2
    steps = _steps(triples)
    names = F.sort_array(F.transform("paths", lambda x: F.concat_ws(" ", x["first"], x["second"])))
    sets = _path_sets(steps).where(F.size("paths") >= least_paths).select(names.alias("properties"), "nodes")
    fan = {f"{r['first']} {r['second']}": (r["middles"], r["uses"]) for r in _middles(steps).collect()}  # a row a pair of predicates
    rows = []
    for properties, members, more, by, _ in merged(sets, similar, most):
        roots = sum(n for _, n in members) + more
        main = sorted(p for p in properties if sum(n for s, n in members if p in s) + by.get(p, 0) >= core * roots)
        if len(main) >= least_paths and roots >= least_roots * depth**2:
            middles, uses = (sum(fan[p][i] for p in main) for i in (0, 1))
            rows.append(([tuple(p.split(" ", 1)) for p in main], roots, uses / middles, uses <= most_fan_in * middles))
    return triples.sparkSession.createDataFrame(rows, "paths array<struct<first: string, second: string>>, roots long, fan_in double, kept boolean")


def deep_table(triples: DataFrame, paths: list[tuple[str, str]]) -> DataFrame:
    """root and a column a path (c0, c1, ...): the least value that the path leads to."""
    out = None
    for i, (first, second) in enumerate(paths):
        a = triples.where(F.col("p") == first).select(F.col("s").alias("root"), F.col("o").alias("mid"))
        b = triples.where(F.col("p") == second).select(F.col("s").alias("mid"), F.col("o").alias("v"))
        leaf = a.join(b, "mid").groupBy("root").agg(F.min("v").alias(f"c{i}"))
        out = leaf if out is None else out.join(leaf, "root", "full")
    return out
