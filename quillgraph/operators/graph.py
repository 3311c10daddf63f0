"""A graph: stored triples, mapped tables, or both; its scans, patterns and updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..sources import formats
from ..sources.mapping import Table
from .solutions import Kind, Solutions, companion, width


#: Triples that a task makes of a table's rows; more once there are MANY tasks.
TASK_TRIPLES, MANY = 500_000, 200


def dealt(rows: DataFrame, t: Table, each: int) -> DataFrame:
    """Rows of a table that become `each` triples, dealt out by key, so that a large row group isn't unpivoted, and its triples told apart, by one task."""
    n = -(-t.df.count() * each // TASK_TRIPLES)
    return rows.repartition(max(min(n, MANY), n // 16), *t.key) if n > 1 else rows


class Graph:
    def __init__(self, triples: DataFrame | None = None, tables: list[Table] | None = None):
        """triples: s, p, o; a set."""
        self.stored, self.tables = triples, tables or []

    # scans

    def predicates(self) -> set[str]:
        """Of the mapped tables; stored ones are data."""
        return {p for t in self.tables for p in t.objects}

    def relation(self, p: str) -> DataFrame:
        """s, o of one predicate: of a mapped table just the columns that it needs."""
        return self._relation(p)[0].select("s", "o")

    def _relation(self, p: str, s: str | None = None, o: str | None = None) -> tuple[DataFrame, dict[str, Kind]]:
        """s, o and their companions, if all that has the predicate is made alike. Constants reach the scans as conditions on stored
        columns; rows that aren't theirs may still be there."""
        tables = [t for t in self.tables if p in t.objects]
        found = {c: {t.companion(x)[0] for t in tables} | ({None} if self.stored is not None else set()) for c, x in (("s", None), ("o", p))}
        kinds = {c: k for c, (k, *more) in ((c, tuple(x)) for c, x in found.items() if x) if k and not more}
        parts = []
        for t in tables:
            where = F.lit(True)
            for x, term in ((None, s), (p, o)):
                where = where if term is None else where & t.given(x, term)
            beside = [col.alias(companion(c, i)) for c, x in (("s", None), ("o", p)) if c in kinds for i, col in enumerate(t.companion(x)[1])]
            there = reduce(lambda a, b: a & b, (col.isNotNull() for x in (None, p) for col in t.companion(x)[1]), F.lit(True))
            parts.append(t.df.where(where & there).select(t.subject.alias("s"), t.objects[p].alias("o"), *beside).where("s IS NOT NULL AND o IS NOT NULL"))
        if self.stored is not None:
            parts.append(self.stored.where(F.col("p") == p).select("s", "o"))
        if not parts:
            raise KeyError(f"no table has {p}")
        rows = reduce(DataFrame.unionByName, parts)
        return rows.distinct() if len(parts) > 1 else rows, kinds

    def triples(self) -> DataFrame:
        """Everything as s, p, o."""
        return self._triples()

    def repeated_triples(self) -> DataFrame:
        """As triples(), but some perhaps more than once: for what tells them apart itself."""
        return self._triples(apart=False)

    def _triples(self, s: str | None = None, o: str | None = None, apart: bool = True) -> DataFrame:
        parts = []
        for t in self.tables:
            where = F.lit(True) if s is None else t.given(None, s)
            if o is not None:
                where = where & reduce(lambda a, b: a | b, (t.given(p, o) for p in t.objects))
            cells = F.array(*(F.struct(F.lit(p).alias("p"), x.alias("o")) for p, x in t.objects.items()))
            parts.append(dealt(t.df.where(where), t, len(t.objects)).select(t.subject.alias("s"), F.explode(cells).alias("c")).select("s", "c.p", "c.o").where("s IS NOT NULL AND o IS NOT NULL"))
        if self.stored is not None:
            parts.append(self.stored.select("s", "p", "o"))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.distinct() if apart and len(parts) > 1 else rows

    def find(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples with these terms."""
        rows = self._relation(p, s, o)[0].withColumn("p", F.lit(p)) if p else self._triples(s, o)
        for c, x in (("s", s), ("o", o)):
            rows = rows if x is None else rows.where(F.col(c) == x)
        return rows.select("s", "p", "o")

    def contains(self, s: str, p: str, o: str) -> DataFrame:
        return Solutions(self.find(s, p, o)).ask()

    def adjacency(self, most: int = 100_000) -> DataFrame:
        """s, part, edges: the (p, o) of each subject; those of a hub with more than `most` in several parts, so that no row is unbounded."""
        t = self.triples()
        hubs = t.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")
        dealt = t.join(hubs, "s", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("p", "o"), F.col("parts")), F.lit(0)).cast("int"))
        return dealt.groupBy("s", "part").agg(F.sort_array(F.collect_list(F.struct("p", "o"))).alias("edges"))

    def statistics(self) -> DataFrame:
        """p, triples, subjects, objects."""
        return self.triples().groupBy("p").agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))

    # patterns

    def match(self, s: str, p: str, o: str) -> Solutions:
        """One triple pattern; ?name is a variable. A repeated variable means equal terms; << ?a p ?b >> as subject looks
        into quoted triples."""
        fixed = [None if "?" in x else x for x in (s, o)]
        rows, kinds = (self._triples(*fixed), {}) if p[0] == "?" else self._relation(p, *fixed)
        rows = rows if p[0] == "?" else rows.withColumn("p", F.lit(p))
        out: dict[str, F.Column] = {}
        where = F.lit(True)
        parts = [(s, F.col("s")), (p, F.col("p")), (o, F.col("o"))]
        for x, c in (parts[0], parts[2]):
            if x[:3] == "<< " and "?" in x:
                where = where & T.is_quoted(c)
                parts += list(zip(x[3:-3].split(" ", 2), T.unquote(c), strict=True))
        for x, c in parts:
            if x[:3] == "<< " and "?" in x:
                continue
            if x[0] != "?":
                where = where & (c == x)
            elif x[1:] in out:
                where = where & (c == out[x[1:]])
            else:
                out[x[1:]] = c
        of = {x[1:]: c for x, c in ((o, "o"), (s, "s")) if c in kinds and x[0] == "?"}
        named = {v: kinds[c] for v, c in of.items()}
        beside = [F.col(companion(of[v], i)).alias(companion(v, i)) for v, k in named.items() for i in range(width(k))]
        return Solutions(rows.where(where).select(*(c.alias(v) for v, c in out.items()), *beside), (), named)

    def star(self, subject: str, **objects: str) -> Solutions:
        """Patterns with one subject variable: variable=predicate. If one mapped table has all the predicates and nothing else has any,
        this is one scan of it without a join; its columns are single-valued, so the answer is the same."""
        wanted = list(objects.values())
        having = [t for t in self.tables if any(p in t.objects for p in wanted)]
        if self.stored is None and len(having) == 1 and all(p in having[0].objects for p in wanted):
            t = having[0]
            made = {v: t.companion(p) for v, p in {subject: None, **objects}.items()}
            there = reduce(lambda a, b: a & b, (c.isNotNull() for _, cs in made.values() for c in cs), F.lit(True))
            beside = [c.alias(companion(v, i)) for v, (_, cs) in made.items() for i, c in enumerate(cs)]
            rows = t.df.where(there).select(t.subject.alias(subject), *(t.objects[p].alias(v) for v, p in objects.items()), *beside)
            rows = rows.dropna(subset=[v for v, (k, _) in made.items() if not k]) if not all(k for k, _ in made.values()) else rows
            return Solutions(rows, (), {v: k for v, (k, _) in made.items() if k})
        return self.bgp(*((f"?{subject}", p, f"?{v}") for v, p in objects.items()))

    def bgp(self, *patterns: tuple[str, str, str]) -> Solutions:
        """All patterns, joined so that each shares a variable with what is there already, if any does."""
        todo = list(patterns)
        out = self.match(*todo.pop(0))
        while todo:
            linked = next((x for x in todo if {v[1:] for v in x if v[0] == "?"} & set(out.variables)), None)
            todo.remove(linked or todo[0])
            out = out.join(self.match(*(linked or todo[0])), product=linked is None)
        return out

    def describe(self, *resources: str) -> DataFrame:
        t = self.triples()
        return t.where(F.col("s").isin(*resources) | F.col("o").isin(*resources)).select("s", "p", "o").distinct()

    def vectors(self, p: str) -> DataFrame:
        """s, vec of a vector predicate."""
        parts = [t.df.select(t.subject.alias("s"), F.col(t.vectors[p]).cast("array<float>").alias("vec")).where("vec IS NOT NULL") for t in self.tables if p in t.vectors]
        if self.stored is not None:
            parts.append(self.stored.where(F.col("p") == p).select("s", T.vector(F.col("o")).alias("vec")).where("vec IS NOT NULL"))
        if not parts:
            raise KeyError(f"{p} is no vector predicate")
        return reduce(DataFrame.unionByName, parts)


# updates: sets of triples in, sets of triples out


def insert(triples: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triples afterwards, and those that are really new."""
    added = new.select("s", "p", "o").distinct().join(triples, ["s", "p", "o"], "left_anti")
    return triples.select("s", "p", "o").unionByName(added), added


def bulk_insert(triples: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of N-Triples lines (line, value): what is new, and line, value, error of the others: duplicate (of the triples, or of an earlier
    line) or malformed. Blank lines and comments are neither."""
    rows = formats._parsed(lines.select("line", "value")).where("s != ''")
    firsts = rows.groupBy("s", "p", "o").agg(F.min("line").alias("__first"))
    new = firsts.join(triples, ["s", "p", "o"], "left_anti")
    again = rows.join(new.select("s", "p", "o", "__first"), ["s", "p", "o"], "left").where(F.col("__first").isNull() | (F.col("line") > F.col("__first")))
    wrong = formats.malformed_lines(lines.select("line", "value"))
    errors = again.select("line", "value", F.lit("duplicate").alias("error")).unionByName(wrong.withColumn("error", F.lit("malformed")))
    return new.select("s", "p", "o"), errors


def delete(triples: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triples afterwards, and those removed."""
    old = old.select("s", "p", "o").distinct()
    return triples.join(old, ["s", "p", "o"], "left_anti").select("s", "p", "o"), triples.join(old, ["s", "p", "o"], "left_semi").select("s", "p", "o")


def verify(triples: DataFrame) -> DataFrame:
    """rows, distinct_rows, nulls: what a set of whole triples must be."""
    null = F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull()
    return triples.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("s", "p", "o").alias("distinct_rows"), F.count(F.when(null, 1)).alias("nulls"))
