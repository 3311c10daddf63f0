"""Graphs over relational tables: rows are subjects, columns predicates.

A mapped table isn't unpivoted: a pattern with a constant predicate reads that one column, a star of patterns over one
table reads its columns in one scan, and only a variable predicate makes the union of all of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

EX = "http://ex.org/"
WHOLE = ("int", "bigint")


@dataclass
class Table:
    """name: of the class; key: columns of the subject; links: predicate -> (class, columns) of IRI objects; every other
    column is a literal of its type, except vectors (array columns), which graph.vectors() reads."""

    df: DataFrame
    name: str
    key: list[str]
    links: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    renamed: dict[str, str] = field(default_factory=dict)

    @property
    def subject(self) -> Column:
        return T.iri_of(f"{EX}{self.name}/", *(F.col(c) for c in self.key))

    @property
    def objects(self) -> dict[str, Column]:
        """Predicate -> object; null cells give no triple."""
        out = {T.RDF_TYPE: F.lit(T.iri(EX + self.name.capitalize()))}
        for c, kind in self.df.dtypes:
            if not kind.startswith("array"):
                out[T.iri(EX + self.renamed.get(c, c))] = T.literal_of(F.col(c), kind)
        for p, (target, columns) in self.links.items():
            out[T.iri(EX + p)] = T.iri_of(f"{EX}{target}/", *(F.col(c) for c in columns))
        return out

    def _made_of(self, p: str | None) -> tuple[str | None, list[str]]:
        """The prefix and the columns of the subject's names (p=None) or of those of a link; of a literal, None and its column."""
        if p is None:
            return f"<{EX}{self.name}/", self.key
        name = p[len(EX) + 1 : -1]
        if name in self.links:
            return f"<{EX}{self.links[name][0]}/", self.links[name][1]
        return None, [c for c, kind in self.df.dtypes if self.renamed.get(c, c) == name and not kind.startswith("array")]

    def companion(self, p: str | None) -> tuple[tuple[str, ...] | None, list[Column]]:
        """What the subject (p=None) or an object is made from: a kind, and columns. Terms of a kind are equal where these columns are."""
        prefix, columns = self._made_of(p)
        types = [dict(self.df.dtypes)[c] for c in columns]
        if p == T.RDF_TYPE or not columns or prefix and len(columns) > 1 and not all(t in WHOLE for t in types):
            return None, []
        if prefix is None:
            known = types[0] in (*WHOLE, "double", "float", "string", "boolean", "timestamp", "timestamp_ntz")
            return (("value", types[0]), [F.col(columns[0])]) if known else (None, [])
        return ("key", prefix, *types), [F.col(c) for c in columns]

    def given(self, p: str | None, term: str) -> Column:
        """A condition on stored columns that holds wherever the subject (p=None) or object is this term: what a scan can be
        told. It may let other rows through."""
        prefix, columns = self._made_of(p)
        if p == T.RDF_TYPE:
            return F.lit(term == T.iri(EX + self.name.capitalize()))
        types = [dict(self.df.dtypes)[c] for c in columns]
        if prefix is None:
            return self._literal(columns[0], types[0], term)
        if not term.startswith(prefix) or term[-1] != ">":
            return F.lit(False)
        parts = [term[len(prefix) : -1]]
        if len(columns) > 1:
            if not all(t in WHOLE for t in types):
                return F.lit(True)
            parts = parts[0].split("_")
        where = F.lit(len(parts) == len(columns))
        for c, kind, x in zip(columns, types, parts, strict=False):
            if kind in WHOLE:
                where = where & (F.col(c) == int(x) if re.fullmatch("0|-?[1-9][0-9]{0,17}", x) else F.lit(False))
            elif kind == "string":
                where = where & (F.col(c) == x)
        return where

    @staticmethod
    def _literal(column: str, kind: str, term: str) -> Column:
        found = T.parsed(term)
        if kind in ("timestamp", "timestamp_ntz", "boolean", "float", "date") or found is None:
            return F.lit(found is not None)
        text, datatype, lang = found
        if kind == "string":
            return F.col(column) == text if datatype is None and not lang else F.lit(False)
        if kind in WHOLE:
            return F.col(column) == int(text) if datatype == T.XSD + "integer" and re.fullmatch("0|-?[1-9][0-9]{0,17}", text) else F.lit(False)
        if kind == "double" and datatype == T.XSD + "double" and re.fullmatch(r"-?[0-9.]+(?:E-?[0-9]+)?", text):
            return F.col(column) == float(text)
        return F.lit(True)

    @property
    def vectors(self) -> dict[str, str]:
        return {T.iri(EX + self.renamed.get(c, c)): c for c, kind in self.df.dtypes if kind.startswith("array")}


def direct_mapping(spark: SparkSession, sf_dir: str, *names: str) -> list[Table]:
    """The given tables, or those named, as mapped tables."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    makers = {
        "region": lambda: Table(read("region"), "region", ["r_regionkey"]),
        "nation": lambda: Table(read("nation"), "nation", ["n_nationkey"], {"region": ("region", ["n_regionkey"])}),
        "customer": lambda: Table(read("customer"), "customer", ["c_custkey"], {"nation": ("nation", ["c_nationkey"])}),
        "supplier": lambda: Table(read("supplier"), "supplier", ["s_suppkey"], {"nation": ("nation", ["s_nationkey"])}),
        "part": lambda: Table(read("part"), "part", ["p_partkey"]),
        "orders": lambda: Table(read("orders"), "orders", ["o_orderkey"], {"customer": ("customer", ["o_custkey"])}),
        "lineitem": lambda: Table(read("lineitem").withColumn("l_id", F.sha2(F.to_json(F.struct("*")), 256)), "lineitem", ["l_id"], {"order": ("orders", ["l_orderkey"]), "part": ("part", ["l_partkey"]), "supplier": ("supplier", ["l_suppkey"])}),
        "events": lambda: Table(read("events"), "event", ["event_id"], {"user": ("user", ["user_id"])}),
        "documents": lambda: Table(read("documents"), "doc", ["doc_id"]),
        "labels": lambda: Table(read("labels"), "doc", ["doc_id"]),
        "embeddings": lambda: Table(read("embeddings"), "vec", ["vec_id"], renamed={"embedding": "hasEmbedding"}),
        "conversations": lambda: Table(read("conversations").withColumn("following", F.col("turn") + 1), "turn", ["conv_id", "turn"]),
        "pages": lambda: Table(read("pages"), "page", ["page_id"]),
        "benchmark": lambda: Table(read("benchmark"), "item", ["item_id"]),
    }
    return [makers[n]() for n in names or makers]
