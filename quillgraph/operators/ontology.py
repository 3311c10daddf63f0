"""Checks of a graph against its ontology: domains, ranges, disjoint classes, functional properties. Subclasses count as their
superclasses. Nodes without a type are not checked against domains and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, iri
from .paths import zero_or_more

RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
DOMAIN, RANGE, SUBCLASS = iri(RDFS + "domain"), iri(RDFS + "range"), iri(RDFS + "subClassOf")
DISJOINT, FUNCTIONAL = iri(OWL + "disjointWith"), iri(OWL + "FunctionalProperty")
SUBPROPERTY, EQUIVALENT, SAME, INVERSE = iri(RDFS + "subPropertyOf"), iri(OWL + "equivalentClass"), iri(OWL + "sameAs"), iri(OWL + "inverseOf")
CLASSES = (iri(OWL + "Class"), iri(RDFS + "Class"))
PROPERTIES = {iri(OWL + "ObjectProperty"): "object", iri(OWL + "DatatypeProperty"): "datatype"}
#: Axioms of an ontology: those of the second row hold both ways.
ONE_WAY = {DOMAIN: "domain", RANGE: "range", SUBCLASS: "subclass", SUBPROPERTY: "subproperty"}
BOTH_WAYS = {EQUIVALENT: "equivalent", SAME: "same", INVERSE: "inverse", DISJOINT: "disjoint"}
SMALL = 100_000  # rows of an ontology's table that are broadcast


def axioms(triples: DataFrame, p: str) -> DataFrame:
    return triples.where(F.col("p") == p).select("s", "o")


def load(triples: DataFrame) -> DataFrame:
    """kind, a, b: the axioms among triples; b is null for functional properties."""
    kind = F.create_map(*(F.lit(x) for pair in (ONE_WAY | BOTH_WAYS).items() for x in pair))
    rows = triples.where(F.col("p").isin(*ONE_WAY, *BOTH_WAYS)).select(kind[F.col("p")].alias("kind"), F.col("s").alias("a"), F.col("o").alias("b"))
    back = rows.where(F.col("kind").isin(*BOTH_WAYS.values())).select("kind", F.col("b").alias("a"), F.col("a").alias("b"))
    functional = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == FUNCTIONAL)).select(F.lit("functional").alias("kind"), F.col("s").alias("a"), F.lit(None).cast("string").alias("b"))
    return rows.unionByName(back).unionByName(functional).distinct()


def small(df: DataFrame) -> DataFrame:
    """An ontology's table, to be broadcast if it is as small as they are."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def all_types(data: DataFrame, ontology: DataFrame) -> DataFrame:
    """node, type: stated types and their superclasses."""
    types = axioms(data, RDF_TYPE).select(F.col("s").alias("node"), F.col("o").alias("type"))
    up = zero_or_more(axioms(ontology, SUBCLASS)).select(F.col("s").alias("type"), F.col("o").alias("above"))
    wider = types.join(small(up), "type").select("node", F.col("above").alias("type"))
    return types.unionByName(wider).distinct()


def _misplaced(uses: DataFrame, types: DataFrame, ontology: DataFrame, axiom: str, side: str, rule: str) -> DataFrame:
    rules = small(axioms(ontology, axiom).select(F.col("s").alias("p"), F.col("o").alias("type")))
    uses = uses.join(rules, "p").withColumn("node", F.col(side))
    if side == "o":
        uses = uses.where(~F.col("o").startswith('"'))
    typed = uses.join(types.select("node").distinct(), "node", "left_semi")
    return typed.join(types, ["node", "type"], "left_anti").select(F.lit(rule).alias("rule"), "s", "p", "o", F.col("type").alias("expected"))


def validate(new: DataFrame, data: DataFrame, ontology: DataFrame) -> DataFrame:
    """rule, s, p, o, expected: what is wrong with triples that are to be inserted, given the types that are there. Of a triple with
    several faults one is told: domain before range before disjoint."""
    types = all_types(data, ontology)
    apart = axioms(ontology, DISJOINT)
    apart = small(apart.select(F.col("s").alias("a"), F.col("o").alias("b")).unionByName(apart.select(F.col("o").alias("a"), F.col("s").alias("b"))).distinct())
    stated = axioms(data, RDF_TYPE).select(F.col("s").alias("node"), F.col("o").alias("a"))
    typing = new.where(F.col("p") == RDF_TYPE).withColumn("node", F.col("s"))
    clash = typing.join(stated, "node").join(apart, "a").where(F.col("b") == F.col("o")).select(F.lit("disjoint").alias("rule"), "s", "p", "o", F.col("a").alias("expected"))
    found = _misplaced(new, types, ontology, DOMAIN, "s", "domain").unionByName(_misplaced(new, types, ontology, RANGE, "o", "range")).unionByName(clash)
    rank = F.array_position(F.array(*map(F.lit, ("domain", "range", "disjoint"))), F.col("rule"))
    first = found.groupBy("s", "p", "o").agg(F.min(F.struct(rank.alias("k"), "rule", "expected")).alias("x"))
    return first.select("x.rule", "s", "p", "o", "x.expected")


def classes(triples: DataFrame) -> DataFrame:
    """class, parent (or null): declared classes, and those named as a parent."""
    declared = triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*CLASSES)).select(F.col("s").alias("class")).distinct()
    below = axioms(triples, SUBCLASS).select(F.col("s").alias("class"), F.col("o").alias("parent")).distinct()
    found = declared.join(below, "class", "left")
    parents = found.where("parent IS NOT NULL").select(F.col("parent").alias("class")).distinct().join(declared, "class", "left_anti")
    return found.unionByName(parents.withColumn("parent", F.lit(None).cast("string")))


def properties(triples: DataFrame) -> DataFrame:
    """property, kind (object or datatype), domain, range; nulls where there is none."""
    kind = F.create_map(*(F.lit(x) for pair in PROPERTIES.items() for x in pair))
    declared = triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*PROPERTIES)).select(F.col("s").alias("property"), kind[F.col("o")].alias("kind"))
    for axiom, name in ((DOMAIN, "domain"), (RANGE, "range")):
        declared = declared.join(axioms(triples, axiom).select(F.col("s").alias("property"), F.col("o").alias(name)), "property", "left")
    return declared.distinct()


def individuals(triples: DataFrame) -> DataFrame:
    """individual, class: typed nodes that are neither classes nor properties."""
    no = [*CLASSES, *PROPERTIES, FUNCTIONAL]
    return axioms(triples, RDF_TYPE).where(~F.col("o").isin(*no)).select(F.col("s").alias("individual"), F.col("o").alias("class")).distinct()


def domain_violations(data: DataFrame, ontology: DataFrame) -> DataFrame:
    return _misplaced(data, all_types(data, ontology), ontology, DOMAIN, "s", "domain")


def range_violations(data: DataFrame, ontology: DataFrame) -> DataFrame:
    return _misplaced(data, all_types(data, ontology), ontology, RANGE, "o", "range")


def disjoint_violations(data: DataFrame, ontology: DataFrame) -> DataFrame:
    """node, a, b: a node of two disjoint classes."""
    types = all_types(data, ontology)
    pairs = small(axioms(ontology, DISJOINT).select(F.col("s").alias("a"), F.col("o").alias("b")))
    return types.withColumnRenamed("type", "a").join(pairs, "a").join(types.withColumnRenamed("type", "b"), ["node", "b"]).select("node", "a", "b")


def functional_violations(data: DataFrame, ontology: DataFrame) -> DataFrame:
    """s, p, n: a functional property with several objects."""
    functional = ontology.where((F.col("p") == RDF_TYPE) & (F.col("o") == FUNCTIONAL)).select(F.col("s").alias("p"))
    return data.join(small(functional), "p", "left_semi").groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where("n > 1")


def graph_health(triples: DataFrame) -> DataFrame:
    """triples, subjects, predicates, terms and a status."""
    places = F.explode(F.array(*(F.struct(F.lit(c).alias("place"), F.col(c).alias("t")) for c in "spo")))
    one = lambda place: F.count(F.when(F.col("places")[place] > 0, 1))
    terms = triples.select(places.alias("x")).groupBy("x.t").agg(F.struct(*(F.count(F.when(F.col("x.place") == c, 1)).alias(c) for c in "spo")).alias("places"))
    counts = terms.agg(F.coalesce(F.sum("places.s"), F.lit(0)).alias("triples"), one("s").alias("subjects"), one("p").alias("predicates"), F.count(F.lit(1)).alias("terms"))
    return counts.withColumn("status", F.when(F.col("triples") > 0, "healthy").otherwise("warning"))


def vector_health(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """Of vectors (s, deleted) and their proximity graph's edges: nodes, edges, mean_degree, tombstones, status, needs_compaction;
    thresholds on degree and on the deleted share count from 10 and 5 nodes."""
    n = vectors.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("deleted").alias("deleted"))
    e = edges.where("type = 'horizontal' AND layer = 0").agg(F.count(F.lit(1)).alias("edges"))
    nodes, per = F.col("nodes"), F.greatest(F.col("nodes"), F.lit(1))
    degree, share = F.col("edges") / per, F.col("deleted") / per
    bad = ((share > 0.5) & (nodes >= 5)) | ((degree < 2) & (nodes >= 10))
    poor = ((share > 0.3) & (nodes >= 5)) | ((degree < 6) & (nodes >= 50))
    status = F.when(bad, "critical").when(poor, "warning").otherwise("healthy")
    return n.crossJoin(e).select("nodes", "edges", degree.alias("mean_degree"), share.alias("tombstones"), status.alias("status"), (share > 0.3).alias("needs_compaction"))  # a row each
