"""Registered queries of the graph operators over the given tables, each with the SQL that says the same. Names begin with the operators'
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import terms as T
from .operators import ontology, paths, tables, temporal, vector
from .operators.graph import Graph, bulk_insert, delete, insert, verify
from .operators.registry import Registry
from .operators.solutions import Solutions, count, extreme, mean, total
from .plans.store import Store, shared_dir
from .sources import formats
from .sources.mapping import EX, direct_mapping
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ex(name: str) -> str:
    return T.iri(EX + name)


def G(spark: SparkSession, sf_dir: str, *names: str) -> Graph:
    return Graph(tables=direct_mapping(spark, sf_dir, *names))


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def I(kind: str, key: str) -> str:  # noqa: E743  an IRI in SQL
    return f"'<{EX}{kind}/' || {key} || '>'"


# scans


@query(f"SELECT {I('customer', 'c_custkey')} AS s, c_name AS o FROM customer")
def S3_scan_predicate(spark, d):
    return Solutions(G(spark, d, "customer").relation(ex("c_name"))).native(o="string")


@query("SELECT (SELECT count(*) + count(o_orderkey) + 2 * count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) FROM orders) + (SELECT count(*) + count(c_custkey) + count(c_name) + 2 * count(c_nationkey) + count(c_acctbal) + count(c_mktsegment) FROM customer) AS n")
def S1_S10_full_scan_count(spark, d):
    return G(spark, d, "orders", "customer").triples().agg(count().alias("n"))


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey = 7")
def S2_S5_scan_subject(spark, d):
    g = G(spark, d, "customer")
    c = ex("customer/7")
    return g.match(c, ex("c_name"), "?name").join(g.match(c, ex("c_nationkey"), "?nation"), product=True).native(name="string", nation="bigint")


@query("SELECT count(*) AS triples FROM (SELECT unnest(['t', 'k', c_name, c_nationkey::VARCHAR, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS x FROM customer WHERE c_custkey = 7) WHERE x IS NOT NULL")
def S2_scan_subject_of_any_predicate(spark, d):
    return G(spark, d, "customer").match(ex("customer/7"), "?p", "?o").group(triples=count()).df


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3")
def S4_S6_scan_object(spark, d):
    s = G(spark, d, "customer").match("?c", ex("nation"), ex("nation/3"))
    return s.bind("id", s.key("c")).select("id").df


@query(f"SELECT {I('orders', 'o_orderkey')} AS s, 2 + 2 * (o_custkey IS NOT NULL)::INT + (o_orderstatus IS NOT NULL)::INT + (o_totalprice IS NOT NULL)::INT + (o_orderdate IS NOT NULL)::INT + (o_orderpriority IS NOT NULL)::INT AS degree FROM orders")
def S7_adjacency(spark, d):
    return G(spark, d, "orders").adjacency().groupBy("s").agg(F.sum(F.size("edges")).cast("int").alias("degree"))


@query("SELECT n AS nation, EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7 AND c_nationkey = n) AS result FROM (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_custkey BETWEEN 7 AND 11)")
def S8_contains(spark, d):
    """True for one nation, false for the others."""
    g = G(spark, d, "customer")
    few = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey BETWEEN 7 AND 11").select("c_nationkey").distinct().collect()
    parts = [g.contains(ex("customer/7"), ex("nation"), ex(f"nation/{r[0]}")).select(F.lit(r[0]).alias("nation"), "result") for r in few]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT * FROM (SELECT 'c_name' AS p, count(c_name) AS triples, count(DISTINCT c_name) AS objects FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 's_name', count(s_name), count(DISTINCT s_name) FROM supplier)")
def S9_statistics(spark, d):
    g = G(spark, d, "customer", "supplier").statistics()
    return g.select(F.regexp_extract("p", "/([a-z_]+)>$", 1).alias("p"), "triples", "objects").where(F.col("p").isin("c_name", "c_nationkey", "s_name"))


@query("SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def S11_S28_stored_scan(spark, d):
    store = new_store(spark).create(G(spark, d, "customer", "supplier").triples())
    rows = Graph(store.triples(ex("c_name")).unionByName(store.triples(ex("s_name")))).match("?s", "?p", "?o")
    return rows.df.select(F.regexp_extract("s", "org/([a-z]+)/", 1).alias("kind"), T.lex(F.col("o")).alias("name"))


@query("WITH c AS (SELECT 7 * count(*) AS n, 7 * count(*) - count(*) FILTER (c_acctbal < 0) AS k FROM customer) SELECT 'created' AS step, n FROM c UNION ALL SELECT 'deleted', k FROM c UNION ALL SELECT 'backup', k FROM c UNION ALL SELECT 'replaced', 6 * count(*) FROM supplier UNION ALL SELECT 'cleared', 0")
def X6_S29_replace_clear_backup(spark, d):
    """Triples in a store after each change of it, and in a backup."""
    store = new_store(spark).create(G(spark, d, "customer").triples())
    debts = G(spark, d, "customer").match("?s", ex("c_acctbal"), "?o").filter(lambda s: T.num(s["o"]) < 0).df.select("s", F.lit(ex("c_acctbal")).alias("p"), "o")
    n = {"created": store.triples().count()}
    n["deleted"] = n["created"] - store.delete(debts)
    n["backup"] = store.copy_to(new_store(spark).path).triples().count()
    n["replaced"] = store.replace(G(spark, d, "supplier").triples()).triples().count()
    store.clear()
    n["cleared"] = store.triples().count()
    return spark.createDataFrame(list(n.items()), "step string, n long")


@query(f"SELECT {I('customer', 'c_custkey')} AS s, c_name AS name, c_acctbal AS balance FROM customer")
def S12_S23_ntriples_round_trip(spark, d):
    lines = formats.to_ntriples(G(spark, d, "customer").triples())
    return Graph(formats.parse_lines(lines).select("s", "p", "o")).star("s", name=ex("c_name"), balance=ex("c_acctbal")).native(name="string", balance="double")


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS subjects FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def S13_nquads_round_trip(spark, d):
    """A graph a source: written as N-Quads, read back, counted by graph."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    quads = t.select(T.iri_of(f"{EX}doc/", F.col("doc_id")).alias("s"), F.lit(ex("lang")).alias("p"), T.literal_of(F.col("lang"), "string").alias("o"), T.iri_of(f"{EX}source/", F.col("source")).alias("g")).where("o IS NOT NULL")
    rows = formats.parse_lines(formats.to_nquads(quads))
    return rows.groupBy(F.regexp_extract("g", "source/(.*)>$", 1).alias("source")).agg(count().alias("n"), F.countDistinct("s").alias("subjects"))


@query("SELECT doc_id AS id, md5(replace(replace(text, 'e', chr(92) || 'n'), 'a', 'é😀')) AS text FROM documents WHERE text IS NOT NULL")
def F8_F16_escapes(spark, d):
    """Texts with real backslashes before n, written with escapes by number too, read back by STR()."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    term = T.literal_of(F.replace(F.col("text"), F.lit("e"), F.lit("\\z")), "string")  # z and q stand in until the term is spelled
    term = F.replace(F.replace(term, F.lit("\\\\z"), F.lit("\\\\n")), F.lit("a"), F.lit("\\u00E9\\U0001F600"))
    line = F.concat(T.iri_of(f"{EX}doc/", F.col("doc_id")), F.lit(f" {ex('text')} "), term, F.lit(" ."))
    s = Graph(formats.parse_lines(t.select(line.alias("value"))).select("s", "p", "o")).match("?d", ex("text"), "?t")
    return s.df.select(number("d").alias("id"), F.md5(T.lex(F.col("t"))).alias("text"))


@query("SELECT count(*) AS inserted, count(*) AS duplicates, count(*) FILTER (s_acctbal < 0) AS malformed FROM supplier")
def S20_bulk_insert(spark, d):
    """Each supplier's name twice, and a broken line for those in debt."""
    t = spark.read.parquet(f"{d}/supplier.parquet")
    good = F.concat(T.iri_of(f"{EX}supplier/", F.col("s_suppkey")), F.lit(f" {ex('s_name')} "), T.literal_of(F.col("s_name"), "string"), F.lit(" ."))
    lines = t.select((F.col("s_suppkey") * 3).alias("line"), good.alias("value")).unionByName(t.select((F.col("s_suppkey") * 3 + 1).alias("line"), good.alias("value")))
    lines = lines.unionByName(t.where("s_acctbal < 0").select((F.col("s_suppkey") * 3 + 2).alias("line"), F.concat(F.lit("<broken "), F.col("s_name")).alias("value")))
    new, errors = bulk_insert(G(spark, d, "customer").triples(), lines)
    told = errors.agg(F.count_if(F.col("error") == "duplicate").alias("duplicates"), F.count_if(F.col("error") == "malformed").alias("malformed"))
    return new.agg(count().alias("inserted")).crossJoin(told)  # a row each


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def S14_S22_turtle_round_trip(spark, d):
    prefixes = {"ex": EX}
    blocks = formats.to_turtle(G(spark, d, "customer").triples(), prefixes)
    document = blocks.select(F.concat(F.lit("\n".join(formats.prefix_lines(prefixes)) + "\n"), "value").alias("value"))
    return Graph(formats.parse_documents(document, "turtle")).star("s", id=ex("c_custkey"), name=ex("c_name")).native(id="bigint", name="string").drop("s")


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def S15_rdfxml(spark, d):
    row = F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex.org/"><rdf:Description rdf:about="http://ex.org/part/'), F.col("p_partkey").cast("string"), F.lit('"><ex:name>'), "p_name", F.lit("</ex:name></rdf:Description></rdf:RDF>"))
    g = Graph(formats.parse_documents(spark.read.parquet(f"{d}/part.parquet").select(row.alias("value")), "rdfxml"))
    return g.match("?s", ex("name"), "?name").df.select(F.regexp_extract("s", "([0-9]+)>", 1).cast("bigint").alias("id"), T.lex(F.col("name")).alias("name"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def S16_jsonld(spark, d):
    t = spark.read.parquet(f"{d}/supplier.parquet")
    row = F.to_json(F.struct(F.struct(F.lit(EX).alias("@vocab")).alias("@context"), F.concat(F.lit(EX + "supplier/"), F.col("s_suppkey").cast("string")).alias("@id"), "s_name", "s_acctbal"))
    g = Graph(formats.parse_documents(t.select(row.alias("value")), "jsonld"))
    rows = g.star("s", name=ex("s_name"), balance=ex("s_acctbal")).native(name="string", balance="double")
    return rows.withColumn("id", F.regexp_extract("s", "([0-9]+)>", 1).cast("bigint")).drop("s")


@query("SELECT count(*) FILTER (s_acctbal >= 0) AS names, count(*) FILTER (s_acctbal < 0) AS errors FROM supplier")
def S16_malformed_documents(spark, d):
    """Documents of suppliers in debt lack their last sign: they're told, and the others read."""
    t = spark.read.parquet(f"{d}/supplier.parquet")
    row = F.to_json(F.struct(F.struct(F.lit(EX).alias("@vocab")).alias("@context"), F.concat(F.lit(EX + "supplier/"), F.col("s_suppkey").cast("string")).alias("@id"), "s_name"))
    documents = t.select(F.when(F.col("s_acctbal") < 0, F.substring(row, F.lit(1), F.length(row) - 1)).otherwise(row).alias("value"))
    names = Graph(formats.parse_documents(documents, "jsonld")).match("?s", ex("s_name"), "?n").group(names=count())
    return names.df.crossJoin(formats.document_errors(documents, "jsonld").agg(count().alias("errors")))  # a row each


@query("SELECT '@prefix void: <http://rdfs.org/ns/void#> .' || chr(10) || chr(10) || '<> a void:Dataset ;' || chr(10) || '    void:triples ' || 7 * count(*) || ' .' || chr(10) AS value FROM customer")
def S30_description(spark, d):
    return formats.service_description(G(spark, d, "customer").triples())


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END AS side, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def S17_typed_values(spark, d):
    lines = formats.to_ntriples(G(spark, d, "customer").find(p=ex("c_acctbal")))
    g = Graph(formats.parse_lines(lines).select("s", "p", "o")).match("?c", ex("c_acctbal"), "?b")  # read from their spelling
    return g.bind("side", F.when(T.num(F.col("b")) < 0, "negative").otherwise("positive")).group("side", n=count(), total=total("b").round(2)).df


@query("SELECT vec_id AS id, round(list_inner_product(embedding, embedding), 4) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)")
def S18_vector_literals(spark, d):
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    term = F.concat(F.lit('"'), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "), F.lit(f'"^^<{EX}{T.VECTOR}>'))
    g = Graph(t.select(T.iri_of(f"{EX}vec/", F.col("vec_id")).alias("s"), F.lit(ex("hasEmbedding")).alias("p"), term.alias("o")))
    from .functions.vectors import dot

    return g.vectors(ex("hasEmbedding")).select(F.regexp_extract("s", "([0-9]+)>", 1).cast("bigint").alias("id"), F.round(dot(F.col("vec"), F.col("vec")), 4).alias("norm"))


@query("SELECT '{\"n\":{\"type\":\"literal\",\"value\":\"' || c_name || '\"}}' AS value FROM customer")
def S25_json_results(spark, d):
    return formats.json_results(G(spark, d, "customer").match("?s", ex("c_name"), "?n").select("n").df)


@query("SELECT c_name AS n FROM customer")
def S26_delimited_results(spark, d):
    return formats.delimited_results(G(spark, d, "customer").match("?s", ex("c_name"), "?n").select("n").df)


@query(f"SELECT '<result><binding name=\"s\"><uri>{EX}customer/' || c_custkey || '</uri></binding></result>' AS value FROM customer")
def S27_xml_results(spark, d):
    return formats.xml_results(G(spark, d, "customer").match("?s", ex("c_name"), "?n").select("s").df)


# projection, values, filters


@query("SELECT c_name AS name, 'customer' AS kind, CASE n_nationkey WHEN 3 THEN 'three' ELSE 'five' END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (3, 5)")
def P3_P4_bind_values(spark, d):
    g = G(spark, d, "customer")
    s = g.star("c", name=ex("c_name"), n=ex("nation")).values("n", [ex("nation/3"), ex("nation/5")]).bind("kind", F.lit("customer"))
    return s.bind("label", T.if_(F.col("n") == ex("nation/3"), F.lit("three"), F.lit("five"))).select("name", "kind", "label").native(name="string")


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment <> 'BUILDING') OR c_acctbal <= -500")
def P5_P8_filters(spark, d):
    s = G(spark, d, "customer").star("c", id=ex("c_custkey"), b=ex("c_acctbal"), m=ex("c_mktsegment"))
    s = s.filter((T.less(5000, s["b"]) & ~T.equal(s["m"], '"BUILDING"')) | ~T.less(-500, s["b"]))
    return s.select("id", "b").native(id="bigint", b="double").withColumnRenamed("b", "balance")


@query("SELECT count(*) FILTER (quality IS NOT NULL) AS bound, count(*) FILTER (quality IS NULL) AS unbound FROM documents LEFT JOIN labels USING (doc_id)")
def P9_bound(spark, d):
    g = G(spark, d, "documents", "labels")
    s = g.match("?d", ex("lang"), "?l").optional(g.match("?d", ex("quality"), "?q"))
    return s.group(bound=F.count_if(F.col("q").isNotNull()), unbound=F.count_if(F.col("q").isNull())).df


# joins


@query("SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def J1_bgp_chain(spark, d):
    g = G(spark, d, "orders", "customer", "nation", "region")
    s = g.star("o", c=ex("customer"), price=ex("o_totalprice")).join(g.match("?c", ex("nation"), "?n")).join(g.match("?n", ex("region"), "?r")).join(g.match("?r", ex("r_name"), "?name"))
    return s.group("name", n=count(), total=total("price").round(2)).native(name="string").withColumnRenamed("name", "region")


@query("SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def J3_J4_subject_object_joins(spark, d):
    g = G(spark, d, "customer", "nation")
    return g.bgp(("?c", ex("nation"), "?n"), ("?n", ex("n_name"), "?nation")).group("nation", customers=count("c")).native(nation="string")


@query("SELECT r_name AS region, segment, n FROM region, (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1)")
def J5_product(spark, d):
    g = G(spark, d, "region", "customer")
    segments = g.match("?c", ex("c_mktsegment"), "?segment").group("segment", n=count())
    return g.match("?r", ex("r_name"), "?region").join(segments, product=True).select("region", "segment", "n").native(region="string", segment="string")


@query("SELECT doc_id AS id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def J6_optional(spark, d):
    g = G(spark, d, "documents", "labels")
    s = g.match("?d", ex("lang"), "?l").optional(g.match("?d", ex("quality"), "?quality"))
    return s.bind("id", s.key("d")).select("id", "quality").native(quality="bigint")


@query("WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), d AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id AS id, quality AS q, n FROM d JOIN n USING (quality) UNION ALL SELECT doc_id, n.quality, n FROM d, n WHERE d.quality IS NULL")
def J6_optional_unbound(spark, d):
    """A variable that may be unbound on the left of OPTIONAL takes every value from the right."""
    g = G(spark, d, "documents", "labels")
    s = g.match("?d", ex("lang"), "?l").optional(g.match("?d", ex("quality"), "?q"))
    s = s.optional(g.match("?x", ex("quality"), "?q").group("q", n=count()))
    return s.bind("id", s.key("d")).select("id", "q", "n").native(q="bigint")


@query("SELECT lang, count(*) AS n, count(quality) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1 AND lang <> 'de' GROUP BY 1")
def J6_optional_filter(spark, d):
    g = G(spark, d, "documents", "labels")
    good = (F.col("q") == T.literal(1)) & (F.col("lang") != '"de"')
    return g.match("?d", ex("lang"), "?lang").optional(g.match("?d", ex("quality"), "?q"), good).group("lang", n=count(), good=count("q")).native(lang="string")


@query("SELECT source, count(*) AS n FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1) GROUP BY 1")
def J7_exists(spark, d):
    g = G(spark, d, "documents", "labels")
    return g.match("?d", ex("source"), "?source").exists(g.match("?d", ex("toxic"), T.literal(1))).group("source", n=count()).native(source="string")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def J8_not_exists(spark, d):
    g = G(spark, d, "customer", "orders")
    dear = g.star("o", c=ex("customer"), price=ex("o_totalprice")).filter(lambda s: T.num(s["price"]) > 300000)
    return g.match("?c", ex("c_custkey"), "?id").not_exists(dear).select("id").native(id="bigint")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY 1")
def J7_exists_in_or(spark, d):
    g = G(spark, d, "customer", "orders")
    dear = g.star("o", c=ex("customer"), price=ex("o_totalprice")).filter(lambda s: T.num(s["price"]) > 400000)
    s = g.star("c", b=ex("c_acctbal"), segment=ex("c_mktsegment")).exists_flag(dear, "__dear")
    return s.filter((T.num(s["b"]) < 0) | F.col("__dear")).group("segment", n=count()).native(segment="string")


@query("SELECT c_custkey AS id, k AS customers FROM customer JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) USING (c_nationkey)")
def J9_subselect(spark, d):
    g = G(spark, d, "customer")
    top = g.match("?c", ex("nation"), "?n").group("n", customers=count("c")).bind("k", F.regexp_extract("n", "([0-9]+)>", 1).cast("bigint")).order_by("-customers", "k").slice(3).select("n", "customers")
    return g.star("c", id=ex("c_custkey"), n=ex("nation")).join(top).select("id", "customers").native(id="bigint")


@query("SELECT doc_id AS id, q FROM documents JOIN (SELECT doc_id, quality AS q FROM labels UNION ALL SELECT doc_id, v FROM documents ANTI JOIN labels USING (doc_id), (VALUES (0), (1)) t(v)) USING (doc_id)")
def J10_compatible(spark, d):
    g = G(spark, d, "documents", "labels")
    s = g.match("?d", ex("lang"), "?l").optional(g.match("?d", ex("quality"), "?q"))
    both = Solutions(spark.createDataFrame([(T.literal(0),), (T.literal(1),)], "q string"))
    return s.join(both).bind("id", F.regexp_extract("d", "([0-9]+)>", 1).cast("bigint")).select("id", "q").native(q="bigint")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def J11_star(spark, d):
    s = G(spark, d, "customer").star("c", id=ex("c_custkey"), name=ex("c_name"), segment=ex("c_mktsegment"), balance=ex("c_acctbal"))
    return s.select("id", "name", "segment", "balance").native(id="bigint", name="string", segment="string", balance="double")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def J12_self_join(spark, d):
    g = G(spark, d, "supplier")
    s = g.star("x", a=ex("s_suppkey"), n=ex("nation")).join(g.star("y", b=ex("s_suppkey"), n=ex("nation"))).filter(F.col("x") != F.col("y"))
    return s.select("a", "b").native(a="bigint", b="bigint")


@query("SELECT doc_id AS id, quality AS q, toxic AS confidence FROM labels")
def J13_quoted_triples(spark, d):
    t = spark.read.parquet(f"{d}/labels.parquet")
    s, q = T.iri_of(f"{EX}doc/", F.col("doc_id")), T.literal_of(F.col("quality"), "bigint")
    notes = t.select(T.quote(s, F.lit(ex("quality")), q).alias("s"), F.lit(ex("confidence")).alias("p"), T.literal_of(F.col("toxic"), "bigint").alias("o"))
    s = Graph(notes).match(f"<< ?d {ex('quality')} ?q >>", ex("confidence"), "?confidence")
    return s.bind("id", F.regexp_extract("d", "([0-9]+)>", 1).cast("bigint")).select("id", "q", "confidence").native(q="bigint", confidence="bigint")


# groups


@query("SELECT c_mktsegment AS segment, count(*) AS rows, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1")
def A1_A8_aggregates(spark, d):
    s = G(spark, d, "customer").star("c", segment=ex("c_mktsegment"), n=ex("nation"), b=ex("c_acctbal"))
    g = s.group("segment", rows=count(), nations=count("n", distinct=True), total=total("b").round(2), mean=mean("b").round(4), least=extreme("b"), most=extreme("b", largest=True))
    return g.native(segment="string", least="double", most="double")


@query("SELECT count(*) AS n, 0.0::DOUBLE AS total FROM customer WHERE false")
def A2_implicit_group(spark, d):
    s = G(spark, d, "customer").match("?c", ex("c_acctbal"), "?b").filter(lambda s: T.num(s["b"]) > 1e12)
    return s.group(n=count(), total=total("b")).df


@query("SELECT c_nationkey AS nation, count(*) AS rows, count(DISTINCT (s, r)) AS solutions FROM (SELECT c_nationkey, c_mktsegment AS s, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS r FROM customer) GROUP BY 1")
def A5_count_distinct_solutions(spark, d):
    """COUNT(DISTINCT *): different solutions, with unbound variables too."""
    s = G(spark, d, "customer").star("c", n=ex("nation"), segment=ex("c_mktsegment"), b=ex("c_acctbal"))
    s = s.bind("r", lambda s: F.when(T.num(s["b"]) >= 0, F.col("n")), maybe=True).select("n", "segment", "r")
    return s.group("n", rows=count(), solutions=count(distinct=True)).df.select(number("n").cast("int").alias("nation"), "rows", "solutions")


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 50")
def A9_having(spark, d):
    g = G(spark, d, "customer", "nation")
    s = g.bgp(("?c", ex("nation"), "?k"), ("?k", ex("n_name"), "?nation")).group("nation", n=count()).filter(F.col("n") > 50)
    return s.native(nation="string")


@query("SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def A10_O6_distinct(spark, d):
    return G(spark, d, "orders").star("o", status=ex("o_orderstatus"), priority=ex("o_orderpriority")).group("status", "priority").native(status="string", priority="string")


# order, union


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def O1_O4_top_k(spark, d):
    s = G(spark, d, "orders").star("o", id=ex("o_orderkey"), price=ex("o_totalprice")).order_by("-price", "id").slice(20)
    return s.select("id", "price").native(id="bigint", price="double")


@query("SELECT c_name AS name FROM customer ORDER BY c_name LIMIT 5 OFFSET 10")
def O3_offset(spark, d):
    return G(spark, d, "customer").match("?n", ex("c_name"), "?name").select("name").order_by("name").slice(5, 10).native(name="string")


@query("SELECT n_name AS nation, 'customer' AS kind, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'supplier', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def U1_union(spark, d):
    g = G(spark, d, "customer", "supplier", "nation")
    c = g.match("?x", ex("c_custkey"), "?id").bind("kind", F.lit("customer"))
    s = g.match("?x", ex("s_suppkey"), "?id").bind("kind", F.lit("supplier"))
    return c.union(s).join(g.match("?x", ex("nation"), "?n")).join(g.match("?n", ex("n_name"), "?nation")).select("nation", "kind", "id").native(nation="string", id="bigint")


# paths


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Edges from each turn of a conversation to the next."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn").distinct()
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
    name = lambda k: T.iri_of(f"{EX}turn/", F.col("conv_id"), k)
    return t.join(nxt, ["conv_id", "turn"]).select(name(F.col("turn")).alias("s"), name(F.col("turn") + 1).alias("o"))


TURNS = "WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn AS a, turn + 1 AS b FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn + 1)), r AS (SELECT conv_id, a, b FROM e UNION SELECT r.conv_id, r.a, e.b FROM r JOIN e ON r.conv_id = e.conv_id AND r.b = e.a) "


def turn(c: str) -> str:
    return f"'<{EX}turn/' || conv_id || '_' || {c} || '>'"


@query("SELECT c_custkey AS id, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def G1_sequence(spark, d):
    g = G(spark, d, "customer", "nation", "region")
    p = paths.sequence(g.relation(ex("nation")), g.relation(ex("region")), g.relation(ex("r_name")))
    return p.select(F.regexp_extract("s", "([0-9]+)>", 1).cast("bigint").alias("id"), T.lex(F.col("o")).alias("region"))


@query(TURNS + f"SELECT {turn('a')} AS s, {turn('b')} AS o FROM r")
def G2_one_or_more(spark, d):
    return paths.one_or_more(turns(spark, d))


REACH = "WITH RECURSIVE e AS (SELECT DISTINCT 'a' || (l_suppkey % 40) AS s, 'a' || (l_partkey % 40) AS o FROM lineitem WHERE l_quantity = 1 AND l_linenumber = 1), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) "


@query(REACH + "SELECT s, o FROM r")
def G2_branching_and_cyclic(spark, d):
    """Which groups of suppliers reach which groups of parts: edges that branch and meet in cycles."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity = 1 AND l_linenumber = 1")
    name = lambda c: F.concat(F.lit("a"), (F.col(c) % 40).cast("string"))
    return paths.one_or_more(t.select(name("l_suppkey").alias("s"), name("l_partkey").alias("o")))


@query(TURNS + f"SELECT {turn('a')} AS s, {turn('b')} AS o FROM (SELECT * FROM r UNION SELECT conv_id, a, a FROM e UNION SELECT conv_id, b, b FROM e)")
def G3_zero_or_more(spark, d):
    return paths.zero_or_more(turns(spark, d))


@query(TURNS + f"SELECT {turn('a')} AS s, {turn('b')} AS o FROM (SELECT * FROM e UNION SELECT conv_id, a, a FROM e UNION SELECT conv_id, b, b FROM e)")
def G4_zero_or_one(spark, d):
    return paths.zero_or_one(turns(spark, d))


@query(TURNS + f"SELECT {turn('a')} AS s, {turn('b')} AS o FROM r WHERE a = 0 AND b <= 4")
def E1_until(spark, d):
    edges = turns(spark, d)
    starts = edges.where(F.col("s").endswith("_0>")).select("s")
    return paths.one_or_more(edges, starts, until=F.col("o").endswith("_4>"))


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
def G5_inverse_sequence(spark, d):
    g = G(spark, d, "orders")
    same = paths.sequence(g.relation(ex("customer")), paths.inverse(g.relation(ex("customer"))))
    return same.select(number("s").alias("a"), number("o").alias("b"))


@query("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def G5_constant_end(spark, d):
    g = G(spark, d, "customer", "nation")
    return paths.sequence(g.relation(ex("nation")), g.find(p=ex("region"), o=ex("region/2"))).select(number("s").alias("id"))


# vectors


VEC = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0) "


def query_vector(spark: SparkSession, d: str) -> tuple[Graph, DataFrame, list[float]]:
    g = G(spark, d, "embeddings")
    v = g.vectors(ex("hasEmbedding"))
    return g, v, list(v.where(F.col("s") == ex("vec/0")).first()["vec"])


def number(c: str):
    return F.regexp_extract(c, "([0-9]+)>", 1).cast("bigint")


@query(VEC + "SELECT vec_id AS id, round(list_cosine_similarity(v.e, q.e), 4) AS score FROM v, q ORDER BY list_cosine_similarity(v.e, q.e) DESC, vec_id LIMIT 25")
def V1_V3_similar_top_k(spark, d):
    _, v, q = query_vector(spark, d)
    return vector.search(v, q, k=25).df.select(number("s").alias("id"), F.round("score", 4).alias("score"))


@query(VEC + "SELECT vec_id AS id, round(list_cosine_similarity(v.e, q.e), 4) AS score FROM v, q WHERE list_cosine_similarity(v.e, q.e) >= 0.1")
def V1_threshold(spark, d):
    _, v, q = query_vector(spark, d)
    return vector.search(v, q, k=None, threshold=0.1).df.select(number("s").alias("id"), F.round("score", 4).alias("score"))


@query(VEC + "SELECT vec_id AS id, round(0 - list_distance(v.e, q.e) * list_distance(v.e, q.e), 4) AS score FROM v, q ORDER BY list_distance(v.e, q.e), vec_id LIMIT 15")
def V2_euclid(spark, d):
    _, v, q = query_vector(spark, d)
    return vector.search(v, q, "euclid", k=15).df.select(number("s").alias("id"), F.round("score", 4).alias("score"))


@query(VEC + "SELECT vec_id AS id, round(list_inner_product(v.e, q.e), 4) AS score FROM v, q ORDER BY list_inner_product(v.e, q.e) DESC, vec_id LIMIT 15")
def V2_dot(spark, d):
    _, v, q = query_vector(spark, d)
    return vector.search(v, q, "dot", k=15).df.select(number("s").alias("id"), F.round("score", 4).alias("score"))


@query(VEC + "SELECT vec_id AS id, label, round(list_cosine_similarity(v.e, q.e), 4) AS score FROM v, q WHERE label = 1 AND list_cosine_similarity(v.e, q.e) >= 0.05")
def V4_V5_bound_subject(spark, d):
    g, v, q = query_vector(spark, d)
    s = vector.filter_similar(g.match("?x", ex("label"), "?label").filter(T.equal(F.col("label"), F.lit(T.literal(1)))), v, q, "x", threshold=0.05)
    return s.bind("id", number("x")).bind("score", F.round("score", 4)).select("id", "label", "score").native(label="bigint")


@query(VEC + "SELECT label, count(*) AS n, round(avg(s), 4) AS mean FROM (SELECT label, list_cosine_similarity(v.e, q.e) AS s FROM v, q ORDER BY 2 DESC, vec_id LIMIT 100) GROUP BY 1")
def V3_vector_to_graph(spark, d):
    g, v, q = query_vector(spark, d)
    s = vector.search(v, q, k=100, subject="x").join(g.match("?x", ex("label"), "?label"))
    return s.group("label", n=count(), mean=F.round(F.avg("score"), 4)).native(label="bigint")


@query(VEC + ", p AS (SELECT e FROM v WHERE vec_id = 1) SELECT vec_id AS id, round(list_cosine_similarity(v.e, q.e) + list_cosine_similarity(v.e, p.e), 4) AS score FROM v, q, p WHERE list_cosine_similarity(v.e, q.e) >= 0 AND list_cosine_similarity(v.e, p.e) >= 0")
def V17_two_vectors(spark, d):
    g, v, q = query_vector(spark, d)
    p = list(v.where(F.col("s") == ex("vec/1")).first()["vec"])
    a = vector.search(v, q, k=None, threshold=0.0)
    b = Solutions(vector.search(v, p, k=None, threshold=0.0).df.withColumnRenamed("score", "other"))
    return a.join(b).df.select(number("s").alias("id"), F.round(F.col("score") + F.col("other"), 4).alias("score"))


NEAR = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC) AS k FROM v a JOIN v b ON a.vec_id <> b.vec_id) "


@query(NEAR + "SELECT a AS source, b AS target, round(s, 4) AS similarity FROM n WHERE k <= 8")
def V10_V12_neighbour_graph(spark, d):
    _, v, _ = query_vector(spark, d)
    return vector.nearest_neighbours(v, 8).select(number("source").alias("source"), number("target").alias("target"), F.round("similarity", 4).alias("similarity"))


@query("WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, floor(-ln((('0x' || substr(md5('<http://ex.org/vec/' || vec_id || '>'), 1, 8))::BIGINT::DOUBLE + 1) / 4294967296.0::DOUBLE) / ln(4.0::DOUBLE))::INT AS top FROM embeddings), l AS (SELECT * FROM (VALUES (0), (1), (2)) x(layer)), n AS (SELECT layer, row_number() OVER (PARTITION BY layer, a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC) AS k FROM l JOIN t a ON a.top >= layer OR layer = 0 JOIN t b ON (b.top >= layer OR layer = 0) AND a.vec_id <> b.vec_id) SELECT layer, 'horizontal' AS type, count(*) AS edges FROM n WHERE k <= CASE layer WHEN 0 THEN 8 ELSE 4 END GROUP BY 1 UNION ALL SELECT layer, 'vertical', count(*) FROM l JOIN t ON top >= layer WHERE layer > 0 GROUP BY 1")
def V13_proximity_layers(spark, d):
    _, v, _ = query_vector(spark, d)
    return vector.proximity_graph(v, m=4, layers=2).groupBy("layer", "type").agg(count().alias("edges"))


@query("WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, floor(-ln((('0x' || substr(md5('<http://ex.org/vec/' || vec_id || '>'), 1, 8))::BIGINT::DOUBLE + 1) / 4294967296.0::DOUBLE) / ln(16.0::DOUBLE))::INT AS top FROM embeddings), l AS (SELECT * FROM (VALUES (0), (1)) x(layer)), n AS (SELECT layer, a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY layer, a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC) AS k FROM l JOIN t a ON a.top >= layer OR layer = 0 JOIN t b ON (b.top >= layer OR layer = 0) AND a.vec_id <> b.vec_id), h AS (SELECT DISTINCT a, b FROM n WHERE k <= CASE layer WHEN 0 THEN 32 ELSE 16 END), v AS (SELECT vec_id AS a, vec_id AS b FROM t WHERE top >= 1) SELECT 'hnswHorizontalNeighbor' AS p, count(*) AS n FROM h UNION ALL SELECT 'hnswLayerDescend', count(*) FROM v UNION ALL SELECT 'hnswNeighbor', count(*) FROM (FROM h UNION FROM v)")
def V12_edge_triples(spark, d):
    _, v, _ = query_vector(spark, d)
    edges = vector.edge_triples(vector.proximity_graph(v, layers=1))
    return edges.groupBy(F.regexp_extract("p", "org/([A-Za-z]+)>", 1).alias("p")).agg(count().alias("n"))


# wide tables


@query("SELECT 'customer' AS kind, count(*) AS nodes, 7 AS properties FROM customer UNION ALL SELECT 'supplier', count(*), 6 FROM supplier")
def T1_T2_characteristic_sets(spark, d):
    sets = tables.characteristic_sets(G(spark, d, "customer", "supplier").triples())
    kind = F.when(F.array_contains("properties", ">" + ex("c_name")), "customer").when(F.array_contains("properties", ">" + ex("s_name")), "supplier")
    return sets.select(kind.alias("kind"), "nodes", F.size("properties").alias("properties")).where("kind IS NOT NULL")


@query("SELECT count(*) AS n, min(c_name) AS least, max(c_name) AS greatest, count(DISTINCT c_mktsegment) AS segments FROM customer")
def T3_T6_wide_table(spark, d):
    t = G(spark, d, "customer").triples()
    wide = tables.materialise(t, max(tables.discover(t), key=lambda x: x.nodes))
    name, segment = (F.col(f"`>{ex(c)}`") for c in ("c_name", "c_mktsegment"))
    return tables.scan(wide, present=[">" + ex("c_name")]).agg(count().alias("n"), T.lex(F.min(name)).alias("least"), T.lex(F.max(name)).alias("greatest"), F.countDistinct(segment).alias("segments"))


@query("SELECT c, min(v) AS least, max(v) AS greatest, count(*) FILTER (v IS NULL) AS nulls, count(*) AS rows FROM (SELECT unnest(['name', 'segment']) AS c, unnest([c_name, c_mktsegment]) AS v FROM customer) GROUP BY 1")
def T7_zone_maps(spark, d):
    wide = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    stats = tables.column_statistics(wide.withColumnRenamed("c_custkey", "node"))
    return stats.groupBy(F.col("column").alias("c")).agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows"))


@query("SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = (SELECT min(p_brand) FROM part)")
def T8_T12_fused_scan(spark, d):
    wide = spark.read.parquet(f"{d}/part.parquet")
    brand = wide.agg(F.min("p_brand")).first()[0]
    return tables.scan(wide, equal={"p_brand": brand}, between={"p_size": (10, 20)}, present=["p_name"]).select(F.col("p_partkey").alias("id"))


@query("SELECT count(*) AS roots, count(DISTINCT c_nationkey) AS middles, round(count(*) / count(DISTINCT c_nationkey), 4) AS fan_in FROM customer JOIN nation ON c_nationkey = n_nationkey")
def T17_T18_two_step_paths(spark, d):
    p = tables.two_step_paths(G(spark, d, "customer", "nation").triples())
    return p.where((F.col("first") == ex("nation")) & (F.col("second") == ex("n_name"))).select("roots", "middles", F.round("fan_in", 4).alias("fan_in"))


TWO = "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), x AS (SELECT conv_id, turn, EXISTS (SELECT 1 FROM t y WHERE y.conv_id = t.conv_id AND y.turn = t.turn + 2) AS two FROM t WHERE EXISTS (SELECT 1 FROM t y WHERE y.conv_id = t.conv_id AND y.turn = t.turn + 1)) "


@query(TWO + "SELECT CASE WHEN two THEN 3 ELSE 2 END AS paths, count(*) AS roots, true AS kept FROM x GROUP BY two HAVING count(*) >= 40 UNION ALL SELECT 7, count(*), count(*) <= 3 * count(DISTINCT o_custkey) FROM orders HAVING count(*) >= 40")
def T17_T18_path_groups(spark, d):
    """Turns by what follows them; and orders, whose customers are shared, so that their group isn't kept."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role").dropDuplicates(["conv_id", "turn"])
    fact = lambda p, o: t.select(T.iri_of(f"{EX}turn/", F.col("conv_id"), F.col("turn")).alias("s"), F.lit(ex(p)).alias("p"), o.alias("o"))
    facts = [turns(spark, d).select("s", F.lit(ex("next")).alias("p"), "o"), fact("role", T.literal_of(F.col("role"), "string")), fact("number", T.literal_of(F.col("turn"), "bigint"))]
    found = tables.discover_paths(reduce(DataFrame.unionByName, [*facts, G(spark, d, "orders", "customer").repeated_triples()]))
    return found.select(F.size("paths").alias("paths"), "roots", "kept")


@query("SELECT c_custkey AS id, n_name AS nation, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def T19_deep_table(spark, d):
    t = G(spark, d, "customer", "nation").triples()
    deep = tables.deep_table(t, [(ex("nation"), ex("n_name")), (ex("nation"), ex("n_regionkey"))])
    return deep.select(number("root").alias("id"), T.lex(F.col("c0")).alias("nation"), T.native(F.col("c1"), "bigint").alias("region"))


# functions


@query("SELECT p_partkey AS id FROM part WHERE contains(p_name, 'a') AND (starts_with(p_type, 'S') OR ends_with(p_type, 'L'))")
def F1_F3_strings(spark, d):
    s = G(spark, d, "part").star("x", id=ex("p_partkey"), name=ex("p_name"), type=ex("p_type"))
    t = F.col("type")
    return s.filter(T.contains(F.col("name"), "a") & (T.strstarts(t, "S") | T.strends(t, "L"))).select("id").native(id="bigint")


@query("SELECT page_id AS id FROM pages WHERE regexp_matches(url, '[0-9]{2}$')")
def F4_regex(spark, d):
    return G(spark, d, "pages").star("x", id=ex("page_id"), url=ex("url")).filter(T.regex(F.col("url"), "[0-9]{2}$")).select("id").native(id="bigint")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1")
def F5_F6_languages(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    named = t.select(T.iri_of(f"{EX}doc/", F.col("doc_id")).alias("s"), F.lit(ex("title")).alias("p"), F.concat(F.lit('"'), F.col("source"), F.lit('"@'), F.col("lang")).alias("o"))
    s = Graph(named).match("?d", ex("title"), "?t")
    return s.filter(T.lang_matches(F.col("t"), "DE") | (T.lang(F.col("t")) == "fr")).bind("lang", T.lang(F.col("t"))).group("lang", n=count()).df


@query("SELECT 'integer' AS type, 2 * count(*) AS n FROM customer UNION ALL SELECT 'double', count(*) FROM customer UNION ALL SELECT 'string', 2 * count(*) FROM customer")
def F7_F10_datatypes(spark, d):
    s = G(spark, d, "customer").match("?c", "?p", "?o").filter(T.is_literal(F.col("o")) & ~T.is_iri(F.col("o")))
    return s.bind("type", F.regexp_extract(T.datatype(F.col("o")), "#([a-z]+)>", 1)).group("type", n=count()).df


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal * 2 + 1 > 1000 THEN c_name ELSE c_mktsegment END AS label FROM customer")
def F11_F13_if_arithmetic(spark, d):
    s = G(spark, d, "customer").star("c", id=ex("c_custkey"), name=ex("c_name"), b=ex("c_acctbal"), segment=ex("c_mktsegment"))
    s = s.bind("label", T.if_(T.num(F.col("b")) * 2 + 1 > 1000, F.coalesce("name", "segment"), F.col("segment")))
    return s.select("id", "label").native(id="bigint", label="string")


# forms and updates


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000) AS result")
def X1_ask(spark, d):
    return G(spark, d, "customer").match("?c", ex("c_acctbal"), "?b").filter(lambda s: T.num(s["b"]) > 9000).ask()


@query(f"SELECT DISTINCT {I('customer', 'c_custkey')} AS s, '<{EX}livesIn>' AS p, {I('region', 'n_regionkey')} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def X2_construct(spark, d):
    g = G(spark, d, "customer", "nation")
    return g.match("?c", ex("nation"), "?n").join(g.match("?n", ex("region"), "?r")).construct(("?c", ex("livesIn"), "?r"))


@query("SELECT 5 + count(*) AS n FROM customer WHERE c_nationkey = 3")
def X3_describe(spark, d):
    return G(spark, d, "customer", "nation").describe(ex("nation/3")).agg(count().alias("n"))


@query("SELECT (SELECT count(*) FROM supplier) AS added, 5 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS n")
def X4_insert(spark, d):
    new = G(spark, d, "supplier").find(p=ex("s_name"))
    base = G(spark, d, "nation").triples()
    after, added = insert(base, new.unionByName(base))
    return after.agg(count().alias("n")).withColumn("added", F.lit(added.count()).cast("long"))


@query("SELECT count(*) AS removed, 6 * count(*) AS n FROM customer")
def X5_delete(spark, d):
    g = G(spark, d, "customer")
    after, gone = delete(g.triples(), g.find(p=ex("c_name")))
    return after.agg(count().alias("n")).withColumn("removed", F.lit(gone.count()).cast("long"))


@query("SELECT 8 * count(*) AS rows, 7 * count(*) AS distinct_rows, count(*) AS nulls FROM customer WHERE c_acctbal < 0")
def X7_verify(spark, d):
    """Of customers in debt, with one more triple each that lacks its object."""
    g = G(spark, d, "customer")
    debtors = g.match("?s", ex("c_acctbal"), "?b").filter(lambda s: T.num(s["b"]) < 0).df.select("s")
    broken = debtors.select("s", F.lit(ex("c_name")).alias("p"), F.lit(None).cast("string").alias("o"))
    return verify(g.triples().join(debtors, "s", "left_semi").select("s", "p", "o").unionByName(broken))


# ontology, health, time, streams


def ontology_of(spark: SparkSession, d: str) -> DataFrame:
    """Derived from the tables: a class a market segment, below Customer; every class is in its table's domain."""
    segments = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit(f"<{EX}Segment/"), "c_mktsegment", F.lit(">")).alias("s")).distinct()
    below = segments.select("s", F.lit(ontology.SUBCLASS).alias("p"), F.lit(ex("Customer")).alias("o"))
    rules = [(ex("c_name"), ontology.DOMAIN, ex("Customer")), (ex("nation"), ontology.DOMAIN, ex("Customer")), (ex("nation"), ontology.RANGE, ex("Nation")), (ex("c_mktsegment"), T.RDF_TYPE, ontology.FUNCTIONAL), (ex("customer"), T.RDF_TYPE, ontology.FUNCTIONAL), (ex("Customer"), ontology.DISJOINT, ex("Supplier"))]
    return below.unionByName(spark.createDataFrame(rules, "s string, p string, o string"))


@query("SELECT s_suppkey AS id, 'domain' AS rule FROM supplier")
def H2_domain(spark, d):
    g = G(spark, d, "customer", "supplier")
    typed = g.triples().where((F.col("p") != T.RDF_TYPE) | F.col("s").contains("supplier"))
    segment = g.relation(ex("c_mktsegment")).select("s", F.lit(T.RDF_TYPE).alias("p"), F.concat(F.lit(f"<{EX}Segment/"), T.lex(F.col("o")), F.lit(">")).alias("o"))
    return ontology.domain_violations(typed.unionByName(segment), ontology_of(spark, d)).select(number("s").alias("id"), "rule")


@query("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0")
def H2_range(spark, d):
    g = G(spark, d, "customer", "nation")
    odd = g.match("?n", ex("region"), ex("region/0")).select("n").df.select(F.col("n").alias("s"))
    wrong = odd.select("s", F.lit(T.RDF_TYPE).alias("p"), F.lit(ex("Island")).alias("o"))
    t = g.triples()
    t = t.join(odd.withColumn("p", F.lit(T.RDF_TYPE)), ["s", "p"], "left_anti").select("s", "p", "o").unionByName(wrong)
    return ontology.range_violations(t, ontology_of(spark, d)).select(number("s").alias("id"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0")
def H3_disjoint(spark, d):
    g = G(spark, d, "supplier")
    debtors = g.match("?s", ex("s_acctbal"), "?b").filter(lambda s: T.num(s["b"]) < 0).df.select("s", F.lit(T.RDF_TYPE).alias("p"), F.lit(ex("Customer")).alias("o"))
    return ontology.disjoint_violations(g.triples().unionByName(debtors), ontology_of(spark, d)).select(number("node").alias("id"))


@query("SELECT o_custkey AS id, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def H4_functional(spark, d):
    g = G(spark, d, "orders")
    uses = g.star("o", c=ex("customer"), x=ex("o_orderpriority")).df.select(F.col("c").alias("s"), F.lit(ex("c_mktsegment")).alias("p"), F.col("x").alias("o"))
    return ontology.functional_violations(uses, ontology_of(spark, d)).select(number("s").alias("id"), "n")


@query("SELECT 'domain' AS kind, 2 AS n UNION ALL SELECT 'range', 1 UNION ALL SELECT 'functional', 2 UNION ALL SELECT 'disjoint', 2 UNION ALL SELECT 'subproperty', 1 UNION ALL SELECT 'inverse', 2 UNION ALL SELECT 'subclass', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'same', 2 * count(*) FROM supplier JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey HAVING count(*) > 0 UNION ALL SELECT 'equivalent', 2 * count(DISTINCT p_brand) FROM part")
def H1_axioms(spark, d):
    """The ontology, with brands as equivalent classes and suppliers that are customers of the same key and nation."""
    brands = spark.read.parquet(f"{d}/part.parquet").select("p_brand").distinct()
    more = brands.select(F.concat(F.lit(f"<{EX}Brand/"), "p_brand", F.lit(">")).alias("s"), F.lit(ontology.EQUIVALENT).alias("p"), F.concat(F.lit(f"<{EX}Label/"), "p_brand", F.lit(">")).alias("o"))
    s, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "customer"))
    same = s.join(c, (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select(T.iri_of(f"{EX}supplier/", F.col("s_suppkey")).alias("s"), F.lit(ontology.SAME).alias("p"), T.iri_of(f"{EX}customer/", F.col("c_custkey")).alias("o"))
    rules = spark.createDataFrame([(ex("nation"), ontology.SUBPROPERTY, ex("place")), (ex("customer"), ontology.INVERSE, ex("orders"))], "s string, p string, o string")
    return ontology.load(ontology_of(spark, d).unionByName(more).unionByName(same).unionByName(rules)).groupBy("kind").agg(count().alias("n"))


@query("SELECT 'domain' AS rule, count(*) AS n FROM supplier UNION ALL SELECT 'range', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'disjoint', count(*) FROM supplier WHERE s_acctbal < 0")
def H5_validate(spark, d):
    """Triples before they're inserted: suppliers with a customer's name, customers in debt whose nation is a customer, suppliers in debt
    as customers; and good ones."""
    g = G(spark, d, "customer", "supplier", "nation")
    names = g.match("?s", ex("s_name"), "?o").df.select("s", F.lit(ex("c_name")).alias("p"), "o")
    debts = g.match("?s", ex("c_acctbal"), "?b").filter(lambda s: T.num(s["b"]) < 0).df.select("s", F.lit(ex("nation")).alias("p"), F.col("s").alias("o"))
    good = g.match("?s", ex("nation"), "?o").df.where(F.col("s").contains("customer")).select("s", F.lit(ex("nation")).alias("p"), "o")
    kinds = g.match("?s", ex("s_acctbal"), "?b").filter(lambda s: T.num(s["b"]) < 0).df.select("s", F.lit(T.RDF_TYPE).alias("p"), F.lit(ex("Customer")).alias("o"))
    new = reduce(DataFrame.unionByName, (names, debts, good, kinds))
    return ontology.validate(new, g.triples(), ontology_of(spark, d)).groupBy("rule").agg(count().alias("n"))


@query("WITH c AS (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS k FROM customer) SELECT 'class' AS kind, k + 1 AS n, k AS linked FROM c UNION ALL SELECT 'property', 2, 1 UNION ALL SELECT 'individual', n, n FROM c")
def H10_browse(spark, d):
    """Classes and those with a parent, properties and those with a domain, individuals and those with a class."""
    t = ontology_of(spark, d)
    declared = t.where(F.col("p") == ontology.SUBCLASS).select("s", F.lit(T.RDF_TYPE).alias("p"), F.lit(ontology.CLASSES[0]).alias("o"))
    rules = spark.createDataFrame([(ex("c_name"), T.RDF_TYPE, list(ontology.PROPERTIES)[1]), (ex("orders"), T.RDF_TYPE, list(ontology.PROPERTIES)[0])], "s string, p string, o string")
    people = G(spark, d, "customer").find(p=ex("c_mktsegment")).select("s", F.lit(T.RDF_TYPE).alias("p"), F.concat(F.lit(f"<{EX}Segment/"), T.lex(F.col("o")), F.lit(">")).alias("o"))
    g = t.unionByName(declared).unionByName(rules).unionByName(people)
    parts = [("class", ontology.classes(g), "parent"), ("property", ontology.properties(g), "domain"), ("individual", ontology.individuals(g), "class")]
    return reduce(DataFrame.unionByName, (x.agg(F.lit(k).alias("kind"), count().alias("n"), F.count(c).alias("linked")) for k, x, c in parts))


@query("WITH t AS (SELECT unnest(['<c' || c_custkey, 'i' || c_custkey, 's' || c_name, 'i' || c_nationkey, '<n' || c_nationkey, 'd' || c_acctbal, 's' || c_mktsegment, '<C', '<p1', '<p2', '<p3', '<p4', '<p5', '<p6', '<p7']) AS x FROM customer) SELECT 7 * (SELECT count(*) FROM customer) AS triples, (SELECT count(DISTINCT c_custkey) FROM customer) AS subjects, 7 AS predicates, count(DISTINCT x) AS terms, CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'warning' END AS status FROM t")
def H8_graph_health(spark, d):
    return ontology.graph_health(G(spark, d, "customer").triples())


@query("WITH q AS (SELECT (SELECT count(DISTINCT doc_id) FROM labels) / count(*) AS c, count(*) AS n FROM documents) SELECT n AS nodes, c >= 0.5 AS core, round(CASE WHEN c >= 0.5 THEN (6 + c) / 7 / 0.01 ELSE 1 / greatest(c, 0.01) END, 6) AS cliff, 'healthy' AS status FROM q")
def T5_H7_table_health(spark, d):
    """Documents, of which some have a quality: that property is the tail, or core where half have it."""
    t = G(spark, d, "documents", "labels").triples().where(F.col("p") != ex("toxic"))
    wide = max(tables.discover(t), key=lambda x: x.nodes)
    core = ">" + ex("quality") in wide.core
    return tables.table_health(spark, [wide]).select("nodes", F.lit(core).alias("core"), F.round("cliff", 6).alias("cliff"), "status")


@query("WITH x AS (SELECT count(*) AS n, count(*) FILTER (label < 4) / count(*) AS gone FROM embeddings) SELECT n AS nodes, n * least(32, n - 1) AS edges, least(32, n - 1)::DOUBLE AS mean_degree, round(gone, 6) AS tombstones, CASE WHEN gone > 0.5 THEN 'critical' WHEN gone > 0.3 THEN 'warning' ELSE 'healthy' END AS status FROM x")
def H6_H9_vector_health(spark, d):
    """Vectors of some labels are deleted, but still in the graph of neighbours."""
    p = ex("hasEmbedding")
    g, v, q = query_vector(spark, d)
    r = Registry(spark)
    r.declare(p, len(q))
    r.insert(p, v)
    edges = r.edges(p, layers=0)
    r.delete(p, g.match("?s", ex("label"), "?l").filter(lambda s: T.num(s["l"]) < 4).df)
    return ontology.vector_health(r.vectors[p], edges).select("nodes", "edges", "mean_degree", F.round("tombstones", 6).alias("tombstones"), "status")


@query("SELECT unnest(['refused', 'deleted', 'again', 'found', 'compacted', 'left']) AS step, unnest([2 * count(*), count(*) FILTER (label = 1), 0, count(*) FILTER (label <> 1), count(*) FILTER (label = 1), count(*) FILTER (label <> 1)]) AS n FROM embeddings")
def V11_V14_V16_registry(spark, d):
    """A declared predicate: rows of another dimension and nulls are refused, deleted vectors aren't found, compaction drops them."""
    p = ex("hasEmbedding")
    g, v, q = query_vector(spark, d)
    r = Registry(spark)
    r.declare(p, len(q), "euclidean")
    short = v.select("s", F.slice("vec", 1, len(q) - 1).alias("vec"))
    n = {"refused": r.insert(p, v.unionByName(short).unionByName(v.select("s", F.lit(None).cast("array<float>").alias("vec")))).count()}
    ones = g.match("?s", ex("label"), T.literal(1)).df
    n["deleted"], n["again"] = r.delete(p, ones), r.delete(p, ones)
    n["found"] = r.search(p, q, k=None).df.count()
    n["compacted"] = r.compact(p)
    n["left"] = r.vectors[p].count()
    return spark.createDataFrame(list(n.items()), "step string, n long")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event types as triples that hold until the user's next event."""
    t = spark.read.parquet(f"{d}/events.parquet")
    until = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.select(T.iri_of(f"{EX}user/", F.col("user_id")).alias("s"), F.lit(ex("did")).alias("p"), T.literal_of(F.col("event_type"), "string").alias("o"), F.col("ts").alias("since"), until.alias("until"))


HELD = "WITH h AS (SELECT user_id, event_type, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) "


@query(HELD + "SELECT user_id AS id, event_type AS did FROM h WHERE since <= TIMESTAMP '2024-01-15' AND (until IS NULL OR until > TIMESTAMP '2024-01-15')")
def E2_E4_at_time(spark, d):
    return temporal.at_time(sessions(spark, d), F.lit("2024-01-15").cast("timestamp")).select(number("s").alias("id"), T.lex(F.col("o")).alias("did"))


@query(HELD + "SELECT event_type AS did, count(*) AS n FROM h WHERE since < TIMESTAMP '2024-01-11' AND (until IS NULL OR until > TIMESTAMP '2024-01-10') GROUP BY 1")
def E3_during(spark, d):
    rows = temporal.during(sessions(spark, d), *(F.lit(x).cast("timestamp") for x in ("2024-01-10", "2024-01-11")))
    return rows.groupBy(T.lex(F.col("o")).alias("did")).agg(count().alias("n"))


@query(HELD + ", a AS (SELECT DISTINCT user_id, event_type FROM h WHERE since <= TIMESTAMP '2024-01-10' AND (until IS NULL OR until > TIMESTAMP '2024-01-10')), b AS (SELECT DISTINCT user_id, event_type FROM h WHERE since <= TIMESTAMP '2024-01-20' AND (until IS NULL OR until > TIMESTAMP '2024-01-20')) SELECT 'added' AS change, count(*) AS n FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'removed', count(*) FROM (FROM a EXCEPT FROM b)")
def E5_temporal_difference(spark, d):
    diff = temporal.difference(sessions(spark, d), *(F.lit(x).cast("timestamp") for x in ("2024-01-10", "2024-01-20")))
    return diff.groupBy("change").agg(count().alias("n"))


@query("SELECT user_id AS id, event_type AS did FROM (SELECT user_id, event_type, arg_max(value < 20, event_id) AS deleted FROM events GROUP BY 1, 2) WHERE NOT deleted")
def E7_log_replay(spark, d):
    """The raw log: each event states that its user did something, or takes it back where its value is small."""
    t = spark.read.parquet(f"{d}/events.parquet")
    log = t.select(T.iri_of(f"{EX}user/", F.col("user_id")).alias("s"), F.lit(ex("did")).alias("p"), T.literal_of(F.col("event_type"), "string").alias("o"), F.col("event_id").alias("seq"), (F.col("value") < 20).alias("deleted"))
    return temporal.state_of_log(log).select(number("s").alias("id"), T.lex(F.col("o")).alias("did"))


@query("SELECT event_id AS id, date_trunc(p, ts) AS since, date_trunc(p, ts) + CASE p WHEN 'year' THEN INTERVAL 1 YEAR WHEN 'month' THEN INTERVAL 1 MONTH WHEN 'day' THEN INTERVAL 1 DAY WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'minute' THEN INTERVAL 1 MINUTE ELSE INTERVAL 1 SECOND END AS until FROM (SELECT event_id, ts, ['year', 'month', 'day', 'hour', 'minute', 'second'][CAST(event_id % 6 + 1 AS INT)] AS p FROM events)")
def E8_precision(spark, d):
    """Times written with six precisions, as annotations of quoted triples; an interval is that of its precision."""
    t = spark.read.parquet(f"{d}/events.parquet")
    length = F.element_at(F.array(*map(F.lit, (4, 7, 10, 13, 16, 19))), (F.col("event_id") % 6 + 1).cast("int"))
    text = F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(1), length)
    fact = T.quote(T.iri_of(f"{EX}event/", F.col("event_id")), F.lit(ex("type")), T.literal_of(F.col("event_type"), "string"))
    notes = t.select(fact.alias("s"), F.explode(F.array(F.lit(ex("validFrom")), F.lit(ex("validTo")))).alias("p"), T.literal_of(text, "string").alias("o"))
    return temporal.with_intervals(notes, ex("validFrom"), ex("validTo")).select(number("s").alias("id"), "since", "until")


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def E7_stream_ingest(spark, d):
    """The table as a stream of new triples, run to the end of what is there."""
    fields = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(fields).parquet(f"{d}/events.parque[t]")
    rows = stream.select(T.iri_of(f"{EX}event/", F.col("event_id")).alias("s"), F.lit(ex("event_type")).alias("p"), T.literal_of(F.col("event_type"), "string").alias("o"))
    done = ingest.run_to_end(rows.dropDuplicates(["s", "p", "o"]), "stream")
    return done.groupBy(T.lex(F.col("o")).alias("type")).agg(count().alias("n"))
