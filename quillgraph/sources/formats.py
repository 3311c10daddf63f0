"""Reading and writing RDF: N-Triples and N-Quads by native expressions; Turtle, RDF/XML and JSON-LD documents, which
can't be split, by a small parser a document."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

SUBJECT = r"(<<.*?>>|<[^>]*>|_:[A-Za-z0-9_.-]+)"
OBJECT = r'(<<.*?>>|<[^>]*>|_:[A-Za-z0-9_.-]+|"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'  # possessive: no recursion on long texts
LINE = rf"^\s*{SUBJECT}\s+(<[^>]*>)\s+{OBJECT}(?:\s+(<[^>]*>|_:[A-Za-z0-9_.-]+))?\s*\.?\s*(?:#.*)?$"


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """s, p, o, g of N-Triples or N-Quads lines; blank, comment and malformed lines are left out. Escapes that needn't be are decoded, so
    that equal terms are equal texts."""
    return _parsed(lines.select(F.col(line).alias("value"))).where("s != ''").select("s", "p", "o", "g")


def _parsed(lines: DataFrame) -> DataFrame:
    """lines with s, p, o, g; s is empty where a line is no triple. Conditions on what generators make stay above them, so a line is matched
    and its terms are decoded once, whatever is asked of them."""
    first = F.regexp_replace("value", LINE, "$1\u0001$2\u0001$3\u0001$4")  # one pass; a line that doesn't match stays as it is
    match = F.when(F.col("value").contains("\u0001"), F.array(F.lit(""))).otherwise(F.split(first, "\u0001"))
    parts = lines.select("*", F.explode(F.array(match)).alias("__x"))
    part = lambda i: F.when(F.size("__x") == 4, F.col("__x")[i]).otherwise("")
    terms = [T.bound(part(i), T.canonical).alias(c) for i, c in enumerate("spo")]
    return parts.select(*lines.columns, F.inline(F.array(F.struct(*terms, F.nullif(part(3), F.lit("")).alias("g")))))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """The lines (value, and other columns) that are neither triples nor blank nor comments."""
    return _parsed(lines).where("s = ''").where(~F.col("value").rlike(r"^\s*(?:#.*)?$")).select(*lines.columns)


def to_nquads(quads: DataFrame) -> DataFrame:
    """value: a line a quad (s, p, o, g); those without a graph are triples."""
    return quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))


def service_description(triples: DataFrame) -> DataFrame:
    """value: the data set's description in Turtle, with its number of triples."""
    head = "@prefix void: <http://rdfs.org/ns/void#> .\n\n<> a void:Dataset ;\n    void:triples "
    return triples.agg(F.concat(F.lit(head), F.count(F.lit(1)).cast("string"), F.lit(" .\n")).alias("value"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path)).dropDuplicates(["s", "p", "o"])


def to_ntriples(triples: DataFrame) -> DataFrame:
    """value: a line a triple."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def to_turtle(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """value: a block a subject, its predicates joined by semicolons; known prefixes shorten IRIs. Prefix lines come from
    prefix_lines()."""

    def short(t: Column) -> Column:
        out = t
        for name, base in prefixes.items():
            out = F.when(t.rlike(f"^<{re.escape(base)}[A-Za-z][A-Za-z0-9_]*>$"), F.concat(F.lit(name + ":"), F.regexp_extract(t, f"^<{re.escape(base)}(.*)>$", 1))).otherwise(out)
        return F.when(t == T.RDF_TYPE, "a").otherwise(out)

    pairs = triples.select("s", F.concat_ws(" ", short(F.col("p")), short(F.col("o"))).alias("po"))
    blocks = pairs.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("po")), " ;\n    ").alias("po"))
    return blocks.select(F.concat(short(F.col("s")), F.lit(" "), F.col("po"), F.lit(" .")).alias("value"))


def prefix_lines(prefixes: dict[str, str]) -> list[str]:
    return [f"@prefix {k}: <{v}> ." for k, v in prefixes.items()]


TOKEN = re.compile(r'\s+|#[^\n]*|(?P<t>@prefix|@base|PREFIX|BASE|<[^>\s]*>|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|\^\^|@[A-Za-z][A-Za-z0-9-]*|_:[A-Za-z0-9_]+|\[|\]|;|,|[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|[A-Za-z0-9_-]*:[A-Za-z0-9_.%-]*[A-Za-z0-9_%-]|[A-Za-z0-9_-]*:|true|false|a|\.)')


def turtle(text: str, name: str) -> Iterator[tuple[str, str, str]]:
    """Triples of a Turtle document: prefixes, base, a, ; and , lists, [], literals. Blank labels get the document's name."""
    words = [m["t"] for m in TOKEN.finditer(text) if m["t"]]
    prefixes, base, fresh, i = {}, "", 0, 0

    def term() -> str:
        nonlocal i, fresh
        w = words[i]
        i += 1
        if w[0] == "<":
            return w if re.match(r"<[A-Za-z][A-Za-z0-9+.-]*:", w) else f"<{base}{w[1:]}"
        if w == "a":
            return T.RDF_TYPE
        if w == "[":
            i += 1
            fresh += 1
            return f"_:{name}b{fresh}"
        if w[:2] == "_:":
            return f"_:{name}{w[2:]}"
        if w[0] in "\"'":
            body = w[3:-3] if w[:3] == '"""' else w[1:-1]
            out = T.literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body))
            if i < len(words) and words[i] == "^^":
                i += 1
                return f"{out}^^{term()}"
            if i < len(words) and words[i][0] == "@":
                i += 1
                return out + words[i - 1]
            return out
        if w in ("true", "false"):
            return T.literal(w, T.XSD + "boolean")
        if re.fullmatch(r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", w):
            return T.literal(w, T.XSD + ("double" if "e" in w.lower() else "decimal" if "." in w else "integer"))
        prefix, _, local = w.partition(":")
        return f"<{prefixes[prefix]}{local}>"

    while i < len(words):
        if words[i].lstrip("@").lower() == "prefix":
            prefixes[words[i + 1][:-1]] = words[i + 2][1:-1]
            i += 3
        elif words[i].lstrip("@").lower() == "base":
            base = words[i + 1][1:-1]
            i += 2
        elif words[i] == ".":
            i += 1
        else:
            s = term()
            while i < len(words) and words[i] != ".":
                p = term()
                yield s, p, term()
                while i < len(words) and words[i] == ",":
                    i += 1
                    yield s, p, term()
                while i < len(words) and words[i] == ";":
                    i += 1


def rdfxml(text: str, name: str) -> Iterator[tuple[str, str, str]]:
    """rdf:Description and typed nodes with rdf:about; rdf:resource, xml:lang and rdf:datatype of properties."""
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    full = lambda tag: T.iri(tag[1:].replace("}", ""))
    for k, node in enumerate(ET.fromstring(text)):
        s = T.iri(node.get(rdf + "about")) if node.get(rdf + "about") is not None else f"_:{name}{node.get(rdf + 'nodeID') or f'n{k}'}"
        if node.tag != rdf + "Description":
            yield s, T.RDF_TYPE, full(node.tag)
        for x in node:
            target = x.get(rdf + "resource")
            yield s, full(x.tag), T.iri(target) if target is not None else T.literal(x.text or "", x.get(rdf + "datatype"), x.get("{http://www.w3.org/XML/1998/namespace}lang"))


def jsonld(text: str, name: str) -> Iterator[tuple[str, str, str]]:
    """Inline @context with @vocab and terms; @id, @type, @value with @language or @type; arrays, nested nodes, @graph."""
    fresh = 0

    def walk(node: dict, context: dict) -> Iterator[tuple[str, str, str]]:
        nonlocal fresh
        context = context | (node.get("@context") or {})

        def expand(word: str) -> str:
            known = context.get(word)
            known = known.get("@id") if isinstance(known, dict) else known
            prefix, colon, local = word.partition(":")
            return known or (context[prefix] + local if colon and prefix in context else word if colon else context.get("@vocab", "") + word)

        fresh += 1
        s = f"_:{name}j{fresh}" if "@id" not in node else node["@id"] if node["@id"][:2] == "_:" else T.iri(expand(node["@id"]))
        node["@self"] = s
        for inner in node.get("@graph", []):
            yield from walk(inner, context)
        for key, values in node.items():
            for v in values if isinstance(values, list) else [values]:
                if key == "@type":
                    yield s, T.RDF_TYPE, T.iri(expand(v))
                elif key[0] != "@":
                    p = T.iri(expand(key))
                    if isinstance(v, dict) and "@value" not in v:
                        below = list(walk(v, context))
                        yield s, p, v["@self"]
                        yield from below
                    else:
                        d = v if isinstance(v, dict) else {"@value": v}
                        value = d["@value"]
                        yield s, p, T.literal(value if isinstance(value, str) or not (d.get("@type") or d.get("@language")) else str(value), expand(d["@type"]) if d.get("@type") else None, d.get("@language"))

    data = json.loads(text)
    for node in data if isinstance(data, list) else [data]:
        yield from walk(node, {})


PARSERS: dict[str, Callable[[str, str], Iterator[tuple[str, str, str]]]] = {"turtle": turtle, "rdfxml": rdfxml, "jsonld": jsonld}


def parse_documents(documents: DataFrame, fmt: str, text: str = "value") -> DataFrame:
    """s, p, o of whole documents, a document a row; a set. Blank nodes are scoped by a hash of the document. Null documents are empty;
    of malformed ones nothing is taken (document_errors() has them)."""
    return _documents(documents, fmt, text).where("error IS NULL").select("s", "p", "o").dropDuplicates()


def document_errors(documents: DataFrame, fmt: str, text: str = "value") -> DataFrame:
    """document (a hash of its text), error: the documents that can't be parsed."""
    return _documents(documents, fmt, text).where("error IS NOT NULL").select(F.col("s").alias("document"), "error")


def _documents(documents: DataFrame, fmt: str, text: str) -> DataFrame:
    parser = PARSERS[fmt]

    def one(t: str | None, name: str) -> list[tuple]:
        try:
            return [(*x, None) for x in parser(t, f"d{name}")] if t and t.strip() else []
        except Exception as error:  # whatever a parser stumbles on, the document is malformed
            return [(name, None, None, f"{type(error).__name__}: {error}"[:200])]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for t, n in zip(b["t"], b["n"], strict=True) for x in one(t, n)], columns=["s", "p", "o", "error"])

    named = documents.select(F.col(text).alias("t"), F.substring(F.md5(text), 1, 12).alias("n"))
    return named.mapInPandas(rows, "s string, p string, o string, error string")


def json_results(rows: DataFrame) -> DataFrame:
    """value: a SPARQL-JSON binding a row; unbound variables are left out."""

    def binding(c: str) -> Column:
        t = F.col(c)
        kind = F.when(T.is_iri(t), "uri").when(T.is_blank(t), "bnode").otherwise("literal")
        return F.when(t.isNotNull(), F.struct(kind.alias("type"), T.lex(t).alias("value"), F.nullif(T.lang(t), F.lit("")).alias("xml:lang"), F.when(F.regexp_extract(t, T.LITERAL, 3) != "", F.regexp_extract(t, T.LITERAL, 3)).alias("datatype"))).alias(c)

    return rows.select(F.to_json(F.struct(*map(binding, rows.columns))).alias("value"))


def xml_results(rows: DataFrame) -> DataFrame:
    """value: a SPARQL-XML result a row."""

    def escape(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def binding(c: str) -> Column:
        t = F.col(c)
        tag = F.when(T.is_iri(t), "uri").when(T.is_blank(t), "bnode").otherwise("literal")
        return F.when(t.isNotNull(), F.concat(F.lit(f'<binding name="{c}"><'), tag, F.lit(">"), escape(T.lex(t)), F.lit("</"), tag, F.lit("></binding>"))).otherwise("")

    return rows.select(F.concat(F.lit("<result>"), *map(binding, rows.columns), F.lit("</result>")).alias("value"))


def delimited_results(rows: DataFrame) -> DataFrame:
    """Plain values for write.csv(sep=...), which quotes where needed."""
    return rows.select(*(T.lex(F.col(c)).alias(c) for c in rows.columns))
