"""RDF terms as strings in N-Triples spelling, and native column expressions over them.

<iri>, _:blank, "text", "text"@lang, "text"^^<datatype>, << s p o >>. Null is an unbound variable. Numbers, times and vectors
are read from a term's lexical form with try_cast, so a malformed value is null, never an error.

A Typed term has beside its spelling the column that it was made from, and the functions below use that where they can, so that
conditions are conditions on stored columns, which Spark pushes into scans, and no text is built or parsed for them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
VECTOR = "f32vec"
LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'
NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "long", "int")]
#: Spark types whose values compare as numbers, and the datatypes of constants that have a value.
NUMBERS = ("bigint", "int", "double", "float")
CONSTANT = {XSD + "integer": "bigint", XSD + "double": "double"}


@dataclass
class Typed:
    """A literal term with its value: a column of Spark type `kind`. Both are null together."""

    term: Column
    value: Column
    kind: str


def term_of(t: Column | Typed | str) -> Column:
    return t.term if isinstance(t, Typed) else F.lit(t) if isinstance(t, str) else t


def typed(t: Column | Typed | str | float | bool) -> Column | Typed:
    """Python numbers and constant literals get their values."""
    if isinstance(t, str):
        found = parsed(t)
        if found is None or found[1] is not None and found[1] not in CONSTANT or found[2]:
            return F.lit(t)
        kind = CONSTANT.get(found[1], "string")
        try:
            return Typed(F.lit(t), F.lit(found[0] if kind == "string" else int(found[0]) if kind == "bigint" else float(found[0])), kind)
        except ValueError:
            return F.lit(t)
    if isinstance(t, int | float) and not isinstance(t, bool):
        return Typed(F.lit(literal(t)), F.lit(t), "bigint" if isinstance(t, int) else "double")
    return F.lit(literal(t)) if isinstance(t, bool) else t


def iri(name: str) -> str:
    return f"<{name}>"


def literal(value: object, datatype: str | None = None, lang: str | None = None) -> str:
    """A Python value as a term: bool, int and float get their XML Schema datatypes."""
    if datatype is None and lang is None and not isinstance(value, str):
        datatype = XSD + {bool: "boolean", int: "integer", float: "double"}[type(value)]
        value = str(value).lower() if isinstance(value, bool) else repr(value)
    text = str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'"{text}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")


ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
#: Escapes of characters by number: of the basic plane, pairs of surrogates, and by eight digits. Others stay as they are.
BASIC = r"\\u(?:[0-9A-CE-Fa-ce-f][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})"
PAIR = r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}"
LONG = r"\\U(?:0000(?:[0-9A-CE-Fa-ce-f][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})|000[1-9A-Fa-f][0-9A-Fa-f]{4}|0010[0-9A-Fa-f]{4})"
PIECE = rf"(?s){PAIR}|{BASIC}|{LONG}|\\.|[^\\]+|\\"


def parsed(t: str) -> tuple[str, str | None, str] | None:
    """Text, datatype and language of a constant literal; of other terms, None."""
    m = re.fullmatch(LITERAL[4:].strip("^$"), t, re.DOTALL)
    if not m:
        return None
    return "".join(map(_one, re.findall(PIECE, m[1]))), m[3], m[2] or ""


def _one(piece: str) -> str:
    if piece[:2] in ("\\u", "\\U") and len(piece) > 2:
        return bytes.fromhex(piece[2:].replace("\\u", "")).decode("utf-16-be" if piece[1] == "u" else "utf-32-be")
    return ESCAPED.get(piece[1:], piece) if piece[0] == "\\" else piece


MARK = "\u0001"  # stands for a decoded backslash, in texts without it
FEW = 32


def unescape(text: Column) -> Column:
    """Escapes decoded from left to right; what is no escape stays as it is."""
    return bound(text, lambda x: F.when(~F.contains(x, F.lit("\\")), x).when(reduce(lambda a, b: a | b, (F.contains(x, F.lit(m)) for m in (MARK, "\\u0001", "\\U00000001"))), _by_pieces(x)).otherwise(_by_kinds(x)))


def bound(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def put(text: Column, old: str, new: str) -> Column:
    """replace(), which is slow, where there is something to replace."""
    return bound(text, lambda x: F.when(F.contains(x, F.lit(old)), F.replace(x, F.lit(old), F.lit(new))).otherwise(x))


def _by_kinds(text: Column) -> Column:
    """Each kind of escape replaced in the whole text: pairs of backslashes first, so that any that is left begins an escape. Texts with
    more than FEW different escapes by number, or with hexadecimal digits so escaped, go by pieces."""

    def number(x: Column) -> Column:
        return bound(_number(x), lambda c: F.when(c == "\\", F.lit(MARK)).otherwise(c))

    out = put(text, "\\\\", MARK)
    for c, plain in ESCAPED.items():
        out = out if c == "\\" else put(out, "\\" + c, plain)
    back = lambda x: put(x, MARK, "\\")
    found = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s){PAIR}|{BASIC}|{LONG}"), F.lit(0)))
    # a decoded digit might make an escape of what looked like one before it and was none
    plain = lambda known: (F.size(known) <= FEW) & ~F.exists(known, lambda e: _number(e).rlike("[0-9A-Fa-f]"))
    each = lambda x: bound(found(x), lambda known: F.when(plain(known), back(F.aggregate(known, x, lambda y, e: F.replace(y, e, number(e))))).otherwise(_by_pieces(text)))
    return bound(out, lambda x: F.when(F.contains(x, F.lit("\\u")) | F.contains(x, F.lit("\\U")), each(x)).otherwise(back(x)))


def _number(x: Column) -> Column:
    """The character of an escape by number."""
    basic = F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")
    return F.when(x.startswith("\\u"), basic).otherwise(F.decode(F.unhex(F.substring(x, F.lit(3), F.lit(8))), "UTF-32"))


def _by_pieces(text: Column) -> Column:
    def one(x: Column) -> Column:
        out = F.when(~x.startswith("\\"), x)
        for c, plain in ESCAPED.items():
            out = out.when(x == "\\" + c, F.lit(plain))
        return out.when((x.startswith("\\u") | x.startswith("\\U")) & (F.length(x) > 2), _number(x)).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), one), "")


#: What must be escaped in literals, in this order.
SPELLED = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"))


def escape(text: Column) -> Column:
    for a, b in SPELLED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def inside(t: Column) -> Column:
    """What is between a literal's quotes."""
    return F.when(t.endswith('"'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.regexp_extract(t, LITERAL, 1))


def canonical(t: Column) -> Column:
    """A term as this library spells it: only the characters that must be are escaped, so equal terms are equal texts."""
    plain = t.endswith('"')
    mark, kind = (F.when(plain, "").otherwise(F.regexp_extract(t, LITERAL, i)) for i in (2, 3))
    tail = F.when(mark != "", F.concat(F.lit("@"), mark)).when(kind != "", F.concat(F.lit("^^<"), kind, F.lit(">"))).otherwise("")
    text = unescape(inside(t))
    for a, b in SPELLED:
        text = put(text, a, b)
    literal = F.concat(F.lit('"'), text, F.lit('"'), tail)
    return F.when(~F.contains(t, F.lit("\\")), t).when(is_literal(t), literal).when(is_iri(t), unescape(t)).otherwise(t)


def quoted(s: str, p: str, o: str) -> str:
    return f"<< {s} {p} {o} >>"


def iri_of(prefix: str, *parts: Column) -> Column:
    """<prefix + parts joined by _>, null if a part is null."""
    key = F.concat_ws("_", *(p.cast("string") for p in parts))
    there = parts[0].isNotNull()
    for p in parts[1:]:
        there = there & p.isNotNull()
    return F.when(there, F.concat(F.lit(f"<{prefix}"), key, F.lit(">")))


def literal_of(value: Column, kind: str) -> Column:
    """A column of Spark type `kind` as literal terms."""
    name = {"bigint": "integer", "int": "integer", "double": "double", "float": "double", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime"}.get(kind)
    if name is None:
        return F.concat(F.lit('"'), escape(value), F.lit('"'))
    text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if name == "dateTime" else value.cast("string")
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{name}>'))


def quote(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))


QUOTED = r'^<< (\S+) (\S+) (.+) >>$'


def unquote(t: Column) -> list[Column]:
    """Subject, predicate and object of a quoted triple."""
    return [F.when(is_quoted(t), F.regexp_extract(t, QUOTED, i)) for i in (1, 2, 3)]


def is_quoted(t: Column) -> Column:
    return t.startswith("<< ")


def is_iri(t: Column) -> Column:
    return t.startswith("<") & ~is_quoted(t)


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lex(t: Column | Typed) -> Column:
    """STR(): the text of a literal, the name of an IRI."""
    if isinstance(t, Typed) and t.kind == "string":
        return t.value
    t = term_of(t)
    return F.when(is_literal(t), unescape(inside(t))).when(is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, LITERAL, 2))


def datatype(t: Column) -> Column:
    """The datatype's IRI as a term; plain literals are strings."""
    name = F.regexp_extract(t, LITERAL, 3)
    return F.when(is_literal(t), F.concat(F.lit("<"), F.when(name != "", name).when(lang(t) != "", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(XSD + "string"), F.lit(">")))


def num(t: Column | Typed) -> Column:
    if isinstance(t, Typed):
        return t.value if t.kind in NUMBERS else F.lit(None).cast("double")
    return F.when(F.regexp_extract(t, LITERAL, 3).isin(NUMERIC), F.regexp_extract(t, LITERAL, 1).try_cast("double"))


def boolean(t: Column | Typed) -> Column:
    if isinstance(t, Typed):
        return t.value if t.kind == "boolean" else F.lit(None).cast("boolean")
    return F.when(F.regexp_extract(t, LITERAL, 3) == XSD + "boolean", F.regexp_extract(t, LITERAL, 1).try_cast("boolean"))


def time(t: Column | Typed) -> Column:
    if isinstance(t, Typed):
        return t.value if t.kind.startswith("timestamp") else F.lit(None).cast("timestamp")
    return F.when(F.regexp_extract(t, LITERAL, 3).isin(XSD + "dateTime", XSD + "date"), F.regexp_extract(t, LITERAL, 1).try_cast("timestamp"))


def vector(t: Column) -> Column:
    return F.when(F.regexp_extract(t, LITERAL, 3).endswith(VECTOR), F.transform(F.split(F.trim(F.regexp_extract(t, LITERAL, 1)), r"\s+"), lambda x: x.try_cast("float")))


def native(t: Column | Typed, kind: str) -> Column:
    """A term's value as a Spark type."""
    if isinstance(t, Typed) and (t.kind == kind or t.kind in NUMBERS and kind in NUMBERS):
        return t.value.try_cast(kind)
    return lex(t) if kind == "string" else lex(t).try_cast(kind)


def kind_rank(t: Column) -> Column:
    return F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).when(is_literal(t), 3).otherwise(4)


def order(t: Column | Typed, descending: bool = False) -> list[Column]:
    """Sort keys: unbound, blank, IRI, literal; numbers by value before other literals by text."""
    if isinstance(t, Typed) and t.kind in (*NUMBERS, "string"):  # literals of one kind
        keys = [t.value]
    else:
        t = term_of(t)
        keys = [kind_rank(t), num(t), lex(t), t]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def _kinds(a, b) -> tuple:
    """Both sides, and what their values compare as: numbers, texts, unlike (values of unlike kinds), or terms."""
    a, b = typed(a), typed(b)
    if isinstance(a, Typed) and isinstance(b, Typed):
        x, y = (k.kind if k.kind in ("string", "boolean") else "number" if k.kind in NUMBERS else "time" if k.kind.startswith("timestamp") else "other" for k in (a, b))
        return a, b, "terms" if "other" in (x, y) else x if x == y else "unlike"
    return a, b, "terms"


def equal(a: Column | Typed | str | float, b: Column | Typed | str | float) -> Column:
    """Numbers by value, everything else by term; null if a side is unbound. Sides may be Python constants."""
    a, b, kind = _kinds(a, b)
    if kind in ("number", "string", "boolean"):
        return a.value == b.value
    x, y = num(a), num(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(term_of(a) == term_of(b))


def less(a: Column | Typed | str | float, b: Column | Typed | str | float) -> Column:
    """Typed <: numbers, then times, then texts of literals; else null."""
    a, b, kind = _kinds(a, b)
    if kind in ("number", "string", "time"):
        return a.value < b.value
    p, q = term_of(a), term_of(b)
    return F.when(num(a).isNotNull() & num(b).isNotNull(), num(a) < num(b)).when(time(a).isNotNull() & time(b).isNotNull(), time(a) < time(b)).when(is_literal(p) & is_literal(q) & num(a).isNull() & num(b).isNull(), lex(a) < lex(b))


def contains(a: Column | Typed, text: str) -> Column:
    return F.contains(lex(a), F.lit(text))


def strstarts(a: Column | Typed, text: str) -> Column:
    return lex(a).startswith(text)


def strends(a: Column | Typed, text: str) -> Column:
    return lex(a).endswith(text)


def regex(a: Column | Typed, pattern: str, flags: str = "") -> Column:
    return lex(a).rlike(f"(?{flags}){pattern}" if flags else pattern)


def lang_matches(t: Column, wanted: str) -> Column:
    """* is any language; de also matches de-AT."""
    mine = F.lower(lang(t))
    return mine != "" if wanted == "*" else (mine == wanted.lower()) | mine.startswith(wanted.lower() + "-")


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)
