"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors in a text: at-signs, plus-digit, digit pairs, digit-dot-digit,
URL schemes and identifier cues. From each anchor a deterministic local parser finds the boundaries of the
e-mail address, IP address, card, phone number, URL or account number around it, and validates it (Luhn,
mod-97, ranges, digit counts). Anchors inside a span that a parser has consumed are skipped, so the work is
linear in the text.

Defined cases: null text counts as empty and has no spans; whole texts are read, whatever their length; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")  # schemes and cues in lower case: they are looked for in a lowered copy
CUES = ("iban", "ssn", "account", "acct", "passport")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
DIGITS = "0123456789"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\x20\x09-\x0D\"'<>()]+")
ACCOUNT = re.compile(r"[\x20#:.-]{0,4}(?:(?ai:number|no|nr)[\x20#:.-]{0,3})?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9][0-9-]{6,30}[0-9])")


def luhn(digits: str) -> bool:
    double = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def email(text: str, at: int, done: int) -> tuple[int, int, bool] | None:
    domain = DOMAIN.match(text, at + 1)
    start = at
    while domain and start > done and text[start - 1] in LOCAL:
        start -= 1
    return (start, domain.end(), True) if domain and start < at else None


def ip(text: str, at: int, done: int) -> Iterator[tuple[int, int, bool]]:
    while at > done and text[at - 1] in DIGITS:
        at -= 1
    parts, start, end = [], at, at
    for p in DOTTED.match(text, at)[0].split("."):
        end += len(p) + bool(parts)
        parts.append(p)
        if len(parts) == 4:
            yield start, end, all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in parts)
            start, parts = end + 1, []
            end = start
    if parts:
        yield start, end, False


def card(text: str, at: int) -> tuple[int, int, bool]:
    m = CHAIN.match(text, at)
    digits = m[0].replace(" ", "").replace("-", "")
    return at, m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int) -> tuple[int, int, bool] | None:
    m = PHONE.match(text, at)
    return m and (at, m.end(), 8 <= sum(c in DIGITS for c in m[0]) <= 15)


def url(text: str, start: int, at: int) -> tuple[int, int, bool] | None:
    m = URL.match(text, at)
    if not m:
        return None
    end = at + len(m[0].rstrip(".,;:!?"))
    return start, end, bool(DOMAIN.search(text, at, end))


def account(text: str, at: int) -> tuple[int, int, bool] | None:
    m = ACCOUNT.match(text, at)
    if not m:
        return None
    found = m[1].replace(" ", "")
    return m.start(1), m.end(1), not found[0].isalpha() or mod97(found)


@cache
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    words = {"@": "email"} | {f"+{d}": "phone" for d in DIGITS} | {f"{d}.{e}": "ip" for d in DIGITS for e in DIGITS}
    words |= {f"{d}{s}{e}": "card" for d in DIGITS for e in DIGITS for s in ("", " ", "-")}
    words |= dict.fromkeys(SCHEMES, "url") | dict.fromkeys(CUES, "account")
    for w, kind in words.items():
        a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """A copy in lower case whose characters stand where the text's do."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(ASCII_LOWER)


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Valid spans of each kind, by start; code points, end exclusive."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, width) in anchors().iter(lowered(text)):
        start = last - width + 1
        if start < done[kind]:
            continue
        if kind == "email":
            found = [email(text, start, done[kind])]
        elif kind == "ip":
            found = ip(text, start, done[kind])
        elif kind == "card":
            found = [card(text, start)]
        elif kind == "phone":
            found = [phone(text, start)]
        elif kind == "url":
            found = [url(text, start, last + 1)]
        else:
            found = [account(text, last + 1)]
        for x in found:
            if x:
                done[kind] = x[1]
                if x[2]:
                    spans[kind].append(x[:2])
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, by kind, then start), n_any (spans of all kinds)."""
    kind = dict(df.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {f"n_{k}": [] for k in BASE_KINDS} | {"base_sha256": [], "spans": [], "n_any": []}
            for t in b.column(1):
                spans = find_spans(t.as_py() or "")
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(len(spans[k]))
                out["base_sha256"].append(hashlib.sha256(joined(spans, BASE_KINDS).encode()).hexdigest())
                out["spans"].append(joined(spans, KINDS))
                out["n_any"].append(sum(map(len, spans.values())))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items())], [id_col, *out])

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return df.select(id_col, F.col(text_col)).mapInArrow(lean(scan), f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string, n_any long")
