"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

The field labels tokens B (secret begins), I (inside), O. Its features are a token's shape, length, alphabet and
entropy, the words next to it, and features of the whole file. Every token of a text is decoded by Viterbi. Tokens for which the weights
prove that no best labelling has them in a secret (see Field.open) are O without it, which cuts the chain there and changes no result. Weights
are trained here by gradient ascent on the conditional likelihood (forward-backward), from a bounded sample of
documents (`sample_docs`), labelled by the fixed patterns: the stretches of EDGE tokens around what looks like a key or is
labelled, one in PLAIN of other stretches, and variations of assignments, so that other names and values are told too.

Defined cases: null text counts as empty; whole texts are read; where the sample holds no run at all, or the table is
empty, the field adds nothing; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import sys
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("assign", "access", "hex", "crf")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

LOOKS = re.compile(r"[0-9]{2}|[+/_]|[A-Za-z]{24}")  # a feature, and where stretches are trained on
TOKEN = re.compile(r"[^\s=:\"'`,;(){}<>\[\]|]+|[=:]")
KEY_LIKE = TOKEN  # what runs hold: every token
CUE = re.compile(r"(?ai:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|key|credentials?|auth|bearer|private)")
STATES = 3  # O, B, I
EDGE = 2
PLAIN = 16
CACHED = 100_000  # tokens whose weights are kept
STRETCH = 64  # tokens of a training stretch; longer ones are several


def assigned(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of ASSIGN; those with too short a value are dropped. A match begins at
    one of WORDS, and these are found by plain substring search."""
    low = text.lower()
    if len(low) != len(text):  # some letter changed its length, so places differ
        return [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    starts = set()
    for w in WORDS:
        at = low.find(w)
        while at >= 0:
            starts.add(at)
            at = low.find(w, at + 1)
    spans, done = [], 0
    for s in sorted(starts):
        if s >= done and (m := ASSIGN.match(text, s)):
            done = m.end()
            if len(m[1]) >= 12:
                spans.append(m.span())
    return spans


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {"assign": assigned(text), "access": [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [], "hex": [m.span() for m in HEX.finditer(text)]}


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    found = sorted((s, rank[k], e, k) for k in kinds for s, e in spans.get(k, ()))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


LENGTHS = (4, 8, 12, 16, 20, 24, 32, 40, 64, 1 << 60)


def token_features(token: str) -> list[str]:
    n = len(token)
    kinds = "".join(k for k, p in (("a", r"[a-z]"), ("A", r"[A-Z]"), ("0", r"[0-9]"), ("-", r"[^a-zA-Z0-9]")) if re.search(p, token))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(token[:256]).values()) if n <= 256 else 9
    digits = sum(c.isdigit() for c in token) / n
    alphabet = "hex" if re.fullmatch(r"[0-9a-f]+", token) else "HEX" if re.fullmatch(r"[0-9A-F]+", token) else "other"
    return [*shape_features(kinds, next(k for k in LENGTHS if n <= k), int(entropy + 1e-9), int(digits * 4), alphabet), f"lead={lead(token)}"]


def shape_features(kinds: str, length: int, entropy: int, digits: int, alphabet: str) -> list[str]:
    return ["bias", f"kinds={kinds}", f"length={length}", f"kinds,length={kinds},{length}", f"entropy={entropy}", f"digits={digits}", f"alphabet={alphabet}"]


def lead(token: str) -> str:
    return token[:4] if token[:4].isupper() else ""


def word(token: str | None) -> str:
    return "none" if token is None else token if token in "=:" else "cue" if CUE.search(token) else "key-like" if LOOKS.search(token) else "plain"


NEAR = ("none", "=", ":", "cue", "key-like", "plain")


def near_features(two: str, one: str, after: str) -> list[str]:
    return [f"-1={one}", f"-2={two}", f"-2,-1={two},{one}", f"+1={after}"]


def file_features(text: str) -> list[str]:
    places = sum(1 for _ in LOOKS.finditer(text))
    return [f"file size={len(text).bit_length() // 2}", f"file key-like={min(8, (places * 1000 // max(1, len(text))).bit_length())}", f"file braces={'{' in text and '}' in text}"]


def runs(text: str, file: list[str] | None = None) -> Iterator[list[tuple[int, int, list[str]]]]:
    """All tokens, as one run: start, end (without a final stop) and features of each. file: features of the whole file, if text is a part."""
    tokens = tokens_of(text)
    if tokens:
        yield [(s, e, f) for (s, e, _), f in zip(tokens, features_of(tokens, 0, len(tokens), file or file_features(text)), strict=True)]


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """Start, end (without a final stop) and text of each token."""
    return [(m.start(), m.start() + len(m[0].rstrip(".")) or m.end(), m[0]) for m in TOKEN.finditer(text)]


def features_of(tokens: list[tuple[int, int, str]], lo: int, hi: int, file: list[str]) -> list[list[str]]:
    """The features of tokens lo to hi."""
    words = [word(tokens[i][2] if 0 <= i < len(tokens) else None) for i in range(lo - 2, hi + 1)]
    return [[*token_features(tokens[i][2]), *near_features(words[i - lo], words[i - lo + 1], words[i - lo + 3]), *file] for i in range(lo, hi)]


def stretches(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Parts of a text's run to be trained on, of STRETCH tokens at most, with labels; what is next to them is O or cut off, so that they are
    chains of their own."""
    run = tokens_of(text)
    if not run:
        return
    file = file_features(text)
    y = np.array(labels(run, spans))
    hot = np.array([bool(LOOKS.search(text[s:e])) for s, e, _ in run]) | (y > 0)
    near = np.convolve(hot, np.ones(2 * EDGE + 1, int))[EDGE:-EDGE] > 0
    rest = np.arange(len(run)) // (2 * EDGE)
    picked = {k for k in set(rest[~near].tolist()) if zlib.crc32(text[run[k * 2 * EDGE][0] : run[k * 2 * EDGE][1]].encode() + b"%d" % k) % PLAIN == 0}
    near |= np.array([k in picked for k in rest.tolist()])
    turn = np.flatnonzero(np.diff(near, prepend=False, append=False))
    for begin, end in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        for lo in range(begin, end, STRETCH):
            hi = min(end, lo + STRETCH)
            part = y[lo:hi].tolist()
            yield features_of(run, lo, hi, file), [1, *part[1:]] if part[0] == 2 else part


#: What a made-up secret may consist of.
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/_-", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789ABCDEF")


def variations(text: str) -> Iterator[tuple[list[list[str]], list[int]]]:
    """More to be trained on, from each assignment that the patterns find: another value of some other alphabet and length behind the same name, with
    and without its sign, is a secret too; an ordinary word there is none. So the field learns the context and not just the
    values that the patterns know. The same text always gives the same."""
    file = file_features(text)
    for s, e in assigned(text):
        m = ASSIGN.match(text, s)
        rng = random.Random(zlib.crc32(m[0].encode()))
        head, before, after = text[s : m.start(1)], re.search(r"(?:\S+\s+){0,2}$", text[max(0, s - 60) : s])[0], text[e : e + 40]
        value = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(12, 44)))
        word = "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 11)))
        for name, what, secret in ((head, value, True), (rng.choice(NAMES) + rng.choice((" ", ": ", "=")), value, True), (rng.choice(HEADERS), value, True), (head, word, False), (rng.choice(NAMES) + " ", word, False)):
            lead = before + name
            for run in runs(lead + what + after, file):
                yield [f for _, _, f in run[:STRETCH]], labels(run, [(len(lead), len(lead) + len(what))] if secret else [])[:STRETCH]


#: Names before secrets that the patterns don't know, and headers.
NAMES = ("pwd", "Bearer", "key", "private_key", "credentials", "auth", "passphrase", "access_key")
HEADERS = ("Authorization: Bearer ", "authorization: token ", "auth: Basic ")


class Field:
    """Weights: `emit` feature -> a weight for each state, `move` state x state."""

    def __init__(self, emit: dict[str, np.ndarray], move: np.ndarray):
        self.emit, self.move, self.known = emit, move, None

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi from O to O."""
        zero = np.zeros(STATES)
        return self.best([sum((self.emit.get(f, zero) for f in fs), zero) for fs in features])

    def best(self, scores: list[np.ndarray]) -> list[int]:
        score, back = self.move[0].copy(), []
        score[2] = -1e9  # I must follow B or I
        for i, e in enumerate(scores):
            if i:
                via = score[:, None] + self.move
                via[0, 2] = -1e9
                back.append(via.argmax(0))
                score = via.max(0)
            score = score + e
        state = int((score + self.move[:, 0]).argmax())
        path = [state]
        for b in reversed(back):
            path.append(state := int(b[state]))
        return path[::-1]

    def weigh(self, features: list[str]) -> np.ndarray:
        return sum((self.emit[f] for f in features if f in self.emit), np.zeros(STATES))

    def scores(self, text: str, tokens: list[str]) -> np.ndarray:
        """The weights of each token's labels."""
        if self.known is None:
            self.near = np.array([[[self.weigh(near_features(a, b, c)) for c in NEAR] for b in NEAR] for a in NEAR])
        if self.known is None or len(self.known.places) > CACHED:
            self.known = Known(self, self.known.shapes if self.known else {})
        at = self.known.rows(tokens)
        kinds = np.zeros(len(tokens) + 3, np.int64)
        kinds[2:-1] = self.known.kinds[at]
        return self.known.weights[at] + self.near[kinds[:-3], kinds[1:-2], kinds[3:]] + self.weigh(file_features(text))

    def open(self, scores: np.ndarray) -> np.ndarray:
        """Which tokens may be B or I in a best labelling. With all of a stretch B I ... made O, a labelling gains at least what is bounded
        here; where no stretch that holds a token can be worth more than O throughout, the token is O."""
        m = self.move
        inside = max(m[1, 1], m[1, 2], m[2, 1], m[2, 2]) - m[0, 0]
        gain = np.maximum(scores[:, 1], scores[:, 2]) - scores[:, 0] + inside
        total = np.concatenate([[0.0], np.cumsum(gain)])
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        return most >= inside - (m[0, 1] + max(m[1, 0], m[2, 0]) - 2 * m[0, 0]) - 1e-6

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        scores = self.scores(text, tokens)
        live = self.open(scores)
        if not live.any():
            return []
        found: list[tuple[int, int]] = []
        places = [m.start() for m in TOKEN.finditer(text)]
        turn = np.flatnonzero(np.diff(live, prepend=False, append=False)).tolist()
        for lo, hi in zip(turn[::2], turn[1::2], strict=True):
            for i, state in enumerate(self.best(list(scores[lo:hi])), lo):
                end = places[i] + len(tokens[i].rstrip(".")) or places[i] + len(tokens[i])
                if state == 1:
                    found.append((places[i], end))
                elif state == 2:
                    found[-1] = (found[-1][0], end)
        return found


#: Bits of a character: a-z, A-Z, 0-9, others; not of lower-case hex, not of upper-case hex. By code, the last one for all beyond ASCII.
SIGNS = np.array([(1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8) | 16 * (c not in "0123456789abcdef") | 32 * (c not in "0123456789ABCDEF") for c in map(chr, range(129))])


class Known:
    """Rows of weights and kinds of tokens, made when first asked for, for all new tokens of a text at once. A token's weights are those of its
    shape, of which there are few, and of its lead."""

    def __init__(self, field: Field, shapes: dict[int, np.ndarray]):
        self.field, self.shapes = field, shapes
        self.places: dict[str, int] = {}
        self.weights, self.kinds = np.zeros((1024, STATES)), np.zeros(1024, np.int64)

    def rows(self, tokens: list[str]) -> np.ndarray:
        new = list(set(tokens).difference(self.places))
        if new:
            first, end = len(self.places), len(self.places) + len(new)
            while end > len(self.kinds):
                self.weights, self.kinds = np.concatenate([self.weights, np.zeros_like(self.weights)]), np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            self.weights[first:end], self.kinds[first:end] = self.weigh(new), word_kinds(new)
            self.places.update(zip(new, range(first, end), strict=True))
        return np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))

    def weigh(self, tokens: list[str]) -> np.ndarray:
        """The weights of token_features of each."""
        codes, bits = shapes(tokens)
        some, which = np.unique(codes, return_inverse=True)
        for code in some.tolist():
            if code not in self.shapes:
                self.shapes[code] = self.field.weigh(shape_features(*shape_of(code)))
        out = np.array([self.shapes[code] for code in some.tolist()])[which]
        zero = np.zeros(STATES)
        out += self.field.emit.get("lead=", zero)
        for i in np.flatnonzero(bits & 10).tolist():  # some letter may be upper case
            if name := lead(tokens[i]):
                out[i] = self.shapes[int(codes[i])] + self.field.emit.get(f"lead={name}", zero)
        return out


@cache
def all_digits() -> np.ndarray:
    """By code, whether a character is a digit."""
    return np.array([chr(c).isdigit() for c in range(sys.maxunicode + 1)])


def shapes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for what shape_features tell of each token (see shape_of), and the bits of its signs."""
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    first = np.cumsum(n) - n
    chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    bits = np.bitwise_or.reduceat(SIGNS[np.minimum(chars, 128)], first)
    digits = (np.add.reduceat(all_digits()[chars].astype(np.int64), first) / n * 4).astype(np.int64)
    pairs = np.repeat(np.arange(len(tokens)), n) << 21 | chars
    pairs.sort()
    turn = np.flatnonzero(np.diff(pairs, prepend=-1))
    owner = pairs[turn] >> 21
    share = np.diff(turn, append=len(pairs)) / n[owner]
    entropy = np.where(n <= 256, (1e-9 - np.bincount(owner, share * np.log2(share), len(tokens))).astype(np.int64), 9)
    alphabet = np.where(bits & 16 == 0, 0, np.where(bits & 32 == 0, 1, 2))
    length = np.searchsorted(LENGTHS, n)
    return (((bits & 15) * 16 + length) * 16 + entropy) * 16 + digits * 3 + alphabet, bits


def shape_of(code: int) -> tuple[str, int, int, int, str]:
    code, last = divmod(code, 16)
    code, entropy = divmod(code, 16)
    bits, length = divmod(code, 16)
    return "".join(k for i, k in enumerate("aA0-") if bits >> i & 1), LENGTHS[length], entropy, last // 3, ("hex", "HEX", "other")[last % 3]


def word_kinds(tokens: list[str]) -> np.ndarray:
    """The places in NEAR of each token's word(); no token comes twice."""
    text = "\n".join(tokens)
    starts = np.cumsum([0, *(len(t) + 1 for t in tokens[:-1])])
    out = np.full(len(tokens), NEAR.index("plain"))
    for pattern, kind in ((LOOKS, "key-like"), (CUE, "cue")):  # of both, the cue counts
        at = np.array([m.start() for m in pattern.finditer(text)], np.int64)
        out[np.searchsorted(starts, at, "right") - 1] = NEAR.index(kind)
    for sign in "=:":
        if sign in tokens:
            out[tokens.index(sign)] = NEAR.index(sign)
    return out


def labels(run: list[tuple], spans: list[tuple[int, int]]) -> list[int]:
    """B where a pattern's span begins in or before the token and covers some of it, I where it goes on, O elsewhere. Of an assignment (name,
    sign, value), name and sign are O: the value is the secret."""
    starts, ends = [r[0] for r in run], [r[1] for r in run]
    hits: list[tuple[int, int] | None] = [None] * len(run)
    for x in reversed(spans):  # the first one counts
        for i in range(bisect_right(ends, x[0]), bisect_left(starts, x[1])):
            hits[i] = x
    names = [i for i in range(len(run) - 2) if hits[i] and hits[i] == hits[i + 1] == hits[i + 2] and (i == 0 or hits[i - 1] != hits[i]) and run[i + 1][1] - run[i + 1][0] == 1]
    for i in names:
        hits[i] = hits[i + 1] = None
    return [0 if hit is None else 2 if i and hits[i - 1] == hit else 1 for i, hit in enumerate(hits)]


def train(samples: list[tuple[list[list[str]], list[int]]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Conditional maximum likelihood with Adagrad steps over all runs; runs of the same length in one block."""
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in samples for x in fs for f in x}))}
    width = max((len(x) for fs, _ in samples for x in fs), default=0)
    blocks: dict[int, list] = {}
    for fs, y in samples:
        blocks.setdefault(len(y), []).append(([[names[f] for f in x] + [len(names)] * (width - len(x)) for x in fs], y))
    data = [(np.array([x for x, _ in b]), np.array([y for _, y in b])) for b in blocks.values()]
    emit, move = np.zeros((len(names) + 1, STATES)), np.zeros((STATES, STATES))
    barred = np.zeros((STATES, STATES))
    barred[0, 2] = -1e9
    seen_e, seen_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for _ in range(rounds):
        ge, gm = -decay * emit, -decay * move
        for x, y in data:
            n, length = y.shape
            e, m = emit[x].sum(2), move + barred
            fwd, bwd = [m[0] + e[:, 0]], [np.broadcast_to(m[:, 0], (n, STATES))]
            for t in range(1, length):
                fwd.append(lse(fwd[-1][:, :, None] + m, 1) + e[:, t])
                bwd.append(lse(m + (e[:, length - t] + bwd[-1])[:, None, :], 2))
            bwd = bwd[::-1]
            z = lse(fwd[-1] + bwd[-1], 1)
            for t in range(length):
                p = np.exp(fwd[t] + bwd[t] - z[:, None])
                g = np.eye(STATES)[y[:, t]] - p
                np.add.at(ge, x[:, t].ravel(), np.repeat(g, x.shape[2], 0))
                if t:
                    q = np.exp(fwd[t - 1][:, :, None] + m + (e[:, t] + bwd[t])[:, None, :] - z[:, None, None])
                    np.add.at(gm, (y[:, t - 1], y[:, t]), 1)
                    gm -= q.sum(0)
                else:
                    np.add.at(gm[0], y[:, 0], 1)
                    gm[0] -= p.sum(0)
                if t == length - 1:
                    np.add.at(gm[:, 0], y[:, t], 1)
                    gm[:, 0] -= p.sum(0)
        ge[-1] = 0
        seen_e += ge**2
        seen_m += gm**2
        emit += rate * ge / np.sqrt(seen_e)
        move += rate * gm / np.sqrt(seen_m)
    return Field({f: emit[i] for f, i in names.items()}, move)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, sample_runs: int = 20000) -> Field:
    """Train on stretches of at most sample_docs documents (those of the smallest id hashes), sample_runs stretches at most (of the smallest hashes)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[list[list[str]], list[int]]] = []
            for t in b.column(0):
                text = t.as_py() or ""
                base = [s for spans in base_spans(text).values() for s in spans]
                rows += [*stretches(text, base), *variations(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.list_(pa.string()))), pa.array([y for _, y in rows], pa.list_(pa.int32()))], ["x", "y"])

    some = df.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)
    texts = df.select(id_col, F.col(text_col).alias("__t")).join(F.broadcast(some), id_col, "left_semi").select("__t")
    rows = texts.mapInArrow(lean(extract), "x array<array<string>>, y array<int>").orderBy(F.xxhash64("x"), "x", "y").limit(sample_runs).collect()
    return train(sorted((r["x"], r["y"]) for r in rows))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per row: id_col, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind)."""
    field = field or fit(df, id_col, text_col)
    kind = dict(df.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, all_spans = [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                counts.append([len(spans[k]) for k in KINDS[:3]])
                digests.append(hashlib.sha256(joined(spans, KINDS[:3]).encode()).hexdigest())
                all_spans.append(joined(spans | {"crf": field.spans(text)}, KINDS))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(digests, pa.string()), pa.array(all_spans, pa.string())], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(id_col, F.col(text_col)).mapInArrow(lean(scan), f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
