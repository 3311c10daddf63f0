"""PII and secrets against the plain regular expressions they are defined by."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import pii, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (2 if i % 2 else 1)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    }


PIECES = st.sampled_from(["a", "b.c", "@", ".", "..", "-", " ", "+", "1", "12", "255", "256", "3.4", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "x@y.zz", "é", "\n", "http://", "mailto:", "IBAN ", "DE89370400440532013000", "account: 12345678", "(", ")", "_%"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_pii_base_spans_equal_the_patterns(text):
    found = pii.find_spans(text)
    assert {k: found[k] for k in pii.BASE_KINDS} == plain_pii(text)


def test_pii_added_kinds():
    text = "see http://a.example.com/x, IBAN DE89370400440532013000 or IBAN DE00370400440532013000; account no 1234-5678-90"
    spans = pii.find_spans(text)
    assert [text[s:e] for s, e in spans["url"]] == ["http://a.example.com/x"]
    assert [text[s:e] for s, e in spans["account"]] == ["DE89370400440532013000", "1234-5678-90"]


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16],
    }


PARTS = st.sampled_from(["password", "PassWd", "secretoken", "token", "api_key", "ApiKey", "apı_key", "Key", "İ", '"', "'", " ", "  ", ":", "=", ": ", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "abc", "DEF+/", ".", "-", "\n", "é", "x"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_secret_base_spans_equal_the_patterns(text):
    assert secrets.base_spans(text) == plain_secrets(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=40).map(" ".join))
def test_runs_hold_every_key_like_token_once(text):
    tokens = [m.start() for m in secrets.TOKEN.finditer(text) if secrets.KEY_LIKE.search(m[0])]
    assert [s for run in secrets.runs(text) for s, _, _ in run] == tokens


def brute_decode(field, features):
    """The best of all label sequences."""
    import itertools

    def score(y):
        if any(b == 2 and a == 0 for a, b in zip((0, *y), y)):
            return -1e9
        s = sum(field.emit[f][k] for fs, k in zip(features, y) for f in fs if f in field.emit)
        return s + sum(field.move[a, b] for a, b in zip((0, *y), (*y, 0)))

    return max(itertools.product(range(3), repeat=len(features)), key=score)


def test_field_learns_and_decodes_exactly():
    samples = []
    for i in range(60):
        key = hashlib.sha256(str(i).encode()).hexdigest()[:24]
        text = f"word {i}{i} and password={key} then plain 2024-01-{i:02d} words"
        base = [s for x in secrets.base_spans(text).values() for s in x]
        samples += [([f for _, _, f in run], secrets.labels(run, base)) for run in secrets.runs(text)]
    field = secrets.train(samples)
    text = "some words, secret is 9f86d081884c7d659a2feaa0 on 2023-11-12"
    assert [text[s:e] for s, e in field.spans(text)] == ["9f86d081884c7d659a2feaa0"]
    for features, _ in samples[:40]:
        assert tuple(field.decode(features)) == brute_decode(field, features)
    double = [samples[0][0][0], samples[1][0][0], samples[0][0][0]]
    assert tuple(field.decode(double)) == brute_decode(field, double)


ROWS = [(1, "mail a@b.cc and password=abcdefabcdef12"), (1, "mail a@b.cc and password=abcdefabcdef12"), (None, None), (2, ""), (3, "x" * 200_000 + " 10.0.0.1")]


def test_tables_with_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, spans string")
    for got in (pii.find_pii(df), secrets.find_secrets(df)):
        rows = {r["doc_id"]: r for r in got.collect()}
        assert got.count() == 5 and set(rows) == {1, 2, 3, None}
        assert rows[None]["spans"] == rows[2]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert {r["n_email"] for r in pii.find_pii(df).where("doc_id = 1").collect()} == {1}
    assert [r["n_ip"] for r in pii.find_pii(df).where("doc_id = 3").collect()] == [1]
    empty = df.limit(0)
    assert pii.find_pii(empty).count() == secrets.find_secrets(empty).count() == 0


def test_every_token_is_decoded():
    import numpy as np

    samples = []
    for i in range(200):
        key = hashlib.sha256(str(i).encode()).hexdigest()[:24]
        text = f"some plain words of number{i} and password={key} then plain 2024-01-{i:02d} words"
        base = [s for x in secrets.base_spans(text).values() for s in x]
        samples += [([f for _, _, f in run], secrets.labels(run, base)) for run in secrets.runs(text)]
    field = secrets.train(samples)
    for f in ("kinds=aA0", "length=20"):  # as trained on a table in which such tokens are secrets
        field.emit[f] = np.array([0.0, 9.0, 0.0])
    text = "Authorization: Bearer aB3dE5gH7jK9mN1p and plain words, 9f86d081884c7d659a2feaa0 too"
    assert "aB3dE5gH7jK9mN1p" in [text[s:e] for s, e in field.spans(text)]
    for text in (text, "x = aB3dE5gH7jK9mN1p aB3dE5gH7jK9mN1q. pwd: s3cr3tPassPhr4se plain", "words only"):
        run = [x for r in secrets.runs(text) for x in r]
        want = []
        for (s, e, _), state in zip(run, field.decode([f for _, _, f in run])):
            want = want + [(s, e)] if state == 1 else want[:-1] + [(want[-1][0], e)] if state == 2 else want
        assert field.spans(text) == want


def test_recall_of_secrets_that_the_patterns_do_not_know(spark):
    """Planted at random places of the table's texts, behind names and headers that the patterns don't have."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = secrets.fit(df, sample_docs=2000)
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [r["text"] for r in df.where("text IS NOT NULL AND length(text) < 5000").orderBy("doc_id").limit(80).collect()]
    made = {"header": lambda: f"Authorization: Bearer {key(24)}", "name": lambda: f"private_key = '{key(32)}'", "no sign": lambda: f"aws_secret_access_key {key(40)}"}
    for kind, make in made.items():
        found = 0
        for t in texts:
            words, secret = t.split(" "), make()
            at = rng.randrange(len(words) + 1)
            lo = len(" ".join(words[:at])) + 1
            hi = lo + len(secret)
            text = " ".join([*words[:at], secret, *words[at:]])
            found += any(a < hi and b > hi - 8 for a, b in field.spans(text))
        assert found / len(texts) >= 0.8, (kind, found)
    inside = lambda a, b, spans: any(a < y and x < b for x, y in spans)
    alarms = sum(not inside(a, b, [x for v in secrets.base_spans(t).values() for x in v]) for t in texts for a, b in field.spans(t))
    assert alarms <= 2


def test_training_stretches_are_short():
    text = " ".join("ab12cd34ef" for _ in range(1000)) + " password: abcdef123456 " + "x" * 10
    spans = [x for v in secrets.base_spans(text).values() for x in v]
    parts = [*secrets.stretches(text, spans), *secrets.variations(text)]
    assert parts and all(len(x) == len(y) <= secrets.STRETCH and y[0] != 2 for x, y in parts)
    assert secrets.variations(text).__next__() == secrets.variations(text).__next__()


def small_field():
    samples = []
    for i in range(60):
        text = f"word {i}{i} and password={hashlib.sha256(str(i).encode()).hexdigest()[:24]} then ABCD{i} plain 2024-01-{i:02d} words"
        base = [s for x in secrets.base_spans(text).values() for s in x]
        samples += [([f for _, _, f in run], secrets.labels(run, base)) for run in secrets.runs(text)]
    return secrets.train(samples)


FIELD = small_field()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aAzZfF09é٣²ⅧK日+/_-.,=: \n\"'İ\ud800", max_size=30) | PARTS, max_size=40).map(" ".join))
def test_weights_of_all_tokens_at_once_are_those_of_their_features(text):
    tokens = secrets.TOKEN.findall(text)
    got = FIELD.scores(text, tokens).tolist() if tokens else []
    assert got == [(FIELD.weigh(secrets.token_features(t)) + FIELD.weigh(n) + FIELD.weigh(secrets.file_features(text))).tolist() for t, n in zip(tokens, near_of(tokens))]


def near_of(tokens):
    w = ["none", "none", *map(secrets.word, tokens), "none"]
    return [secrets.near_features(w[i], w[i + 1], w[i + 3]) for i in range(len(tokens))]


def test_scan_of_many_distinct_tokens_takes_no_step_of_python_a_feature(monkeypatch):
    def fail(token):
        raise AssertionError("features spelled out")

    FIELD.known = None
    monkeypatch.setattr(secrets, "token_features", fail)
    rng = random.Random(3)
    FIELD.spans(" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(20_000)))


def test_training_spells_out_picked_tokens_only(monkeypatch):
    made, plain = [], secrets.token_features
    monkeypatch.setattr(secrets, "token_features", lambda t: made.append(t) or plain(t))
    parts = list(secrets.stretches(" ".join(f"plain{'abcdefgh'[i % 8]}" for i in range(4000)), []))
    assert len(made) == sum(len(y) for _, y in parts) < 1000
