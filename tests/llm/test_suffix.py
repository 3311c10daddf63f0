"""Suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quillgraph.llm import suffix_dedup
from quillgraph.llm import induced
from quillgraph.llm.induced import suffix_order


def test_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    for trial in range(150):
        limit = rng.choice([5, 8, 20])
        letters = rng.choice([1, 2, 3, 200])
        parts = [bytes(rng.randint(1, letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        parts += [parts[0][3:], parts[0]] * (trial % 2)
        text = np.frombuffer(b"".join(x + b"\0" for x in parts), np.uint8)
        at, common = suffix_order(text, limit, rng.choice([16, 300, 1 << 20]))  # 16: nearly everything on disk, in many blocks and runs
        assert sorted(at.tolist()) == list(range(len(text)))
        head = [bytes(text[i : i + limit]).split(b"\0")[0] for i in at]
        for a, b, c in zip(head, head[1:], common[1:], strict=False):
            assert a <= b
            assert c == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_a_text_of_many_times_the_memory():
    """Equal to the order in memory, with queues and runs on disk, and no array beyond the memory but in files."""
    rng = random.Random(3)
    words = [bytes(rng.randint(97, 122) for _ in range(rng.randint(2, 9))) for _ in range(300)]
    parts = [b" ".join(rng.choice(words) for _ in range(40)) for _ in range(400)]
    parts += [p[20:150] + b"z" * 300 for p in parts[:200]]
    text = np.frombuffer(b"".join(x + b"\0" for x in parts), np.uint8)
    memory, made = len(text) // 20, []
    whole = induced.array
    induced.array = lambda n, kind, most: made.append(x := whole(n, kind, most)) or x
    try:
        at, common = suffix_order(text, 100, memory)
    finally:
        induced.array = whole
    assert any(isinstance(x, np.memmap) for x in made) and all(isinstance(x, np.memmap) or x.nbytes <= memory for x in made)
    want = suffix_order(text, 100, 1 << 30)
    assert (at == want[0]).all() and (common == want[1]).all()


def test_a_shard_of_many_times_the_memory():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(150)
    docs = [(i, text(rng.randint(0, 80)) + passage[rng.randint(0, 30) :] + text(60)) for i in range(300)]
    found = []
    for memory in (1 << 30, 500):
        shard = suffix_dedup.Shard(memory)
        for i, t in docs:
            shard.add(i, 0, 0, t.encode())
        spans = {tuple(r.values()) for b in suffix_dedup.sort_shard(shard, 100, memory) for r in b.to_pylist()}
        found.append(spans)
    for i, (_, _, n, _) in brute(docs, 100).items():
        assert (n > 0) == any(x[0] == i for x in found[0])
    assert found[0] == found[1]


def brute(docs, length):
    """docs: (id, text); the answer by looking at each window."""
    first, gone = {}, {}
    for i, t in sorted(docs):
        data = t.encode()
        gone[i] = np.zeros(len(data), bool)
        for a in range(len(data) - length + 1):
            w = data[a : a + length]
            if w in first:
                gone[i][a : a + length] = True
            else:
                first[w] = (i, a)
    out = {}
    for i, t in docs:
        g = gone[i]
        kept = bytes(np.frombuffer(t.encode(), np.uint8)[~g])
        out[i] = (len(g), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def answer(df, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, **options).collect()}


@pytest.mark.parametrize("crowd", [2000, 3])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    word = lambda: "".join(rng.choice("abé\0x") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), "The same line of some length in very many of the documents here.\n"
    docs = []
    for i in range(150):
        t = text(rng.randint(0, 120))
        kind = rng.randint(0, 6)
        if kind == 0 and docs:
            t = rng.choice(docs)[1]
        elif kind == 1:
            cut = rng.randint(0, len(t))
            t = t[:cut] + passage[rng.randint(0, 50) :] + t[cut:]
        elif kind == 2:
            t = t + t
        elif kind == 3:
            t = "z" * rng.randint(90, 900)
        elif kind == 4:
            t = line + t + line * rng.randint(1, 4)
        docs.append((1000 - i if i % 2 else i, t))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert answer(df) == brute(docs, 100)


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert answer(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 100)


def test_nulls_repeats_and_other_columns(spark):
    rng = random.Random(3)
    t = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(1, t, "x"), (1, t, "y"), (None, t, "z"), (2, None, None), (3, "", ""), (4, t[:99], ""), (5, t[10:115], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [("1", 150, 0, 0), ("1", 150, 0, 0), ("2", 0, 0, 0), ("3", 0, 0, 0), ("4", 99, 0, 0), ("5", 105, 105, 1), ("None", 150, 150, 1)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_no_key_fills_a_shard(spark, monkeypatch):
    """A passage with different surroundings: windows that overhang its edges keep one gram, but never come to one shard in a row."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 10)
    monkeypatch.setattr(suffix_dedup, "SHARD", 1000)
    whole = suffix_dedup.sort_shard

    def sort_shard(shard, length, memory):
        assert shard.held <= 1000 + 10 * (257 + length), "a key filled the shard"
        return whole(shard, length, memory)

    monkeypatch.setattr(suffix_dedup, "sort_shard", sort_shard)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, ends = text(200), [text(60) for _ in range(40)]
    docs = [(i, text(60) + passage + (ends[i % 40] if i % 3 else text(60))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert answer(df) == brute(docs, 100)
