"""Exact dedup, mixing, packing, WARC, nearest neighbours, quality, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import ann, exact_dedup, mixing, packing, quality, queries, warc
from quillgraph.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("counters", [1, 3, 512])
def test_exact_dedup(spark, counters):
    rng = random.Random(counters)
    texts = ["hot  text", "hot\ttext", "hot text", "a", "b ", "b ", "", None, " "]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(texts), "x") for i in range(300)] + [(7, "hot text", "y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(df, counters=counters).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for sha in by:
        mine = [r for r in got if r["text_sha256"] == sha]
        least = min((i for i in by[sha] if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(least, len(by[sha]))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [least]
    kept = exact_dedup.drop_exact_copies(df, counters=counters)
    assert kept.columns == df.columns
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_frequent_finds_all_above_the_bound(spark):
    rng = random.Random(0)
    keys = [str(min(int(rng.expovariate(0.2)), 40)) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(6)
    found = exact_dedup.frequent(df, "k", 9)
    assert len(found) <= 9 and {k for k, n in Counter(keys).items() if n > 300} <= set(found)
    numbers = exact_dedup.frequent_numbers(df.select(F.col("k").cast("long").alias("k")), "k", 9)
    assert len(numbers) <= 9 and {int(k) for k, n in Counter(keys).items() if n > 300} <= set(numbers)
    assert exact_dedup.frequent_numbers(df.limit(0).select(F.col("k").cast("long").alias("k")), "k", 9) == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", None]), 1.5) for i in range(1500)] + [(None, "x y", "b", 0.0), (3, None, "c", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mix(df, chunk_rows=16).collect()
    again = mixing.mix(df.repartition(7), chunk_rows=300).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    weight, target, todo = {"a": 3, "b": 1, "c": 2, None: 3}, {}, set(size)
    while True:  # share, stop at twice the size, share again
        rest = 1.5 * sum(size.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in todo)
        over = {s for s in todo if level * weight[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2 * size[s] for s in over}
        todo -= over
    target |= {s: level * weight[s] for s in todo}
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in size) and sum(taken.values()) <= 1.5 * sum(size.values())
    docs = mixing.mixed_documents(df, chunk_rows=16)
    assert docs.columns == df.columns and sum(len(r["text"].split()) for r in docs.collect()) == sum(taken.values())
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(df.where("text IS NULL")).collect()] == [0]


ODD = ["İ.", "<|endoftext|>.", "<|EndOfText|> a", "it's. DON'T, x", ".,", "a.,b", "Σ. ΑΣ,", "é. ̈.", " x. y,\x1cz\x85q.", "", ". ,", "A1, B2.", "ﬁ. ǅ, ß. ẞ.", "éá. ñ", "日本 語。 한국어, คำ"]


def test_words_encode_as_the_tokenizer_does(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").limit(20).collect()]
    for x, data in zip(texts, packing.encode_all(texts, path), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing(spark):
    path = queries.tokenizer_path()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(1).alias("length"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, 1), (-5, "", 1), (-6, "twice", 1), (-6, "twice", 1)], docs.schema))
    rows = packing.pack_documents(docs, path, with_ids=True).collect()
    ids = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        ids[(i, packing.encode_all([t or ""], path)[0] + b"\1\0\0\0")] += 1
    whole = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole[r["doc_id"]].append(r)
    for (i, data), n in ids.items():
        parts = sorted(whole[i], key=lambda r: r["start"])[::n]
        assert b"".join(r["ids"] for r in parts) == data and {r["doc_tokens"] for r in parts} == {len(data) // 4}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r["length"] for r in rows) / 2048 / len(sequences) > 0.97
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_shortest_pack_first():
    rng = random.Random(0)
    for _ in range(50):
        size = rng.choice([8, 64])
        counts = {n: rng.randint(1, 200) for n in rng.sample(range(1, size + 1), rng.randint(1, size))}
        packs = packing.shortest_pack_first(counts, size)
        used = Counter()
        for n, lengths in packs:
            assert sum(lengths) <= size
            for x in lengths:
                used[x] += n
        assert used == counts


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", t, "x") for i, t in enumerate(["a", "b", "a", "é\r\n\r\n", "", None, "a"])] + [(6, "u\nv", "a", ""), (None, None, "b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    uri = f"file://{tmp_path}/one"
    manifest = warc.write_warc(df, uri, roll_bytes=600, shard_bytes=3)
    got = warc.read_warc(spark, uri, manifest).collect()
    assert len(got) == len(rows) and {r["name"] for r in manifest.collect()} == {p.name for p in (tmp_path / "one").glob("*.gz")}
    assert not (tmp_path / "one/_temporary").exists() and len(list((tmp_path / "one").glob("*.gz"))) > 2
    roles = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    want = [(0, "revisit", 6, 1), (1, "response", None, 1), (2, "revisit", 6, 1), (3, "response", None, 6), (4, "revisit", 5, 0), (5, "response", None, 0), (6, "response", None, 1), (6, "revisit", 6, 1), (None, "revisit", 1, 1)]
    assert roles == Counter(want)
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response"} == {(1, "b"), (3, "é\r\n\r\n"), (5, ""), (6, "a")}
    two = f"file://{tmp_path}/two"
    warc.write_warc(df.repartition(5), two, roll_bytes=600, shard_bytes=3)
    assert {p.name: p.read_bytes() for p in (tmp_path / "one").glob("*.gz")} == {p.name: p.read_bytes() for p in (tmp_path / "two").glob("*.gz")}
    assert warc.round_trip(df.limit(0)).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df.where("page_id < 6"), min_bytes=2).collect()}
    assert set(small.values()) == {"response"}


def exact_neighbours(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = sorted((-float((q * x).sum()), j) for j, x in good if j != i)[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.standard_normal(8) * rng.choice([0.5, 1, 4])).tolist()) for i in range(3000)]
    rows += [(5000 + i, [1.0] * 8) for i in range(400)]  # one vector many times: ties, and a cell that can't be cut
    rows += [(9000, None), (9020, [0.0] * 8), (9040, [float("nan")] * 8), (9060, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, unit int").repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, cell_rows=128, block_rows=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = exact_neighbours(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == [(n + 1, i, s) for n, (i, s) in enumerate(sorted(((i, s) for _, i, s in found), key=lambda x: (-x[1], x[0])))]
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    few = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df.where("vec_id < 3"), F.col("id") % 20 == 0).collect()}
    assert {(q, i) for q, _, i in few} == {(0, 1), (0, 2)}
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_nearest_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact_neighbours([(r["vec_id"], list(r["embedding"])) for r in df.collect()], 20)
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("id") % 20 == 0, cell_rows=256).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 1000 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in spark.range(50).select("id", quality.fold(F.col("id")) == 1).collect())


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (1, "", 2.0), (None, "word " * 50, 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert [r["score"] for r in got] == [0.5] * 3 and [r["predicted"] for r in got] == [1] * 3
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark):
    from tests.llm.test_jaccard import brute

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = kept.get("last", docs)
        now = f(spark, before, SMALL)
        assert now.columns == docs.columns
        kept["last"] = spark.createDataFrame(now.collect(), docs.schema)
        a = [(r["doc_id"], r["text"]) for r in before.collect()]
        b = [(r["doc_id"], r["text"]) for r in kept["last"].collect()]
        if name == "quality":
            marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
            left = {i for i, _ in b}
            assert sum((i in left) == bool(marks[i]) for i, _ in a if i in marks) >= 0.95 * len(marks)
        elif name == "exact":
            least = {}
            for i, t in sorted(a):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
            assert sorted(b) == sorted(least.values())
        elif name == "near":
            assert sorted(i for i, _ in b) == sorted(i for i, (_, c) in brute(a, 5, 80).items() if i == c)
        else:
            assert {i for i, _ in b} <= {i for i, _ in a} and max(Counter(b).values()) <= 2
    assert len([f for _, f in corpus_pipeline.STAGES]) == 5 and corpus_pipeline.run(spark, SMALL).count() > 0


def test_pieces_of_latin_text_have_the_ids_of_the_whole_text():
    path = queries.tokenizer_path()
    whole = packing.tokenizer(path)
    signs = [chr(i) for i in range(0x2100) if not packing.OTHERS.match(chr(i))]
    texts = [f"{c}{x}{c}{y}A{c}" for c in signs for x, y in (("a", "'s"), ("É1", ". "), ("'", "Œ"))] + ["a<|endoftext|>b", "é ﬁ Σας K ＡＢ", "x y\u0085z", "’tis “so”…"]
    for x, data in zip(texts, packing.encode_all(texts, path), strict=True):
        assert np.frombuffer(data, np.uint32).tolist() == whole.encode(x, add_special_tokens=False).ids, x


def test_words_with_signs_are_not_encoded_one_by_one(monkeypatch):
    path = queries.tokenizer_path()
    words = packing.Words(path)
    calls, encode = [], words.encode
    monkeypatch.setattr(words, "encode", lambda *a, **k: calls.append(a) or encode(*a, **k))
    monkeypatch.setattr(packing, "known_words", lambda path: words)
    rng = random.Random(4)
    packing.encode_all([f"({''.join(rng.choices('abcé', k=8))}) Été's {i}" for i in range(500)], path)
    assert len(calls) <= 20  # the signs and digits
