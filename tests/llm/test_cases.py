"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and pipeline stage."""

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from quillgraph.llm import ann, exact_dedup, jaccard, mixing, packing, pii, quality, queries, secrets, suffix_dedup, warc

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
#: Names that operators use for columns of their own.
CLASHING = ("id", "key", "cls", "size", "place", "row", "score", "token", "n", "source_size", "target", "kept", "__id", "__n", "__digest", "start", "length", "gone")


def long_text():
    """Of 300,000 characters: many words, one of 100,000 signs, and a line that repeats."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    return " ".join(words) + " " + "x" * 100_000 + ("\nthe same line again and again " * 500) + " password=abcdefgh12345678 mail a.b@example.org"


LONG = long_text()
TEXTS = [
    (1, "one two three four five six seven", "a", "en"),
    (2, "one two three four five six seven", "b", "en"),
    (2, "one two three four five six seven", "b", "en"),
    (3, LONG, "a", None),
    (4, LONG + " end", None, "de"),
    (5, "", "a", "en"),
    (6, None, "b", None),
    (7, " \t\n ", None, "en"),
    (None, "one  two three four five six seven", "c", "fr"),
    (None, None, None, None),
    (8, "token: 'AbC123deF456gHi' ip 10.0.0.1 and 10.0.0.300, card 4111 1111 1111 1111, +49 30 123456", "c", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *("x",) * len(CLASHING)) for r in TEXTS], f"doc_id long, text string, source string, lang string, {extra}").repartition(3)


def rows(df):
    return [r.asDict() for r in df.collect()]


def norm(t):
    return re.sub(WHITE, " ", t or "")


def in_order(found):
    return sorted(map(str, found))


def test_exact(docs):
    got = rows(exact_dedup.exact_dedup(docs))
    sha = lambda t: hashlib.sha256(norm(t).encode()).hexdigest()
    least, size = {}, {}
    for i, t, *_ in TEXTS:
        size[sha(t)] = size.get(sha(t), 0) + 1
        if i is not None:
            least[sha(t)] = min(i, least.get(sha(t), i))
    assert in_order((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == in_order((i, least.get(sha(t)), size[sha(t)], sha(t)) for i, t, *_ in TEXTS)
    assert sum(r["kept"] for r in got) == len(size)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and in_order(norm(r["text"]) for r in rows(kept)) == in_order({norm(t) for _, t, *_ in TEXTS})


def test_jaccard(docs):
    got = rows(jaccard.near_duplicates(docs, words=3, percent=90))
    assert len(got) == len(TEXTS)
    by = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got}
    n = len({tuple(w[i : i + 3]) for w in [re.findall(WORD, LONG)] for i in range(len(w) - 2)})
    assert {(1, 5, 1, 3), (2, 5, 1, 3), (None, 5, 1, 3), (5, 0, 5, 0), (6, 0, 6, 0), (7, 0, 7, 0), (None, 0, None, 0)} <= by
    assert {(3, n, 3, 1), (4, n + 1, 3, 1)} <= by
    kept = jaccard.keep_one(docs, words=3, percent=90)
    assert kept.columns == docs.columns and in_order(r["doc_id"] for r in rows(kept)) == in_order([1, 3, 5, 6, 7, None, 8])


def test_scans(docs):
    for find, patterns in ((secrets.find_secrets, secrets.base_spans), (pii.find_pii, pii.find_spans)):
        got = rows(find(docs))
        kinds = secrets.KINDS[:3] if find is secrets.find_secrets else pii.BASE_KINDS
        join = secrets.joined if find is secrets.find_secrets else pii.joined
        want = [(i, *(len(patterns(t or "")[k]) for k in kinds), hashlib.sha256(join(patterns(t or ""), kinds).encode()).hexdigest()) for i, t, *_ in TEXTS]
        assert in_order((r["doc_id"], *(r[f"n_{k}"] for k in kinds), r["base_sha256"]) for r in got) == in_order(want)
        assert find(docs.limit(0), *(["doc_id", "text"])).count() == 0
    assert {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows(pii.find_pii(docs)) if r["doc_id"] in (3, 8)} == {(3, 1, 0, 0, 0), (8, 0, 1, 1, 1)}


def test_warc(docs):
    pages = docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "id", "row", "key")
    got = rows(warc.round_trip(pages))
    b32 = lambda t: warc.base32_sha1((t or "").encode())
    keep = {}
    for i, t, *_ in TEXTS:
        if i is not None:
            keep[b32(t)] = max(i, keep.get(b32(t), i))
    assert in_order((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == in_order((i, len((t or "").encode()), b32(t)) for i, t, *_ in TEXTS)
    for digest, k in keep.items():
        mine = [r for r in got if r["payload_digest"] == digest]
        assert [r["page_id"] for r in mine if r["record_type"] == "response"] == [k]
        assert {r["refers_to"] for r in mine if r["record_type"] == "revisit"} <= {k}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_mixing(docs):
    got = rows(mixing.mix(docs))
    assert in_order((r["doc_id"], r["source"], r["size"]) for r in got) == in_order((i, s, len(re.findall(WORD, t or ""))) for i, t, s, _ in TEXTS)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] <= 2 * sizes[r["source"]] for r in got)
    assert {r["taken"] for r in got if r["doc_id"] == 2} == {next(r["taken"] for r in got if r["doc_id"] == 2)}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {s: n for s, n in taken.items() if n} == {s: n for s in sizes if (n := sum(len(re.findall(WORD, r["text"] or "")) for r in rows(mixed) if r["source"] == s))}
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0


def test_targets_of_many_sources(spark):
    """By rounds of aggregation, as by filling up one source after the other."""
    rng = random.Random(1)
    sizes = [(f"s{i:03}" if i else None, rng.choice([0, 1, 10, 1000, 100_000]), 1) for i in range(60)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long, n long").repartition(5)).collect()}
    named = sorted((s for s, *_ in sizes if s is not None)) + [None]
    weight, size = {s: (3, 1, 2)[i % 3] for i, s in enumerate(named)}, {s: n for s, n, _ in sizes}
    left, open_, want = 1.5 * sum(size.values()), set(named), {}
    while full := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}:
        want |= {s: 2.0 * size[s] for s in full}
        left, open_ = left - sum(2 * size[s] for s in full), open_ - full
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in named)


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (5, None, "x"), (None, 1, "x"), (2, 0, "x"), (2, 1, "x")], "doc_id long, quality int, text string")
    got = rows(quality.classify(docs, labels))
    assert in_order((r["doc_id"], r["held_out"]) for r in got) == in_order((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6, 7)}) == 1
    assert {r["score"] for r in rows(quality.classify(docs, labels.limit(0)))} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns and quality.keep_good(docs, labels.limit(0)).count() == len(TEXTS)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_suffixes(docs):
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows(suffix_dedup.remove_repeats(docs))}
    size = len(LONG.encode())
    assert {(1, 33, 0, 0), (5, 0, 0, 0), (6, 0, 0, 0), (7, 4, 0, 0), (None, 0, 0, 0)} <= got
    first = next(r for r in got if r[0] == 3)
    assert first[1] == size and first[2] >= 100_000 - 100 + 499 * 31 - 200  # the long word and the lines repeat within the text
    assert (4, size + 4, size, 1) in got


def test_packing(docs):
    path = queries.tokenizer_path()
    whole = packing.tokenizer(path)
    got = rows(packing.pack_documents(docs, path))
    want = []
    for i, t, *_ in TEXTS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, s, len(p := ids[s : s + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p)), len(ids)) for s in range(0, len(ids), 2048)]
    assert in_order((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == in_order(want)
    for q in {r["sequence_id"] for r in got}:
        pieces = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == q)
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 2048
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_nearest(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    data = [(0, same, "x"), (0, same, "x"), (20, [4.0, 3.0, 2.0, 1.0], "x"), *((100 + i, same, "x") for i in range(40)), (7, [1.0] * 5, "x"), (9, [], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, unit string").repartition(3)
    got = rows(ann.nearest(df, "id % 20 = 0", k=5, cell_rows=16))
    ranks = {}
    for r in got:
        ranks.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(ranks[0]) == sorted([(k + 1, 100 + k, 30.0) for k in range(5)] * 2)  # each of two equal queries has a whole result
    assert sorted(ranks[20])[:2] == [(1, 0, 20.0), (2, 0, 20.0)] and len(ranks[20]) == 5 and len(ranks[100]) == 5


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, tmp_path, stage):
    """Each takes all these cases, and an empty table; all but the last return the columns of their input, and no row that isn't there."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stage(spark, docs, str(tmp_path))
    found = rows(out)
    if stage is not corpus_pipeline.packing:
        assert out.columns == docs.columns
        there = {(r["doc_id"], r["text"], r["source"]) for r in rows(docs)}
        assert found and {(r["doc_id"], r["text"], r["source"]) for r in found} <= there
    else:
        assert {r["doc_id"] for r in found} == {i for i, *_ in TEXTS}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
