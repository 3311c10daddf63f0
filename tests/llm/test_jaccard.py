"""N-gram Jaccard join against brute force, also with lists so short that pivots and the second round are needed."""

import random
import re

import pytest

from quillgraph.llm import jaccard


def brute(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    top[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def answer(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, **options).collect()}


def copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÄé") for _ in range(3))
    docs, line = [], " ".join(word() for _ in range(12))
    for base in range(4):
        text = [word() for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(18):
            t = list(text)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = word()
            docs.append((len(docs) * 7 % 101, " ".join(t).upper() if base == 2 else " ".join(t) + (" " + line if base == 3 else "")))
    docs += [(200 + i, line + " " + " ".join(word() for _ in range(10))) for i in range(15)]
    return docs + [(300, ""), (301, " \t\n"), (302, "one"), (303, "ONE"), (304, "one two"), (305, None)]


@pytest.mark.parametrize(("seed", "words", "percent", "long"), [(1, 3, 90, 16), (2, 5, 80, 16), (3, 3, 90, 3), (4, 3, 70, 2)])
def test_against_brute_force(spark, monkeypatch, seed, words, percent, long):
    monkeypatch.setattr(jaccard, "LIST", long)
    docs = copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert answer(df, words=words, percent=percent) == brute(docs, words, percent)


def test_divide_skip():
    import numpy as np

    rng = random.Random(0)
    for _ in range(200):
        query = np.array(sorted(rng.sample(range(80), rng.randint(1, 60))), np.uint64)
        sets = [np.array(sorted(rng.sample(range(80), rng.randint(1, 60))), np.uint64) for _ in range(rng.randint(0, 9))]
        needs = [rng.randint(1, 40) for _ in sets]
        want = [len(set(query.tolist()) & set(s.tolist())) >= n for s, n in zip(sets, needs)]
        assert jaccard.divide_skip(query, sets, needs) == want


def test_parities_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        other = np.unique(np.concatenate([base[rng.integers(0, 10) :], rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)]))
        base = np.unique(base)
        n = len(np.intersect1d(base, other))
        link = 100 * n >= 90 * (len(base) + len(other) - n)
        assert not link or jaccard.maybe_near(jaccard.parities(base), [jaccard.parities(other)], 90) == [True]
        if len(other):
            need = -(-90 * (len(base) + len(other)) // 190)
            assert jaccard.divide_skip(base, [other], [need]) == [link] == [bool(jaccard.linked([base, other], 90)[0, 1])]


def test_nulls_repeats_and_other_columns(spark):
    t = " ".join(map(str, range(40)))
    rows = [(5, t, b"x"), (5, t, b"x"), (7, t, None), (None, t + " 41", None), (None, "alone in the world it is", None), (9, t + " 42", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls binary")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.near_duplicates(df).collect())
    assert got == [("5", "5"), ("5", "5"), ("7", "5"), ("9", "5"), ("None", "5"), ("None", "None")]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("5", t), ("None", "alone in the world it is")]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_links_through_rows_without_an_id_and_rows_of_one_id(spark):
    """A row without an id joins two others; of two texts of one id only the near copy goes."""
    t = [str(i) for i in range(60)]
    bridge, far = t[:-2] + ["x", "y"], ["u", "v", *t[2:-2], "x", "y"]
    rows = [(1, " ".join(t)), (None, " ".join(bridge)), (7, " ".join(far)), (7, "quite another text of the same id"), (8, "again a text that nobody else has")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(df, words=1, percent=93).collect()}
    assert got == {(1, 1, 1), (None, 1, 2), (7, 1, 1), (7, 7, 0), (8, 8, 0)}
    assert sorted(r["text"][:5] for r in jaccard.keep_one(df, words=1, percent=93).collect()) == ["0 1 2", "again", "quite"]
    nobody = df.where("doc_id IS NULL").unionByName(df.where("doc_id IS NULL"))
    assert jaccard.keep_one(nobody).count() == 1 and {r["component_id"] for r in jaccard.near_duplicates(nobody).collect()} == {None}


def test_a_full_class_map_loses_nothing(spark, monkeypatch):
    docs = copies(6)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "MAP_BITS", 12)
    want = brute(docs, 3, 90)
    assert answer(df, words=3, percent=90) == want
    kept = {r["doc_id"] for r in jaccard.keep_one(df, words=3, percent=90).collect()}
    assert kept == {i for i, (_, top) in want.items() if i == top}


def test_all_links_are_counted(spark, monkeypatch):
    """Also within groups of different texts, which the components need no more than one link a member of."""
    docs = copies(5)
    docs += [(400 + i, t) for i, (_, t) in enumerate(docs[:9])]
    sets = {i: set(jaccard.shingle_set(t, 3).tolist()) for i, t in docs}
    want = {i: sum(j != i and 100 * len(a & b) >= 90 * len(a | b) > 0 for j, b in sets.items()) for i, a in sets.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for group, small in ((512, 16), (4, 16), (512, 1)):
        monkeypatch.setattr(jaccard, "GROUP", group)
        monkeypatch.setattr(jaccard, "SMALL", small)
        got = {r["doc_id"]: r["n_links"] for r in jaccard.near_duplicates(df, words=3, percent=90).collect()}
        assert got == want


def family(seed, size, kinds=4):
    """Texts of a family share 9 in 10 of the pieces, and few are links; some come again with one word changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs = []
    for _ in range(kinds):
        line = [[word() for _ in range(6)] for _ in range(40)]
        for _ in range(size):
            t = [w for part in line for w in (part if rng.random() < 0.9 else [word()] * 3)]
            docs += [t] + [t[:-1] + [word()] for _ in range(rng.randint(0, 3) // 3)]
    return [(i * 7 % 10007, " ".join(t)) for i, t in enumerate(docs)]


def test_members_of_long_lists_never_become_pairs(spark, monkeypatch):
    """What goes to tasks as rows follows the rows of lists, not the square of a family that is no group of links."""
    docs = family(1, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    asked, alike = [], jaccard.alike

    def counted(sketches, pairs, percent):
        asked.append(pairs.count())
        return alike(sketches, pairs, percent)

    monkeypatch.setattr(jaccard, "LIST", 4)
    monkeypatch.setattr(jaccard, "alike", counted)
    got = answer(df, words=3, percent=80)
    assert got == brute(docs, 3, 80) and len({top for _, top in got.values()}) > 60
    assert len(asked) == 1, f"{asked} pairs of {len(docs)} texts"


@pytest.mark.parametrize(("seed", "cell", "room", "bundle"), [(2, 512, 1 << 24, 8), (3, 3, 1 << 24, 4096), (4, 512, 700, 4096), (5, 5, 1 << 24, 1)])
def test_cells_and_bundles_lose_no_link(spark, monkeypatch, seed, cell, room, bundle):
    docs = family(seed, 14) + [(20000 + i, t) for i, t in copies(seed)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name, value in (("LIST", 2), ("CELL", cell), ("CELL_BYTES", room), ("BUNDLE", bundle)):
        monkeypatch.setattr(jaccard, name, value)
    assert answer(df, words=3, percent=75) == brute(docs, 3, 75)


def test_parities_of_many_pairs_are_those_of_each():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sketches = [jaccard.parities(np.unique(base[rng.integers(0, 400) : rng.integers(401, 900)])) for _ in range(60)]
    x, y = (a.ravel() for a in np.meshgrid(np.arange(60), np.arange(60)))
    for percent in (50, 80, 90):
        got = jaccard.maybe_near_pairs(sketches, x, y, percent).tolist()
        assert got == [jaccard.maybe_near(sketches[i], [sketches[j]], percent)[0] for i, j in zip(x, y)] and 0 < sum(got) < len(got)
