"""N-gram Jaccard join by T-occurrence search, and the classes of near duplicates it gives.

Texts with equal shingle sets are one class from the start. Two sets of x and y shingles reach a Jaccard similarity of
p % only with an overlap of T = ceil(p (x + y) / (100 + p)) shingles. As in DivideSkip, a set's inverted lists are parted into short and
long ones: in one global order of shingles, rare ones first, T shared shingles leave at least one among the first
x - ceil(p x / 100) + 1 of each, at places from which T is still reachable. Only these short lists are merged (sorted by shingle over
the cluster). Long lists are then probed for the sets that came out, in three steps, of which none loses a link:

1. Parities of hashed shingle counts (half a byte a shingle) bound how far two sets differ; most candidates that are no links fall out.
2. What is left connects classes into groups, and all links lie within groups. Lists of frequent shingles, and others of more than LIST members,
   aren't paired up: each member is a candidate with the list's pivot only (its member of fewest rarer shingles), and in a second
   round, members that aren't in the list's largest group yet meet the others from which T is reachable, with their parities, in
   tasks that return one pair a connection of groups. So rows follow the lists' sizes; comparisons of parities in a task still go by
   the square of a list's members that are in different groups.
3. The sets of each group are compared exactly, every pair, in blocks: small groups by DivideSkip (for a query, inverted lists
   over its shingles; the short ones heap-merged, candidates whose count can still reach T probed for in the long ones by
   binary search), larger ones with all long lists probed at once, as a product of membership tables. Counts of links and one
   label a class leave a task, no pairs.

Sets are found by class: a text whose class isn't wanted is told by a bitmap of hashed classes (at most 2^29 bits, about 16 a class, a
bounded broadcast; false hits fall out in the join that follows), so texts are never shuffled and ids play no part.

Frequent shingles: those that at least LOCAL sets share in some slice of a partition, counted over all slices, the FREQUENT commonest of
them. That bounds what is broadcast; shingles beyond the bound only make lists longer, which pivots take care of.

Defined cases: null text counts as empty; empty sets are linked with nothing; rows without an id are linked like others, and a
component has the smallest id of its rows, null if none has one; rows of one id are separate documents; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, bit_map, give_back, in_map, lean, stage, whole_row
from .components import connected_components
from .shingles import shingle_set

LOCAL = 4
SLICE = 1 << 21  # shingles counted at a time
FREQUENT = 1_000_000
LIST = 8
BLOCK = 128  # candidates verified at a time
GROUP = 512  # members of a group compared with as many at a time
GROUP_BYTES = 16 << 20  # of their sets
SMALL = 16  # members of a group that are compared by DivideSkip
CELL = 512  # members of a long list that meet as many others in a task
CELL_BYTES = 16 << 20  # of their parities, at most
BUNDLE = 4096  # members of lists in a task's bundle
MAP_BITS = 29
EMIT = 8 << 20  # bytes of sets in a batch


def signature(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def documents(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """A row of each document: id, cls (of its shingle set), n; and rows with frequent shingles and their counts."""
    kind = dict(df.dtypes)[id_col]
    id_type = df.select(id_col).schema[0].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids_as = to_arrow_type(id_type)
        held: list[np.ndarray] = []
        size = 0

        def common() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            c = np.diff(np.append(first, len(every)))
            t, c = every[first[c >= LOCAL]], c[c >= LOCAL]
            none = [pa.nulls(len(t), k) for k in (ids_as, pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names)

        names = ["id", "cls", "n", "token", "count"]
        for b in batches:
            cls, n = [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                cls.append(signature(s))
                n.append(len(s))
                held.append(s)
                size += len(s)
                if size >= SLICE:
                    yield common()
                    size = 0
            none = [pa.nulls(len(n), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), *none], names)
        if held:
            yield common()

    return stage(df.select(id_col, F.col(text_col)).mapInArrow(lean(scan), f"id {kind}, cls binary, n long, token long, count long"), "shingled")


def prefixes(df: DataFrame, text_col: str, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """token, frequent, cls, n, place: the first shingles of each set, in the global order; and a row with the parities of each set
    (sketch; token is null). More than once where rows repeat in several partitions."""
    known = df.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent)))
    names = ["token", "frequent", "cls", "n", "place", "sketch"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = known.value
        seen: set[bytes] = set()
        for b in batches:
            parts: list[tuple[np.ndarray, np.ndarray, bytes, int]] = []
            sketches: list[bytes] = []
            for t in b.column(0):
                s = shingle_set(t.as_py(), words)
                cls = signature(s)
                if len(s) and cls not in seen:
                    seen.add(cls)
                    at = np.minimum(np.searchsorted(tokens, s), max(0, len(tokens) - 1))
                    hit = tokens[at] == s if len(tokens) else np.zeros(len(s), bool)
                    order = np.concatenate([np.flatnonzero(~hit), np.flatnonzero(hit)[np.argsort(rank[at[hit]], kind="stable")]])
                    order = order[: len(s) - -(-len(s) * percent // 100) + 1]
                    parts.append((s[order], hit[order], cls, len(s)))
                    sketches.append(parities(s))
            lens = [len(p[0]) for p in parts]
            if parts:
                cls = pa.array([p[2] for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                        pa.array(np.concatenate([p[1] for p in parts])),
                        cls.take(pa.array(np.repeat(np.arange(len(parts)), lens))),
                        pa.array(np.repeat(np.array([p[3] for p in parts], np.int64), lens)),
                        pa.array(np.concatenate([np.arange(k) for k in lens]).astype(np.int64)),
                        pa.nulls(sum(lens), pa.binary()),
                    ],
                    names,
                )
                none = [pa.nulls(len(parts), k) for k in (pa.int64(), pa.bool_(), pa.int64())]
                yield pa.RecordBatch.from_arrays([none[0], none[1], cls, pa.array([p[3] for p in parts], pa.int64()), none[2], pa.array(sketches, pa.binary())], names)

    return stage(df.select(F.col(text_col)).mapInArrow(lean(scan), "token long, frequent boolean, cls binary, n long, place long, sketch binary"), "prefixes")


def reachable(n, place, m, other, percent: int):
    """Whether sets of n and m shingles that share these places can still share enough."""
    need = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return F.least(n - place, m - other) >= need


def short_list_pairs(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows with shingles not known as frequent: candidate pairs, and the members of lists longer than LIST (as
    cls, with the token). Lists stream through, so none is held beyond LIST members."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out: list[tuple]) -> pa.RecordBatch:
            kinds = {"a": pa.binary(), "b": pa.binary(), "token": pa.int64(), "n": pa.int64(), "place": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], list(kinds))

        token, members, long = None, [], False
        for b in batches:
            out: list[tuple] = []
            for t, cls, n, place in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if t != token:
                    token, members, long = t, [], False
                elif members[-1][0] == cls:
                    continue
                for other, m, p in members[:1] if long else members:
                    if min(n - place, m - p) >= -(-percent * (n + m) // (100 + percent)):
                        out.append((min(cls, other), max(cls, other), None, None, None))
                if len(members) < LIST:
                    members.append((cls, n, place))
                else:
                    if not long:
                        out += [(c, None, t, k, p) for c, k, p in members]
                        long = True
                    out.append((cls, None, t, n, place))
                    members[-1] = (cls, n, place)
            yield flush(out)

    sorted_rows = rows.select("token", "cls", "n", "place").repartition("token").sortWithinPartitions("token", "place", "cls")
    found = stage(sorted_rows.mapInArrow(lean(pairs), "a binary, b binary, token long, n long, place long"), "candidates")
    return found.where("b IS NOT NULL").select("a", "b").distinct(), found.where("b IS NULL").select("token", F.col("a").alias("cls"), "n", "place")


def ordered_pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates of frequent shingles' lists: each member with the pivot. Pivots are found by a pre-aggregated minimum; those of
    common lists are broadcast (a bounded number, see attach)."""
    pivots = stage(rows.groupBy("token").agg(F.min(F.struct("place", "cls", "n")).alias("p"), F.count(F.lit(1)).alias("k")), "pivots")
    pairs = attach(rows, pivots, "token", "k", rows.count(), complete=True).where(F.col("cls") != F.col("p.cls"))
    pairs = pairs.where(reachable(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place"), percent))
    return pairs.select(*ordered_pair(F.col("cls"), F.col("p.cls"))).distinct()


def unconnected_pairs(rows: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b: classes of two groups that meet in a long list, at places from which T is reachable, and that parities allow to be links; enough
    of them to connect all groups so met. Groups are told apart by roots, and members of a list's largest group aren't compared with each other.

    Pairs never become rows: members go to tasks with their parities. Members reach each other when their intervals [n, hi] of lengths meet,
    so a list of CELL members at most falls into runs of meeting intervals, of which those of one group go. Runs with the same
    smallest class have much the same members and share a bundle, of about BUNDLE rows, in which a class has its parities once. Longer lists are dealt
    into cells: each block of members outside the largest group with each other block."""
    rows = rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = stage(rows, "long_lists")
    sizes = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("k", "n", "root")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("weight"), F.count(F.lit(1)).alias("roots"))
    rows = attach(rows, stage(lists, "lists"), "token", "k", rows.count(), complete=True).where("roots > 1")
    long = (F.col("k") > CELL) | (F.col("weight") > CELL_BYTES)
    blocks = lambda k, n: F.greatest(F.ceil(k / CELL), F.ceil(n / CELL_BYTES)).cast("int")

    by_length = Window.partitionBy("token").orderBy("n", "cls")
    run, hi = Window.partitionBy("token", "run"), F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    short = rows.where(~long).withColumn("apart", F.coalesce(F.max(hi).over(by_length.rowsBetween(Window.unboundedPreceding, -1)) < F.col("n"), F.lit(False)))
    short = short.withColumn("run", F.sum(F.col("apart").cast("int")).over(by_length.rowsBetween(Window.unboundedPreceding, 0)))
    short = short.select("token", "run", "cls", "n", "place", "root", F.xxhash64(F.min("cls").over(run)).alias("home"), (F.min("root").over(run) < F.max("root").over(run)).alias("several"))
    short = stage(short.where("several").drop("several"), "runs")
    bundles = short.groupBy("home").agg(F.count(F.lit(1)).alias("k"), F.greatest(F.ceil(F.count(F.lit(1)) / BUNDLE), F.ceil(F.sum("n") / CELL_BYTES)).cast("int").alias("parts"))
    short = attach(short, stage(bundles, "bundles"), "home", "k", short.count(), complete=True)
    short = short.withColumn("p", F.pmod(F.xxhash64("token", "run"), F.col("parts")).cast("int")).withColumn("q", F.lit(-1))

    others, mains = blocks(F.col("k") - F.col("main.k"), F.col("weight") - F.col("main.n")), blocks(F.col("main.k"), F.col("main.n"))
    cut = rows.where(long).withColumn("others", others).withColumn("mains", mains).withColumn("outside", F.col("root") != F.col("main.root"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("cls"), F.when(F.col("outside"), F.col("others")).otherwise(F.col("mains"))).cast("int"))
    cut = cut.withColumn("block", F.col("block") + F.when(F.col("outside"), 0).otherwise(F.col("others")))  # blocks of the largest group come after the others
    meets = F.when(F.col("outside"), F.col("others") + F.col("mains")).otherwise(F.col("others"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), meets - 1))).withColumn("home", F.col("token"))
    cut = cut.withColumn("p", F.least("block", "with")).withColumn("q", F.greatest("block", "with"))

    columns = ["home", "p", "q", "cls", "n", "root", "token", "place"]
    seats = short.select(columns).unionByName(cut.select(columns)).groupBy("home", "p", "q", "cls")
    seats = seats.agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_list(F.struct("token", "place")).alias("lists"))
    seated = sketches.join(seats, "cls").select("home", "p", "q", "cls", "n", "root", "lists", "sketch")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        at, held = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            out: list[tuple[bytes, bytes]] = []
            column = b.column(6)
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            token, place = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
            for i, (*key, cls, n, root, sketch) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 7)), strict=True)):
                if key != at:
                    out += connecting(held, percent)
                    at, held = key, {}
                held[cls] = n, root, token[ends[i] : ends[i + 1]], place[ends[i] : ends[i + 1]], sketch
            yield batch(out)
        yield batch(connecting(held, percent))

    return seated.repartition("home", "p", "q").sortWithinPartitions("home", "p", "q").mapInArrow(lean(search), "a binary, b binary")


def connecting(held: dict[bytes, tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Of classes (n, root, tokens, places, parities), pairs that may be links: each connects roots that those before it don't."""
    if len(held) < 2:
        return []
    names = list(held)
    n = np.array([r[0] for r in held.values()], np.int64)
    group = np.unique(np.array([r[1].hex() for r in held.values()]), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(held)), [len(r[2]) for r in held.values()])
    token, place = (np.concatenate([r[i] for r in held.values()]) for i in (2, 3))
    order = np.argsort(token, kind="stable")
    owner, token, left = owner[order], token[order], (n[owner] - place)[order]
    met = []
    for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(token)) + 1).tolist(), len(token)]):
        i, rest = owner[lo:hi], left[lo:hi]
        ok = np.minimum(rest[:, None], rest) >= -(-percent * (n[i][:, None] + n[i]) // (100 + percent))
        x, y = np.nonzero(np.triu(ok & (group[i][:, None] != group[i]), 1))
        met.append(i[x] * len(held) + i[y])  # owners ascend in each list
    x, y = np.divmod(np.unique(np.concatenate(met)), len(held))
    ok = maybe_near_pairs([r[4] for r in held.values()], x, y, percent)
    top = list(range(len(held)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    out = []
    for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
        g, h = find(int(group[i])), find(int(group[j]))
        if g != h:
            top[g] = h
            out.append((names[i], names[j]))
    return out


def divide_skip(query: np.ndarray, sets: list[np.ndarray], needs: list[int]) -> list[bool]:
    """Which of sets share at least so many shingles with the query."""
    if not sets:
        return []
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    shared = query[at] == tokens
    order = np.lexsort((owner[shared], at[shared]))
    lists = np.split(owner[shared][order], np.flatnonzero(np.diff(at[shared][order])) + 1) if shared.any() else []
    lists.sort(key=len, reverse=True)
    least = min(needs)
    long_lists = min(len(lists), int(least / (0.01 * math.log2(max(2, len(lists[0]) if lists else 2)) + 1)), max(0, least - 1))
    counts: dict[int, int] = {}
    for c, run in groupby(heapq.merge(*(x.tolist() for x in lists[long_lists:]))):
        counts[c] = sum(1 for _ in run)
    for x in lists[:long_lists]:
        live = np.array([c for c, k in counts.items() if k + long_lists >= least], np.int64)
        if len(live):
            place = np.minimum(np.searchsorted(x, live), len(x) - 1)
            for c in live[x[place] == live].tolist():
                counts[c] += 1
    return [counts.get(c, 0) >= need for c, need in enumerate(needs)]


def parities(s: np.ndarray) -> bytes:
    """The number of shingles, and for each of a power of two of buckets, four a shingle at least, whether an odd number of shingles fall into it."""
    buckets = max(64, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.int64(len(s)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def maybe_near(query: bytes, others: list[bytes], percent: int) -> list[bool]:
    """Whether parities allow a link: buckets of different parity hold a shingle that only one set has."""
    n, mine = np.frombuffer(query[:8], np.int64)[0], np.frombuffer(query[8:], np.uint8)
    out = []
    for o in others:
        m, bits, own = np.frombuffer(o[:8], np.int64)[0], np.frombuffer(o[8:], np.uint8), mine
        while len(bits) > len(own):  # halves add up
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        while len(own) > len(bits):
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        need = -(-percent * int(n + m) // (100 + percent))
        out.append(int(np.bitwise_count(own ^ bits).sum()) <= int(n + m) - 2 * need)
    return out


def maybe_near_pairs(sketches: list[bytes], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """maybe_near of the sketches numbered x with those numbered y, many at a time."""
    n = np.array([int.from_bytes(s[:8], "little") for s in sketches])
    width = np.array([len(s) // 8 - 1 for s in sketches])  # in words of 64 bits
    place, tables = np.zeros(len(sketches), np.int64), {}
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        place[of] = np.arange(len(of))
        tables[w] = np.frombuffer(b"".join(sketches[i][8:] for i in of), np.uint64).reshape(len(of), w)
    x, y = np.where(width[x] <= width[y], x, y), np.where(width[x] <= width[y], y, x)
    ok = np.zeros(len(x), bool)
    for v, w in np.unique(np.stack([width[x], width[y]], 1), axis=0).tolist():
        pairs = np.flatnonzero((width[x] == v) & (width[y] == w))
        small, large = tables[v], tables[w]
        while large.shape[1] > v:  # halves add up
            large = large[:, : large.shape[1] // 2] ^ large[:, large.shape[1] // 2 :]
        step = max(1, (1 << 17) // v)
        for lo in range(0, len(pairs), step):
            some = pairs[lo : lo + step]
            odd = np.bitwise_count(small[place[x[some]]] ^ large[place[y[some]]]).sum(1, dtype=np.int64)
            both = n[x[some]] + n[y[some]]
            ok[some] = odd <= both - 2 * -(-percent * both // (100 + percent))
    return ok


def class_map(classes: DataFrame) -> np.ndarray:
    return bit_map(classes.select("cls"), lambda b: hashes_of([x.as_py() for x in b.column(0)]), MAP_BITS)


def hashes_of(classes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(c[:8] for c in classes), np.uint64)


def sets_of(df: DataFrame, text_col: str, words: int, classes: DataFrame) -> DataFrame:
    """cls, shingles: the sets of classes (cls, distinct), and by the way a few others."""
    known = df.sparkSession.sparkContext.broadcast(class_map(classes))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["cls", "shingles"])

        seen: set[bytes] = set()
        out, size = ([], []), 0
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py(), words)
                cls = signature(s)
                if len(s) and cls not in seen and in_map(known.value, hashes_of([cls]))[0]:
                    seen.add(cls)
                    out[0].append(cls)
                    out[1].append(s.tobytes())
                    size += s.nbytes
                    if size >= EMIT:
                        yield batch()
                        out, size = ([], []), 0
        yield batch()

    return df.select(F.col(text_col)).mapInArrow(lean(shingle), "cls binary, shingles binary")


def alike(sketches: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that their parities don't rule out. A query's candidates come in blocks of about BLOCK; its sketch
    goes to each of its blocks."""
    pairs = stage(pairs, "pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    asked = sizes.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("binary").alias("b"))
    seats = asked.unionByName(dealt.select(F.col("b").alias("cls"), "a", "block", "b"))
    rows = sketches.join(seats, "cls").select("a", "block", "b", "sketch")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left(query: tuple, block: list[tuple]) -> list[tuple[bytes, bytes]]:
            return [(query[0], r[2]) for r, ok in zip(block, maybe_near(query[3], [r[3] for r in block], percent), strict=True) if ok]

        def batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        query, block = None, []
        for b in batches:
            out: list[tuple[bytes, bytes]] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[2] is None:
                    out += left(query, block) if query else []
                    query, block = r, []
                else:
                    block.append(r)
            yield batch(out)
        if query:
            yield batch(left(query, block))

    sorted_rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return stage(sorted_rows.mapInArrow(lean(search), "a binary, b binary"), "alike")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each two of sets are links. Of many, overlaps are summed in tables of some shingles at a time."""
    if len(sets) <= SMALL:
        links = np.zeros((len(sets), len(sets)), bool)
        for i, s in enumerate(sets[:-1]):
            links[i, i + 1 :] = divide_skip(s, sets[i + 1 :], [-(-percent * (len(s) + len(o)) // (100 + percent)) for o in sets[i + 1 :]])
        return links | links.T
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    owner, token = owner[several[token]], (np.cumsum(several) - 1)[token[several[token]]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    overlap = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(several.sum()), 4096):
        x, y = np.searchsorted(token, (lo, lo + 4096))
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[x:y], token[x:y] - lo] = 1
        overlap += held @ held.T
    both = n[:, None] + n
    links = overlap >= -(-percent * both // (100 + percent))
    np.fill_diagonal(links, False)
    return links


def labels(links: np.ndarray) -> np.ndarray:
    """For each, the first member of its component."""
    label = np.arange(len(links))
    near = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(near, label, len(links)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(df: DataFrame, text_col: str, words: int, percent: int, groups: DataFrame) -> DataFrame:
    """cls, linked, other: for each class of groups (cls, size, n, root: of several classes), in each pair of blocks, how many rows of other
    classes are linked with it, and a class of its component there. Groups of more than GROUP classes or GROUP_BYTES are
    compared in pairs of blocks."""
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") * 8 / GROUP_BYTES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("k"))
    members = stage(attach(groups, stage(sizes, "groups"), "root", "k", groups.count(), complete=True), "members")
    block, other = F.col("block"), F.col("other")
    seats = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seats = seats.select("cls", "size", "root", F.least(block, other).alias("p"), F.greatest(block, other).alias("q"), "block")
    rows = sets_of(df, text_col, words, members.select("cls")).join(seats, "cls").select("root", "p", "q", "block", "cls", "size", "shingles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(rows: dict[bytes, tuple]) -> list[tuple[bytes, int, bytes]]:
            held = list(rows.values())
            links = linked([np.frombuffer(r[6], np.uint64) for r in held], percent)
            names = list(rows)
            first = labels(links).tolist()
            part = np.array([r[3] for r in held])
            if held[0][1] != held[0][2]:  # links within a block are counted where it meets itself
                links &= part[:, None] != part
            return list(zip(names, (links @ np.array([r[5] for r in held], np.int64)).tolist(), [names[i] for i in first], strict=True))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64() if i == 1 else pa.binary()) for i in range(3)], ["cls", "linked", "other"])

        at, held = None, {}
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:3] != at:
                    out += sums(held) if held else []
                    at, held = r[:3], {}
                held[r[4]] = r
            yield batch(out)
        if held:
            yield batch(sums(held))

    sorted_rows = rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    return stage(sorted_rows.mapInArrow(lean(count), "cls binary, linked long, other binary"), "verified")


def classes_of(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents (id, cls, n), and of each class that isn't empty: cls, id (smallest), size (rows), n, root (a class of its component), linked (rows
    of other classes that are linked with it)."""
    scanned = documents(df, id_col, text_col, words)
    docs = scanned.where("cls IS NOT NULL").select("id", "cls", "n")
    common = scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()
    frequent = common.sort_values(["c", "token"])["token"].to_numpy(np.int64).view(np.uint64)
    classes = stage(docs.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n")), "classes")

    scanned = prefixes(df, text_col, words, percent, frequent)
    sketches = scanned.where("token IS NULL").select("cls", "sketch")
    rows = scanned.where("token IS NOT NULL").drop("sketch")
    often = stage(rows.where("frequent").drop("frequent").distinct(), "frequent_prefixes")
    pairs, long_rows = short_list_pairs(rows.where("NOT frequent"), percent)
    edges = alike(sketches, pairs.unionByName(pivot_pairs(often, percent)).distinct(), percent)
    roots = connected_components(edges)
    more = stage(unconnected_pairs(often.unionByName(long_rows.distinct()), roots, sketches, percent), "more_pairs")
    if not more.isEmpty():
        roots = connected_components(edges.unionByName(more))

    groups = stage(classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls").select("cls", "size", "n", "root"), "grouped")
    verified = verify(df, text_col, words, percent, groups)
    true_roots = connected_components(verified.where("cls != other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    counted = verified.groupBy("cls").agg(F.sum("linked").alias("linked"))
    facts = classes.join(true_roots.select(F.col("node").alias("cls"), "root"), "cls", "left").join(counted, "cls", "left")
    return docs, stage(facts.select("cls", "id", "size", "n", F.coalesce("root", "cls").alias("root"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked")), "class_facts")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of df: id_col, n_shingles, component_id (the smallest id of those reachable by links), n_links (how many
    other rows are linked with the row; rows of an equal set are)."""
    kind = dict(df.dtypes)[id_col]
    docs, facts = classes_of(df, id_col, text_col, words, percent)
    tops = facts.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("k"))
    per_class = attach(facts.select("cls", "size", "root", "linked"), stage(tops, "components"), "root", "k", facts.count(), complete=True)
    out = attach(docs, stage(per_class.select("cls", "size", "component_id", (F.col("linked") + F.col("size") - 1).alias("n_links")), "answers"), "cls", "size", docs.count())
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).cast(kind)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, with df's columns, without near copies: of each component the row with the smallest id stays, null ids last, and of several
    with that id one. Classes decide, not ids, so other rows of an id aren't touched. Rows of classes that are alone stay where
    they are; of the others one row a class and task is shuffled at most."""
    _, facts = classes_of(df, id_col, text_col, words, percent)
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("cls").alias("cls"))
    tops = facts.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("rows"), F.min(best)["cls"].alias("cls"))
    several = stage(tops.where("rows > 1"), "several")
    crowded = stage(attach(facts.select("cls", "root"), several.select("root", "k"), "root", "k", facts.count()).where("k IS NOT NULL").select("cls"), "crowded")
    known = df.sparkSession.sparkContext.broadcast(class_map(crowded))

    @F.pandas_udf("binary")
    def class_if_crowded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [signature(s) if len(s := shingle_set(t, words)) else None for t in texts]
            there = in_map(known.value, hashes_of([c or bytes(8) for c in found]))
            yield pd.Series([c if c and x else None for c, x in zip(found, there.tolist(), strict=True)], dtype=object)
        give_back()

    rows = df.select(whole_row(df), F.col(id_col).alias("id"), class_if_crowded(F.col(text_col)).alias("cls"))
    rows = stage(rows, "classed")
    first = Window.partitionBy("cls").orderBy(F.col("id").asc_nulls_last())
    one = rows.where("cls IS NOT NULL").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    lost = crowded.join(several.select("cls"), "cls", "left_anti")
    return rows.where("cls IS NULL").select("row.*").unionByName(one.join(lost.hint("merge"), "cls", "left_anti").select("row.*"))
