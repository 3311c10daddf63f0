"""Suffix-array dedup: remove each byte covered by a string of `length` bytes that also starts earlier.

A suffix order over all documents would put each byte through a global sort. Instead each place of a text is dealt by content:
of the `length`-byte window there, the least hash of its GRAM-byte grams is its key, and equal windows have equal keys. Runs of
places with one key (about 35 places, cut at `RUN`) are a segment. Segments alone under their key hold nothing repeated; a bitmap of the
keys that several have lets the others through before anything is shuffled but keys. Of equal
segments (found by their hashes, first within a task, so that copies are pre-aggregated) only the first is kept for sorting, and
the windows of the others are removed. What is left, different segments under one key, is sorted in shards by external induced
sorting (induced.py), with common-prefix values: runs of suffixes sharing `length` bytes are equal windows, of which the
first in the order of documents stays. Segments of keys of more than CROWD different ones are dealt again by longer
grams, equal ones again dropped, so that the contexts of a passage in a third of all documents spread over the shards. Keys that
are still crowded then are told window by window: a window's first place is a pre-aggregated minimum by its hash. So a key
never brings more than CROWD segments to a shard.

The bytes of wanted segments are cut from the texts in one more scan, led by a bitmap of wanted places (a few more segments come along,
which changes nothing: what is removed are windows that start earlier too, and a key's first segments are always there). So texts are
shuffled at most once, to meet what is to be removed from them; where that is little, Spark broadcasts it.

Defined cases: null text counts as empty; order is by id, nulls last; rows of one id and different text are ordered by a hash
of the text; rows equal in id and text are one document, judged once, each giving the same result; matches never cross
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, bit_map, in_map, lean, stage
from .exact_dedup import frequent_numbers
from .induced import Sorter, suffix_blocks
from .shingles import R, mix, powers

GRAM = 32
LONGER = 88  # bytes of the grams by which windows of crowded keys are dealt again
RUN = 256
CHUNK = 2 << 20  # bytes of text handled at a time
SHARD = 2 << 20  # bytes of segments sorted at a time; what comes of them is some thirty times as much, and more than `memory` waits in files
CROWD = 2000  # different segments of a key beyond which they are dealt again
LAST = (1 << 63) - 1
PLACE = "id long, th long, start long, places long"


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(h)
    if n < w:
        return h[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """data: texts one after the other, each ending at `ends`. start, places, key, hash, and whether its key's gram occurs twice in it."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    p, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * inverse[: len(data) - gram + 1])
    w = length - gram + 1
    key = least_in_window(h, w)
    at = np.arange(len(key))
    text = np.searchsorted(ends, at, "right")
    inside = at + length <= ends[text]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]) | ~inside | np.concatenate([[True], ~inside[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    first, count = first[inside[first]], count[inside[first]]
    parts = -(-count // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + nth * RUN
    places = np.minimum(RUN, np.repeat(count, parts) - nth * RUN)
    end = start + places + length - 1
    content = mix((total[end] - total[start]) * inverse[start] + places.astype(np.uint64) * R)
    twice = np.zeros(len(start), bool)
    for lo in range(0, len(start), 50_000):
        s, k = start[lo : lo + 50_000], key[start[lo : lo + 50_000]]
        head = (h[s[:, None] + np.arange(w)] == k[:, None]).argmax(1) + s
        last = s + places[lo : lo + 50_000] - 1
        tail = last + w - 1 - (h[last[:, None] + np.arange(w)[::-1]] == k[:, None]).argmax(1)
        twice[lo : lo + 50_000] = head != tail
    return start, places, key[start], content, twice


def chunks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """ids, text hashes and texts of parts of a batch (id, th, text, ...) of about CHUNK bytes."""
    ids, th = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    lo, texts, size = 0, [], 0
    for i, t in enumerate(b.column(2)):
        texts.append((t.as_py() or "").encode())
        size += len(texts[-1])
        if size >= CHUNK or i == b.num_rows - 1:
            yield ids[lo : i + 1], th[lo : i + 1], texts
            lo, texts, size = i + 1, [], 0


def cut(ids: np.ndarray, th: np.ndarray, texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of several texts: which text, start in it, places, key, hash, twice."""
    ends = np.cumsum([len(t) for t in texts])
    start, places, key, content, twice = segments(np.frombuffer(b"".join(texts), np.uint8), ends, length, gram)
    text = np.searchsorted(ends, start, "right")
    return text, start - (ends - [len(t) for t in texts])[text], places, key, content, twice


def table(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def keyed(docs: DataFrame, length: int) -> DataFrame:
    """key, content, id, th, start, places, twice, kept: the segments of all texts; of those equal within a chunk only the
    first has kept = true."""
    names = ["key", "content", "id", "th", "start", "places", "twice", "kept"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, th, texts in chunks(b):
                text, start, places, key, content, twice = cut(ids, th, texts, length)
                order = np.lexsort((start, th[text], ids[text], content, key))
                k, c = key[order], content[order]
                kept = np.ones(len(order), bool)
                kept[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                t = text[order]
                yield table(names, [k, c, ids[t], th[t], start[order], places[order], twice[order], kept])

    return docs.mapInArrow(lean(scan), f"key long, content long, {PLACE}, twice boolean, kept boolean")


def keys_of(b: pa.RecordBatch) -> np.ndarray:
    return mix(b.column(0).to_numpy().view(np.uint64))


def places_of(ids: np.ndarray, th: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(mix(ids.astype(np.int64).view(np.uint64)) ^ th.astype(np.int64).view(np.uint64)) ^ start.astype(np.int64).view(np.uint64))


def of_repeated_keys(rows: DataFrame) -> DataFrame:
    """The rows whose key several have, or whose key's gram occurs twice in them; and by the way a few others."""
    keys = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("t")).where("k > 1 OR t").select("key"), "repeated_keys")
    known = rows.sparkSession.sparkContext.broadcast(bit_map(keys, keys_of))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_map(known.value, keys_of(b))))

    return rows.select("key", "content", "id", "th", "start", "places", "twice").mapInArrow(lean(pick), f"key long, content long, {PLACE}, twice boolean")


HOT = 512  # contents


def compare(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of segments: those equal to an earlier one; and of the others those to be sorted, with the number k of different ones of their key. Rows are
    dealt by key and content, so a key's many segments don't meet in a task; the commonest contents (HOT at most, found by a
    Misra-Gries sketch) are decided where they are, and keys of many are broadcast (see attach)."""
    rows = stage(rows, "to_compare")
    hot = rows.sparkSession.createDataFrame([(x,) for x in frequent_numbers(rows, "content", HOT)], "content long")
    place = F.struct("id", "th", "start")
    firsts = rows.join(F.broadcast(hot), "content").groupBy("key", "content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
    firsts = stage(firsts.where(F.col("c") * HOT > rows.count()), "hot_contents")  # fewer than HOT
    told = rows.join(F.broadcast(firsts), ["key", "content"], "left")
    equal = Window.partitionBy("key", "content").orderBy("id", "th", "start")
    columns = ["key", "id", "th", "start", "places", "twice"]
    cold = told.where("first IS NULL").select(*columns, (F.row_number().over(equal) > 1).alias("again"))
    told = stage(cold.unionByName(told.where("first IS NOT NULL").select(*columns, (place != F.col("first")).alias("again"))), "compared")
    firsts = told.where("NOT again")
    keys = stage(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("t")).where("k > 1 OR t").select("key", "k"), "mixed_keys")
    todo = attach(firsts, keys, "key", "k", firsts.count()).where("k IS NOT NULL").select("key", "id", "th", "start", "places", "k")
    return told.where("again"), stage(todo, "to_sort")


#: Spans as they travel to their documents: two numbers.
SPAN = np.dtype([("a", "<u4"), ("b", "<u4")])


def spans_of(rows: DataFrame) -> DataFrame:
    """A row for each document (id, th): its spans, packed."""
    listed = rows.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct(*SPAN.names))).alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2)
            flat, at = x.flatten(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])
            parts = np.empty(len(flat), SPAN)
            for i, field in enumerate(SPAN.names):
                parts[field] = flat.field(i).to_numpy(zero_copy_only=False)
            spans = [parts[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.binary())], ["id", "th", "gone"])

    return stage(listed.mapInArrow(lean(packed), "id long, th long, gone binary"), "gone")


def whole_spans(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("id", "th", F.col("start").alias("a"), (F.col("start") + F.col("places") + length - 1).alias("b"))


DATA = "key long, id long, th long, a long, data binary, crowded boolean"


def maps_of(todo: DataFrame):
    """Broadcast bitmaps of the places of segments to be sorted, and of crowded keys."""
    place = lambda b: places_of(*(b.column(i).to_numpy() for i in range(3)))
    crowded = stage(todo.where(F.col("k") > CROWD).select("key").distinct(), "crowded")
    return todo.sparkSession.sparkContext.broadcast((bit_map(todo.select("id", "th", "start"), place), bit_map(crowded, keys_of))), not crowded.isEmpty()


def data_rows(keys, ids, th, start, data: list[bytes], known) -> pa.RecordBatch:
    crowded = in_map(known.value[1], mix(keys))
    columns = [pa.array(keys.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(th.astype(np.int64)), pa.array(start), pa.array(data, pa.binary()), pa.array(crowded)]
    return pa.RecordBatch.from_arrays(columns, ["key", "id", "th", "a", "data", "crowded"])


def with_bytes(docs: DataFrame, length: int, known) -> DataFrame:
    """The segments of the texts whose places are in the map, with their bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, th, texts in chunks(b):
                text, start, places, key, _, _ = cut(ids, th, texts, length)
                hit = np.flatnonzero(in_map(known.value[0], places_of(ids[text], th[text], start)))
                data = [texts[t][s : s + n + length - 1] for t, s, n in zip(text[hit].tolist(), start[hit].tolist(), places[hit].tolist(), strict=True)]
                yield data_rows(key[hit], ids[text[hit]], th[text[hit]], start[hit], data, known)

    return docs.mapInArrow(lean(scan), DATA)


def smaller(b: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """Segments of rows with bytes cut in smaller ones by the least longer grams of their windows: key, content, id, th, start, places, twice, bytes."""
    for lo in range(0, b.num_rows, 4096):
        part = b.slice(lo, 4096)
        old, ids, th, begin = (part.column(i).to_numpy() for i in range(4))
        data = part.column(4).to_pylist()
        row, start, places, key, content, twice = cut(ids, th, data, length, LONGER)
        yield mix(key ^ old[row].view(np.uint64)), content, ids[row], th[row], begin[row] + start, places, twice, [data[r][s : s + n + length - 1] for r, s, n in zip(row.tolist(), start.tolist(), places.tolist(), strict=True)]


def dealt_again(crowded: DataFrame, length: int) -> DataFrame:
    """key, content, id, th, start, places, twice: crowded segments in smaller ones."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *columns, _ in smaller(b, length):
                yield table(["key", "content", "id", "th", "start", "places", "twice"], columns)

    return stage(crowded.mapInArrow(lean(deal), f"key long, content long, {PLACE}, twice boolean"), "dealt_again")


def smaller_with_bytes(crowded: DataFrame, length: int, known) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, _, ids, th, start, _, _, data in smaller(b, length):
                hit = np.flatnonzero(in_map(known.value[0], places_of(ids, th, start)))
                yield data_rows(key[hit], ids[hit], th[hit], start[hit], [data[i] for i in hit.tolist()], known)

    return crowded.mapInArrow(lean(scan), DATA)


def window_spans(crowded: DataFrame, length: int) -> DataFrame:
    """id, th, a, b: the windows in segments that start earlier too. The rows of common windows aren't shuffled but for their minimum."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                out = [(hashlib.blake2b(data[s : s + length], digest_size=16).digest(), i, t, a + s) for _, i, t, a, data, _ in zip(*(c.to_pylist() for c in b.slice(lo, 1024).columns), strict=True) for s in range(len(data) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k else pa.binary()) for k in range(4)], ["window", "id", "th", "a"])

    places = stage(crowded.mapInArrow(lean(windows), "window binary, id long, th long, a long"), "windows")
    firsts = places.groupBy("window").agg(F.min(F.struct("id", "th", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = attach(places, stage(firsts, "first_windows"), "window", "n", places.count())
    return found.where(F.struct("id", "th", "a") != F.col("first")).select("id", "th", "a", (F.col("a") + length).alias("b"))


class Shard:
    """Segments to be sorted together. Their bytes wait in a file beyond `memory`; numbers of a segment (32 bytes of some 200) don't."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: list[bytes] = []
        self.ids, self.th, self.begin, self.sizes = array("q"), array("q"), array("q"), array("q")

    def add(self, doc: int, th: int, begin: int, data: bytes) -> None:
        self.parts.append(data.replace(b"\0", b"\xff") + b"\0")  # 255, which UTF-8 never has, stands for 0, which ends a segment
        for x, v in ((self.ids, doc), (self.th, th), (self.begin, begin), (self.sizes, len(data) + 1)):
            x.append(v)
        self.held += len(data) + 1
        if self.held > self.memory and len(self.parts) >= 1024:
            self._write()

    def _write(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.write(b"".join(self.parts))
        self.parts = []

    def text(self) -> np.ndarray:
        if self.file is None and self.held <= self.memory:
            return np.frombuffer(b"".join(self.parts), np.uint8)
        self._write()
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r", shape=(self.held,))


def sort_shard(shard: Shard, length: int, memory: int) -> Iterator[pa.RecordBatch]:
    """Of a shard's segments: the windows that start earlier too, as spans (id, th, a, b)."""
    ids, th, begin, sizes = (np.frombuffer(x, np.int64) for x in (shard.ids, shard.th, shard.begin, shard.sizes))
    ends = np.cumsum(sizes)
    order = np.lexsort((th, ids))
    rank = np.cumsum(np.concatenate([[False], (ids[order][1:] != ids[order][:-1]) | (th[order][1:] != th[order][:-1])]))
    document = np.empty(len(ids), np.int64)
    document[order] = rank
    of_rank = order[np.searchsorted(rank, np.arange(rank[-1] + 1))]  # a segment of each document
    gone = Sorter(memory)

    def equal_windows(at: np.ndarray, new: np.ndarray) -> None:
        """Whole runs of equal windows: all but the first in the order of documents are to go."""
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        several = np.repeat(size > 1, size)
        at, new = at[several], new[several]
        if len(at):
            segment = np.searchsorted(ends, at, "right")
            where = document[segment] << 36 | (begin[segment] + at - (ends - sizes)[segment])
            first = np.flatnonzero(new)
            least = np.repeat(np.minimum.reduceat(where, first), np.diff(np.append(first, len(where))))
            again = where[where != least]
            gone.push(again, np.zeros(len(again), np.int64))

    open_run, open_new = np.zeros(0, np.int64), np.zeros(0, bool)
    for at, common in suffix_blocks(shard.text(), length, memory):
        at, new = np.concatenate([open_run, at]), np.concatenate([open_new, common < length])
        new[0] = True
        last = np.flatnonzero(new)[-1]  # its run may go on
        equal_windows(at[:last], new[:last])
        open_run, open_new = at[last:], new[last:]
    equal_windows(open_run, open_new)

    def spans(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        which, mask = of_rank[a >> 36], (1 << 36) - 1
        return table(["id", "th", "a", "b"], [ids[which], th[which], a & mask, (b & mask) + length])

    held = np.zeros(0, np.int64)  # of the last block: first and last place of a stretch that may go on
    for key, _ in gone.popped():
        places = np.concatenate([held, key.view(np.int64)])
        cut = np.flatnonzero(np.diff(places) > 1) + 1
        if len(held):
            cut = cut[cut > 1]
        a = places[np.concatenate([[0], cut])]
        b = places[np.append(cut - 1, len(places) - 1)]
        yield spans(a[:-1], b[:-1])
        held = np.array([a[-1], b[-1]])
    if len(held):
        yield spans(held[:1], held[1:])


def repeated_spans(docs: DataFrame, length: int, memory: int) -> DataFrame:
    """id, th, a, b: what is to be removed of docs (id, th, text)."""
    rows = stage(keyed(docs, length), "segments")
    again, todo = compare(of_repeated_keys(rows.where("kept")))
    spans = [whole_spans(rows.where("NOT kept"), length), whole_spans(again, length)]
    known, any_crowded = maps_of(todo)
    texts = stage(with_bytes(docs, length, known), "wanted_segments")
    pieces = texts.where("NOT crowded")
    if any_crowded:
        again, todo = compare(dealt_again(texts.where("crowded"), length))
        spans.append(whole_spans(again, length))
        known, any_crowded = maps_of(todo)
        texts = stage(smaller_with_bytes(texts.where("crowded"), length, known), "wanted_segments")
        pieces = pieces.unionByName(texts.where("NOT crowded"))
        if any_crowded:
            spans.append(window_spans(texts.where("crowded"), length))
    pieces = pieces.select("key", "id", "th", "a", "data")
    size = pieces.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(memory), None
        for b in batches:
            for key, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard.held >= SHARD and key != last:
                    yield from sort_shard(shard, length, memory)
                    shard = Shard(memory)
                shard.add(*r)
                last = key
        if shard.held:
            yield from sort_shard(shard, length, memory)

    parts = pieces.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(lean(sort), "id long, th long, a long, b long")
    for x in spans:
        parts = parts.unionByName(x)
    return parts


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, memory: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, where asked for)."""
    kind = dict(df.dtypes)[id_col]
    ids = df.select(F.col(id_col).alias("i"))
    n, distinct, nulls = ids.agg(F.count(F.lit(1)), F.countDistinct("i"), F.count(F.when(F.col("i").isNull(), 1))).first()
    text_hash = F.lit(0).cast("long") if n == distinct and not nulls else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_hash.alias("th"), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"))
    judged = docs.select("id", "th", "text")
    if n != distinct or nulls:
        judged = judged.dropDuplicates(["id", "th"])
    spans = repeated_spans(judged, length, memory).distinct()
    rows = docs.join(spans_of(spans), ["id", "th"], "left").select("id", "th", "text", "gone", "no_id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, gone in zip(batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode()
                parts, at, removed, runs = [], 0, 0, 0
                for a, b in np.frombuffer(gone.as_py() or b"", SPAN).tolist():
                    if a > at or not runs:
                        parts.append(data[at:a])
                        runs += 1
                    removed += max(0, b - max(a, at))
                    at = max(at, b)
                parts.append(data[at:])
                kept = b"".join(parts)
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names)

    names = ["id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    done = rows.mapInArrow(lean(apply), "id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return done.select(F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(id_col), *names[2:])
