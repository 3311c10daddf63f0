"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

Documents are tokenised once and cut into pieces of the sequence length and a rest. Only the histogram of piece lengths
(one number a length) goes to the driver, where lengths are placed longest first, each into the packs with the
shortest content, by counts: a pack pattern is a list of lengths and how many packs have it. Pieces then find their
places by their rank among the pieces of the same length: ranks count over chunks (common.running_total), so that a
common length isn't ranked in one task, and a table of rank intervals, whose size depends on the sequence length
alone, maps them to sequence and offset.

Defined cases: null text counts as empty and gives the single end id; whole texts are tokenised; rows with
equal ids are separate documents; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, running_total, stage

KNOWN_WORDS = 32 << 20  # bytes of a worker's word cache, about
SLICE = 1 << 20  # characters tokenised at a time


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Byte-level vocabularies spell a byte as the character of its number, or if that isn't printable as the next of those from 256 on.
SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


#: Characters beside which others are rare: Latin letters and signs and common punctuation, which normalisation only lowers, each apart.
LATIN = r"\x00-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e"
OTHERS = re.compile(f"[^{LATIN}]")
#: What the pre-tokenizer cuts text of such characters into, in lower case: runs of letters, single numbers, and runs of others but white space.
LETTER, NUMBER, BLANK = r"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
PIECE = re.compile(f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{LETTER}{NUMBER}{BLANK}]+")


class Words(dict):
    """The ids of words and of pieces of text, as little-endian unsigned 32-bit numbers; encoded when first asked for. When the cache is
    full, words that it lacks (rare ones: frequent words came early) are encoded each time."""

    def __init__(self, path: str):
        self.encode, self.model, self.size = tokenizer(path).encode, tokenizer(path).model.tokenize, 0
        self.added = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]  # told before anything is cut

    def __missing__(self, w: str) -> bytes:
        if w.isalpha() and w.islower() and w == w.lower() and (w.isascii() or is_normalized("NFC", w)):  # one piece, as it is
            ids = array("I", [t.id for t in self.model(w if w.isascii() else w.encode().decode("latin-1").translate(SPELLING))]).tobytes()
        elif w.isascii() and w.isalpha():  # the normaliser lowers letters
            ids = self[w.lower()]
        elif w[-1:] in (".", ",") and w[-2:-1].lower().isalpha():  # the pre-tokenizer cuts behind a letter
            ids = self[w[:-1]] + self[w[-1]]
        else:
            ids = array("I", self.encode(w, add_special_tokens=False).ids).tobytes()
        if self.size < KNOWN_WORDS:
            self[w] = ids
            self.size += len(w) + len(ids) + 200  # two objects and an entry
        return ids

    def cut(self, text: str) -> list[str]:
        """Parts of a text to be encoded apart: pieces, or words between blanks where it has rarer characters or added tokens."""
        if OTHERS.search(text) or any(a in text for a in self.added):
            return text.replace("\n", " ").replace("\t", " ").split(" ")
        return PIECE.findall(text.lower())


known_words = cache(Words)  # of this worker


def encode_all(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, equal to the tokenizer's over the whole text.

    For a tokenizer that lowers letters and whose pre-tokenizer splits at white space, drops it, and parts runs of letters, single numbers and runs of
    other signs: these, or words between blanks, line feeds and tabs, are encoded apart, and the cached ones once."""
    words = known_words(path)
    return [b"".join(map(words.__getitem__, words.cut(t))) for t in texts]


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Parts of a batch with texts of about SLICE characters together."""
    start, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= SLICE or i == batch.num_rows - 1:
            yield batch.column(0).slice(start, len(texts)), texts
            start, texts, size = i + 1, [], 0


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens (and ids, where asked for) of each piece."""
    kind = dict(df.dtypes)[id_col]
    end = array("I", [end_id]).tobytes()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in slices(b):
                rows = []
                for i, data in enumerate(encode_all(texts, tokenizer_path)):
                    data += end
                    n = len(data) // 4
                    for s in range(0, n, length):
                        part = data[4 * s : 4 * (s + length)]
                        rows.append((i, s, len(part) // 4, zlib.crc32(part), n, part))
                columns = [pa.array([r[k] for r in rows], pa.binary() if k == 5 else pa.int64()) for k in range(1, 5 + with_ids)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), *columns], names)

    return df.select(id_col, F.col(text_col)).mapInArrow(lean(cut), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, list[int]]]:
    """Pack patterns: (number of packs, lengths, longest first)."""
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by free space
    done: list[tuple[int, list[int]]] = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        space = length
        while left:
            while space >= size and not open_packs.get(space):
                space -= 1
            if space < size:  # nothing fits: new packs, each of which stays the shortest until it is full
                times = length // size
                for packs, k in ((left // times, times), (1, left % times)):
                    if packs and k:
                        (done if k * size == length else open_packs[length - k * size]).append((packs, [size] * k))
                break
            packs, pattern = open_packs[space].pop()
            used = min(packs, left)
            if packs > used:
                open_packs[space].append((packs - used, pattern))
            left -= used
            (done if space == size else open_packs[space - size]).append((used, [*pattern, size]))
    return done + [p for space in sorted(open_packs) for p in open_packs[space]]


def intervals(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of that length a pack, offset), by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for packs, lengths in patterns:
        offset = 0
        for size in dict.fromkeys(lengths):
            times = lengths.count(size)
            rows.append((size, used[size], sequence, times, offset))
            used[size] += packs * times
            offset += size * times
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, length: int = 2048, chunk_rows: int = 256) -> DataFrame:
    """parts (staged; id, start, length and more) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    table = intervals(shortest_pack_first(counts, length))
    sizes = F.broadcast(parts.sparkSession.createDataFrame(list(counts.items()), "length long, n long"))  # a row a length
    place = F.pmod(F.xxhash64("id", "start"), F.lit(1 << 32))
    chunk = F.floor(place * F.ceil(F.col("n") / chunk_rows) / F.lit(1 << 32))
    rows = parts.join(sizes, "length").withColumn("place", place).withColumn("chunk", chunk)
    ranked = running_total(rows, "length", "chunk", [F.col("place"), F.col("id").asc_nulls_last(), F.col("start"), F.col("ids_crc32")], F.lit(1), "rank")
    starts = table[:, 0] << 44 | table[:, 1]
    names = parts.columns

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            rank = rank - 1
            t = table[np.searchsorted(starts, size << 44 | rank, "right") - 1]
            place = rank - t[:, 1]
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(t[:, 2] + place // t[:, 3]), pa.array(t[:, 4] + place % t[:, 3] * size)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes)
    return ranked.select(*names, "rank").mapInArrow(lean(seat), f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, where asked for)."""
    parts = stage(pieces(df, tokenizer_path, id_col, text_col, length, end_id, with_ids), "pieces")
    return pack(parts, length).withColumnRenamed("id", id_col)
