"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; cyclically boosted shallow trees learn for each feature a table of one number a bin, then
for the most useful pairs of features a table of one number a pair of coarse bins. A score is the logistic function
of the sum of the looked-up numbers. Training takes a bounded sample of labelled documents (`sample_rows`); scoring
reads every whole text once, in place, without a shuffle.

Defined cases: null and empty texts have all features 0 and are scored like any other; null labels are not learnt from;
several labels of a document all count; without any label every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, whole_row

NAMES = ("words", "word_length", "upper", "digits", "symbols", "marks", "bars", "stops", "commas", "wide", "distinct", "twins", "line_words", "same_lines", "top_word", "long_words")


def features(text: str | None) -> list[float]:
    words = (text or "").split()
    if not words:
        return [0.0] * len(NAMES)
    data = text.encode("utf-8", "replace")
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), len(data)
    lines = [x for x in text.split("\n") if x]
    distinct = Counter(words)
    twins = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = c[65:91].sum() + c[97:123].sum() + c[128:].sum()
    return [
        float(np.log1p(n)),
        size / n,
        c[65:91].sum() / max(1, letters),
        c[48:58].sum() / size,
        c[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 126]].sum() / n,
        (c[33] + c[63]) / n,
        (c[124] + c[123] + c[125] + c[91] + c[93]) / n,
        c[46] / n,
        (c[44] + c[59] + c[58]) / n,
        c[128:].sum() / size,
        len(distinct) / n,
        twins / n,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        max(distinct.values()) / n,
        sum(len(w) > 25 for w in distinct) / n,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]  # of each feature's bins
    base: float = 0.0
    main: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        s = np.full(len(x), self.base)
        for t, i in zip(self.main, b, strict=False):
            s += t[i]
        for i, j, t in self.pairs:
            s += t[coarse(b[i], self.edges[i]), coarse(b[j], self.edges[j])]
        return 1 / (1 + np.exp(-s))


GRID = 8


def coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return bins * GRID // (len(edges) + 1)


def split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best cut of a row of bins into two: gain, place."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of depth two over the bins, as the bins' leaf values."""
    out = np.zeros(len(g))
    _, at = split(g, h, ridge)
    for lo, hi in ((0, at), (at, len(g))):
        _, mid = split(g[lo:hi], h[lo:hi], ridge)
        for a, b in ((lo, lo + mid), (lo + mid, hi)):
            if b > a:
                out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four by one place on each axis: gain, leaf values on the grid."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best = (-1.0, np.zeros_like(g))
    for i in range(1, GRID):
        for j in range(1, GRID):
            boxes = ((0, i, 0, j), (0, i, j, GRID), (i, GRID, 0, j), (i, GRID, j, GRID))
            sums = [[c[b, d] - c[a, d] - c[b, e] + c[a, e] for c in (cg, ch)] for a, b, e, d in boxes]
            gain = sum(x * x / (y + ridge) for x, y in sums)
            if gain > best[0]:
                values = np.zeros_like(g)
                for (a, b, e, d), (x, y) in zip(boxes, sums, strict=True):
                    values[a:b, e:d] = x / (y + ridge)
                best = (float(gain), values)
    return best


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 200, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> Model:
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, bins) / bins)) if len(x) else np.zeros(0) for i in range(len(NAMES))]
    m = Model(edges)
    if not len(x):
        return m
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    m.base = float(np.log(p0 / (1 - p0)))
    b = m.bins(x)
    m.main = [np.zeros(len(e) + 1) for e in edges]
    s = np.full(len(x), m.base)
    for _ in range(rounds):
        for i, table in enumerate(m.main):
            p = 1 / (1 + np.exp(-s))
            step = rate * shallow_tree(np.bincount(b[i], y - p, len(table)), np.bincount(b[i], p * (1 - p), len(table)), ridge)
            table += step
            s += step[b[i]]
    cells = [coarse(v, e) for v, e in zip(b, edges, strict=True)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, at = 1 / (1 + np.exp(-s)), cells[i] * GRID + cells[j]
        return tuple(np.bincount(at, w, GRID * GRID).reshape(GRID, GRID) for w in (y - p, p * (1 - p)))

    gains = sorted(((quadrants(*grid(i, j), ridge)[0], i, j) for i in range(len(NAMES)) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((GRID, GRID))) for _, i, j in gains[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in m.pairs:
            step = rate * quadrants(*grid(i, j), ridge)[1]
            table += step
            s += step[cells[i], cells[j]]
    return m


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; -1 of a null id. Fold 1 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> Model:
    """Train on at most sample_rows labels outside the held-out fold, those of the smallest id hashes."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__y").isNotNull() & F.col("__id").isNotNull() & (fold(F.col("__id")) != 1))
    some = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample_rows))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(some, "__id")
    found = sorted((r["__id"], r["__y"], r["x"]) for r in rows.select("__id", "__y", measured("__text").alias("x")).collect())
    return train(np.array([x for _, _, x in found]).reshape(-1, len(NAMES)), np.array([float(y > 0) for _, y, _ in found]))


def scorer(model: Model):
    """The score of a text, as a function of columns."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, len(NAMES))))
        give_back()

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> DataFrame:
    """Per row: id_col, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    rows = docs.select(F.col(id_col), scorer(model)(F.col(text_col)).alias("score"))
    return rows.select(id_col, (fold(F.col(id_col)) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that score at least threshold, with docs' own columns."""
    score = scorer(fit(docs, labels, **options))(F.col(options.get("text_col", "text")))
    return docs.select(whole_row(docs), score.alias("score")).where(F.col("score") >= threshold).select("row.*")
