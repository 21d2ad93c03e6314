"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting.

Every feature has a lookup table over its bins, grown by shallow trees that see that feature alone;
the strongest pairs get a small two-way table. A score is a sum of table entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import doc_crc, slices, words

FEATURES = ("log_words", "word_length", "short_words", "long_words", "symbols", "bars", "exclamations", "digits", "capitals",
            "capitalised", "distinct_words", "top_word", "same_neighbours", "repeated_triples", "duplicate_lines",
            "line_words", "line_ends", "word_ends")
SYMBOL = re.compile(rb"[#*$%&<>@^~\\{}\[\]=+_]")
ENDS = (b".", b"!", b"?", b",", b";", b":")


def text_features(text: str | None) -> list[float]:
    """Figures of one whole text; an empty or null one gives zeros."""
    found = words(text)
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    data = text.encode()
    size = sum(map(len, found))
    counts = Counter(found)
    lines = [x for x in (line.strip() for line in data.split(b"\n")) if x]
    triples = list(zip(found, found[1:], found[2:], strict=False))
    return [
        math.log1p(n), size / n, sum(len(w) < 4 for w in found) / n, sum(len(w) > 14 for w in found) / n,
        len(SYMBOL.findall(data)) / n, data.count(b"|") / n, data.count(b"!") / n, sum(map(data.count, b"0123456789")) / size,
        sum(map(str.isupper, text)) / size, sum(w[:1].isupper() for w in found) / n, len(counts) / n,
        max(counts.values()) / n, sum(map(bytes.__eq__, found, found[1:])) / n,
        1 - len(set(triples)) / len(triples) if triples else 0.0, 1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)), sum(x.endswith(ENDS) for x in lines) / len(lines), sum(w.endswith(ENDS) for w in found) / n]


def feature_matrix(texts) -> np.ndarray:
    return np.array([text_features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    """``cuts[f]``: inner bin borders; ``tables[f]``: a value for each bin; ``pairs``: (f, g, table over coarse bins)."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for b, table in zip(self.bins(x, self.cuts), self.tables, strict=True):
            out += table[b]
        if self.pairs:
            wide = self.bins(x, self.coarse)
            for f, g, table in self.pairs:
                out += table[wide[f], wide[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Step for each bin by a tree over ordered bins with gradient sums ``g`` and curvature sums ``h``."""
    total = g.sum(), h.sum()
    if depth and len(g) > 1:
        left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
        right_g, right_h = total[0] - left_g, total[1] - left_h
        gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - total[0] ** 2 / (total[1] + ridge)
        gain[(left_h < least) | (right_h < least)] = -1
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > 0:
            return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1, ridge, least),
                                   shallow_tree(g[cut:], h[cut:], depth - 1, ridge, least)])
    return np.full(len(g), total[0] / (total[1] + ridge))


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts both ways, over a two-way table of sums."""
    def corners(t: np.ndarray) -> list[np.ndarray]:
        c = t.cumsum(0).cumsum(1)
        a, rows, cols, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, rows - a, cols - a, all_ - rows - cols + a]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    cg, ch = corners(g), corners(h)
    gain = sum(a ** 2 / (b + ridge) for a, b in zip(cg, ch, strict=True)) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where(np.min(ch, axis=0) < least, -1, gain)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] <= 0:
        return 0.0, np.zeros_like(g)
    out = np.empty_like(g)
    for (a, b), rows, cols in zip(zip(cg, ch, strict=True), (slice(None, i + 1), slice(None, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                  (slice(None, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, cols] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 40,
            n_pairs: int = 8, depth: int = 2, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Gam:
    """Cyclic boosting of logistic loss: each round gives every feature one shallow tree, then each chosen pair.

    Without rows the score is one half; with one class it is that class's smoothed share everywhere.
    """
    n, share = len(y), (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(base=float(math.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        model.cuts = model.coarse = [np.empty(0)] * x.shape[1]
        model.tables = [np.zeros(1)] * x.shape[1]
        return model
    model.cuts, model.coarse = quantile_cuts(x, bins), quantile_cuts(x, coarse_bins)
    fine, wide = model.bins(x, model.cuts), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    margin = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(fine):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * shallow_tree(np.bincount(b, g, size), np.bincount(b, h, size), depth, ridge, least)
            model.tables[f] += step
            margin += step[b]

    def cells(f: int, g: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(model.coarse[f]) + 1, len(model.coarse[g]) + 1
        return wide[f] * shape[1] + wide[g], shape

    def sums(at: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    ranked = sorted(((quadrants(*sums(*cells(f, g)), ridge, least)[0], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
    chosen = [(f, g, *cells(f, g)) for gain, f, g in ranked[:n_pairs] if gain > 0]
    tables = [np.zeros(shape) for *_, shape in chosen]
    for _ in range(pair_rounds):
        for table, (_, _, at, shape) in zip(tables, chosen, strict=True):
            step = rate * quadrants(*sums(at, shape), ridge, least)[1]
            table += step
            margin += step.ravel()[at]
    model.pairs = [(f, g, t) for t, (f, g, *_) in zip(tables, chosen, strict=True)]
    return model


def matrix_column():
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(feature_matrix(texts)))

    return features


def scores(model: Gam, batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    return model.score(feature_matrix(t.as_py() for t in batch.column(column)))


def fit_quality(documents: DataFrame, labels: DataFrame, max_rows: int = 40_000, label_col: str = "quality",
                held_out_of: int = 5, **settings) -> Gam:
    """Fit on labelled documents whose crc32 of the id leaves a remainder, at most ``max_rows`` of them.

    The sample is the labels with the smallest hashes of their ids, so it does not depend on file order.
    Rows with a null id or label teach nothing; a document with several labels is taken once for each.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id")) % held_out_of != 0))
    sample = (usable.select("doc_id", F.col(label_col).cast("double").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows))
    rows = (documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows
            .select(F.col("doc_id"), F.col("y"), matrix_column()("text").alias("x")).toPandas().sort_values(["doc_id", "y"]))
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_gam(x, rows["y"].to_numpy(dtype=np.float64), **settings)


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out_of: int = 5, **settings) -> DataFrame:
    """Score of every document, one row for each input row.

    Null and empty texts are scored by their zero features; repeated rows get the same score each;
    columns other than doc_id and text are not read.
    """
    model = fit_quality(documents, labels, held_out_of=held_out_of, **settings)
    held = (doc_crc(F.col("doc_id")) % held_out_of == 0).alias("held_out")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(model, batch))], names=["doc_id", "held_out", "score"])

    scored = documents.select("doc_id", held, "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """Documents that score at least ``threshold``, with all their columns."""
    model = fit_quality(documents, labels, **settings)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(model, batch) >= threshold))

    return documents.mapInArrow(keep, documents.schema)
