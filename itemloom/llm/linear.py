"""Hashed sparse features and logistic regression on a bounded labelled sample.

The sample is drawn by a hash of the id, at most ``per_class`` rows of each class,
so it doesn't grow with the corpus. Its features are counted in Spark, of whole texts
of any length; only the sparse rows of the sample reach the driver, where the weights are
fitted. Scores are means of weights over a text's features, which needs no sorting per
text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import bytescan

DIMS = 1 << 18
#: Rows of each class that a model learns from, at most.
PER_CLASS = 2000
#: Features are shares of the text times this.
SCALE = 30.0
U64 = np.uint64

Features = Callable[[bytescan.Chunk], tuple[np.ndarray, np.ndarray]]


def text_features(c: bytescan.Chunk, shown: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and byte trigrams, repeats included: indices and row offsets.

    Words fall in the lower half of the dimensions, trigrams in the upper half. The last
    ``shown`` bytes belong to the next piece of a text: trigrams reach into them.
    """
    n = len(c.data) - shown
    w = bytescan.words(bytescan.Chunk(c.first, c.rows, c.data[:n], np.minimum(c.offsets, n)))
    word = (bytescan.range_hashes(c.data[:n], w.start, w.end) & U64(DIMS // 2 - 1)).astype(np.int64)
    d = c.data.astype(U64)
    gram = (bytescan.mix(d[:-2] | (d[1:-1] << U64(8)) | (d[2:] << U64(16))) & U64(DIMS // 2 - 1)).astype(np.int64) + DIMS // 2
    ends = np.minimum(np.maximum(c.offsets[1:] - 2, c.offsets[:-1]), len(gram))
    begins = np.minimum(c.offsets[:-1], len(gram))
    gram_offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    offsets = w.offsets + gram_offsets
    # A row's words come first, then its trigrams; those that span two rows are left out.
    index = np.empty(offsets[-1], np.int64)
    is_word = np.zeros(len(index) + 1, np.int8)
    np.add.at(is_word, offsets[:-1], 1)
    np.add.at(is_word, offsets[:-1] + w.counts, -1)
    is_word = np.cumsum(is_word[:-1], dtype=np.int8) > 0
    kept = np.zeros(len(gram) + 1, np.int8)
    np.add.at(kept, begins, 1)
    np.add.at(kept, ends, -1)
    index[is_word] = word
    index[~is_word] = gram[np.cumsum(kept[:-1], dtype=np.int8) > 0]
    return index, offsets


def parts(c: bytescan.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text_features`` of a chunk; those of one long text in parts that are its own when put together."""
    for piece, shown in bytescan.pieces(c, 2):
        yield text_features(piece, shown)


def halves(index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words and how many trigrams each row has, (2, rows)."""
    upper = bytescan.sums(index >= DIMS // 2, offsets)
    return np.stack([np.diff(offsets) - upper, upper])


@dataclass
class Sparse:
    """Rows of a sparse matrix, in row order."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    rows: int

    def margins(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], self.rows)

    def take(self, which: np.ndarray) -> Sparse:
        place = np.full(self.rows, -1)
        place[which] = np.arange(len(which))
        row = place[self.row]
        kept = np.flatnonzero(row >= 0)
        kept = kept[np.argsort(row[kept], kind="stable")]
        return Sparse(row[kept], self.index[kept], self.value[kept], len(which))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int] = PER_CLASS, more: tuple[str, ...] = ()) -> DataFrame:
    """At most ``per_class`` rows of each class (or of 0 and 1), by a hash of the id: doc_id, text, ``more``, label.

    An id with several labels takes the greatest, one with several texts the least; null
    ids, labels and texts are left out.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(label))
    most = (per_class, per_class) if isinstance(per_class, int) else per_class
    chosen = [known.filter(F.col("label") == k).orderBy(order, "doc_id").limit(most[k]) for k in (0, 1)]
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.struct("text", *more).alias("row")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("row").alias("row"), F.first("label").alias("label")).select("doc_id", "row.*", "label")


def prior_shift(labels: DataFrame, label: str, y: np.ndarray) -> float:
    """What to add to log odds fitted on a sample with its own class shares.

    The difference between the log odds of the classes among all labelled rows and
    in the sample; 0 where a class is missing.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("k"))
    n = known.agg(F.count_if(F.col("k") == 1).alias("one"), F.count_if(F.col("k") == 0).alias("zero")).first()
    one, zero = int((y == 1).sum()), int((y == 0).sum())
    return float(np.log(n.one / n.zero) - np.log(one / zero)) if min(n.one, n.zero, one, zero) else 0.0


@dataclass
class Counted:
    """Distinct features of a text (a row for each) and how often it has them."""

    features: np.ndarray
    counts: np.ndarray


def counted(features: np.ndarray) -> Counted:
    if features.shape[1] > 1:
        return Counted(*np.unique(features, axis=0, return_counts=True))
    found, n = np.unique(features[:, 0], return_counts=True)
    return Counted(found[:, None], n)


def counted_texts(c: bytescan.Chunk) -> list[Counted]:
    """Of each row of a chunk its counted ``text_features``."""
    found = [[counted(index[a:b].astype(np.int32)[:, None]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] for index, offsets in parts(c)]
    return found[0] if len(found) == 1 else [_together([x for (x,) in found])]


def _together(pieces: list[Counted]) -> Counted:
    features, place = np.unique(np.concatenate([x.features[:, 0] for x in pieces]), return_inverse=True)
    return Counted(features[:, None], np.bincount(place, np.concatenate([x.counts for x in pieces])).astype(np.int64))


def extract(sample: DataFrame, features: Features | None = None, width: int = 1) -> tuple[np.ndarray, np.ndarray, list[Counted]]:
    """Ids, labels and feature counts of a bounded sample, in id order; features are ``width`` numbers each.

    Without ``features`` they are those of ``text_features``.
    """

    def counts_of(c: bytescan.Chunk) -> list[Counted]:
        if features is None:
            return counted_texts(c)
        index, offsets = features(c)
        return [counted(index[a:b].astype(np.int32).reshape(-1, width)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in bytescan.chunks(batch.column(1)):
                own = counts_of(c)
                packed = [pa.array([x.astype(np.int32).tobytes() for x in column], pa.binary()) for column in ([x.features for x in own], [x.counts for x in own])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), batch.column(2).slice(c.first, c.rows), *packed], names=["doc_id", "label", "features", "counts"])

    got = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, features binary, counts binary").toArrow()
    ids, y = got["doc_id"].to_numpy(), got["label"].to_numpy()
    rows = [Counted(np.frombuffer(f.as_buffer(), np.int32).reshape(-1, width), np.frombuffer(n.as_buffer(), np.int32)) for f, n in zip(got["features"], got["counts"], strict=True)]
    order = np.lexsort((y, ids))
    return ids[order], y[order], [rows[i] for i in order]


def sparse(texts: list[Counted]) -> Sparse:
    """Shares of each text's words and of its trigrams."""
    rows, indices, values = [], [], []
    for r, x in enumerate(texts):
        index = x.features[:, 0]
        half = np.searchsorted(index, DIMS // 2)
        share = x.counts.astype(np.float64)
        for part in (slice(0, half), slice(half, None)):
            share[part] /= max(share[part].sum(), 1)
        rows.append(np.full(len(index), r))
        indices.append(index.astype(np.int64))
        values.append(share * SCALE)
    if not rows:
        return Sparse(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0)
    return Sparse(np.concatenate(rows), np.concatenate(indices), np.concatenate(values), len(texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: Sparse, y: np.ndarray, dims: int = DIMS, epochs: int = 12, batch: int = 128, rate: float = 0.5, decay: float = 1e-5, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad over small batches in a fixed random order, from ``start`` or 0."""
    w, bias, square, bias_square = np.zeros(dims) if start is None else start.copy(), 0.0, np.full(dims, 1e-8), 1e-8
    if not x.rows:
        return w, bias
    by_row = np.concatenate([[0], np.cumsum(np.bincount(x.row, minlength=x.rows))])
    random = np.random.default_rng(7)
    for _ in range(epochs):
        order = random.permutation(x.rows)
        for k in range(0, x.rows, batch):
            some = order[k : k + batch]
            at = np.concatenate([np.arange(by_row[r], by_row[r + 1]) for r in some])
            row = np.repeat(np.arange(len(some)), by_row[some + 1] - by_row[some])
            index, value = x.index[at], x.value[at]
            error = (sigmoid(np.bincount(row, value * w[index], len(some)) + bias) - y[some]) / len(some)
            used, place = np.unique(index, return_inverse=True)
            g = np.bincount(place, value * error[row], len(used)) + decay * w[used]
            square[used] += g * g
            w[used] -= rate * g / np.sqrt(square[used])
            bias_square += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_square)
    return w, bias


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method.

    Targets are drawn in from 0 and 1 as Platt advises, so that perfectly parted
    classes keep finite values. Without both classes the margin is left as it is.
    """
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(design @ beta)
        gradient = design.T @ (p - t)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        beta -= step / max(1.0, size / 5)
        if size < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Calibrated:
    """A linear model over means of hashed features, with its calibration."""

    weights: np.ndarray  # float32
    bias: float
    slope: float
    offset: float

    def margins(self, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Margins of the rows of a chunk, of which ``found`` are the features, in one part or several."""
        total, n = 0.0, 0
        for index, offsets in found:
            w, upper = self.weights[index].astype(np.float64), index >= DIMS // 2
            total = total + np.stack([bytescan.sums(np.where(half, w, 0.0), offsets) for half in (~upper, upper)])
            n = n + halves(index, offsets)
        return self.bias + (total / np.maximum(n, 1)).sum(0) * SCALE

    def probabilities(self, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(found) + self.offset)


def fit_calibrated(ids: np.ndarray, y: np.ndarray, x: Sparse, shift: float = 0.0) -> Calibrated:
    """Fit on four fifths of the rows, calibrate on the other fifth (by id hash).

    ``shift`` takes the log odds from the sample's class shares to the corpus's.
    """
    held = bytescan.mix(ids.astype(np.int64).view(U64)) % U64(5) == U64(0)
    if held.sum() < 20 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), bool)
    w, bias = fit_logistic(x.take(np.flatnonzero(~held)), y[~held])
    margin = x.margins(w) + bias
    judge = held if held.any() else np.ones(len(y), bool)
    slope, offset = fit_platt(margin[judge], y[judge])
    return Calibrated(w.astype(np.float32), bias, slope, offset + shift)
