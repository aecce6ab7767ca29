"""Quality classifier by co-training of two views.

The text view sees hashed words and byte trigrams. The metadata view sees the
page's record: source, language, length and layout measures, each in coarse steps.
Both start as naive Bayes models of a labelled sample. In each round every
document of the table is scored by both views; those that one view is certain about are
pseudo-labelled for the other, and Spark adds up their features by class. The sums
and the sample's make the next models, whose weights are then fitted to the sample. At the
end a logistic model of both calibrated log odds joins the views, and every document is
scored in one pass.

A quarter of the sample calibrates the views, another quarter fits the joint model, and
half is learned from. The sample is bounded, see PER_CLASS; what is exchanged is not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import bytescan, linear

PER_CLASS = 1500
ROUNDS = 2
#: Least probability of a pseudo-label.
CERTAIN = 0.9
#: Mass that each feature is given beside what is seen, in documents.
SMOOTHING = 0.05
KEEP_FROM = 0.5
META_DIMS, META_FEATURES = 1 << 12, 9
SCHEMA = "doc_id long, p_text double, p_meta double, quality double, kept boolean"
U64 = np.uint64

_UPPER, _DIGIT, _SYMBOL, _LINE = (np.zeros(256, bool) for _ in range(4))
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"]] = True
_LINE[10] = True


def metadata(c: bytescan.Chunk, source: list, lang: list) -> np.ndarray:
    """Hashed metadata features of each row, as many for every row."""
    size = np.diff(c.offsets)
    counts = 0
    for piece, _ in bytescan.pieces(c):
        own = [bytescan.words(piece).counts, *(bytescan.sums(mask[piece.data], piece.offsets) for mask in (_LINE, _UPPER, _DIGIT, _SYMBOL))]
        counts = counts + np.stack(own)
    n_words, lines = counts[0], counts[1] + 1
    share = counts[2:] / np.maximum(size, 1)
    steps = [
        np.log2(size + 1).astype(int),
        np.log2(lines).astype(int),
        np.log2(n_words / lines + 1).astype(int),
        np.minimum(size / np.maximum(n_words, 1) * 2, 60).astype(int),
        np.log2(share[0] * 256 + 1).astype(int),
        np.log2(share[1] * 256 + 1).astype(int),
        np.log2(share[2] * 256 + 1).astype(int),
    ]
    named = [[hash_text(x) for x in values] for values in (source, lang)]
    columns = [np.asarray(s, np.int64).astype(U64) for s in steps] + [np.array(v, U64) for v in named]
    return np.stack([bytescan.mix(v * U64(31) + U64(k + 1)) & U64(META_DIMS - 1) for k, v in enumerate(columns)], 1).astype(np.int64)


def hash_text(x: str | None) -> int:
    """A small fixed hash of a short name; null has its own."""
    out = 7 if x is None else 17
    for b in (x or "").encode():
        out = (out * 131 + b) % 2147483647
    return out


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang; null where the documents lack one of the last two."""
    own = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", "text", *own)


def _extract(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, linear.Sparse, linear.Sparse]:
    """Ids, labels, text shares and metadata features of a bounded sample, in id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for c in bytescan.chunks(batch.column(1)):
                rows = slice(c.first, c.first + c.rows)
                own = linear.counted_texts(c)
                packed = [pa.array([x.astype(np.int32).tobytes() for x in column], pa.binary()) for column in ([x.features for x in own], [x.counts for x in own], metadata(c, source[rows], lang[rows]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), batch.column(4).slice(c.first, c.rows), *packed], names=["doc_id", "label", "features", "counts", "meta"])

    got = sample.mapInArrow(run, "doc_id long, label int, features binary, counts binary, meta binary").toArrow()
    ids, y = got["doc_id"].to_numpy(), got["label"].to_numpy()
    order = np.lexsort((y, ids))
    features, counts, meta = ([np.frombuffer(x.as_buffer(), np.int32) for x in got[name]] for name in ("features", "counts", "meta"))
    texts = linear.sparse([linear.Counted(features[i][:, None], counts[i]) for i in order])
    metas = np.array([meta[i] for i in order], np.int64).reshape(len(order), META_FEATURES)
    return ids[order], y[order], texts, _meta_matrix(metas)


def _meta_matrix(meta: np.ndarray) -> linear.Sparse:
    rows, width = meta.shape
    return linear.Sparse(np.repeat(np.arange(rows), width), meta.ravel(), np.ones(rows * width), rows)


@dataclass
class View:
    """Weights of a view, and what makes calibrated log odds of its margins."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def odds(self, margins: np.ndarray) -> np.ndarray:
        return self.slope * (margins + self.bias) + self.offset


def naive_bayes(sums: np.ndarray, halves: int) -> np.ndarray:
    """Log ratio of each feature's smoothed share in class 1 and 0; ``sums`` is (2, dims).

    Shares are of each half of the dimensions, as words and trigrams are kinds of their own.
    """
    smooth = (sums + SMOOTHING / sums.shape[1]).reshape(2, halves, -1)
    share = np.log(smooth / smooth.sum(2, keepdims=True))
    return (share[1] - share[0]).ravel()


def fit_view(x: linear.Sparse, y: np.ndarray, learn: np.ndarray, judge: np.ndarray, given: np.ndarray, halves: int) -> View:
    """Naive Bayes of the sample's and the given sums, fitted on to the rows to learn from, calibrated on those to judge by."""
    own = x.take(learn)
    sums = given.copy()
    for k in (0, 1):
        sums[k] += np.bincount(own.index, own.value * (y[learn] == k)[own.row], given.shape[1])
    prior = naive_bayes(sums, halves)
    slope, offset = linear.fit_platt(own.margins(prior), y[learn])
    w, bias = linear.fit_logistic(own, y[learn] - 0.0, given.shape[1], start=slope * prior)
    slope, offset = linear.fit_platt(x.margins(w)[judge] + bias, y[judge])
    return View(w.astype(np.float32), bias, slope, offset)


@dataclass
class CoTrained:
    text: View
    meta: View
    joint: tuple[float, float, float]  # weights of the two log odds, and a bias

    def odds(self, texts: Iterable[tuple[np.ndarray, np.ndarray]], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both views' calibrated log odds of a chunk's rows, of its ``linear.parts`` and ``metadata``."""
        means = linear.Calibrated(self.text.weights, 0.0, 1.0, 0.0).margins(texts)
        return self.text.odds(means), self.meta.odds(self.meta.weights[meta].sum(1, dtype=np.float64))

    def joined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a, b, bias = self.joint
        return linear.sigmoid(a * np.clip(text, -12, 12) + b * np.clip(meta, -12, 12) + bias)


def exchanged(rows: DataFrame, views: CoTrained) -> tuple[np.ndarray, np.ndarray]:
    """Feature sums by class (2, dims) of all rows: for the text view those that metadata is certain of, and conversely.

    A task adds up its rows, Spark adds up the tasks; the driver gets as many numbers as
    there are dimensions. ``rows`` are doc_id, text, source, lang.
    """
    limit = float(np.log(CERTAIN / (1 - CERTAIN)))
    dims = (linear.DIMS, META_DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, n)) for n in dims]
        for batch in batches:
            source, lang = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for c in bytescan.chunks(batch.column(1)):
                rows = slice(c.first, c.first + c.rows)
                meta = metadata(c, source[rows], lang[rows])
                # A chunk's features are made once, those of a long text anew for each use.
                once = None if bytescan.in_pieces(c) else list(linear.parts(c))
                odds = views.odds(once or linear.parts(c), meta)
                n = sum(linear.halves(*found) for found in once or linear.parts(c))
                some = n[0] > 0
                sure = [[(sign * x >= limit) & some for x in odds] for sign in (-1, 1)]
                for k in (0, 1):
                    sums[1][k] += np.bincount(meta[sure[k][0]].ravel(), minlength=dims[1])
                if not any(by_meta.any() for _, by_meta in sure):
                    continue
                for index, offsets in once or linear.parts(c):
                    row = np.repeat(np.arange(c.rows), np.diff(offsets))
                    share = linear.SCALE / n[(index >= linear.DIMS // 2).astype(np.int8), row]
                    for k in (0, 1):
                        chosen = sure[k][1][row]
                        sums[0][k] += np.bincount(index[chosen], share[chosen], dims[0])
        for v, x in enumerate(sums):
            used = np.flatnonzero(x.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), v, np.int32)), pa.array(used), pa.array(x[0, used]), pa.array(x[1, used])], names=["view", "slot", "zero", "one"])

    got = rows.mapInArrow(run, "view int, slot long, zero double, one double").groupBy("view", "slot").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
    out = [np.zeros((2, n)) for n in dims]
    view, slot = got["view"].to_numpy(), got["slot"].to_numpy()
    for v in (0, 1):
        for k, name in enumerate(("zero", "one")):
            out[v][k, slot[view == v]] = np.round(got[name].to_numpy()[view == v], 6)
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on at most ``per_class`` rows of each label, and on what the views say of all documents.

    Null ids, labels and texts aren't learned from. Labelled documents are exchanged
    like all others: by the views' word, not by their label.
    """
    rows = _columns(docs).filter(F.col("text").isNotNull())
    ids, y, x_text, x_meta = _extract(linear.labelled(rows, labels, "quality", per_class, ("source", "lang")))
    part = bytescan.mix(ids.astype(np.int64).view(U64)) % U64(4)
    parts = [np.flatnonzero(part >= U64(2)), np.flatnonzero(part == U64(0)), np.flatnonzero(part == U64(1))]
    everything = np.arange(len(y))
    learn, judge, joint = (p if len(p) >= 20 and len(np.unique(y[p])) == 2 else everything for p in parts)
    given = np.zeros((2, linear.DIMS)), np.zeros((2, META_DIMS))
    for turn in range(rounds + 1):
        text = fit_view(x_text, y, learn, judge, given[0], 2)
        meta = fit_view(x_meta, y, learn, judge, given[1], 1)
        views = CoTrained(text, meta, (0.5, 0.5, 0.0))
        if turn < rounds and len(np.unique(y)) == 2:
            given = exchanged(rows, views)
    both = [v.odds(x.margins(v.weights))[joint] for v, x in ((text, x_text), (meta, x_meta))]
    weights, bias = linear.fit_logistic(_pair(*both), y[joint], 2, epochs=200, rate=0.3, decay=1e-3)
    # The joint odds are moved from the sample's class shares to those of all labelled rows.
    shift = linear.prior_shift(labels, "quality", y)
    return CoTrained(text, meta, (float(weights[0]), float(weights[1]), float(bias) + shift))


def _pair(a: np.ndarray, b: np.ndarray) -> linear.Sparse:
    n = len(a)
    return linear.Sparse(np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.clip(np.stack([a, b], 1).ravel(), -12, 12), n)


def score(docs: DataFrame, model: CoTrained, keep_from: float = KEEP_FROM) -> DataFrame:
    """Both views' calibrated probabilities, the joint quality and verdict of every document.

    ``docs`` has doc_id and text, and source and lang if it has them; other columns
    are ignored. A null or wordless text has quality 0 and isn't kept. A null source
    or language is a value of its own. Repeated rows score alike. Texts of any length are
    scored whole, in pieces of a megabyte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, lang = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for c in bytescan.chunks(batch.column(1)):
                rows = slice(c.first, c.first + c.rows)
                own = metadata(c, source[rows], lang[rows])
                text, meta = model.odds(linear.parts(c), own)
                filled = sum(bytescan.words(piece).counts for piece, _ in bytescan.pieces(c)) > 0
                both = np.where(filled, model.joined(text, meta), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(linear.sigmoid(text)), pa.array(linear.sigmoid(meta)), pa.array(both), pa.array(both >= keep_from)], names=["doc_id", "p_text", "p_meta", "quality", "kept"])

    return _columns(docs).mapInArrow(run, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
