"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed lower-case tokens (runs of letters and digits) and their
leading four, five and six bytes, so that inflected forms share evidence. Those
that a bounded labelled sample ties to toxic texts form the vocabulary. One
weight vector serves all grades; ordered thresholds part them:
P(grade >= k) = sigmoid(score - threshold_k).

The labels say toxic or not. Grades 1 to 3 of toxic rows are thirds of their
evidence density, hits per hundred tokens, as a vocabulary sees it that was learned from
the other half of the sample; other rows have grade 0. So a grade never rests on
what the row itself has taught.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from itemloom.llm import bytescan, linear

#: Features are 31-bit hashes: so few collide with the vocabulary that clean texts stay clean.
HASH_BITS = 31
#: Labelled rows to learn from, at most: not toxic and toxic. Many clean ones, so that
#: words that only happen to be in toxic texts are seen in clean ones too.
PER_CLASS = (3000, 900)
STEMS = (4, 5, 6)
GRADES = 3
#: A document is rejected from this probability of grade 1 or more on.
REJECT_FROM = 0.5
#: Evidence has these log odds at least, and a likelihood ratio statistic that
#: chance doesn't give among a few hundred thousand features.
LEAST_LOG_ODDS = 3.5
LEAST_RATIO = 16.0
SCHEMA = "doc_id long, severity double, p_toxic double, grade int, rejected boolean"
U64 = np.uint64


def features(c: bytescan.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token's features and row offsets: 1 + len(STEMS) for each token.

    Texts of any length are looked at whole; a long one takes about seven bytes for each of its own.
    """
    data = bytescan.lower(c.data)
    w = bytescan.words(c, bytescan.PUNCTUATION)
    low = U64((1 << HASH_BITS) - 1)
    out = np.empty((len(w.start), 1 + len(STEMS)), np.int32)
    out[:, 0] = bytescan.range_hashes(data, w.start, w.end) & low
    for k, n in enumerate(STEMS, 1):
        stem = bytescan.range_hashes(data, w.start, np.minimum(w.end, w.start + n))
        out[:, k] = bytescan.mix(stem + U64(n)) & low
    return out.ravel(), w.offsets * out.shape[1]


def _per_token(offsets: np.ndarray) -> np.ndarray:
    """What scores are divided by: the root of the tokens, counted in hundreds."""
    return np.sqrt(np.maximum(np.diff(offsets) / (1 + len(STEMS)), 1) / 100)


@dataclass
class Ordinal:
    """The vocabulary (sorted hashes) with weights shared by all grades, and thresholds.

    ``presence`` is the weight of having any evidence at all.
    """

    vocabulary: np.ndarray
    weights: np.ndarray
    presence: float
    thresholds: np.ndarray  # ascending, GRADES

    def exceedance(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return linear.sigmoid(score[:, None] - self.thresholds[None, :])

    def scores(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        place, at = known(self.vocabulary, hashes)
        row = np.searchsorted(offsets, place, "right") - 1
        n = len(offsets) - 1
        evidence = np.bincount(row, self.weights[at], n)
        return evidence / _per_token(offsets) + self.presence * (np.bincount(row, minlength=n) > 0)


def known(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``hashes`` that are in the vocabulary, and where they are in it."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sieve = np.zeros(1 << 16, bool)
    sieve[vocabulary & 0xFFFF] = True
    maybe = np.flatnonzero(sieve[hashes & 0xFFFF])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    same = vocabulary[at] == hashes[maybe]
    return maybe[same], at[same]


def vocabulary(texts: list[linear.Counted], y: np.ndarray) -> np.ndarray:
    """Sorted hashes of the features that speak for a toxic text, by sequential covering.

    The feature that tells most is taken, its tokens are set aside, and toxic rows
    that have it count for less from then on. So what merely stands beside known
    evidence, in copies of one text above all, gathers no weight of its own. It goes
    on until no feature tells enough.
    """
    flat = [x.features.ravel() for x in texts]
    every, place = np.unique(np.concatenate([*flat, np.zeros(0, np.int32)]), return_inverse=True)
    place = place.astype(np.int32)
    ends = np.cumsum([len(x) for x in flat])[:-1]
    tokens = [x.reshape(-1, 1 + len(STEMS)) for x in np.split(place, ends)]
    order = np.argsort(place, kind="stable").astype(np.int32)
    doc = np.repeat(np.arange(len(flat), dtype=np.int32), [len(x) for x in flat])
    by_feature = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(every)))])
    cover = np.ones(len(y))
    seen = np.zeros((2, len(every)))
    for t, k in zip(tokens, y, strict=True):
        seen[int(k), np.unique(t)] += 1
    n = np.bincount(y, minlength=2)[:2].astype(float)
    chosen = np.zeros(len(every), bool)
    while len(every) and n.all():
        odds = np.log((seen[1] + 0.5) / (n[1] - seen[1] + 0.5)) - np.log((seen[0] + 0.5) / (n[0] - seen[0] + 0.5))
        both, share = seen.sum(0), n[1] / n.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(seen[1] > 0, seen[1] * np.log(seen[1] / (both * share)), 0) + np.where(seen[0] > 0, seen[0] * np.log(seen[0] / (both * (1 - share))), 0))
        ratio[(odds < LEAST_LOG_ODDS) | chosen] = 0
        best = int(ratio.argmax())
        if ratio[best] < LEAST_RATIO:
            break
        chosen[best] = True
        for i in np.unique(doc[order[by_feature[best] : by_feature[best + 1]]]):
            t = tokens[i]
            has = (t == best).any(1)
            if has.any():
                k = int(y[i])
                seen[k, np.unique(t)] -= cover[i]
                if k:
                    n[1] -= cover[i]
                    cover[i] = 1 / (1 + 1 / cover[i])
                    n[1] += cover[i]
                tokens[i] = t[~has]
                seen[k, np.unique(tokens[i])] += cover[i]
        np.maximum(seen, 0, out=seen)
    return every[chosen].astype(np.int64)


def _hits(columns: np.ndarray, x: linear.Counted) -> tuple[np.ndarray, np.ndarray]:
    """Which vocabulary entries a text has, and how often."""
    place, at = known(columns, x.features.ravel())
    n = np.bincount(at, x.counts[place // (1 + len(STEMS))], len(columns)) if len(at) else np.zeros(len(columns))
    some = np.flatnonzero(n)
    return some, n[some]


def grades(ids: np.ndarray, y: np.ndarray, texts: list[linear.Counted]) -> np.ndarray:
    """0 for rows that aren't toxic, else 1 to GRADES by thirds of the evidence density.

    Either half of the rows (by id hash) is looked at with the vocabulary of the other.
    """
    out = np.zeros(len(y), int)
    half = (bytescan.mix(ids.astype(np.int64).view(U64)) & U64(1)).astype(int)
    density = np.zeros(len(y))
    for k in (0, 1):
        other = np.flatnonzero(half != k)
        columns = vocabulary([texts[r] for r in other], y[other])
        for r in np.flatnonzero((half == k) & (y == 1)):
            density[r] = 100 * _hits(columns, texts[r])[1].sum() / max(texts[r].counts.sum(), 1)
    toxic = np.flatnonzero(y == 1)
    if len(toxic):
        cuts = np.quantile(density[toxic], np.arange(1, GRADES) / GRADES)
        out[toxic] = 1 + np.searchsorted(cuts, density[toxic], "left")
    return out


def fit_ordinal(x: linear.Sparse, grade: np.ndarray, columns: int, rounds: int = 400, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the proportional-odds model by full-batch AdaGrad.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    w, gap = np.full(columns, 0.5), np.array([1.0] + [0.0] * (GRADES - 1))
    square_w, square_gap = np.full(columns, 1e-8), np.full(GRADES, 1e-8)
    n = max(x.rows, 1)
    for _ in range(rounds):
        steps = np.exp(gap[1:])
        thresholds = gap[0] + np.concatenate([[0.0], np.cumsum(steps)])
        s = x.margins(w)
        p = np.concatenate([np.ones((x.rows, 1)), linear.sigmoid(s[:, None] - thresholds), np.zeros((x.rows, 1))], 1)
        at = np.arange(x.rows)
        upper, lower = p[at, grade], p[at, grade + 1]
        likely = np.maximum(upper - lower, 1e-12)
        slope = 1 - upper - lower  # of the log likelihood by the score
        by_threshold = np.zeros(GRADES + 2)
        np.add.at(by_threshold, grade, -upper * (1 - upper) / likely)
        np.add.at(by_threshold, grade + 1, lower * (1 - lower) / likely)
        by_threshold = by_threshold[1:-1]
        g_gap = np.array([by_threshold.sum(), *(by_threshold[k:].sum() * steps[k - 1] for k in range(1, GRADES))]) / n
        g_w = np.bincount(x.index, x.value * slope[x.row], columns) / n - decay * w / n
        square_w += g_w**2
        square_gap += g_gap**2
        w = w + rate * g_w / np.sqrt(square_w)
        gap += rate * g_gap / np.sqrt(square_gap)
    return w, gap[0] + np.concatenate([[0.0], np.cumsum(np.exp(gap[1:]))])


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Ordinal:
    """Fit on a bounded number of other and of toxic labelled rows.

    Without toxic rows or without evidence nothing is toxic.
    """
    ids, y, texts = linear.extract(linear.labelled(docs, labels, "toxic", per_class), features, 1 + len(STEMS))
    columns = vocabulary(texts, y) if len(np.unique(y)) == 2 else np.zeros(0, np.int64)
    if not len(columns):
        return Ordinal(columns, np.zeros(0), 0.0, 20.0 + np.arange(GRADES))
    hits = [_hits(columns, x) for x in texts]
    tokens = np.array([x.counts.sum() for x in texts])
    row = np.repeat(np.arange(len(y)), [len(i) for i, _ in hits])
    value = np.concatenate([n for _, n in hits]) / np.sqrt(np.maximum(tokens, 1) / 100)[row]
    some = np.flatnonzero([len(i) for i, _ in hits])  # rows with any evidence: one more column
    row, value = np.concatenate([row, some]), np.concatenate([value, np.ones(len(some))])
    x = linear.Sparse(row, np.concatenate([*(i for i, _ in hits), np.full(len(some), len(columns))]).astype(int), value, len(y))
    w, thresholds = fit_ordinal(x, grades(ids, y, texts), len(columns) + 1)
    return Ordinal(columns, w[:-1], float(w[-1]), thresholds)


def score(docs: DataFrame, model: Ordinal, reject_from: float = REJECT_FROM) -> DataFrame:
    """Expected severity (0 to GRADES), P(toxic), likeliest grade and verdict of every document.

    ``docs`` has doc_id and text; other columns are ignored. A null or wordless
    text scores 0, as any text without evidence does. Repeated rows score alike,
    each with a row of its own. Between equally likely grades the lower one counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in bytescan.chunks(batch.column(1)):
                p = model.exceedance(model.scores(*features(c)))
                each = -np.diff(np.concatenate([np.ones((c.rows, 1)), p, np.zeros((c.rows, 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.rows), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(each.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= reject_from)],
                    names=["doc_id", "severity", "p_toxic", "grade", "rejected"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, model: Ordinal, reject_from: float = REJECT_FROM) -> DataFrame:
    """The documents that aren't rejected, all columns as they are, in one pass."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.exceedance(model.scores(*features(c)))[:, 0] < reject_from for c in bytescan.chunks(batch.column(place))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots can't be passed
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
