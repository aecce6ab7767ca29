"""Quality rules: fixed counts of each text, and a calibrated classifier's verdict.

The classifier is a logistic regression on hashed words and byte trigrams, fitted
on a bounded labelled sample and calibrated on a held-out part of it; all texts
are scored in Arrow batches and held against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from itemloom.llm import bytescan, linear

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_QUALITY = 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality double, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point of a word.
_IN_WORD = (np.arange(256) & 0xC0) != 0x80
_IN_WORD[list(b" \t\n\v\f\r")] = False


def counts(c: bytescan.Chunk) -> dict[str, np.ndarray]:
    """The five counts of each text of a chunk."""
    w = bytescan.words(c)
    h = bytescan.range_hashes(c.data, w.start, w.end)

    # lines that have a word, by row
    stops = np.flatnonzero(c.data == 10)
    begin = np.union1d(c.offsets[:-1], stops + 1)
    begin = begin[begin < len(c.data)]
    end = np.append(begin[1:], len(c.data))
    end = end - ((end > begin) & (c.data[np.maximum(end - 1, 0)] == 10)) if len(begin) else end
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[filled], end[filled]
    line_row = np.searchsorted(c.offsets, begin, "right") - 1
    lines = bytescan.by_row(bytescan.range_hashes(c.data, begin, end), line_row)
    _, again = bytescan.repeated(lines)

    windows, first = bytescan.grams(h, w.offsets, 3)
    twice, _ = bytescan.repeated(bytescan.by_row(windows, np.searchsorted(w.offsets, first, "right") - 1))
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[first[twice] + k] = True
    return {
        "n_words": w.counts,
        "word_chars": bytescan.sums(_IN_WORD[c.data], c.offsets),
        "n_symbols": bytescan.sums(_SYMBOL[c.data], c.offsets),
        "n_dup_lines": np.bincount(line_row[again], minlength=c.rows),
        "n_repeat_words": bytescan.sums(covered, w.offsets),
    }


def fit(docs: DataFrame, labels: DataFrame, per_class: int = linear.PER_CLASS) -> linear.Calibrated:
    """The calibrated classifier of ``labels.quality`` on a bounded sample."""
    ids, y, texts = linear.extract(linear.labelled(docs, labels, "quality", per_class))
    return linear.fit_calibrated(ids, y, linear.sparse(texts), linear.prior_shift(labels, "quality", y))


def score(docs: DataFrame, model: linear.Calibrated, least_quality: float = LEAST_QUALITY) -> DataFrame:
    """Counts, calibrated quality and verdict of every document.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text
    has all counts 0 and fails the base rules. Repeated rows are scored alike, each
    with a row of its own. A model fitted without both classes gives one half, so
    that the base rules decide alone. A text of any length is scored whole, its features in
    pieces of a megabyte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in bytescan.chunks(batch.column(1)):
                n = counts(c)
                quality = model.probabilities(linear.parts(c))
                failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED_PERCENT * n["n_words"])
                kept = ~failed & (quality >= least_quality)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.rows), *(pa.array(x.astype(np.int64)) for x in n.values()), pa.array(quality), pa.array(failed), pa.array(kept)],
                    names=["doc_id", *n, "quality", "base_failed", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
