"""Language identification by prediction by partial matching.

Per language a tree of byte contexts up to ORDER bytes deep is counted on a bounded
sample and then frozen. A symbol that a context has seen c times among n, with q
distinct ones, costs -log2(c / (n + q)) bits; else the escape costs -log2(q / (n + q))
and the next shorter context is asked, down to a uniform choice among 256 bytes.
A context that a language never saw is passed over at no cost. A text's language is
the one that codes it in the fewest bits.

The cost of a byte depends on its last ORDER bytes only, so the frozen trees become
one table of costs for all byte strings that any language saw, with a column for
each language, and texts are scored by lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm import bytescan

ORDER = 3
#: Documents of each language that are learned from, about.
PER_LANGUAGE = 300
#: Most languages whose counts are broadcast.
BROADCAST_LANGUAGES = 10_000
#: Documents whose crc32 of the id's text has this remainder by 4 are never learned from.
HELD_OUT = 2
UNDETERMINED = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"

_FOLD = np.full(256, 0x20, np.uint8)  # ASCII letters in lower case and high bytes; others are spaces
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_SLOTS = 22


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def stream(c: bytescan.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, each row led by ORDER spaces; row offsets.

    Latin capitals of two bytes are folded too.
    """
    d = _FOLD[c.data]
    capital = np.zeros(len(d), bool)
    capital[1:] = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97)
    d = d + capital * np.uint8(0x20)
    space = d == 0x20
    keep = np.ones(len(d), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    total = np.concatenate([[0], np.cumsum(keep)])
    lengths = np.diff(total[c.offsets])
    offsets = np.concatenate([[0], np.cumsum(lengths + ORDER)])
    out = np.full(offsets[-1], 0x20, np.uint8)
    body = np.ones(offsets[-1], bool)
    for k in range(ORDER):
        body[offsets[:-1] + k] = False
    out[body] = d[keep]
    return out, offsets


def keys(s: np.ndarray) -> np.ndarray:
    """For each place the last ORDER + 1 bytes as a number, the latest byte lowest."""
    out = np.zeros(len(s), np.uint32)
    for back in range(ORDER + 1):
        out[back:] |= s[: len(s) - back].astype(np.uint32) << np.uint32(8 * back)
    return out


def _scored_places(offsets: np.ndarray) -> np.ndarray:
    out = np.ones(offsets[-1], bool)
    for k in range(ORDER):
        out[offsets[:-1] + k] = False
    return out


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language, below a hash threshold of the id."""
    fit = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    n = fit.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    n = F.broadcast(n) if n.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else n
    share = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    return fit.join(n, F.col("lang") == F.col("l")).filter(share * F.col("n") < per_language).select("lang", "text")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for c in bytescan.chunks(batch.column(1)):
            s, offsets = stream(c)
            key, scored = keys(s), _scored_places(offsets)
            row = np.repeat(np.arange(c.rows), np.diff(offsets))
            own = langs[c.first : c.first + c.rows]
            for lang in sorted(set(own)):
                got = key[scored & (own == lang)[row]]
                grams, n = np.unique(got, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


@dataclass
class _Level:
    """Strings of one length that any language saw: sorted, with costs by language."""

    grams: np.ndarray
    cost: np.ndarray  # float32, (strings, languages)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        return at, self.grams[at] == key


@dataclass
class Trees:
    """Frozen costs: ``levels[k]`` for strings of k + 1 bytes, ``escapes[k]`` for contexts of k."""

    langs: list[str]
    levels: list[_Level]
    escapes: list[_Level]

    def __post_init__(self) -> None:
        self._slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "levels": self.levels, "escapes": self.escapes, "_slots": None}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)

    def costs(self, key: np.ndarray) -> np.ndarray:
        """Bits of each place by language, for keys of ORDER + 1 bytes."""
        if self._slots is None:
            self._slots = np.zeros(1 << _SLOTS, np.int32)
            self._slots[self._slot(self.levels[ORDER].grams)] = np.arange(len(self.levels[ORDER].grams))
        at = self._slots[self._slot(key)]
        out = self.levels[ORDER].cost[at]
        other = np.flatnonzero(self.levels[ORDER].grams[at] != key)
        if len(other):
            rare, back = np.unique(key[other], return_inverse=True)
            out[other] = self._costs(rare, ORDER)[back]
        return out

    def _costs(self, key: np.ndarray, order: int) -> np.ndarray:
        at, seen = self.levels[order].find(key)
        out = self.levels[order].cost[at]
        rest = np.flatnonzero(~seen)
        if len(rest):
            shorter = key[rest] & np.uint32((1 << (8 * order)) - 1) if order else key[rest]
            context, known = self.escapes[order].find(key[rest] >> np.uint32(8))
            escape = np.where(known[:, None], self.escapes[order].cost[context], 0)
            lower = self._costs(shorter, order - 1) if order else np.full((len(rest), len(self.langs)), 8, np.float32)
            out[rest] = escape + lower
        return out


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Trees:
    """Freeze the counts of (ORDER + 1)-byte strings into trees.

    Shorter strings' counts are sums over their ends, so all orders come from one table.
    """
    trees = Trees(langs, [], [])
    lower: np.ndarray | None = None
    for order in range(ORDER + 1):
        mask = np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
        grams, place = np.unique(gram & mask, return_inverse=True)
        count = np.zeros((len(grams), len(langs)))
        np.add.at(count, (place, lang), n)
        contexts, of = np.unique(grams >> np.uint32(8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, of, count)
        np.add.at(distinct, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0)
            seen = -np.log2(count / (total + distinct)[of])
        if order:
            at, _ = trees.levels[-1].find(grams & np.uint32((1 << (8 * order)) - 1))
            lower = trees.levels[-1].cost[at]
        else:
            lower = np.full((len(grams), len(langs)), 8.0)
        cost = np.where(count > 0, seen, escape[of] + lower)
        trees.levels.append(_Level(grams, cost.astype(np.float32)))
        trees.escapes.append(_Level(contexts, escape.astype(np.float32)))
    return trees


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Trees | None:
    """Trees of every language of the documents that may be learned from, or None."""
    counted = _sample(docs, per_language).mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    langs = sorted(set(counted["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(langs)}
    lang = np.array([number[x] for x in counted["lang"].to_pylist()])
    return build(langs, lang, counted["gram"].to_numpy().astype(np.uint32), counted["n"].to_numpy())


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The language of every document by exact code length.

    ``docs`` has doc_id and text; other columns are not read. Returns doc_id,
    held_out, lang_pred, score (the share of the best language in 2**-bits, as if
    all were equally likely before) and bits_per_byte. A text that is null or has no
    letter is ``und`` with score 0, as all are where nothing could be learned. Of
    equally short codes the first language by name counts. Repeated rows are
    predicted alike; a null doc_id is not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            for c in bytescan.chunks(batch.column(2)):
                names = [UNDETERMINED] * c.rows
                score, rate = np.zeros(c.rows), np.zeros(c.rows)
                has = letters[c.first : c.first + c.rows].astype(bool)
                if trees is not None and has.any():
                    s, offsets = stream(c)
                    scored = _scored_places(offsets)
                    cost = trees.costs(keys(s)[scored])
                    inner = offsets - ORDER * np.arange(len(offsets))
                    bits = np.stack([bytescan.sums(cost[:, k].astype(np.float64), inner) for k in range(len(trees.langs))], 1)
                    best = bits.argmin(1)
                    least = bits[np.arange(c.rows), best]
                    score = np.where(has, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0)
                    rate = np.where(has, least / np.maximum(np.diff(inner), 1), 0)
                    names = [trees.langs[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.rows), batch.column(1).slice(c.first, c.rows), pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                    names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
                )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", letter.alias("letter")).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
