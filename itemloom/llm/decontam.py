"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Tokens are lower-case runs of letters and digits. The SEED_WORDS-grams of a benchmark
item are its seeds. A seed that more than SHARED_ITEMS items have is a stem ("what is the capital of"): it says
nothing of one of them. The tokens of an item that no stem covers are its own (all, if stems cover all), and a
passage must hold a share of them besides reaching the score.

A document is cut to the windows around its rare seeds of an item. Of stems it is cut to those around
which an own token of the item stands: as a share of the own tokens must be there, one of the
rarest few of them is, so stems are looked up together with these, and no window is lost to rarity.
Every window is aligned with its item, unless the tokens that both hold are too few for the score; equal windows of a task
are aligned once. The score is that of the best local alignment over that of the
whole item with itself.

Items come in blocks of bounded size, one pass over the documents for each block; stems are
counted over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import bytescan
from itemloom.session import discard, materialize, quoted

SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: A seed that more items have is a stem.
SHARED_ITEMS = 8
#: Share of an item's own tokens that a passage must hold.
LEAST_OWN = 0.5
#: Words beside stems that are looked up at once.
AROUND = 1 << 20
#: Characters of benchmark text that one block holds, at most (or one item).
BLOCK_CHARS = 20_000_000
#: Bytes of aligned windows that a task remembers, about, before it begins anew.
REMEMBERED_BYTES = 16 << 20
U64 = np.uint64


def _tokens(column: pa.Array) -> Iterator[tuple[bytescan.Chunk, bytescan.Words, np.ndarray]]:
    for c in bytescan.chunks(column):
        data = bytescan.lower(c.data)
        w = bytescan.words(c, bytescan.PUNCTUATION)
        yield c, w, bytescan.range_hashes(data, w.start, w.end)


@dataclass
class Index:
    """Items by key: key k is in items[offsets[k]:offsets[k + 1]]."""

    keys: np.ndarray  # sorted, distinct
    offsets: np.ndarray
    items: np.ndarray
    sieve: np.ndarray  # bool by the low bits of a key

    @classmethod
    def of(cls, key: np.ndarray, item: np.ndarray) -> Index:
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        sieve = np.zeros(1 << max(16, int(len(keys)).bit_length() + 4), bool)
        sieve[(keys & U64(len(sieve) - 1)).astype(np.int64)] = True
        return cls(keys, np.append(first, len(key)), item[order], sieve)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hits(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``asked`` that hold a key, and which."""
        maybe = np.flatnonzero(self.sieve[(asked & U64(len(self.sieve) - 1)).astype(np.int64)])
        if not len(self.keys) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, asked[maybe]), len(self.keys) - 1)
        same = self.keys[at] == asked[maybe]
        return maybe[same], at[same]

    def spread(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``asked`` that hold a key, once for each item that has it, and that item."""
        place, key = self.hits(asked)
        count = self.offsets[key + 1] - self.offsets[key]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(place, count), self.items[np.repeat(self.offsets[key], count) + within]

    def only(self, chosen: np.ndarray) -> Index:
        return Index.of(np.repeat(self.keys, self.counts)[np.repeat(chosen, self.counts)], self.items[np.repeat(chosen, self.counts)])


def _pairs(stem: np.ndarray, token: np.ndarray) -> np.ndarray:
    return bytescan.mix(stem * U64(0xD1342543DE82EF95) + token)


@dataclass
class Block:
    """Tokens of some benchmark items, which of them are their own, and the items by seed."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    own: list[np.ndarray]
    rare: Index  # items by seed
    stems: Index  # the greatest length of an item by stem
    pairs: Index  # items by stem and own token

    @classmethod
    def of(cls, ids: np.ndarray, texts: pa.Array, stems: np.ndarray | None = None) -> Block:
        """``stems`` are those of all items; without them the items given are all."""
        tokens: list[np.ndarray] = []
        for _, w, h in _tokens(texts):
            tokens += [h[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        grams = [bytescan.gram_hashes(t, SEED_WORDS) for t in tokens]
        distinct = [np.unique(g) for g in grams]
        item = np.repeat(np.arange(len(tokens)), [len(g) for g in distinct])
        seeds = Index.of(np.concatenate([*distinct, np.zeros(0, U64)]), item)
        shared = seeds.counts > SHARED_ITEMS if stems is None else np.isin(seeds.keys, stems)
        words, having = np.unique(np.concatenate([*map(np.unique, tokens), np.zeros(0, U64)]), return_counts=True)
        own, keys, of, reach = [], [], [], np.zeros(len(seeds.keys), np.int64)
        for i, (t, g) in enumerate(zip(tokens, grams, strict=True)):
            at = np.searchsorted(seeds.keys, g)
            starts = np.flatnonzero(shared[at]) if len(at) else at
            covered = np.zeros(len(t), bool)
            for k in range(SEED_WORDS):
                covered[starts + k] = True
            own.append(t if covered.all() else t[~covered])
            if len(starts):
                reach[at[starts]] = np.maximum(reach[at[starts]], len(t))
                missing = len(own[i]) - int(np.ceil(LEAST_OWN * len(own[i])))
                rarest = own[i][np.argsort(having[np.searchsorted(words, own[i])], kind="stable")][: missing + 1]
                both = _pairs(np.unique(g[starts])[:, None], np.unique(rarest)[None, :]).ravel()
                keys.append(both)
                of.append(np.full(len(both), i))
        none = np.zeros(0, np.int64)
        pairs = Index.of(np.concatenate([*keys, np.zeros(0, U64)]), np.concatenate([*of, none]))
        return cls(ids, tokens, own, seeds.only(~shared), Index.of(seeds.keys[shared], reach[shared]), pairs)


def _seeds(items: DataFrame) -> DataFrame:
    """The distinct seeds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w, h in _tokens(batch.column(0)):
                for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(bytescan.gram_hashes(h[a:b], SEED_WORDS)).view(np.int64))], names=["seed"])

    return items.select("text").mapInArrow(run, "seed long")


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The distinct item texts in blocks of bounded size; equal texts go by the least id."""
    items = benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    if n > 1:
        shared = materialize(_seeds(items).groupBy("seed").count().filter(F.col("count") > SHARED_ITEMS).select("seed"), "stems")
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id")
        # A block has at most as many stems as words.
        stems = shared.join(_seeds(part), "seed", "left_semi").toArrow()["seed"].to_numpy().view(U64) if n > 1 else None
        got = part.toArrow()
        yield Block.of(got["item_id"].to_numpy(), got["text"].combine_chunks(), stems)
    if n > 1:
        discard(shared)


def most_matches(item: np.ndarray, window: np.ndarray) -> int:
    """Tokens of ``item`` that an alignment can match, at most: those that both hold."""
    tokens, counts = np.unique(item, return_counts=True)
    at = np.searchsorted(tokens, window)
    at[at == len(tokens)] = 0
    found = np.bincount(at[tokens[at] == window], minlength=len(tokens))
    return int(np.minimum(found, counts).sum())


def _near_stems(h: np.ndarray, offsets: np.ndarray, at: np.ndarray, stem: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of stems beside which an own token of an item with this stem stands, and that item."""
    places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    row = np.searchsorted(offsets, at, "right") - 1
    reach = block.stems.items[block.stems.offsets[stem]]
    low, high = np.maximum(at - reach, offsets[row]), np.minimum(at + SEED_WORDS + reach, offsets[row + 1])
    size = high - low
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + AROUND, AROUND), "left")
    for a, b in zip(np.append(0, cuts[1:]), np.append(cuts[1:], len(size)), strict=True):
        if a >= b:
            continue
        n = size[a:b]
        word = np.arange(n.sum()) + np.repeat(low[a:b] - (np.cumsum(n) - n), n)
        place, item = block.pairs.spread(_pairs(np.repeat(block.stems.keys[stem[a:b]], n), h[word]))
        found = np.unique(np.stack([np.repeat(at[a:b], n)[place], item]), axis=1)
        places.append(found[0])
        items.append(found[1])
    return np.concatenate(places), np.concatenate(items)


def seed_windows(docs: DataFrame, block: Block, least_score: float = LEAST_SCORE) -> DataFrame:
    """Windows of documents around the seeds of an item: one row for each.

    Seeds of an item that lie within its length of each other share a window, which
    reaches the item's length beyond them. Windows that can't reach ``least_score``, or hold too few of the
    item's own tokens, with all tokens that they share with the item are left out.
    """
    lengths = np.array([len(t) for t in block.tokens])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for c, w, h in _tokens(batch.column(1)):
                rows = []
                grams, first = bytescan.grams(h, w.offsets, SEED_WORDS)
                place, item = block.rare.spread(grams)
                at = first[place]
                shared, stem = block.stems.hits(grams)
                if len(shared):
                    more_at, more_items = _near_stems(h, w.offsets, first[shared], stem, block)
                    at, item = np.concatenate([at, more_at]), np.concatenate([item, more_items])
                if not len(at):
                    continue
                row = np.searchsorted(w.offsets, at, "right") - 1
                order = np.lexsort((at, item, row))
                row, item, at = row[order], item[order], at[order]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > lengths[item[1:]])
                starts = np.flatnonzero(new)
                for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True):
                    r, i = row[a], item[a]
                    lo = max(at[a] - lengths[i], w.offsets[r])
                    hi = min(at[b - 1] + SEED_WORDS + lengths[i], w.offsets[r + 1])
                    if most_matches(block.tokens[i], h[lo:hi]) >= least_score * lengths[i] and own_share(block.own[i], h[lo:hi]) >= LEAST_OWN:
                        rows.append((ids[c.first + int(r)].as_py(), int(i), int(lo - w.offsets[r]), h[lo:hi].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                        names=["doc_id", "item", "first_word", "tokens"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item int, first_word long, tokens binary")


def own_share(own: np.ndarray, passage: np.ndarray) -> float:
    """The share of an item's own tokens that a passage holds."""
    return most_matches(own, passage) / len(own)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Score, first and end place in ``window`` of the best local alignment.

    Gaps along the window are a running maximum, so each row of the table is a few
    vector operations. The first of equally good ends counts.
    """
    n = len(window)
    ramp = np.arange(n + 1) * GAP
    previous = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    best = (0, 0, 0)
    for token in item:
        diagonal = previous[:-1] + np.where(window == token, MATCH, MISMATCH)
        up = previous[1:] + GAP
        score = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        source = np.concatenate([[0], np.where(score[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, begin[:-1], begin[1:]))])
        reach = score - ramp
        top = np.maximum.accumulate(reach)
        from_place = np.maximum.accumulate(np.where(reach == top, np.arange(n + 1), 0))
        score, begin = top + ramp, source[from_place]
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(begin[end]), end)
        previous = score
    return best


def _aligned(windows: DataFrame, block: Block) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], tuple[int, int, int, float]] = {}
        size = 0
        for batch in batches:
            rows = []
            for doc, i, first, packed in zip(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3), strict=True):
                item, key = block.tokens[i], (int(i), packed.as_py())
                if key not in known:
                    if size > REMEMBERED_BYTES:
                        known, size = {}, 0
                    window = np.frombuffer(key[1], U64)
                    score, a, b = align(item, window)
                    known[key] = score, a, b, own_share(block.own[i], window[a:b])
                    size += len(key[1])
                score, a, b, own = known[key]
                if own >= LEAST_OWN:
                    rows.append((doc.as_py(), int(block.ids[i]), score / (MATCH * len(item)), int(first + a), int(first + b)))
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return windows.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The (doc_id, item_id) pairs whose best alignment reaches ``least_score`` and holds LEAST_OWN of the item's own tokens.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are
    ignored. Returns the score and the aligned words of the document, first_word to
    end_word (exclusive). Items with equal texts count as the one of least id. Null
    texts have no words; items of fewer than SEED_WORDS words are in no pair. Rows
    that repeat a doc_id are one document; its best window counts, the first one
    among equals. Without documents or items the result is empty.
    """
    out = []
    for block in blocks(benchmark):
        scored = _aligned(seed_windows(docs, block, least_score), block).filter(F.col("score") >= least_score)
        best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word")))
        out.append(materialize(scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*"), "aligned"))
    if not out:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    return reduce(DataFrame.union, out)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents in no contaminated pair, all columns as they are."""
    return docs.join(contaminated(docs, benchmark, least_score).select("doc_id").distinct(), "doc_id", "left_anti").select(*quoted(docs))
