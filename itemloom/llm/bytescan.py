"""Vectorised word scan over the raw UTF-8 bytes of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``. Every separator is one ASCII byte and no byte
of a multi-byte character is ASCII, so cutting the bytes cuts the text exactly.
Work goes in chunks of about a megabyte. A text that is longer is a chunk of its own, but
its words are found and hashed, and its pieces are looked at, a megabyte at a time: what
grows with it are the text and some numbers for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of plain tokens: all ASCII but letters and digits.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = [not chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            out = np.full(size, base, U64)
            out[0] = 1
            tables.append(np.cumprod(out, dtype=U64))
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Chunk:
    """Some consecutive rows of a batch: their bytes and where each row begins."""

    first: int
    rows: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, rows + 1


@dataclass
class Words:
    """The words of a chunk: byte ranges, and each row's range of words."""

    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray  # int64, rows + 1: the words of row r are offsets[r]:offsets[r + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column in chunks of about ``most`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, where, body = column.buffers()
    ends = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Chunk(at, to - at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def in_pieces(chunk: Chunk) -> bool:
    """Whether the chunk is one text that is too long to be looked at as a whole."""
    return chunk.rows == 1 and len(chunk.data) > 2 * CHUNK_BYTES


def pieces(chunk: Chunk, beyond: int = 0) -> Iterator[tuple[Chunk, int]]:
    """The chunk itself or, of one long text, pieces that end with a separator and where the next begins.

    A piece shows up to ``beyond`` bytes of the next one, as many as its second item says. A word
    that is longer than that makes its piece longer.
    """
    most, n = CHUNK_BYTES, len(chunk.data)
    if not in_pieces(chunk):
        yield chunk, 0
        return
    at = 0
    while at < n:
        to = min(at + most, n)
        while to < n and not _SPACE[chunk.data[to - 1]]:
            some = np.flatnonzero(_SPACE[chunk.data[to : to + most]])
            to = to + int(some[0]) + 1 if len(some) else min(to + most, n)
        shown = min(to + beyond, n)
        yield Chunk(chunk.first, 1, chunk.data[at:shown], np.array([0, shown - at])), shown - to
        at = to


def _words_of_one(data: np.ndarray, separators: np.ndarray) -> Words:
    """The words of one long text, a megabyte at a time."""
    start, end = [], []
    for a in range(0, len(data), CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, len(data))
        inside = np.zeros(b - a + 2, bool)  # with the byte before and after
        lo, hi = max(a - 1, 0), min(b + 1, len(data))
        inside[lo - a + 1 : hi - a + 1] = ~separators[data[lo:hi]]
        start.append(np.flatnonzero(inside[1:-1] & ~inside[:-2]) + a)
        end.append(np.flatnonzero(inside[1:-1] & ~inside[2:]) + a + 1)
    starts = np.concatenate(start)
    return Words(starts, np.concatenate(end), np.array([0, len(starts)]))


def words(chunk: Chunk, separators: np.ndarray = _SPACE) -> Words:
    if in_pieces(chunk):
        return _words_of_one(chunk.data, separators)
    inside = ~separators[chunk.data]
    n = len(inside)
    begins = np.zeros(n, bool)
    if n:
        begins[chunk.offsets[:-1][chunk.offsets[:-1] < n]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (begins | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~begins[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets))


def _range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], dtype=U64, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


def _long_hash(data: np.ndarray) -> np.ndarray:
    """The hash of one range of any length, in one item."""
    total = 0
    for a in range(0, len(data), CHUNK_BYTES):
        part = data[a : a + CHUNK_BYTES].astype(U64) + U64(1)
        total += pow(_BASE, a, 1 << 64) * int((part * _power_tables(len(part))[0][: len(part)]).sum(dtype=U64))
    return mix(np.array([(total + len(data)) % (1 << 64)], U64))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes. ``start`` ascends.

    Long data is looked at a megabyte at a time, or as much as one range holds.
    """
    if len(data) <= 2 * CHUNK_BYTES:
        return _range_hashes(data, start, end)
    out = np.zeros(len(start), U64)
    long = end - start > CHUNK_BYTES
    for k in np.flatnonzero(long):
        out[k] = _long_hash(data[start[k] : end[k]])[0]
    cuts = np.searchsorted(start, np.arange(0, len(data) + CHUNK_BYTES, CHUNK_BYTES))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = np.arange(a, b)[~long[a:b]]
        if len(some):
            lo, hi = start[some[0]], end[some].max()
            out[some] = _range_hashes(data[lo:hi], start[some] - lo, end[some] - lo)
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values, which doesn't depend on the rows before it."""
    out = np.zeros(len(offsets) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(values[: offsets[-1]], offsets[filled], dtype=out.dtype)
    return out


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items' keys occur twice or more, and which are not the first of their key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] = same
    twice = again.copy()
    twice[order[:-1]] |= same
    return twice, again


def by_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one row."""
    return mix(keys ^ mix(row.astype(U64) + U64(1)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` items of ``h``; rows are not looked at."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k])
    return out


def grams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-grams that stay inside one row, and each one's first item."""
    every = gram_hashes(h, n)
    begin = np.arange(len(every))
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(every)]
    keep = begin + n <= row_end
    return every[keep], begin[keep]


def shingle_sets(chunk: Chunk, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sorted distinct hashes of its lower-cased ``n``-word shingles.

    A row with fewer words has one shingle, the whole sequence; a row without
    words has none. Returns the hashes and each row's offsets in them.
    """
    data = lower(chunk.data)
    w = words(chunk)
    h = range_hashes(data, w.start, w.end)
    counts = w.counts
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], U64)
    long = np.repeat(counts >= n, sizes)
    out[long] = grams(h, w.offsets, n)[0]
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        out[offsets[r]] = sequence_hash(h[w.offsets[r] : w.offsets[r + 1]])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out[a:b].sort()
    row = np.repeat(np.arange(chunk.rows), sizes)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.searchsorted(row[new], np.arange(chunk.rows + 1))


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a short whole sequence, apart from those of shingles by its length."""
    out = U64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = mix(np.array([out * U64(0xA24BAED4963EE407) + x], U64))[0]
    return int(out)
