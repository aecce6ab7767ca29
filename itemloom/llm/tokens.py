"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte prefix begins with that of every shorter prefix that ends at
one of its token bounds, so a prefix is told by its last token alone, and that token
is unique: the one vocabulary entry that ends there and goes with the last token of
what stands before it. ``Piece`` stores these last tokens. Bytes that are appended
leave them as they are, and an edit leaves those before it, so both encode no more
than what is new.

Two neighbours go together if merging their bytes gives just these two. That is read
off the merges along their touching edges, in order of rank.

A text is cut into pieces by the tokenizer's pattern; pieces are encoded each on its
own. ``Encoding`` holds the pieces of one text and takes appends and edits. On tables,
``encode``, ``decode`` and ``reencode`` work row by row within tasks, without a shuffle but
for the join of edits. Null texts are empty, empty ones have no ids; repeated rows
are encoded alike, all other columns stay as they are. Texts of any length are cut at white space
into stretches of ``STRETCH`` characters, so that besides the text and its ids only a stretch is held; a
single word beyond that is one stretch.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Characters of a text whose pieces are held at once.
STRETCH = 1 << 16
#: Pieces and pairs that a worker remembers; more are forgotten and found again.
REMEMBERED = 1 << 19
#: Bytes of text in one Arrow batch of results.
BATCH = 1 << 22
#: How far behind its end a match may have looked: a contraction that isn't one, white space before a word.
LOOK = 2


class Vocabulary:
    """The tokens of a rank file (a base64 token and its rank on each line), with how each was merged."""

    def __init__(self, ranks: bytes) -> None:
        lines = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank), default=0)
        self._even: dict[bytes, bool] = {}
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.known: dict[int, bool] = {}  # answers of goes()
        self.endings = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), rank))
        self.endings.make_automaton()

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The parts of ``data`` after merging by rank, leftmost first, down to ``stop`` parts."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > stop:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            at = ranks.index(min(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge gives this one; None for one that no merges lead to."""
        if token not in self._parts:
            found = self.merged(token, 2)
            self._parts[token] = (found[0], found[1]) if len(found) == 2 and found[0] + found[1] in self.rank else None
        return self._parts[token]

    def reached(self, rank: int) -> bool:
        """Whether merging a token's bytes gives the token: others only stand for whole pieces."""
        token = self.token[rank]
        return len(token) == 1 or self.parts(token) is not None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The tokens that touch one side while ``token`` is merged, each with the rank that ends it."""
        out = [(token, float("inf"))]
        while len(token) > 1:
            until, token = self.rank[token], self.parts(token)[side]
            out.append((token, until))
        return out[::-1]

    def goes(self, pair: int) -> bool:
        """Whether a token can follow another: the bytes of both merge to these two.

        ``pair`` has the token in its lower 32 bits, above them the other's rank + 1, or 0 at the start of a piece.
        """
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        before, after = pair >> 32, pair & 0xFFFFFFFF
        out = self.known[pair] = self.reached(after) and (not before or self._stays_apart(self.token[before - 1], self.token[after]))
        return out

    def even(self, token: bytes) -> bool:
        """Whether ranks grow along the merges of a token, so that the order of ranks is that of time."""
        if token not in self._even:
            parts = self.parts(token) if len(token) > 1 else ()
            self._even[token] = parts is not None and all(self.rank[p] < self.rank[token] and self.even(p) for p in parts)
        return self._even[token]

    def _stays_apart(self, before: bytes, after: bytes) -> bool:
        if not (self.even(before) and self.even(after)):
            return self.merged(before + after) == [before, after]
        left, right = self._edge(before, 1), self._edge(after, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.rank.get(x + y)
            # Of equal ranks the leftmost is merged first: that of x is left of this, that of y is right.
            if across is not None and across < x_until and across <= y_until:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


class Piece:
    """A piece of text and the last token of each of its prefixes."""

    __slots__ = ("data", "last", "vocabulary")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", array("I")
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; known prefixes keep their last tokens."""
        v, last = self.vocabulary, self.last
        self.data += data
        back = max(0, len(last) - v.longest)  # no token that ends in the new bytes begins before
        known, goes = len(last) - back, v.known
        for at, (size, token) in v.endings.iter(self.data[back:].decode("latin-1")):
            if at != known:  # done, or behind a byte without a token
                continue
            start = back + at + 1 - size
            pair = (last[start - 1] + 1 if start else 0) << 32 | token
            good = goes.get(pair)
            if v.goes(pair) if good is None else good:
                last.append(token)
                known += 1
        if len(last) < len(self.data):
            raise ValueError(f"the vocabulary has no token for byte {self.data[len(last)]}")

    def upto(self, at: int) -> Piece:
        """The piece of the first ``at`` bytes, whose last tokens are known."""
        out = Piece(self.vocabulary)
        out.data, out.last = self.data[:at], self.last[:at]
        return out

    def ids(self) -> list[int]:
        whole = self.vocabulary.rank.get(self.data)
        if whole is not None:
            return [whole]
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers, found when first asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.rank.get(data)
        out = np.array([whole] if whole is not None else Piece(self.vocabulary, data).ids(), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Tokenizer:
    """A vocabulary and the pattern that cuts texts into pieces.

    In the pattern white space may only begin a match or fill it, as in all public ones of this kind.
    """

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self._pieces = _Pieces(self.vocabulary)
        self._edge = regex.compile(r"(?<=\S)\s")
        most = max(self.vocabulary.token, default=-1)
        sizes = np.array([len(self.vocabulary.token.get(k, b"")) for k in range(most + 1)], np.int64)
        self._starts = np.concatenate([[0], np.cumsum(sizes)])
        self._bytes = np.frombuffer(b"".join(self.vocabulary.token.get(k, b"") for k in range(most + 1)), np.uint8)

    def stretches(self, text: str) -> Iterator[str]:
        """The text in stretches whose pieces are those of the whole: each begins with white space after a word."""
        at = 0
        while at < len(text):
            found = self._edge.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            to = found.start() if found else len(text)
            yield text[at:to]
            at = to

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(b"".join(map(self._pieces.__getitem__, self.pattern.findall(s))) for s in self.stretches(text or ""))

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of such ids."""
        out = []
        every = np.frombuffer(ids or b"", "<u4")
        for at in range(0, len(every), STRETCH):
            some = every[at : at + STRETCH].astype(np.int64)
            start, size = self._starts[some], self._starts[some + 1] - self._starts[some]
            first = np.cumsum(size) - size
            out.append(self._bytes[np.arange(size.sum()) + np.repeat(start - first, size)].tobytes())
        return b"".join(out)


@lru_cache(2)
def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """The tokenizer of these ranks, made once in each worker."""
    return Tokenizer(ranks, pattern)


class Encoding:
    """One text's pieces and ids, kept right through appends and edits.

    A match depends on what follows its start, and looks no further than ``LOOK`` characters behind
    its end. So after a change the pieces that end well before it stay, matching begins
    anew there, and stops as soon as it begins a piece behind the change where an old one began.
    """

    def __init__(self, tok: Tokenizer, text: str = "") -> None:
        self.tok, self.text = tok, ""
        self.starts: list[int] = []
        self.pieces: list[Piece] = []
        self.matched = 0  # pieces that the last change matched anew
        self.append(text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to before ``end``."""
        text = self.text[:start] + new + self.text[end:]
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        keep = bisect_right(ends, start - LOOK)
        at = ends[keep - 1] if keep else 0
        shift = len(text) - len(self.text)
        again = bisect_left(self.starts, end)  # the first old piece behind the change
        old, starts, pieces = self.pieces[keep:], self.starts[:keep], self.pieces[:keep]
        self.matched = 0
        while at < len(text):
            while again < len(self.starts) and self.starts[again] + shift < at:
                again += 1
            if again < len(self.starts) and at >= start + len(new) and self.starts[again] + shift == at:
                starts += [s + shift for s in self.starts[again:]]
                pieces += self.pieces[again:]
                break
            m = self.tok.pattern.match(text, at)
            if m is None or m.end() == at:  # characters that the pattern leaves out are in no piece
                at += 1
                continue
            starts.append(at)
            pieces.append(self._piece(m[0].encode(), old[0] if old and len(pieces) == keep else None))
            self.matched += 1
            at = m.end()
        self.text, self.starts, self.pieces = text, starts, pieces

    def _piece(self, data: bytes, old: Piece | None) -> Piece:
        """The first piece that is matched anew shares a prefix with the old one, whose last tokens stay."""
        if old is None:
            return Piece(self.tok.vocabulary, data)
        same = next((k for k, (a, b) in enumerate(zip(old.data, data)) if a != b), min(len(old.data), len(data)))
        out = old.upto(same)
        out.append(data[same:])
        return out

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in p.ids()]


def _batches(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BATCH bytes of values."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(column):
        to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH, "right"))
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def _made(df: DataFrame, source: str, name: str, keep: list[str] | None, make: Callable[[], Callable[[object], bytes]]) -> DataFrame:
    """Columns of ``df`` and a binary one made of each value of ``source``; one of that name is replaced."""
    kept = [c for c in (df.columns if keep is None else keep) if c != name]
    place, places = df.columns.index(source), [df.columns.index(c) for c in kept]
    schema = StructType([*(df.schema[k] for k in places), StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at, to in _batches(batch.column(place)):
                made = pa.array([one(x) for x in batch.column(place).slice(at, to - at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, to - at) for k in places), made], names=[*kept, name])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: bytes, pattern: str, column: str = "text", name: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all), and the ids of a text column as little-endian unsigned 32-bit integers.

    ``ranks`` is the content of the rank file, whose size is that of the vocabulary; it goes to the tasks.
    """
    return _made(docs, column, name, keep, lambda: tokenizer(ranks, pattern).encode)


def decode(tokens: DataFrame, ranks: bytes, pattern: str, column: str = "ids", name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all), and the bytes of a column of ids; null ids are empty."""
    return _made(tokens, column, name, keep, lambda: tokenizer(ranks, pattern).decode)


def reencode(docs: DataFrame, edits: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Edited documents with their text and ids: key, text, ids, n_matched.

    ``edits`` has the key, at (edits of a document go in this order), start, end and new: each
    puts ``new`` in the place of those characters of the text as it is then; places beyond its end are its end. n_matched is the number
    of pieces that the edits matched anew. Documents without edits are left out, as are edits of none.
    """
    listed = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "start", "end", F.coalesce("new", F.lit("")).alias("new")))).alias("edits"))
    joined = docs.select(key, F.coalesce(column, F.lit("")).alias("text")).join(listed, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks, pattern)
        for batch in batches:
            for at, to in _batches(batch.column(1)):
                cut = batch.slice(at, to - at)
                texts, ids, matched = [], [], []
                for text, changes in zip(cut.column(1).to_pylist(), cut.column(2).to_pylist(), strict=True):
                    e, n = Encoding(tok, text), 0
                    for c in changes:
                        start = min(c["start"], len(e.text))
                        e.edit(start, max(start, min(c["end"], len(e.text))), c["new"])
                        n += e.matched
                    texts.append(e.text)
                    ids.append(np.array(e.ids(), "<u4").tobytes())
                    matched.append(n)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.binary()), pa.array(matched, pa.int64())], names=[key, "text", "ids", "n_matched"])

    kind = joined.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, text string, ids binary, n_matched long")


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
