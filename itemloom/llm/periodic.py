"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
equal), that is ``max(LEAST_WORDS, TIMES * q)`` words long or longer and that no word beside it
extends. Each of its words stands in it ``TIMES`` times at least. So a word that is rarer within
a segment is in no run there and splits the segment; this goes on in what is left until nothing
splits, and segments shorter than ``LEAST_WORDS`` go. In prose hardly a segment is left.

Surviving segments are scanned by lag, one octave of lags at a time: the window of W = 2**k
words has its next equal at a lag in (W / 2, W] exactly where a stretch of that period begins or goes
on, as a window that isn't shorter than a primitive period meets itself first one period on. The
lag is then followed to both ends. Windows of 2**(k + 1) words are pairs of windows of 2**k words, so
all lags of a segment of n words take about n log(n)**2 steps, not n**2.

Words are compared as such, not by hashes. A document is one row in one task, without a shuffle. Null and
wordless texts have no runs and an empty collapsed text; repeated rows are treated alike; other columns aren't
read. Texts of any length are taken whole, word by word from pieces of ``PIECE`` bytes: besides the text a word
takes four bytes, in a surviving segment about a hundred.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 24
TIMES = 3
#: Bytes of a text that are cut in words at once, and of results in one Arrow batch.
PIECE = 1 << 20
BATCH = 1 << 22
_SPACE = b" \t\n\r\x0b\x0c"

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
Run = tuple[int, int, int]


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words."""
    at = 0
    while at < len(text):
        to = at + PIECE
        while to < len(text):
            ends = [k for s in _SPACE if (k := text.find(s, to, to + PIECE)) >= 0]
            if ends:
                to = min(ends)
                break
            to += PIECE
        yield text[at:to]
        at = to


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word of each number."""
    number: dict[bytes, int] = {}
    parts = [np.fromiter((number.setdefault(w, len(number)) for w in p.split()), np.int32) for p in _pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(number)


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """What is left of a sequence when words that are rarer than ``TIMES`` within their segment have split it to stability."""
    out, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST_WORDS:
            continue
        _, place, count = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero((count < TIMES)[place])
        if not len(rare):
            out.append((a, b))
            continue
        begins, ends = np.concatenate([[a], a + rare + 1]), np.concatenate([a + rare, [b]])
        long = ends - begins >= LEAST_WORDS
        todo += zip(begins[long].tolist(), ends[long].tolist(), strict=True)
    return sorted(out)


def _follow(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (before ``at`` where ``step`` is -1) equal those ``lag`` further on."""
    n, size = 0, 64
    while True:
        if step > 0:
            a, b = at + n, min(at + n + size, len(ids) - lag)
        else:
            a, b = max(at - n - size, 0), at - n
        if a >= b:
            return n
        same = ids[a:b] == ids[a + lag : b + lag]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return n + int(same.argmin())
        n += b - a
        size *= 2


def scan(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence, by octaves of lags."""
    found, n, width = set(), len(ids), 1
    windows = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while len(windows) and TIMES * (width // 2 + 1) <= n:
        order = np.argsort(windows, kind="stable")
        equal = windows[order][1:] == windows[order][:-1]
        if not equal.any():
            break
        here, lag = order[:-1][equal], np.diff(order)[equal]
        good = (lag > width // 2) & (lag <= width)
        here, lag = here[good], lag[good]
        by_place = np.argsort(here)
        here, lag = here[by_place], lag[by_place]
        first = np.ones(len(here), bool)
        first[1:] = (np.diff(here) > 1) | (np.diff(lag) != 0)
        for at, q in zip(here[first].tolist(), lag[first].tolist(), strict=True):
            start = at - _follow(ids, at, q, -1)
            length = at - start + _follow(ids, at, q, 1) + q
            if length >= max(LEAST_WORDS, TIMES * q):
                found.add((start, length, q))
        pairs = windows[:-width] * (windows.max() + 1) + windows[width:] if width < len(windows) else windows[:0]
        windows = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(ids: np.ndarray) -> list[Run]:
    """The runs of a whole sequence by start, then period: a split word is in none, so each lies in one segment."""
    out = [(a + start, length, q) for a, b in segments(ids) for start, length, q in scan(ids[a:b])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period, of these the first, then that of the least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse(ids: np.ndarray, words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by spaces, without those that a run repeats: all behind its first period."""
    change = np.zeros(len(ids) + 1, np.int32)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    kept = ids[np.cumsum(change[:-1]) == 0] if runs else ids
    return b" ".join(b" ".join(map(words.__getitem__, kept[k : k + PIECE].tolist())) for k in range(0, len(kept), PIECE))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, all runs, the strongest one (null without runs), and the collapsed text."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        name = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        ids, n, runs, best, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([[name(r) for r in x] for x in runs], pa.list_(kind)), pa.array([name(r) for r in best], kind), pa.array([t.decode() for t in text], pa.string())],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                ids, words = numbered(batch.column(1)[k].as_py() or b"")
                runs = runs_of(ids)
                rows.append((batch.column(0)[k].as_py(), len(ids), runs, strongest(runs), collapse(ids, words, runs)))
                size += len(rows[-1][-1])
                if size >= BATCH:
                    yield result(rows)
                    rows, size = [], 0
            if rows:
                yield result(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the texts of every tenth document by hash.

    With h the CRC-32 of the decimal doc_id and g = h div 10: where h mod 10 is 0, each word i >= a of the n words becomes word
    a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other texts and those of null ids stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = (h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = docs.select("doc_id", "text", F.when(chosen, words).alias("_words"), g.alias("_g"))
    n = F.size("_words")
    cut = cut.select("*", (F.col("_g") % n).cast("int").alias("_a"))
    period = 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))
    tail = F.transform(F.sequence(F.lit(0), n - F.col("_a") - 1), lambda i: F.get("_words", (F.col("_a") + i % F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return cut.select("*", period.alias("_p")).select("doc_id", F.when(F.col("_words").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what ``periodic_runs`` gives."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = lambda name: F.col(f"strongest.{name}").alias(name)
    milli = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    sha: Column = F.sha2(listed.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"), milli, sha.alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
