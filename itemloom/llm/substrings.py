"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingle hashes. Under one hash function, all
subsequences with the same least element form a compact window (left, centre,
right): a node of the Cartesian tree over the values, with its subtree's range. Only
nodes whose range holds a passage of MIN_WORDS are kept; they are the minima of the
sliding windows of that length, and the tree is built on them alone. Two passages of
similarity 3/4 share the least element under HASHES functions but in one case of 256.

Windows with equal least elements meet by hash bucket. Those of other nodes that also agree on
the least element of what stands left or right of theirs, under one of SIDES further functions, put
their regions in the group of a leading region, whose members are compared on their
shingles, those not yet linked only. A passage pair holds MIN_WORDS or more words on both sides,
shares LEAST_SHARED different shingles or more (which follows where none is repeated), and has Jaccard similarity of 3/4 or
more. Stretches joined by pairs are one class, named by
its least document.

Equal texts are one node throughout. Groups are dealt to tasks of bounded size and give a
forest of links, so they don't become all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm import bytescan
from itemloom.llm.graph import components, deal, groups_of
from itemloom.llm.jaccard import led, similar
from itemloom.session import discard, materialize

SHINGLE_WORDS = 5
MIN_WORDS = 50
LENGTH = MIN_WORDS - SHINGLE_WORDS + 1  # of the shortest passage, in shingles
HASHES = 4
#: Two passages of LENGTH different shingles are similar if they share so many: 3/7 of both.
LEAST_SHARED = -(-6 * LENGTH // 7)
#: Regions are cut at multiples of this, and reach beyond by what a shortest passage can.
CELL, MARGIN = 256, 64
#: Functions whose least element left and right of a window is looked at.
SIDES = 2
FLUSH_BYTES = 24 << 20
#: Bytes of windows and of regions that one task compares, about.
BUCKET_BYTES, REGION_BYTES = 8 << 20, 2 << 20
#: Buckets that a group is dealt to, at most, and members of it that leave a bucket at once, about.
SLOTS, PIECE = 64, 16
#: Most document ids that are broadcast to pick texts: 16 bytes each, 8 MB.
BROADCAST_IDS = 500_000
U64 = np.uint64
_WINDOW = ("keys", "nodes", "centres")


def sequences(c: bytescan.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in order, their row offsets, and a 64-bit id of each row's words."""
    w = bytescan.words(c)
    h = bytescan.range_hashes(bytescan.lower(c.data), w.start, w.end)
    shingles, _ = bytescan.grams(h, w.offsets, SHINGLE_WORDS)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(w.counts - SHINGLE_WORDS + 1, 0))])
    place = (np.arange(len(h)) - np.repeat(w.offsets[:-1], w.counts)).astype(U64)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(bytescan.mix(h + place * U64(0x9E3779B97F4A7C15)), dtype=U64, out=total[1:])
    node = bytescan.mix((total[w.offsets[1:]] - total[w.offsets[:-1]]) ^ w.counts.astype(U64))
    return shingles, offsets, node


def _sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def compact_windows(values: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, centre and right (inclusive) of each compact window of ``length`` or more.

    Among equal values the first is the least. Nodes with a range that long are the
    sliding minima; all their ancestors are too, so a stack over them finds the
    nearest lesser value on either side.
    """
    n = len(values)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    rank = np.empty(n, np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    least = _sliding_minimum(rank, length)
    key = least[np.concatenate([[True], least[1:] != least[:-1]])]
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    centre, key = place[key], key.tolist()
    left, right = np.zeros(len(centre), np.int64), np.full(len(centre), n - 1)
    stack: list[int] = []
    for k, v in enumerate(key):
        while stack and key[stack[-1]] > v:
            right[stack.pop()] = centre[k] - 1
        if stack:
            left[k] = centre[stack[-1]] + 1
        stack.append(k)
    return left, centre, right


def _packed_windows(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    salts = bytescan.mix(np.arange(1, HASHES + 1, dtype=U64))

    def flush(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([k for _, k, _ in held])
        node = np.repeat(np.array([n for n, _, _ in held], U64), [len(k) for _, k, _ in held])
        centre = np.concatenate([c for _, _, c in held]).astype(np.uint32)
        bucket = key % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
        filled = np.flatnonzero(np.diff(cuts))
        packed = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary()) for x in (key[order], node[order], centre[order])]
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), *packed], names=["bucket", *_WINDOW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size, seen = 0, set()
        for batch in batches:
            for c in bytescan.chunks(batch.column(0)):
                shingles, offsets, nodes = sequences(c)
                hashed = [bytescan.mix(shingles ^ s) for s in salts]
                for r in np.flatnonzero(np.diff(offsets) >= LENGTH):
                    a, b, node = offsets[r], offsets[r + 1], int(nodes[r])
                    if node in seen:  # copies within the task emit once
                        continue
                    seen.add(node)
                    for h in hashed:
                        _, centre, _ = compact_windows(h[a:b])
                        held.append((node, h[a:b][centre], centre))
                        size += 20 * len(centre)
                if size > FLUSH_BYTES:
                    yield from flush(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from flush(held)

    return run


_MET = "key long, node long, centre int"


def _met(table: pa.Table) -> pa.Table:
    """The windows of this bucket whose least element is also that of a window of another node."""
    key, node, centre = (np.frombuffer(b"".join(table.column(x).to_pylist()), t) for x, t in zip(_WINDOW, (U64, U64, np.uint32), strict=True))
    order = np.lexsort((centre, node, key))
    key, node, centre = key[order], node[order], centre[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (centre[1:] != centre[:-1])
    key, node, centre = key[new], node[new], centre[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(first[1:], len(key)) - 1
    met = np.repeat(node[first] != node[last], last + 1 - first)
    return pa.table({"key": pa.array(key[met].view(np.int64)), "node": pa.array(node[met].view(np.int64)), "centre": pa.array(centre[met].astype(np.int32))})


def region_id(node: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return bytescan.mix(node.view(U64) + cell.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


_REGION = "bucket int, signatures binary, nodes binary, id long, node long, cell int, content binary"


def surroundings(own: np.ndarray, key: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of one text their keys joined with the least elements on either side, and which window each is of."""
    reach, none = LENGTH - 1, U64((1 << 64) - 1)
    out, of = [], []
    for k in range(SIDES):
        value = np.full(len(own) + 2 * reach, none)
        value[reach:-reach] = bytescan.mix(own ^ bytescan.mix(np.array([1000 + k], U64)))
        least = _sliding_minimum(value, reach)
        for side, at in enumerate((centre, centre + reach + 1)):
            some = np.flatnonzero(least[at] != none)
            out.append(bytescan.mix(key[some] + bytescan.mix(least[at[some]] + U64(2 * k + side))))
            of.append(some)
    return np.concatenate(out), np.concatenate(of)


def _regions(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of windows with their surroundings, packed by bucket; and, without bucket, the shingles of their regions.

    Shingles are cut to 32 bits: they are only compared within a group.
    """

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = key % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
        filled = np.flatnonzero(np.diff(cuts))
        columns = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary()) for x in (key[order], ids[order])]
        rest = [pa.nulls(len(filled), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), *columns, *rest], names=names)

    names = [c.split()[0] for c in _REGION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for c in bytescan.chunks(batch.column(0)):
                shingles, offsets, nodes = sequences(c)
                wanted = batch.column(1).slice(c.first, c.rows).to_numpy()
                windows = batch.column(2).slice(c.first, c.rows)
                rows = []
                for r in np.flatnonzero(nodes.view(np.int64) == wanted):
                    own = shingles[offsets[r] : offsets[r + 1]]
                    met = windows[int(r)].values
                    key, centre = met.field("key").to_numpy().view(U64), met.field("centre").to_numpy()
                    joined, of = surroundings(own, key, centre)
                    cell = centre // CELL
                    held.append((joined, region_id(np.full(len(of), wanted[r]), cell[of])))
                    size += 16 * len(of)
                    cells = np.unique(cell)
                    ids = region_id(np.full(len(cells), wanted[r]), cells)
                    rows += [(i, wanted[r], x, own[max(0, x * CELL - MARGIN) : (x + 1) * CELL + MARGIN].astype(np.uint32).tobytes()) for i, x in zip(ids.tolist(), cells.tolist(), strict=True)]
                if rows:
                    columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in (pa.int32(), pa.binary(), pa.binary())), *columns], names=names)
                if size > FLUSH_BYTES:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


def _densest(shared: np.ndarray) -> tuple[int, int] | None:
    """The stretch with the greatest sum of 4 for each shared and -3 for each other shingle, if that is enough.

    A stretch of m different shingles, s of them shared, can be in a similar pair only if
    7 s >= 3 (m + LENGTH).
    """
    total = np.zeros(len(shared) + 1, np.int64)
    np.cumsum(np.where(shared, 4, -3), out=total[1:])
    least = np.minimum.accumulate(total)
    end = int((total - least).argmax())
    if total[end] - least[end] < 3 * LENGTH:
        return None
    return int(np.flatnonzero(total[:end] == least[end])[-1]), end


def _longest(shared: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch of which 6/7 are shared, if it is long enough: where neither of two passages has more of its own, that makes 3/4."""
    total = np.zeros(len(shared) + 1, np.int64)
    np.cumsum(np.where(shared, 1, -6), out=total[1:])
    later = np.maximum.accumulate(total[::-1])[::-1]  # descends
    end = len(total) - 1 - np.searchsorted(later[::-1], total, "left")  # the last place with as great a sum
    length = end - np.arange(len(total))
    begin = int(length.argmax())
    return (begin, int(end[begin])) if length[begin] >= LENGTH else None


def passages(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Similar passages of two shingle sequences: begin and end in x, begin and end in y.

    The densest stretch of shared shingles in x and that of its shingles in y are a
    passage if their sets are similar; else the longest stretches in them of which 6/7 are
    shared are, if their sets are similar; else the stretch is cut at its widest gap, on
    either side. What stands before and after a stretch in x is looked at in turn.
    """
    out = []
    distinct, ids = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = ids[: len(x)], ids[len(x) :]
    marked = np.zeros(len(distinct), bool)

    def shares(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        marked[other] = True
        found = marked[own]
        marked[other] = False
        return found

    def different(own: np.ndarray) -> int:
        marked[own] = True
        n = int(np.count_nonzero(marked))
        marked[own] = False
        return n

    def alike(s: int, e: int, u: int, v: int) -> bool:
        n = different(p[s:e][shares(p[s:e], q[u:v])])
        return n >= LEAST_SHARED and similar(n, different(p[s:e]), different(q[u:v]))

    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if min(b - a, d - c) < LENGTH:
            continue
        found = _densest(shares(p[a:b], q[c:d]))
        if not found:
            continue
        s, e = a + found[0], a + found[1]
        todo += [(a, s, c, d), (e, b, c, d)]
        found = _densest(shares(q[c:d], p[s:e]))
        if not found:
            continue
        u, v = c + found[0], c + found[1]
        in_x = np.flatnonzero(shares(p[s:e], q[u:v]))
        shared = different(p[s:e][in_x])
        if shared < LEAST_SHARED or min(e - s, v - u) < LENGTH:
            continue
        if similar(shared, different(p[s:e]), different(q[u:v])):
            out.append((s, e, u, v))
            continue
        if within := _longest(shares(p[s:e], q[u:v])):
            f, g = s + within[0], s + within[1]
            if (mirror := _longest(shares(q[u:v], p[f:g]))) and alike(f, g, u + mirror[0], u + mirror[1]):
                out.append((f, g, u + mirror[0], u + mirror[1]))
                todo += [(s, f, u, v), (g, e, u, v)]
                continue
        in_y = np.flatnonzero(shares(q[u:v], p[s:e]))
        gap_x, gap_y = np.diff(in_x), np.diff(in_y)
        if max(gap_x.max(), gap_y.max()) <= 1:
            continue
        if gap_x.max() >= gap_y.max():
            k = int(gap_x.argmax())
            todo += [(s, s + int(in_x[k]) + 1, u, v), (s + int(in_x[k + 1]), e, u, v)]
        else:
            k = int(gap_y.argmax())
            todo += [(s, e, u, u + int(in_y[k]) + 1), (s, e, u + int(in_y[k + 1]), v)]
    return out


def _nearly_whole(shared: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each row, whether some stretch has LEAST_SHARED shared shingles or more, and six or more for each new one that isn't."""
    k, n = shared.shape
    total, count = np.zeros((k, n + 1), np.int64), np.zeros((k, n + 1), np.int64)
    np.cumsum(np.where(shared, 1, -6 * new), axis=1, out=total[:, 1:])
    np.cumsum(shared, axis=1, out=count[:, 1:])
    begin = shared.copy()  # a stretch that doesn't begin with a run of shared ones is better with all of the run
    begin[:, 1:] &= ~shared[:, :-1]
    row, at = np.nonzero(begin)
    later = np.maximum.accumulate(total[:, ::-1], axis=1)  # from the right
    lift = 7 * (n + 1) * np.arange(k)  # a row's sums are above those of the rows before it
    place = np.searchsorted((later + lift[:, None]).ravel(), total[row, at] + lift[row])
    end = n - (place - row * (n + 1))  # the last place with as great a sum
    out = np.zeros(k, bool)
    out[row[count[row, end] - count[row, at] >= LEAST_SHARED]] = True
    return out


_PAIR = "a long, b long, sa int, ea int, sb int, eb int"


@dataclass
class _Group:
    """Regions of a group: their shingles as small numbers, and where each different one is."""

    begin: np.ndarray  # of each region's shingles in ``element``
    element: np.ndarray
    first: np.ndarray  # whether a shingle is the first of its kind in its region
    known: np.ndarray  # by element: whether the reference region has it
    in_known: np.ndarray  # by region: different shingles of the reference region
    posting: np.ndarray  # regions by element
    posting_begin: np.ndarray
    marked: np.ndarray  # by element: all false, for use within a method

    @classmethod
    def of(cls, parts: list[np.ndarray], reference: int, members: np.ndarray) -> _Group:
        size = np.array([len(p) for p in parts])
        begin = np.concatenate([[0], np.cumsum(size)])
        distinct, element = np.unique(np.concatenate(parts), return_inverse=True)
        region = np.repeat(np.arange(len(parts)), size)
        _, at = np.unique(region * len(distinct) + element, return_index=True)
        first = np.zeros(len(element), bool)
        first[at] = True
        known = np.zeros(len(distinct), bool)
        known[element[begin[reference] : begin[reference + 1]]] = True
        in_known = np.bincount(region[at], known[element[at]], len(parts)).astype(np.int64)
        listed = at[members[region[at]]]
        listed = listed[np.argsort(element[listed], kind="stable")]
        return cls(begin, element, first, known, in_known, region[listed], np.searchsorted(element[listed], np.arange(len(distinct) + 1)), np.zeros(len(distinct), bool))

    def content(self, x: int) -> np.ndarray:
        return self.element[self.begin[x] : self.begin[x + 1]]

    def most_shared(self, x: int) -> np.ndarray:
        """Different shingles that each region shares with ``x``, at most.

        Those outside of the reference region are counted; of it, two regions share no more
        than the one with fewer has.
        """
        own = self.content(x)[self.first[self.begin[x] : self.begin[x + 1]]]
        own = own[~self.known[own]]
        lengths = self.posting_begin[own + 1] - self.posting_begin[own]
        at = np.repeat(self.posting_begin[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.posting[at], minlength=len(self.in_known)) + np.minimum(self.in_known[x], self.in_known)

    def dense_enough(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Whether ``x`` and each of ``ys`` may have a similar passage, which either of them must hold nearly whole.

        Two passages that share n different shingles, with u and v more that are not shared, are similar
        if n >= 3 (u + v). So one of them has n / 6 more at most.
        """
        own, first = self.content(x), self.first[self.begin[x] : self.begin[x + 1]]
        shared = np.zeros((len(ys), len(own)), bool)
        for k, y in enumerate(ys):
            theirs = self.content(y)
            self.marked[theirs] = True
            shared[k] = self.marked[own]
            self.marked[theirs] = False
        enough = _nearly_whole(shared, first[None, :])
        rest = np.flatnonzero(~enough)
        width = int((self.begin[ys + 1] - self.begin[ys]).max())
        shared, new = np.zeros((len(rest), width), bool), np.ones((len(rest), width), bool)
        self.marked[own] = True
        for k, y in enumerate(ys[rest]):
            theirs = self.content(y)
            shared[k, : len(theirs)] = self.marked[theirs]
            new[k, : len(theirs)] = self.first[self.begin[y] : self.begin[y + 1]]
        self.marked[own] = False
        enough[rest] = _nearly_whole(shared, new)
        return enough


def _linked(table: pa.Table) -> pa.Table:
    """Passage pairs between the regions of each group: all of those with the leader, and a forest of the others.

    Whatever two regions share under a key the key's leader has too, or they don't become
    one tree by it; what they share besides has keys, and leaders, of its own.
    """
    node, cell, content = table.column("node").to_numpy(), table.column("cell").to_numpy(), table.column("content").to_pylist()
    out: list[tuple[int, ...]] = []
    for rows, left, right in groups_of(table, "order"):
        group = _Group.of([np.frombuffer(content[r], np.uint32) for r in rows], int(np.flatnonzero(left)[0]) if left.any() else 0, right)
        label, names = np.arange(len(rows)), node[rows]
        rank, one_block = np.arange(len(rows)), (left == right).all()
        for x in np.flatnonzero(left):
            open_rows = right & (names != names[x]) & (label != label[x]) & ((rank > x) if one_block else True)
            if not open_rows.any():
                continue
            shared = group.most_shared(x)
            todo = np.flatnonzero(open_rows & (shared >= LEAST_SHARED))
            todo = todo[np.argsort(-shared[todo], kind="stable")]
            while len(todo):
                some, todo = todo[:64], todo[64:]
                for y in some[group.dense_enough(x, some)].tolist():
                    if label[y] == label[x]:
                        continue
                    found = passages(group.content(x), group.content(y))
                    for s, e, u, v in found:
                        from_x, from_y = (max(0, int(cell[rows[k]]) * CELL - MARGIN) for k in (x, y))
                        tail = SHINGLE_WORDS - 1
                        out.append((int(names[x]), int(names[y]), from_x + s, from_x + e + tail, from_y + u, from_y + v + tail))
                    if found:
                        label[label == label[y]] = label[x]
                todo = todo[label[todo] != label[x]]
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.table([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 4), strict=True)], names=[c.split()[0] for c in _PAIR.split(", ")])


_LED = "bucket int, signatures binary, nodes binary"


def _by_leader(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """What ``led`` gives of a bucket, packed anew by group: the leader as signature of its members.

    Copies share many keys, so a member is told to be in its group by each bucket that holds some of them. Here all that
    tell it meet. A group is dealt to SLOTS buckets by the members' hashes, and its leader goes with each.
    """

    def run(table: pa.Table) -> pa.Table:
        found = led(table)
        group, node = (found[x].to_numpy().view(U64) for x in ("group", "id"))
        bucket = (bytescan.mix(group + (bytescan.mix(node) % U64(SLOTS))) % U64(buckets)).astype(np.int64)
        leads = np.unique(np.stack([bucket.view(U64), group]), axis=1)
        bucket = np.concatenate([bucket, leads[0].view(np.int64)])
        group, node = np.concatenate([group, leads[1]]), np.concatenate([node, leads[1]])
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(cuts))
        packed = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary()) for x in (group[order], node[order])]
        return pa.table([pa.array(filled.astype(np.int32)), *packed], names=[c.split()[0] for c in _LED.split(", ")])

    return run


def _led_pieces(table: pa.Table) -> pa.Table:
    """What ``led`` gives of this bucket, the members of each group in pieces of some PIECE ids.

    A member falls in a piece by its hash.
    """
    found = led(table)
    group, node = (found[x].to_numpy() for x in ("group", "id"))
    _, place, n = np.unique(group, return_inverse=True, return_counts=True)
    bits = np.ceil(np.log2(np.maximum(n / PIECE, 1))).astype(U64)[place]
    slot = (bytescan.mix(node.view(U64)) >> U64(1)) >> (U64(63) - bits)
    order = np.lexsort((node, slot, group))
    group, node, slot = group[order], node[order], slot[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(node), 1), bool), (group[1:] != group[:-1]) | (slot[1:] != slot[:-1])]))
    return pa.table({"group": pa.array(group[new]), "ids": pa.ListArray.from_arrays(pa.array(np.append(new, len(node)).astype(np.int32)), pa.array(node))})


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in bytescan.chunks(batch.column(1)):
            w, (_, _, node) = bytescan.words(c), sequences(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array(w.counts), pa.array(node.view(np.int64))], names=["doc_id", "n_words", "node"])


def passage_pairs(docs: DataFrame, nodes: DataFrame, repeated: bool = True) -> DataFrame:
    """Passages (a, sa, ea) and (b, sb, eb) in words of two nodes that are near-duplicates.

    ``docs`` has doc_id and text, ``nodes`` node, n_words and rep, a document that has it. Not all
    pairs, but enough to link each passage to one that it is similar to. ``repeated`` says
    that rows may be repeated as they are.
    """
    spark = docs.sparkSession
    n_words = nodes.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words * HASHES * 40 // LENGTH // BUCKET_BYTES)
    packed = docs.select("text").mapInArrow(_packed_windows(buckets), "bucket int, keys binary, nodes binary, centres binary")
    met = materialize(packed.groupBy("bucket").applyInArrow(_met, _MET), "met-windows")

    # The surroundings of these windows, and their regions, from one document of each node.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), met.count() * 2 * SIDES * 16 // BUCKET_BYTES)
    wanted = met.groupBy("node").agg(F.collect_list(F.struct("key", "centre")).alias("windows"))
    reps = nodes.select(F.col("node").alias("w"), F.col("rep").alias("r"))
    wanted = materialize(wanted.join(reps, F.col("node") == F.col("w")).select("r", "w", "windows"), "wanted")
    ids = wanted.select(F.col("r").alias("i")).distinct()
    texts = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("i"), "left_semi") if ids.count() <= BROADCAST_IDS else docs
    found = texts.join(wanted, F.col("doc_id") == F.col("r")).select("text", "w", "windows").mapInArrow(_regions(buckets), _REGION)
    regions = materialize(found, "regions")
    discard(met, wanted)

    grouped = regions.filter("bucket IS NOT NULL").select("bucket", "signatures", "nodes").groupBy("bucket").applyInArrow(_by_leader(max(1, buckets // 4)), _LED)
    grouped = grouped.groupBy("bucket").applyInArrow(_led_pieces, "group long, ids array<long>").select("group", F.explode("ids").alias("id")).distinct()
    content = regions.filter("bucket IS NULL").select(F.col("id").alias("k"), "node", F.col("cell").alias("at"), "content")
    content = content.dropDuplicates(["k"]) if repeated else content
    weighed = grouped.join(content.select("k", F.length("content").alias("weight")), F.col("id") == F.col("k")).drop("k")
    weighed = materialize(weighed, "led-regions")
    total = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first().n
    # The leader comes first in its group, the others in the order of a hash.
    order = F.when(F.col("group") == F.col("id"), F.lit(-(1 << 63))).otherwise(F.xxhash64("id", "group"))
    tasks = deal(weighed, REGION_BYTES, total).drop("weight").join(content, F.col("id") == F.col("k")).select("group", "block", F.col("cell").alias("task"), "lo", "hi", "node", F.col("at").alias("cell"), "content", order.alias("order"))
    pairs = materialize(tasks.groupBy("task", "lo", "hi").applyInArrow(_linked, _PAIR), "passages")
    discard(weighed, regions)
    return pairs


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Stretches of documents that are near-duplicates of stretches of others.

    ``docs`` has doc_id and text; other columns are ignored. Returns doc_id,
    first_word, end_word (exclusive), n_words, first_doc_id and repeats. Overlapping
    passages of a document are one stretch, and stretches that passages join, directly or by
    others, one class; first_doc_id is the least document of the class, and repeats is
    true in all other documents.

    Null texts and texts under MIN_WORDS words are in no row. Texts with equal words
    are wholly repeated. Rows that repeat a doc_id count as one document and give
    each stretch once; such rows with different texts are told apart by text only.
    A null doc_id is never the least; texts that only rows without one hold are
    found where they repeat each other, and their class has no name.
    """
    docs = docs.select("doc_id", "text")
    index = materialize(docs.mapInArrow(_index, "doc_id long, n_words long, node long").filter(F.col("n_words") >= MIN_WORDS), "index")
    nodes = index.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n_words").alias("n_words"))
    nodes = materialize(nodes, "nodes")
    rows = index.groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    pairs = passage_pairs(docs, nodes, not rows.filter("n > 1").isEmpty()).withColumn("link", F.xxhash64("a", "b", "sa", "sb", "ea", "eb"))

    # Stretches: overlapping passages of a node. Equal texts are one stretch.
    whole = nodes.filter("rep != last").select(F.col("node").alias("n"), F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e"), F.lit(None).cast("long").alias("link"))
    spans = pairs.select(F.col("a").alias("n"), F.col("sa").alias("s"), F.col("ea").alias("e"), "link").union(pairs.select("b", "sb", "eb", "link")).union(whole)
    before = Window.partitionBy("n").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("n").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("new", F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1)).withColumn("stretch", F.sum("new").over(upto))
    spans = materialize(spans.select("n", "s", "e", "link", F.xxhash64("n", "stretch").alias("stretch")), "spans")
    stretches = spans.groupBy("n", "stretch").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    joined = components(spans.filter("link IS NOT NULL").groupBy("link").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")))
    named = stretches.join(joined, F.col("stretch") == F.col("node"), "left").select("n", "s", "e", F.coalesce("component", "stretch").alias("class"))
    named = materialize(named.join(nodes.select("node", "rep"), F.col("n") == F.col("node")).drop("node"), "stretches")
    least = named.groupBy("class").agg(F.min("rep").alias("first")).withColumnRenamed("class", "c")
    stretch = named.join(least, F.col("class") == F.col("c")).select("n", "s", "e", "first")
    out = index.select("doc_id", "node").distinct().join(stretch, F.col("node") == F.col("n"))
    repeats = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return out.select("doc_id", F.col("s").cast("long").alias("first_word"), F.col("e").cast("long").alias("end_word"), (F.col("e") - F.col("s")).cast("long").alias("n_words"), F.col("first").alias("first_doc_id"), repeats.alias("repeats"))
