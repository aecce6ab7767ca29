"""Set-similarity join of documents on word shingles by PartEnum signatures.

The shingle domain (64-bit hashes) is cut in ``2 ** band`` equal parts, where the
band of a set is the octave of its size. A part's signature is the hash of the
elements that the set has in it. Two sets that differ in H elements spoil at most
H parts, and Jaccard similarity of 3/4 bounds H by a third of the smaller set and
so of either. A set with more than k = size // 3 filled parts therefore shares a
filled part with each similar set, and as at most H of its parts are spoiled, the
k + 1 first signatures of both sides, in any order common to all sets, already have
one in common. Sets with fewer filled parts (small ones) add the signatures of the
next finer cuts, down to single elements. A set just above an octave also emits in
the octave below, where the smaller partner is. So every similar pair shares a
signature. Parts made of shingles that many documents hold come last in the order,
so that passages which many documents share make few documents meet.

Equal sets are one node from the start. Nodes that share a signature form a group
around the signature's leading node; groups are dealt to tasks of bounded size. A first
pass compares parity sketches, which rule out most pairs and never a similar one, and
gives a spanning forest of what is left. A second one deals the trees of that forest out with their
whole sets, verifies, and gives a spanning forest of the links. So both passes compare all
pairs that may be similar, but neither gives more rows than it has nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm import bytescan
from itemloom.llm.graph import cells_for, components, deal, forest, groups_of, place, spread
from itemloom.session import discard, materialize, quoted

SHINGLE_WORDS = 5
U64 = np.uint64
#: Packed signatures held by a task before it hands them on.
FLUSH_BYTES = 24 << 20
#: Bytes of signatures, of sketches and of sets that one task compares, about.
BUCKET_BYTES, SKETCH_BYTES, SET_BYTES = 8 << 20, 2 << 20, 8 << 20
#: What a sketch weighs besides its bytes, so that a task's pairs have a bound too.
NODE_WEIGHT = 512
#: Most rows that are broadcast to pick the texts to verify: six numbers each, 24 MB.
BROADCAST_IDS = 500_000
#: The finest cut: parts this small hold single elements.
FINEST = 63
#: Documents are counted by this many low bits of their shingles.
SLOT_BITS = 16
_SLOT = U64((1 << SLOT_BITS) - 1)
#: Standard deviations above the mean from which a slot is frequent: within a task, then in all.
TASK_DEVIATIONS, DEVIATIONS = 4, 6
_INDEX_SCHEMA = "doc_id long, n_shingles long, node long, sketch binary, slot int, excess double"


def similar(shared: Column | np.ndarray, a: Column | np.ndarray, b: Column | np.ndarray):
    """100 * intersection >= 75 * union, in whole numbers."""
    return 100 * shared >= 75 * (a + b - shared)


def _set_id(sh: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set; rows must be non-empty where it is used."""
    total = np.zeros(len(sh) + 1, U64)
    np.cumsum(bytescan.mix(sh), dtype=U64, out=total[1:])
    return bytescan.mix((total[offsets[1:]] - total[offsets[:-1]]) ^ np.diff(offsets).astype(U64))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of two to four hash cells an element, packed.

    Each element that only one of two sets has flips one cell at most, so the
    cells in which two sketches differ never outnumber the differing elements. The
    same holds when a sketch is folded to half its cells.
    """
    cells = max(64, 2 << (len(s) - 1).bit_length())
    odd = (np.bincount((s & U64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each slot of shingles that many of the task's texts hold."""
    counted, total = np.zeros(1 << SLOT_BITS, np.int64), 0
    for batch in batches:
        for c in bytescan.chunks(batch.column(1)):
            sh, offsets = bytescan.shingle_sets(c, SHINGLE_WORDS)
            counted += np.bincount((sh & _SLOT).astype(np.int64), minlength=len(counted))
            total += len(sh)
            sketches = [sketch(sh[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column(0).slice(c.first, c.rows), pa.array(np.diff(offsets)), pa.array(_set_id(sh, offsets).view(np.int64)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(c.rows, pa.int32()), pa.nulls(c.rows, pa.float64())], names=_INDEX_NAMES)
    mean = total / len(counted)
    often = np.flatnonzero(counted > mean + TASK_DEVIATIONS * np.sqrt(mean) + 2)
    nothing = [pa.nulls(len(often), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    yield pa.RecordBatch.from_arrays([*nothing, pa.array(often.astype(np.int32)), pa.array(counted[often] - mean)], names=_INDEX_NAMES)


_INDEX_NAMES = [x.split()[0] for x in _INDEX_SCHEMA.split(", ")]


def _frequent_slots(index: DataFrame, shingles: int) -> np.ndarray:
    """Which slots hold shingles of many documents: 2 ** SLOT_BITS bits.

    Only the order of signatures depends on it, so it needn't be exact.
    """
    mean = shingles / (1 << SLOT_BITS)
    found = index.filter("slot IS NOT NULL").groupBy("slot").agg(F.sum("excess").alias("excess")).filter(F.col("excess") > DEVIATIONS * np.sqrt(mean))
    out = np.zeros(1 << SLOT_BITS, bool)
    out[found.select("slot").toArrow()["slot"].to_numpy()] = True
    return out


def _part_signatures(s: np.ndarray, band: int, frequent: np.ndarray) -> np.ndarray:
    """Signatures of the filled parts of one sorted set in order: parts of frequent shingles only come last."""
    part = s >> U64(64 - band) if band else np.zeros(len(s), U64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    total = np.add.reduceat(bytescan.mix(s), first)
    often = np.logical_and.reduceat(frequent[(s & _SLOT).astype(np.int64)], first)
    return np.sort(bytescan.mix(total + U64(band)) >> U64(1) | often.astype(U64) << U64(63))


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """All signatures that one sorted, non-empty set emits."""
    n = len(s)
    most = n // 3
    octave = n.bit_length() - 1
    bands = [octave]
    if octave and n * 3 <= (4 << octave):  # at most 4/3 of the octave's beginning
        bands.append(octave - 1)
    out = []
    for band in bands:
        while True:
            found = _part_signatures(s, band, frequent)
            out.append(found[: most + 1])
            if len(found) > most or band >= FINEST:
                break
            band = min(band + 2, FINEST)
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def _packed_signatures(buckets: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        signature = np.concatenate(held)
        node = np.repeat(np.array(nodes, U64), [len(x) for x in held])
        bucket = signature % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
        signature, node = signature[order], node[order]
        filled = np.flatnonzero(np.diff(cuts))
        packed = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary()) for x in (signature, node)]
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), *packed], names=["bucket", "signatures", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        nodes: list[int] = []
        size, seen = 0, set()
        for batch in batches:
            for c in bytescan.chunks(batch.column(0)):
                sh, offsets = bytescan.shingle_sets(c, SHINGLE_WORDS)
                for node, a, b in zip(_set_id(sh, offsets).tolist(), offsets[:-1], offsets[1:], strict=True):
                    if a == b or node in seen:  # copies within the task emit once
                        continue
                    seen.add(node)
                    held.append(signatures(sh[a:b], frequent))
                    nodes.append(node)
                    size += 16 * len(held[-1])
                if size > FLUSH_BYTES:
                    yield from flush(held, nodes)
                    held, nodes, size, seen = [], [], 0, set()
        if held:
            yield from flush(held, nodes)

    return run


def led(table: pa.Table) -> pa.Table:
    """Nodes (id) that share a signature of this bucket with others, with the signature's leader (group).

    The leader is the node of least hash, so that nodes which share many signatures
    mostly have one leader in all of them.
    """
    signature, node = (np.frombuffer(b"".join(table.column(x).to_pylist()), U64) for x in ("signatures", "nodes"))
    order = np.lexsort((bytescan.mix(node), signature))
    signature, node = signature[order], node[order]
    new = np.ones(len(node), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
    signature, node = signature[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
    length = np.diff(np.append(first, len(node)))
    lead, met = np.repeat(node[first], length), np.repeat(length > 1, length)
    lead, node = lead[met], node[met]
    order = np.lexsort((node, lead))
    lead, node = lead[order], node[order]
    new = np.ones(len(node), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (node[1:] != node[:-1])
    return pa.table({"group": pa.array(lead[new].view(np.int64)), "id": pa.array(node[new].view(np.int64))})


_EDGE = "a long, b long"


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": pa.array(np.concatenate(a + none)), "b": pa.array(np.concatenate(b + none))})


def _near_by_sketch(size: np.ndarray, sketches: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which rows a row may be similar to by the differing cells; rows are in order of size."""
    width = np.array([len(x) for x in sketches])
    own: dict[int, np.ndarray] = {}
    folded: dict[int, np.ndarray] = {}
    start = {int(w): int(np.searchsorted(width, w)) for w in np.unique(width)}
    for w, at in start.items():
        own[w] = np.frombuffer(b"".join(sketches[at : int(np.searchsorted(width, w, "right"))]), U64).reshape(-1, w // 8)
        if w > 8:
            folded[w] = own[w][:, : w // 16] ^ own[w][:, w // 16 :]

    def near(x: int, ys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ys), bool)
        w = int(width[x])
        for v in np.unique(width[ys]).tolist():
            a, b = np.searchsorted(width[ys], [v, v + 1])
            least = min(v, w)
            mine = (own if w == least else folded)[w][x - start[w]]
            theirs = (own if v == least else folded)[v][ys[a:b] - start[v]]
            differing = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
            out[a:b] = 7 * differing <= size[x] + size[ys[a:b]]
        return out

    return near


def _near_sketches(table: pa.Table) -> pa.Table:
    """A spanning forest of the pairs of each group that sizes and sketches don't rule out."""
    ids, sizes, sketches = table.column("id").to_numpy(), table.column("n_shingles").to_numpy(), table.column("sketch").to_pylist()
    a, b = [], []
    for rows, left, right in groups_of(table, "n_shingles"):
        found = forest(sizes[rows], left, right, _near_by_sketch(sizes[rows], [sketches[r] for r in rows]))
        if found:
            pairs = ids[rows[np.array(found)]]
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return _edges(a, b)


def _similar_sets(table: pa.Table) -> pa.Table:
    """A spanning forest of the pairs of each group whose whole sets are similar."""
    ids, sizes, packed = table.column("id").to_numpy(), table.column("n_shingles").to_numpy(), table.column("elements").to_pylist()
    a, b = [], []
    for rows, left, right in groups_of(table, "n_shingles"):
        size = sizes[rows]
        distinct, element = np.unique(np.frombuffer(b"".join(packed[r] for r in rows), U64), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        marked = np.zeros(len(distinct), bool)

        def near(x: int, ys: np.ndarray, size=size, element=element, begin=begin, marked=marked) -> np.ndarray:
            own = element[begin[x] : begin[x + 1]]
            marked[own] = True
            total = np.concatenate([[0], np.cumsum(size[ys])])
            at = np.repeat(begin[ys] - total[:-1], size[ys]) + np.arange(total[-1])
            shared = np.add.reduceat(marked[element[at]], total[:-1], dtype=np.int64)
            marked[own] = False
            return similar(shared, size[x], size[ys])

        found = forest(size, left, right, near)
        if found:
            pairs = ids[rows[np.array(found)]]
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return _edges(a, b)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed sets of texts that are the node they are expected to be."""
    for batch in batches:
        for c in bytescan.chunks(batch.column(0)):
            sh, offsets = bytescan.shingle_sets(c, SHINGLE_WORDS)
            same = _set_id(sh, offsets).view(np.int64) == batch.column(1).slice(c.first, c.rows).to_numpy()
            elements = [sh[a:b].tobytes() if ok else None for ok, a, b in zip(same, offsets[:-1], offsets[1:], strict=True)]
            rest = batch.select(range(1, batch.num_columns)).slice(c.first, c.rows)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(elements, pa.binary())], names=[*rest.schema.names, "elements"]).filter(pa.array(same))


def _verified(docs: DataFrame, nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """Components of nodes by links within the trees (node, component) of what may be similar.

    Only the texts of one document for each node are read again. Their ids are
    broadcast up to BROADCAST_IDS of them; beyond that both sides shuffle.
    """
    wanted = trees.select(F.col("node").alias("id"), F.col("component").alias("group")).join(nodes.select(F.col("node").alias("id"), "rep", "n_shingles"), "id")
    wanted = materialize(wanted.withColumn("weight", 8 * F.col("n_shingles")), "wanted")
    n = wanted.agg(F.count("*").alias("rows"), F.coalesce(F.sum("weight"), F.lit(0)).alias("bytes")).first()
    # Where each set goes is known before it is made, so that sets are shuffled once.
    picked = place(wanted, SET_BYTES).select(F.col("rep").alias("r"), "id", "group", "n_shingles", "block", "blocks")
    texts = docs.join(F.broadcast(picked) if n.rows <= BROADCAST_IDS else picked, F.col("doc_id") == F.col("r")).select("text", "id", "group", "n_shingles", "block", "blocks")
    sets = texts.mapInArrow(_sets, "id long, group long, n_shingles long, block int, blocks int, elements binary")
    tasks = spread(sets, cells_for(n.bytes, SET_BYTES))
    links = tasks.groupBy("cell", "lo", "hi").applyInArrow(_similar_sets, _EDGE)
    found = components(links)
    discard(wanted)
    return found


def similar_documents(docs: DataFrame) -> DataFrame:
    """Components of documents linked by shingle-set similarity of 3/4 or more.

    ``docs`` has doc_id and text; other columns are ignored. Returns doc_id,
    n_shingles and component_id, the least doc_id reachable by links, itself
    included; one row for each input row.

    Words are lower-cased over A-Z. A text of one to four words is one shingle,
    equal only to the same sequence. A null or wordless text has no shingles and
    its component is its own id. Rows that repeat a doc_id are separate documents
    with that id; a null doc_id is passed over as a name of a component, unless all
    its members have none. Ties can't arise: all comparisons are in whole numbers.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = materialize(docs.mapInArrow(_index, _INDEX_SCHEMA), "index")
    index = found.filter("slot IS NULL").select("doc_id", "n_shingles", "node", "sketch")
    nodes = index.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes, "nodes")
    n = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    frequent = _frequent_slots(found, n.shingles)

    # Nodes by shared signatures, 16 bytes for every second shingle or so.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n.shingles * 8 // BUCKET_BYTES)
    packed = docs.select("text").mapInArrow(_packed_signatures(buckets, frequent), "bucket int, signatures binary, nodes binary")
    grouped = packed.groupBy("bucket").applyInArrow(led, "group long, id long").distinct()

    # What sketches don't rule out, then what whole sets confirm.
    met = grouped.join(nodes.select(F.col("node").alias("id"), "n_shingles", (F.length("sketch") + NODE_WEIGHT).alias("weight")), "id")
    met = materialize(met, "met")
    weight = met.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first().n
    dealt = deal(met, SKETCH_BYTES, weight).drop("weight").join(nodes.select(F.col("node").alias("k"), "sketch"), F.col("id") == F.col("k")).drop("k")
    trees = components(dealt.groupBy("cell", "lo", "hi").applyInArrow(_near_sketches, _EDGE))
    discard(met)
    linked = _verified(docs, nodes, trees)
    discard(trees)

    named = linked.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = nodes.select(F.col("node").alias("k"), "rep").join(linked, F.col("k") == F.col("node"), "left").join(least, "component", "left").select("k", F.coalesce("component_id", "rep").alias("component_id"))
    return index.join(by_node, (F.col("node") == F.col("k")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that have a similar one of lesser doc_id in their component.

    All columns stay as they are. Rows that share a doc_id stay if one of them does;
    equal rows of one doc_id and text become one. Wordless texts all stay, and rows
    without a doc_id, which can't be told apart.
    """
    found = materialize(similar_documents(docs).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("own")), "found")
    by_id = materialize(found.groupBy("doc_id").agg(F.max("own").alias("own"), F.count("*").alias("n")), "by-id")
    columns = quoted(docs)
    kept = docs.join(by_id.filter("NOT own").select("doc_id"), "doc_id", "left_anti").select(*columns)
    twice = by_id.filter("own AND n > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(*columns).union(once)


#: The components as SQL, by all pairs that share a shingle: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) m USING (doc_id)
"""
