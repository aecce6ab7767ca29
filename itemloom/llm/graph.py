"""Groups cut to tasks of bounded size, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.session import discard, materialize


def place(members: DataFrame, block: int) -> DataFrame:
    """``members`` (group and id long, weight) with block, and blocks: into how many its group is cut, null for 1.

    A group of at most ``block`` weight goes whole; a heavier one is cut by a hash of the id.
    """
    heavy = members.groupBy("group").agg(F.sum("weight").alias("all")).filter(F.col("all") > block)
    heavy = heavy.select(F.col("group").alias("heavy"), F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    placed = members.join(heavy, F.col("group") == F.col("heavy"), "left").drop("heavy")
    return placed.withColumn("block", F.coalesce(F.pmod(F.xxhash64("id", "group"), F.col("blocks")), F.lit(0)).cast("int"))


def spread(placed: DataFrame, cells: int) -> DataFrame:
    """Placed rows with the task that they belong to: cell, lo, hi.

    Whole groups share ``cells`` cells. Of a group in blocks each pair of blocks is a cell of its own,
    so that every two members meet in a task that holds two blocks at most.
    """
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    cell = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("group"), F.lit(cells))).otherwise(F.xxhash64("group"))
    rest = [c for c in placed.columns if c != "blocks"]
    return dealt.select(*rest, cell.alias("cell"), F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))


def cells_for(total: int, block: int) -> int:
    """How many cells whole groups share, for tasks of a block's weight or so."""
    return max(16, -(-int(total) // block))


def deal(members: DataFrame, block: int, total: int) -> DataFrame:
    """``members`` dealt to tasks of bounded size; ``total`` is the sum of weights."""
    return spread(place(members, block), cells_for(total, block))


def groups_of(table: pa.Table, order: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each group of a dealt task: its rows by ``order``, and which of them meet which (masks)."""
    group, block = table.column("group").to_numpy(), table.column("block").to_numpy()
    rows = np.lexsort((table.column(order).to_numpy(), group))
    cuts = np.flatnonzero(np.concatenate([[True], group[rows[1:]] != group[rows[:-1]], [True]]))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = rows[a:b]
        yield own, block[own] == lo, block[own] == hi


def forest(size: np.ndarray, left: np.ndarray, right: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the near pairs of left and right rows.

    Rows are in order of ``size``; only sizes within 4 to 3 meet. ``near(x, ys)``
    tells which rows ``ys`` (ascending) are near to ``x``. Rows already in one tree aren't
    compared again, so that there are fewer edges than rows.
    """
    edges, label = [], np.arange(len(size))
    others = np.flatnonzero(right)
    begin = np.searchsorted(4 * size[others], 3 * size)
    if (left == right).all():  # within one block each pair is looked at from its first row
        begin = np.maximum(begin, np.searchsorted(others, np.arange(len(size)), "right"))
    end = np.searchsorted(3 * size[others], 4 * size, "right")
    for x in np.flatnonzero(left):
        ys = others[begin[x] : end[x]]
        ys = ys[label[ys] != label[x]]
        if not len(ys):
            continue
        ys = ys[near(x, ys)]
        if len(ys):
            trees, first = np.unique(label[ys], return_index=True)
            edges += [(x, int(y)) for y in ys[first]]
            label[np.isin(label, trees)] = label[x]
    return edges


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    sides = _both_ways(edges)
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return sides.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    moved = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the least node reachable from each node that has an edge.

    ``edges`` has long columns a and b, in either order; loops are ignored. The
    rounds grow with the logarithm of the longest chain; each is written to the
    shared folder, so a lost executor costs one round at most. The result is such a
    table too.
    """
    now = materialize(edges.select("a", "b").filter("a != b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if not state.n or state == before:
            named = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
            out = materialize(named, "components")
            discard(now)
            return out
        before, last = state, now
        now = materialize(_small_star(_large_star(now)), "edges")
        discard(last)
