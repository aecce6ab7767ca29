"""Mix sources to target weights by hash-threshold histograms.

Every document gets a fixed 36-bit hash of its id. Per source the sizes are
summed by the leading bits of the hash; the running sum finds the one bucket in
which the budget runs out, and only that bucket is summed again by the next bits.
After ``LEVELS`` rounds the boundary is an exact hash threshold: documents below
it are taken once more than those above it. Nothing is sorted or collected; a
larger budget always takes a superset of a smaller one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.session import materialize, quoted

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BITS_A_LEVEL = 12
LEVELS = 3
HASH_BITS = BITS_A_LEVEL * LEVELS
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """The first 36 bits of the MD5 of the id's decimal text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: its size, weight and target.

    ``sizes`` has source and source_size. Sources by code point, null last, weigh
    ``weights`` in turn. The shares of the total are filled like water: with all
    sources in order of cap by weight, the level is what the uncapped share, and
    a source whose cap lies below the level stops at its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cap = F.col("source_size") * most
    level_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = level_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("all_sizes", F.sum("source_size").over(whole))
        .withColumn("all_weights", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # the level if this source and all after it were uncapped
        .withColumn("level", (F.col("all_sizes") - F.col("cap_before")) / (F.col("all_weights") - F.col("weight_before")))
        .withColumn("level_place", F.row_number().over(level_order))
        .withColumn("first_free", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("level_place", "level"))).over(whole))
    )
    capped = F.col("first_free").isNull() | (F.col("level_place") < F.col("first_free.level_place"))
    return ranked.select(
        "source",
        "source_size",
        F.when(capped, F.col("cap").cast("double")).otherwise(F.col("first_free.level") * F.col("weight")).alias("target"),
    )


def _boundaries(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repeats of every document, and the hash threshold of one more.

    The threshold stands after the last hash value whose running sum stays within
    the rest of the budget or overshoots it by less than it would fall short.
    """
    state = targets.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("repeats"),
        F.lit(0).cast("long").alias("prefix"),
    ).withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    for level in range(LEVELS):
        shift = BITS_A_LEVEL * (LEVELS - 1 - level)
        at = _join_sources(docs, state.select("s", "prefix"))
        if level:
            at = at.filter(F.shiftright("h", shift + BITS_A_LEVEL) == F.col("prefix"))
        histogram = at.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        summed = histogram.withColumn("below", F.coalesce(F.sum("words").over(running), F.lit(0))).select(F.col("source").alias("hs"), "bucket", "words", "below")
        found = (
            summed.join(state.select("s", "budget"), F.col("hs").eqNullSafe(F.col("s")))
            .filter(F.col("below") <= F.col("budget"))
            .groupBy("hs")
            .agg(F.max_by(F.struct("bucket", "below", "words"), "bucket").alias("edge"))
        )
        state = state.join(found, F.col("s").eqNullSafe(F.col("hs")), "left").select(
            "s",
            "source_size",
            "target",
            "repeats",
            F.coalesce("edge.bucket", F.lit(0)).alias("prefix"),
            (F.col("budget") - F.coalesce("edge.below", F.lit(0))).alias("budget"),
            F.coalesce("edge.words", F.lit(0)).alias("edge_words"),
        )
        state = materialize(state, "mixing-state")
    over = F.col("edge_words") - F.col("budget") < F.col("budget")
    return state.select("s", "source_size", "target", "repeats", F.when(over, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))


def _join_sources(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    """Join documents with one row per source ``s``.

    The source rows are broadcast where their counted number allows; beyond it
    both sides shuffle, and adaptive execution splits a hot source.
    """
    small = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return docs.join(F.broadcast(by_source) if small else by_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _sized(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per source: source_size, target, whole repeats and threshold."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return _boundaries(sized, materialize(source_targets(sizes, weights, most), "mixing-targets"))


def _repeats(most: int) -> Column:
    return F.least(F.col("repeats") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0), F.lit(most)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has doc_id, text and source; other columns are ignored. Returns
    doc_id, size, source_size, target, repeats and taken = size * repeats.

    A null or empty text has size 0 and takes nothing. A null source is a source
    of its own. Rows that share a doc_id share the hash and so the decision. A
    source without words has target 0. An empty table gives an empty result.
    """
    sized = materialize(_sized(docs, "doc_id"), "mixing-sizes")
    joined = _join_sources(sized, _plan(sized, weights, most))
    return joined.select("doc_id", "size", "source_size", "target", _repeats(most).alias("repeats"), (F.col("size") * _repeats(most)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The documents of which the mix takes words: all their columns, then size, target, repeats and taken.

    Where a document's own column has one of these names, the new one is called mix_size and so on.
    Rows without words are never taken. Otherwise as in ``mix``.
    """
    sized = materialize(_sized(docs, "doc_id"), "mixing-sizes")
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    joined = _join_sources(rows, _plan(sized, weights, most))
    named = {"size": F.col("size"), "target": F.col("target"), "repeats": _repeats(most), "taken": F.col("size") * _repeats(most)}
    new = [c.alias(f"mix_{name}" if name in docs.columns else name) for name, c in named.items()]
    return joined.filter(named["taken"] > 0).select("row.*", *new)


#: The mix with the default weights as SQL.
ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
named AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, 3 * source_size AS cap FROM sizes),
ordered AS (SELECT *, row_number() OVER w AS place, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM named WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source)),
levelled AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) AS level FROM ordered),
free AS (SELECT min(place) AS first_free, arg_min(level, place) AS shared FROM levelled WHERE cap > level * weight),
targets AS (SELECT source, source_size, CASE WHEN first_free IS NULL OR place < first_free THEN CAST(cap AS DOUBLE) ELSE shared * weight END AS target FROM levelled CROSS JOIN free),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM targets),
by_hash AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY 1, 2),
running AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_hash),
edges AS (SELECT p.source, p.source_size, p.target, p.repeats, max(r.h) AS edge, arg_max(p.target - p.repeats * p.source_size - r.below, r.h) AS rest, arg_max(r.words, r.h) AS words
  FROM planned p JOIN running r ON r.source IS NOT DISTINCT FROM p.source WHERE r.below <= p.target - p.repeats * p.source_size GROUP BY ALL)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, e.source_size, e.target,
  CAST(d.size * least(3, e.repeats + CASE WHEN d.h < e.edge + CASE WHEN e.words - e.rest < e.rest THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN edges e ON e.source IS NOT DISTINCT FROM d.source
"""
