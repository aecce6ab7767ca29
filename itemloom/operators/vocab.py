"""Aliases of topic names and their curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 80


def canonicalise(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``df`` with a name column trimmed and replaced by its canonical form, one hop only.

    Of an alias that is listed more than once the least canonical form counts.
    """
    known = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    joined = df.withColumn(column, F.trim(column)).join(known, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def canonicalise_list(df: DataFrame, key: str, column: str, aliases: DataFrame) -> DataFrame:
    """The same for an array of names, in order; ``key`` identifies the rows."""
    spread = df.select(key, F.posexplode(column).alias("_at", "_name"))
    names = canonicalise(spread, "_name", aliases).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_name"))).alias("_list"))
    joined = df.join(names, key, "left")
    return joined.withColumn(column, F.when(F.col(column).isNull(), None).otherwise(F.coalesce(F.transform("_list", lambda x: x["_name"]), F.array().cast("array<string>")))).drop("_list")


def apply_groups(aliases: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases after the accepted duplicate groups, and one row with the number applied.

    ``groups`` has group_id, canonical and duplicates. Blank names and names equal to
    their canonical form are passed over; a later group or place wins over an earlier.
    """
    spread = groups.select("group_id", F.trim("canonical").alias("canonical"), F.posexplode("duplicates").alias("at", "alias")).withColumn("alias", F.trim("alias"))
    valid = spread.filter("alias != '' AND canonical != '' AND alias != canonical")
    last = F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("group_id"), F.desc("at")))
    new = valid.withColumn("n", last).filter("n = 1").select("alias", "canonical")
    old = aliases.select("alias", "canonical").join(new.select("alias"), "alias", "left_anti")
    return old.unionByName(new), valid.agg(F.count("*").alias("applied"))


def canonical_names(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.col("canonical").alias("name")).distinct()


def review_batches(topics: DataFrame, chapters: DataFrame, subjects: DataFrame, size: int = BATCH) -> DataFrame:
    """Numbered lists of topic names for review: subject, batch, n_names, names.

    Names are in chapter and topic order, as bullets; subjects with one name are left out.
    """
    c = chapters.select(F.col("id").alias("chapter_id"), "subject_id", F.col("sort_order").alias("chapter_order"))
    s = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    named = topics.select("id", "name", "sort_order", "chapter_id").join(c, "chapter_id").join(s, "subject_id")
    inside = Window.partitionBy("subject_id")
    numbered = named.withColumn("n", F.row_number().over(inside.orderBy("chapter_order", "sort_order", "id"))).withColumn("total", F.count("*").over(inside)).filter("total >= 2")
    grouped = numbered.groupBy("subject", F.floor((F.col("n") - 1) / size).cast("bigint").alias("batch")).agg(F.count("*").alias("n_names"), F.array_sort(F.collect_list(F.struct("n", "name"))).alias("list"))
    return grouped.select("subject", "batch", "n_names", F.array_join(F.transform("list", lambda x: F.concat(F.lit("- "), x["name"])), "\n").alias("names"))


def suspect_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases to look at: blank or question-mark keys, self-maps, and targets that are aliases."""
    again = aliases.select(F.col("alias").alias("next")).distinct()
    joined = aliases.join(again, F.col("canonical") == F.col("next"), "left")
    reason = F.when(F.trim("alias").rlike(r"^\?*$"), "blank").when(F.col("alias") == F.col("canonical"), "self").when(F.col("next").isNotNull(), "chained")
    return joined.select("alias", "canonical", reason.alias("reason")).filter("reason IS NOT NULL")
