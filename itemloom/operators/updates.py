"""Changes to items: practice marks, sources, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_marks(marks: DataFrame) -> DataFrame:
    """The last mark of each item by time, then mark id: item_id, level, ts."""
    last = F.max_by(F.struct("level", "ts"), F.struct("ts", "mark_id"))
    return marks.filter(F.col("level").between(0, 5)).groupBy("item_id").agg(last.alias("m")).select("item_id", F.col("m.level").alias("level"), F.col("m.ts").alias("ts"))


def apply_marks(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Items with level and update time of their latest mark; levels outside 0 to 5 don't count."""
    joined = items.join(latest_marks(marks), F.col("id") == F.col("item_id"), "left")
    return joined.withColumn("mastery_level", F.coalesce("level", "mastery_level")).withColumn("updated_at", F.coalesce("ts", "updated_at")).select(*items.columns)


def set_source(items: DataFrame, ids: DataFrame, source: str | None) -> DataFrame:
    """Items whose listed ids get a source, or lose theirs where it is None or blank."""
    value = source.strip() if source and source.strip() else None
    listed = ids.select(F.col("id").alias("listed")).distinct()
    joined = items.join(listed, F.col("id") == F.col("listed"), "left")
    return joined.withColumn("source", F.when(F.col("listed").isNotNull(), F.lit(value).cast("string")).otherwise(F.col("source"))).select(*items.columns)


def delete_items(items: DataFrame, links: DataFrame, item_tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("gone")).distinct()
    keep = lambda df, key: df.join(gone, F.col(key) == F.col("gone"), "left_anti")
    return keep(items, "id"), keep(links, "item_id"), keep(item_tags, "item_id")
