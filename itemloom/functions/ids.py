"""Consecutive ids without a global single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.session import materialize


def assign_ids(df: DataFrame, order: list[str], start: int = 1, name: str = "id") -> DataFrame:
    """``df`` with ids start, start + 1, ... in the given order.

    Rows are dealt out by range and written in order with their places; each part is shifted by the
    sizes of the parts before it. Equal rows may share out their ids either way.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ids").withColumn("_part", F.shiftright("_at", 33)).withColumn("_place", F.col("_at") - F.shiftleft("_part", 33))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_shift"))
    return dealt.join(F.broadcast(shifts), "_part").withColumn(name, (F.col("_shift") + F.col("_place") + start).cast("bigint")).drop("_at", "_part", "_place", "_shift")  # a row for each part


def next_id(existing: DataFrame, name: str = "id") -> int:
    return (existing.agg(F.max(name)).first()[0] or 0) + 1


def number_within(df: DataFrame, key: str, order: list[str], form: str, name: str) -> DataFrame:
    """Text ids that count the rows of each ``key`` from 1, in a printf form."""
    return df.withColumn(name, F.format_string(form, F.col(key), F.row_number().over(Window.partitionBy(key).orderBy(*order))))
