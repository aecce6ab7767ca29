"""The question-bank model over the provided tables, and the same views as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions.ids import assign_ids
from itemloom.session import in_tasks, table

NOW = "2003-01-01 00:00:00"

#: The model views as SQL, to stand behind WITH.
MODEL = """
subjects AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region),
chapters AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS subject_id, n_name AS name, n_nationkey AS sort_order FROM nation),
topics AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS chapter_id, s_name AS name, s_suppkey AS sort_order,
  CASE WHEN s_suppkey > 0 THEN CAST(floor((s_suppkey - 1) / 4.0) AS BIGINT) END AS parent_id FROM supplier),
items AS (SELECT o_orderkey AS id, CAST(n_regionkey AS BIGINT) AS subject_id, 'Item ' || o_orderkey || ' ' || o_orderpriority AS content,
  'src' || (o_orderkey % 20) AS source, CAST(o_orderkey AS VARCHAR) AS question_number,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS mastery_level,
  CAST(o_orderkey % 97 + 1 AS INTEGER) AS source_page, o_orderdate AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
links AS (SELECT l_orderkey AS item_id, l_suppkey AS topic_id, CASE WHEN min(l_linenumber) = 1 THEN 'primary' ELSE 'secondary' END AS role,
  CAST(greatest(0.1, least(1.0, max(l_quantity) / 50)) AS DECIMAL(6, 4)) AS weight FROM lineitem GROUP BY 1, 2),
item_tags AS (SELECT DISTINCT l_orderkey AS item_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
tags AS (SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand AS name FROM (SELECT DISTINCT p_brand FROM part)),
exams AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Mid-term', 2), (CAST(2 AS BIGINT), 'Final', 1), (CAST(3 AS BIGINT), 'Mock', 3)) e(id, name, sort_order)),
exam_subjects AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS BIGINT)), (1, 1), (1, 2), (2, 2), (2, 3), (2, 4)) b(exam_id, subject_id)),
aliases AS (SELECT a.s_name AS alias, b.s_name AS canonical FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey - 1 WHERE a.s_suppkey % 7 = 0)
"""


def model_sql(body: str) -> str:
    return f"WITH {MODEL}{',' if not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"


@dataclass
class Model:
    """The model tables of one data folder, each built where it is asked for."""

    spark: SparkSession
    sf_dir: str

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def subjects(self) -> DataFrame:
        return self._table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def chapters(self) -> DataFrame:
        return self._table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("subject_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("sort_order"))

    @cached_property
    def topics(self) -> DataFrame:
        parent = F.when(F.col("s_suppkey") > 0, F.floor((F.col("s_suppkey") - 1) / 4).cast("long"))
        return self._table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("chapter_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("sort_order"), parent.alias("parent_id"))

    @cached_property
    def items(self) -> DataFrame:
        joined = self._table("orders").join(self._table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self._table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("o_orderkey")
        return joined.select(
            key.alias("id"),
            F.col("n_regionkey").cast("long").alias("subject_id"),
            F.concat(F.lit("Item "), key, F.lit(" "), "o_orderpriority").alias("content"),
            F.concat(F.lit("src"), key % 20).alias("source"),
            key.cast("string").alias("question_number"),
            F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.substring("o_orderpriority", 1, 1).cast("int")).alias("mastery_level"),
            (key % 97 + 1).cast("int").alias("source_page"),
            F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        )

    @cached_property
    def links(self) -> DataFrame:
        weight = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.max("l_quantity") / 50)).cast("decimal(6,4)")
        role = F.when(F.min("l_linenumber") == 1, "primary").otherwise("secondary")
        lines = self._table("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("topic_id"), "l_linenumber", "l_quantity")
        return in_tasks(lines, lines.count(), "item_id").groupBy("item_id", "topic_id").agg(role.alias("role"), weight.alias("weight"))

    @cached_property
    def item_tags(self) -> DataFrame:
        joined = self._table("lineitem").join(self._table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(F.col("l_orderkey").alias("item_id"), F.col("p_brand").alias("tag")).distinct()

    @cached_property
    def tags(self) -> DataFrame:
        return assign_ids(self._table("part").select(F.col("p_brand").alias("name")).distinct(), ["name"]).select("id", "name")

    @cached_property
    def item_tag_ids(self) -> DataFrame:
        return self.item_tags.join(self.tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), "tag").select("item_id", "tag_id")

    @cached_property
    def exams(self) -> DataFrame:
        return self.spark.createDataFrame([(1, "Mid-term", 2), (2, "Final", 1), (3, "Mock", 3)], "id long, name string, sort_order int")

    @cached_property
    def exam_subjects(self) -> DataFrame:
        return self.spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (2, 4)], "exam_id long, subject_id long")

    @cached_property
    def aliases(self) -> DataFrame:
        a, b = self._table("supplier").alias("a"), self._table("supplier").alias("b")
        return a.filter("a.s_suppkey % 7 = 0").join(b, F.expr("b.s_suppkey = a.s_suppkey - 1")).select(F.col("a.s_name").alias("alias"), F.col("b.s_name").alias("canonical"))
