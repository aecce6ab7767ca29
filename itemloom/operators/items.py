"""Search, selection and joins over items, topics and their hierarchy.

Tables: subjects(id, name), chapters(id, subject_id, name, sort_order),
topics(id, chapter_id, name, sort_order, parent_id), items(id, subject_id, ...),
links(item_id, topic_id, role, weight), item_tags(item_id, tag). The hierarchy
sides are dimension tables; Spark broadcasts them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.ids import assign_ids


def with_hierarchy(links: DataFrame, topics: DataFrame, chapters: DataFrame, subjects: DataFrame) -> DataFrame:
    """Links with the names and ids of topic, chapter and subject."""
    t = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic"), "chapter_id", F.col("sort_order").alias("topic_order"))
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("name").alias("chapter"), F.col("subject_id").alias("topic_subject_id"), F.col("sort_order").alias("chapter_order"))
    s = subjects.select(F.col("id").alias("topic_subject_id"), F.col("name").alias("subject"))
    return links.join(t.join(c, "chapter_id").join(s, "topic_subject_id"), "topic_id")


def number_contains(number: Column, part: str, literal: bool = False) -> Column:
    """Whether a question number has ``part``: LIKE without case, or literally."""
    return F.contains(number, F.lit(part)) if literal else number.ilike(f"%{part}%")


def search_items(
    items: DataFrame,
    links: DataFrame,
    topics: DataFrame,
    topic: int | None = None,
    chapter: int | None = None,
    subject: int | None = None,
    mastery: int | None = None,
    number_like: str | None = None,
    source: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Items that meet all given conditions; a condition that is None doesn't count.

    Topic and chapter are semi-joins, so an item with several matching links is
    found once. The source is compared as it is stored.
    """
    if subject is not None:
        items = items.filter(F.col("subject_id") == subject)
    if mastery is not None:
        items = items.filter(F.col("mastery_level") == mastery)
    if number_like:
        items = items.filter(number_contains(F.col("question_number"), number_like, literal))
    if source is not None:
        items = items.filter(F.col("source") == source)
    if topic is not None:
        items = items.join(links.filter(F.col("topic_id") == topic), F.col("id") == F.col("item_id"), "left_semi")
    if chapter is not None:
        inside = links.join(topics.filter(F.col("chapter_id") == chapter).select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
        items = items.join(inside, F.col("id") == F.col("item_id"), "left_semi")
    return items


def order_by_number(items: DataFrame, descending: bool = False) -> DataFrame:
    """Items by the number at the start of their question number.

    No number sorts last either way, text without digits counts as 0, and the id
    breaks ties.
    """
    return items.orderBy(F.col("question_number").isNull(), number_value("question_number").desc() if descending else number_value("question_number"), "id")


def number_value(column: str) -> Column:
    digits = F.regexp_extract(column, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def distinct_sources(items: DataFrame) -> DataFrame:
    """The trimmed sources that aren't blank, each once."""
    source = F.nullif(F.trim("source"), F.lit(""))
    return items.select(source.alias("source")).filter("source IS NOT NULL").distinct()


def select_ids(items: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Items whose id is listed in ``ids.id`` (numbers or numeric text), or isn't."""
    wanted = ids.select(F.col("id").cast("string").try_cast("bigint").alias("wanted")).filter("wanted IS NOT NULL")
    return items.join(wanted, F.col("id") == F.col("wanted"), "left_semi" if keep else "left_anti")


def with_topics(items: DataFrame, links: DataFrame, topics: DataFrame, chapters: DataFrame, subjects: DataFrame) -> DataFrame:
    """Items with an array of their topics, primary first, then by weight and id."""
    named = with_hierarchy(links, topics, chapters, subjects)
    rank = F.struct((F.col("role") != "primary").alias("secondary"), (-F.col("weight")).alias("lighter"), F.col("topic_id").alias("id"), "topic", "chapter", "subject", "role", "weight")
    grouped = named.groupBy(F.col("item_id").alias("of_item")).agg(F.array_sort(F.collect_list(rank)).alias("topics"))
    joined = items.join(grouped, F.col("id") == F.col("of_item"), "left").drop("of_item")
    return joined.withColumn("topics", F.coalesce("topics", F.array().cast(grouped.schema["topics"].dataType)))


def item_details(items: DataFrame, links: DataFrame, topics: DataFrame, chapters: DataFrame, subjects: DataFrame, item_tags: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed items with their topics and tags."""
    chosen = select_ids(items, ids)
    own = links.join(chosen.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    tags = item_tags.groupBy(F.col("item_id").alias("of_item")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    detailed = with_topics(chosen, own, topics, chapters, subjects).join(tags, F.col("id") == F.col("of_item"), "left").drop("of_item")
    return detailed.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def children(topics: DataFrame) -> DataFrame:
    """Topic and child pairs: parent_id, parent, id, name."""
    parents = topics.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return topics.select("id", "name", "parent_id").join(parents, "parent_id").select("parent_id", "parent", "id", "name")


def parents(topics: DataFrame) -> DataFrame:
    """Every topic with its parent's id and name, null for roots and lost parents."""
    above = topics.select(F.col("id").alias("p"), F.col("name").alias("parent"))
    return topics.join(above, F.col("parent_id") == F.col("p"), "left").select("id", "name", F.col("p").alias("parent_id"), "parent")


def topic_catalogue(topics: DataFrame, chapters: DataFrame, subject: int | None = None) -> DataFrame:
    """Topics with chapters of a subject (or all), to be shown by chapter and topic order."""
    c = chapters if subject is None else chapters.filter(F.col("subject_id") == subject)
    c = c.select(F.col("id").alias("chapter_id"), "subject_id", F.col("name").alias("chapter"), F.col("sort_order").alias("chapter_order"))
    return topics.join(c, "chapter_id").select("subject_id", "chapter_id", "chapter", "chapter_order", "id", "name", "sort_order")


def recent_items(items: DataFrame, subjects: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` latest items, by update time then id, with the subject's name."""
    names = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    return items.join(names, "subject_id").orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def child_counts(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parents with the number of children whose ``key`` is their id, 0 for none."""
    n = child.groupBy(F.col(key).alias("of_parent")).agg(F.count("*").alias("n_children"))
    return parent.join(n, F.col("id") == F.col("of_parent"), "left").drop("of_parent").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))


def subject_counts(subjects: DataFrame, chapters: DataFrame, topics: DataFrame, items: DataFrame) -> DataFrame:
    """Subjects with their numbers of chapters, topics and items.

    Each side is counted before the join, so nothing fans out.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    n_chapters = chapters.groupBy("subject_id").agg(F.count("*").alias("n_chapters"))
    of = chapters.select(F.col("id").alias("chapter_id"), "subject_id")
    n_topics = topics.join(of, "chapter_id").groupBy("subject_id").agg(F.count("*").alias("n_topics"))
    n_items = items.groupBy("subject_id").agg(F.count("*").alias("n_items"))
    out = subjects.withColumn("subject_id", F.col("id"))
    for side in (n_chapters, n_topics, n_items):
        out = out.join(side, "subject_id", "left")
    return out.select("id", "name", *map(zero, ("n_chapters", "n_topics", "n_items")))


def exam_subject_counts(exams: DataFrame, bridge: DataFrame, subjects: DataFrame, chapters: DataFrame, topics: DataFrame, items: DataFrame) -> DataFrame:
    """The subjects of every exam with their counts."""
    counted = subject_counts(subjects, chapters, topics, items)
    named = exams.select(F.col("id").alias("exam_id"), F.col("name").alias("exam"))
    return bridge.join(named, "exam_id").join(counted.withColumnRenamed("id", "subject_id"), "subject_id")


def exam_counts(exams: DataFrame, bridge: DataFrame) -> DataFrame:
    """Exams with their number of subjects, to be shown by sort order."""
    return child_counts(exams, bridge, "exam_id").withColumnRenamed("n_children", "n_subjects")


def append_ordered(existing: DataFrame, new: DataFrame, parent_col: str | None = None, order: str = "id") -> DataFrame:
    """New rows with the sort orders that follow the greatest one of their parent.

    A null parent is a list of its own. Without ``parent_col`` all rows are one list, which is
    numbered by ranges of ``order``.
    """
    if parent_col is None:
        last = existing.agg(F.max("sort_order").alias("last")).first().last
        return assign_ids(new.drop("sort_order"), [order], 0 if last is None else last + 1, "sort_order")
    last = existing.groupBy(F.col(parent_col).alias("k")).agg(F.max("sort_order").alias("last"))
    numbered = new.withColumn("n", F.row_number().over(Window.partitionBy(parent_col).orderBy(order)))
    joined = numbered.join(last, F.col(parent_col).eqNullSafe(F.col("k")), "left")
    return joined.withColumn("sort_order", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("bigint")).drop("k", "n", "last")


def numbered_order(items: DataFrame, descending: bool = False, name: str = "place") -> DataFrame:
    """Items with their place (from 1) in the order of ``order_by_number``, numbered by ranges."""
    value = number_value("question_number")
    keyed = items.withColumn("_none", F.col("question_number").isNull()).withColumn("_value", -value if descending else value)
    return assign_ids(keyed, ["_none", "_value", "id"], 1, name).drop("_none", "_value")
