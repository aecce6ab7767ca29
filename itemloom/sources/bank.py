"""Question-bank files: nested import and export, and import-ready records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators.items import with_hierarchy

TOPIC = "struct<name:string, chapter:string, role:string, weight:double>"
BANK = f"""subjects array<struct<name:string, chapters:array<struct<name:string, topics:array<struct<name:string>>>>>>,
questions array<struct<subject_name:string, content:string, answer:string, source:string, question_number:string, source_page:int, mastery_level:int, topics:array<{TOPIC}>>>"""


def read_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The chapters that a bank file names, and its import entries.

    Chapters are (subject, chapter), to be created where they are missing; topics
    never are. Entries are numbered by file and place.
    """
    files = spark.read.schema(BANK).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    chapters = files.select(F.explode("subjects").alias("s")).select(F.col("s.name").alias("subject"), F.explode_outer("s.chapters").alias("c")).select("subject", F.col("c.name").alias("chapter")).distinct()
    q = files.select("file", F.posexplode("questions").alias("at", "q"))
    entries = q.select(F.xxhash64("file", "at").alias("entry_id"), "q.*")
    return chapters, entries


def export_bank(subjects: DataFrame, chapters: DataFrame, topics: DataFrame, items: DataFrame, links: DataFrame, subject: int | None = None, chapter: int | None = None, any_subject: bool = False) -> tuple[DataFrame, DataFrame]:
    """The hierarchy tree and the items with their topics, of all, a subject or a chapter.

    An item's topics are those of the scope's chapter, else those of its own subject
    (or all with ``any_subject``). With a chapter only items linked to it are exported.
    """
    if subject is not None:
        subjects, items = subjects.filter(F.col("id") == subject), items.filter(F.col("subject_id") == subject)
    if chapter is not None:
        chapters = chapters.filter(F.col("id") == chapter)
    named = with_hierarchy(links, topics, chapters, subjects)
    if chapter is not None:
        items = items.join(named.select("item_id"), F.col("id") == F.col("item_id"), "left_semi")
    own = named.join(items.select(F.col("id").alias("item_id"), "subject_id"), "item_id")
    if chapter is None and not any_subject:
        own = own.filter("topic_subject_id = subject_id")
    topic = F.struct("topic_id", F.col("topic").alias("name"), "chapter", "role", F.col("weight").cast("double").alias("weight"))
    grouped = own.groupBy(F.col("item_id").alias("of_item")).agg(F.array_sort(F.collect_list(topic)).alias("topics"))
    names = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"))
    exported = items.join(names, "subject_id").join(grouped, F.col("id") == F.col("of_item"), "left")
    exported = exported.select("id", "subject_name", "content", "source", "question_number", "source_page", "mastery_level", F.coalesce("topics", F.array().cast(grouped.schema["topics"].dataType)).alias("topics"))
    t = topics.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "name"))).alias("topics"))
    c = chapters.join(t, F.col("id") == F.col("chapter_id"), "left").groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "name", "topics"))).alias("chapters"))
    tree = subjects.join(c, F.col("id") == F.col("subject_id"), "left").select("id", "name", "chapters")
    return tree, exported


def merge_records(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import-ready records, and the ones without content with the reason."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    return entries.filter(~blank), entries.filter(blank).select("entry_id", F.lit("empty content").alias("reason"))
