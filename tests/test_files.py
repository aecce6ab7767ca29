"""Files of nested documents stay of bounded size and lose nothing."""

from pyspark.sql import functions as F

from itemloom.operators import hierarchy
from itemloom.plans import document_queries, hierarchy_queries
from itemloom.plans.bindings import Model
from itemloom.sources import bank
from oracle import DATA


def test_bank_files_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(document_queries, "PER_FILE", 100)
    m = Model(spark, DATA)
    document_queries._bank_documents(m).write.option("maxRecordsPerFile", 1).json(f"{tmp_path}/bank")
    sizes = [r.n for r in spark.read.json(f"{tmp_path}/bank").filter("questions IS NOT NULL").select(F.size("questions").alias("n")).collect()]
    assert max(sizes) <= 100
    chapters, entries = bank.read_bank(spark, f"{tmp_path}/bank")
    assert entries.count() == entries.select("entry_id").distinct().count() == m.items.count()
    assert chapters.filter("chapter IS NOT NULL").count() == m.chapters.count()


def test_syllabus_has_a_document_for_each_chapter(spark):
    m = Model(spark, DATA)
    documents = hierarchy_queries._syllabus(m)
    filled = documents.select(F.explode("subjects").alias("s", "c")).select(F.size(F.filter(F.map_values("c"), lambda x: F.size(x) > 0)).alias("n"))
    assert {r.n for r in filled.collect()} == {1}
    rows = hierarchy.flatten_syllabus(documents)
    assert rows.filter("topic IS NOT NULL").count() == m.topics.count()
    used = m.chapters.join(m.topics.select("chapter_id"), F.col("id") == F.col("chapter_id"), "left_semi")
    expected = {}
    for r in used.orderBy("subject_id", "sort_order").collect():
        expected.setdefault(r.subject_id, []).append(r.name)
    places = {(r.chapter, r.chapter_order) for r in rows.collect()}
    assert places == {(name, k) for names in expected.values() for k, name in enumerate(names)}
