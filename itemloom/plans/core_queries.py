"""Queries over items, links and the hierarchy, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemloom.operators import items as I
from itemloom.operators import stats as S
from itemloom.plans.bindings import NOW, Model, model_sql
from itemloom.plans.registry import query

CHAIN = """topics t JOIN chapters c ON t.chapter_id = c.id JOIN subjects s ON c.subject_id = s.id"""
POINTS = "CAST(CASE mastery_level WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.55 WHEN 4 THEN 0.2 ELSE 0 END AS DECIMAL(4, 2))"


@query("o12_search_items", model_sql("SELECT id, subject_id, question_number, source FROM items WHERE mastery_level = 3 AND subject_id = 2 AND EXISTS (SELECT 1 FROM links l JOIN topics t ON l.topic_id = t.id WHERE l.item_id = items.id AND t.chapter_id = 7)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.search_items(m.items, m.links, m.topics, chapter=7, subject=2, mastery=3).select("id", "subject_id", "question_number", "source")


@query("o12_search_by_topic", model_sql("SELECT id, mastery_level FROM items WHERE mastery_level = 0 AND source = 'src3' AND EXISTS (SELECT 1 FROM links l WHERE l.item_id = items.id AND l.topic_id = 5)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.search_items(m.items, m.links, m.topics, topic=5, mastery=0, source="src3").select("id", "mastery_level")


@query("o13_number_contains", model_sql("SELECT id, question_number FROM items WHERE question_number ILIKE '%1_3%'"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.search_items(m.items, m.links, m.topics, number_like="1_3").select("id", "question_number")


@query("o14_distinct_sources", model_sql("SELECT DISTINCT nullif(trim(source), '') AS source FROM items WHERE nullif(trim(source), '') IS NOT NULL"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.distinct_sources(Model(spark, d).items)


@query("o15_select_ids", model_sql("SELECT id, source FROM items WHERE id IN (SELECT TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS BIGINT) FROM events WHERE event_type = 'click')"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    asked = m._table("events").filter("event_type = 'click'").select(F.expr("CASE WHEN event_id % 3 = 0 THEN concat('x', event_id) ELSE string(event_id) END").alias("id"))
    return I.select_ids(m.items, asked).select("id", "source")


@query("o15_exclude_ids", model_sql("SELECT id, source FROM items WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    asked = m._table("events").filter("event_type = 'click'").select(F.col("event_id").alias("id"))
    return I.select_ids(m.items, asked, keep=False).select("id", "source")


_TOPIC_TEXT = "string_agg(t.name || '/' || c.name || '/' || l.role, ';' ORDER BY CASE WHEN l.role = 'primary' THEN 0 ELSE 1 END, l.weight DESC, t.id)"


def _topic_text() -> F.Column:
    return F.array_join(F.transform("topics", lambda t: F.concat_ws("/", t["topic"], t["chapter"], t["role"])), ";")


@query(
    "o16_item_details",
    model_sql(f"""SELECT i.id, i.content, coalesce(x.topics, '') AS topics, coalesce(y.tags, '') AS tags FROM items i
  LEFT JOIN (SELECT l.item_id, {_TOPIC_TEXT} AS topics FROM links l JOIN {CHAIN} ON l.topic_id = t.id GROUP BY 1) x ON x.item_id = i.id
  LEFT JOIN (SELECT item_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM item_tags GROUP BY 1) y ON y.item_id = i.id
  WHERE i.id IN (SELECT user_id FROM events)"""),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    asked = m._table("events").select(F.col("user_id").alias("id")).distinct()
    out = I.item_details(m.items, m.links, m.topics, m.chapters, m.subjects, m.item_tags, asked)
    return out.select("id", "content", _topic_text().alias("topics"), F.array_join("tags", ",").alias("tags"))


@query("o17_children", model_sql("SELECT p.id AS parent_id, p.name AS parent, t.id, t.name FROM topics t JOIN topics p ON t.parent_id = p.id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.children(Model(spark, d).topics)


@query("o17_parents", model_sql("SELECT t.id, t.name, p.id AS parent_id, p.name AS parent FROM topics t LEFT JOIN topics p ON t.parent_id = p.id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return I.parents(Model(spark, d).topics)


@query("o18_recent_items", model_sql("SELECT i.id, i.updated_at, s.name AS subject FROM items i JOIN subjects s ON i.subject_id = s.id ORDER BY i.updated_at DESC, i.id DESC LIMIT 10"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.recent_items(m.items, m.subjects).select("id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "subject")


@query("o19_with_hierarchy", model_sql(f"SELECT l.item_id, l.topic_id, t.name AS topic, c.name AS chapter, s.name AS subject, l.role, CAST(l.weight AS DOUBLE) AS weight FROM links l JOIN {CHAIN} ON l.topic_id = t.id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.with_hierarchy(m.links, m.topics, m.chapters, m.subjects).select("item_id", "topic_id", "topic", "chapter", "subject", "role", F.col("weight").cast("double").alias("weight"))


_COUNTS = """SELECT s.id, s.name, (SELECT count(*) FROM chapters c WHERE c.subject_id = s.id) AS n_chapters,
  (SELECT count(*) FROM topics t JOIN chapters c ON t.chapter_id = c.id WHERE c.subject_id = s.id) AS n_topics,
  (SELECT count(*) FROM items i WHERE i.subject_id = s.id) AS n_items FROM subjects s"""


@query("o20_subject_counts", model_sql(_COUNTS))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.subject_counts(m.subjects, m.chapters, m.topics, m.items)


@query("o21_chapter_topic_counts", model_sql("SELECT c.id, c.name, count(t.id) AS n_children FROM chapters c LEFT JOIN topics t ON t.chapter_id = c.id GROUP BY c.id, c.name"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.child_counts(m.chapters, m.topics, "chapter_id").select("id", "name", "n_children")


@query("o21_topic_item_counts", model_sql("SELECT t.id, t.name, count(l.item_id) AS n_children FROM topics t LEFT JOIN links l ON l.topic_id = t.id GROUP BY t.id, t.name"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.child_counts(m.topics, m.links, "topic_id").select("id", "name", "n_children")


@query("o22_exam_subject_counts", model_sql(f"SELECT e.name AS exam, b.exam_id, x.id AS subject_id, x.name, x.n_chapters, x.n_topics, x.n_items FROM exam_subjects b JOIN exams e ON b.exam_id = e.id JOIN ({_COUNTS}) x ON x.id = b.subject_id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    out = I.exam_subject_counts(m.exams, m.exam_subjects, m.subjects, m.chapters, m.topics, m.items)
    return out.select("exam", "exam_id", "subject_id", "name", "n_chapters", "n_topics", "n_items")


@query("o23_items_with_topics", model_sql(f"SELECT i.id, coalesce(x.topics, '') AS topics FROM items i LEFT JOIN (SELECT l.item_id, {_TOPIC_TEXT} AS topics FROM links l JOIN {CHAIN} ON l.topic_id = t.id GROUP BY 1) x ON x.item_id = i.id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.with_topics(m.items, m.links, m.topics, m.chapters, m.subjects).select("id", _topic_text().alias("topics"))


@query("o24_exam_counts", model_sql("SELECT e.id, e.name, e.sort_order, count(b.subject_id) FILTER (WHERE s.id IS NOT NULL) AS n_subjects FROM exams e LEFT JOIN exam_subjects b ON b.exam_id = e.id LEFT JOIN subjects s ON b.subject_id = s.id GROUP BY ALL"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    bridge = m.exam_subjects.join(m.subjects.select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    return I.exam_counts(m.exams, bridge).orderBy("sort_order")


@query("o27_dashboard_counts", model_sql("SELECT (SELECT count(*) FROM subjects) AS n_subjects, (SELECT count(*) FROM chapters) AS n_chapters, (SELECT count(*) FROM topics) AS n_topics, count(*) AS n_items, count(*) FILTER (WHERE mastery_level >= 4) AS mastered, count(*) FILTER (WHERE mastery_level = 3) AS fuzzy, count(*) FILTER (WHERE mastery_level IN (1, 2)) AS weak FROM items"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.dashboard_counts(m.subjects, m.chapters, m.topics, m.items)


@query("o28_mastery_distribution", model_sql("SELECT mastery_level, count(*) AS n FROM items WHERE mastery_level > 0 GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.mastery_distribution(Model(spark, d).items)


@query("o29_subject_mastery", model_sql("SELECT i.subject_id, s.name AS subject, i.mastery_level, count(*) AS n FROM items i JOIN subjects s ON i.subject_id = s.id WHERE i.mastery_level > 0 GROUP BY ALL"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.subject_mastery(m.items, m.subjects)


@query("o30_subject_mastery_matrix", model_sql("SELECT s.id AS subject_id, s.name AS subject, " + ", ".join(f"count(*) FILTER (WHERE i.mastery_level = {k}) AS level_{k}" for k in range(1, 6)) + " FROM subjects s LEFT JOIN items i ON i.subject_id = s.id GROUP BY s.id, s.name"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.subject_mastery_matrix(m.items, m.subjects)


_WEAK = f"""weak AS (SELECT t.id AS topic_id, t.name AS topic, c.name AS chapter, s.name AS subject, s.id AS sid, c.sort_order AS co, t.sort_order AS tu, x.n_items,
  CASE WHEN total > 0 THEN CAST(weak AS DOUBLE) / (CAST(total AS DOUBLE) * 1.5) ELSE 0.0 END AS weakness
  FROM (SELECT l.topic_id, count(*) AS n_items, sum(l.weight) AS total, sum({POINTS} * l.weight) AS weak FROM links l JOIN items i ON l.item_id = i.id WHERE i.mastery_level > 0 GROUP BY 1) x
  JOIN {CHAIN} ON x.topic_id = t.id)"""


def _weakness(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.topic_weakness(m.items, m.links, m.topics, m.chapters, m.subjects)


@query("o31_topic_weakness", model_sql(f"{_WEAK} SELECT topic_id, topic, chapter, subject, n_items, weakness, (1 - weakness) * 100 AS mastery_rate FROM weak"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.by_weakness(_weakness(spark, d)).select("topic_id", "topic", "chapter", "subject", "n_items", "weakness", "mastery_rate")


@query("o32_weakness_bands", model_sql(f"{_WEAK} SELECT 'uncategorised' AS exam, subject, topic_id, topic, weakness, CASE WHEN weakness > 0.45 THEN 'high' WHEN weakness > 0.42 THEN 'medium' ELSE 'low' END AS band, row_number() OVER (PARTITION BY sid ORDER BY weakness DESC, co, tu) AS place FROM weak"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.weakness_bands(_weakness(spark, d), hi=0.45, mid=0.42)


@query("o33_weakest_topics", model_sql(f"{_WEAK} SELECT topic_id, topic, weakness FROM weak ORDER BY weakness DESC, sid, co, tu LIMIT 20"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.weakest(_weakness(spark, d)).select("topic_id", "topic", "weakness")


_NEED = f"need AS (SELECT l.topic_id, CAST(sum({POINTS} * l.weight) AS DOUBLE) / coalesce(nullif(CAST(sum(l.weight) AS DOUBLE), 0), 1) AS need FROM links l JOIN items i ON l.item_id = i.id GROUP BY 1)"


@query("o34_topic_need", model_sql(f"{_NEED} SELECT topic_id, need FROM need"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.topic_need(m.items, m.links)


@query("o35_append_ordered", model_sql("SELECT n.s_suppkey + 100000 AS id, CAST(n.s_nationkey AS BIGINT) AS chapter_id, coalesce(x.last, -1) + row_number() OVER (PARTITION BY n.s_nationkey ORDER BY n.s_suppkey) AS sort_order FROM supplier n LEFT JOIN (SELECT chapter_id, max(sort_order) AS last FROM topics WHERE id % 2 = 0 GROUP BY 1) x ON x.chapter_id = n.s_nationkey WHERE n.s_suppkey % 2 = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    new = m.topics.filter("id % 2 = 1").select((F.col("id") + 100000).alias("id"), "chapter_id")
    return I.append_ordered(m.topics.filter("id % 2 = 0"), new, "chapter_id")


@query("o38_order_by_number", model_sql("SELECT id, question_number, row_number() OVER (ORDER BY question_number IS NULL, coalesce(TRY_CAST(nullif(regexp_extract(question_number, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0) DESC, id) AS place FROM (SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN question_number || 'a' WHEN id % 13 = 0 THEN 'abc' ELSE question_number END AS question_number FROM items)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    n = F.col("question_number")
    items = m.items.withColumn("question_number", F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 7 == 0, F.concat(n, F.lit("a"))).when(F.col("id") % 13 == 0, "abc").otherwise(n))
    return I.numbered_order(items, descending=True).select("id", "question_number", "place")


_SCORED = f"""{_NEED},
lead_link AS (SELECT item_id, topic_id, role FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN role = 'primary' THEN 0 ELSE 1 END, weight DESC, topic_id) AS n FROM links) WHERE n = 1),
scored AS (SELECT i.id, k.topic_id, i.subject_id,
  CASE mastery_level WHEN 1 THEN 10 WHEN 2 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 8 END * (1 + coalesce(need, CAST(0 AS DOUBLE)))
  * (1 + CAST(coalesce(least(CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(updated_at)) / 86400) AS BIGINT), 30), 15) AS DOUBLE) / 30) * CASE WHEN role = 'primary' THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score
  FROM items i JOIN lead_link k ON i.id = k.item_id LEFT JOIN need ON need.topic_id = k.topic_id WHERE mastery_level > 0)"""


@query("o39_scored_items", model_sql(f"{_SCORED} SELECT id, topic_id, round(score, 6) AS score FROM scored"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.scored_items(m.items, m.links, NOW).select("id", "topic_id", F.round("score", 6).alias("score"))


@query("o39_recommend", model_sql(f"{_SCORED} SELECT x.id, t.name AS topic, round(score, 2) AS score FROM scored x JOIN topics t ON x.topic_id = t.id ORDER BY x.score DESC, x.id LIMIT 20"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.recommend(m.items, m.links, m.topics, NOW)[0]


@query("o39_recommend_total", model_sql(f"{_SCORED} SELECT count(*) AS total FROM scored WHERE subject_id = 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return S.recommend(m.items, m.links, m.topics, NOW, subject=2)[1]


@query("o67_label_mastery", model_sql("SELECT mastery_level, label, colour, count(*) AS n FROM items JOIN (VALUES (0, 'unmarked', 'grey'), (1, 'blind spot', 'red'), (2, 'only started', 'orange'), (3, 'error-prone', 'yellow'), (4, 'independent', 'blue'), (5, 'effortless', 'green')) v(level, label, colour) ON level = mastery_level GROUP BY ALL"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.label_mastery(Model(spark, d).items)[0].groupBy("mastery_level", "label", "colour").agg(F.count("*").alias("n"))


@query("o68_topic_catalogue", model_sql("SELECT c.subject_id, t.chapter_id, c.name AS chapter, c.sort_order AS chapter_order, t.id, t.name, t.sort_order FROM topics t JOIN chapters c ON t.chapter_id = c.id WHERE c.subject_id = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return I.topic_catalogue(m.topics, m.chapters, 1).orderBy("chapter_order", "sort_order")
