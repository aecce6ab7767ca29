"""Queries over the hierarchy, the vocabulary, imports and updates, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemloom.functions.ids import next_id
from itemloom.operators import hierarchy as H
from itemloom.operators import resolve as R
from itemloom.operators import updates as U
from itemloom.operators import vocab as V
from itemloom.plans.bindings import MODEL, Model, model_sql
from itemloom.plans.core_queries import CHAIN
from itemloom.plans.registry import query
from itemloom.session import materialize, shared_dir, small

_SUBJECTS, _CHAPTERS, _TOPICS = "id long, name string", "id long, subject_id long, name string, sort_order int", "id long, chapter_id long, name string, sort_order int"


def _empty(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.createDataFrame([], s) for s in (_SUBJECTS, _CHAPTERS, _TOPICS))


def _named(subjects: DataFrame, chapters: DataFrame, topics: DataFrame) -> DataFrame:
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("name").alias("chapter"), "subject_id", F.col("sort_order").alias("chapter_order"))
    s = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    return topics.withColumnRenamed("id", "topic_id").withColumnRenamed("name", "topic").join(c, "chapter_id").join(s, "subject_id")


def _syllabus(m: Model) -> DataFrame:
    """The tables as syllabus documents, one for each chapter.

    The subject's chapters before it are named without topics, so that it keeps its place.
    """
    t = m.topics.select("chapter_id", F.struct("sort_order", "name").alias("t"))
    by_chapter = t.groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["name"]).alias("names"))
    own = m.chapters.select("id", "subject_id", F.struct("sort_order", "name").alias("own"))
    listed = own.join(t.select("chapter_id"), F.col("id") == F.col("chapter_id"), "left_semi").groupBy("subject_id").agg(F.array_sort(F.collect_list("own")).alias("all"))
    named = own.join(by_chapter, F.col("id") == F.col("chapter_id")).join(listed, "subject_id").join(m.subjects.select(F.col("id").alias("subject_id"), "name"), "subject_id")
    before = F.transform(F.filter("all", lambda x: x < F.col("own")), lambda x: F.struct(x["name"].alias("key"), F.array().cast("array<string>").alias("value")))
    chapters = F.map_from_entries(F.concat(before, F.array(F.struct(F.col("own.name").alias("key"), F.col("names").alias("value")))))
    return named.select(F.lit("test").alias("exam_type"), F.create_map("name", chapters).alias("subjects"))


_LOADED = f"SELECT t.name AS topic, c.name AS chapter, s.name AS subject, CAST(row_number() OVER (PARTITION BY c.id ORDER BY t.sort_order) - 1 AS INTEGER) AS sort_order FROM {CHAIN}"


@query("o01_load_syllabus", model_sql(_LOADED))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    path = f"{shared_dir(spark)}/syllabus-{uuid.uuid4().hex}"
    _syllabus(m).write.option("maxRecordsPerFile", 1).json(path)
    loaded = H.load_syllabus(H.read_syllabus(spark, path), *_empty(spark))
    again = H.load_syllabus(H.read_syllabus(spark, path), *(materialize(t, "hierarchy") for t in loaded))  # adds nothing
    return _named(*again).select("topic", "chapter", "subject", F.col("sort_order").cast("int").alias("sort_order"))


@query("o02_seed", model_sql(_LOADED))
def _(spark: SparkSession, d: str) -> DataFrame:
    seeded = H.seed(H.flatten_syllabus(_syllabus(Model(spark, d))), *_empty(spark))
    return _named(*seeded).select("topic", "chapter", "subject", F.col("sort_order").cast("int").alias("sort_order"))


@query("o44_get_or_create", model_sql("SELECT name, coalesce(old, 1000 + row_number() OVER (PARTITION BY old IS NULL ORDER BY name)) AS id FROM (SELECT name, max(old) AS old FROM (SELECT p_brand AS name, NULL AS old FROM part UNION ALL SELECT DISTINCT p_brand, 1000 FROM part WHERE p_brand = 'Brand#7') GROUP BY 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    brands = Model(spark, d)._table("part").select(F.col("p_brand").alias("name"))
    existing = brands.filter("name = 'Brand#7'").distinct().select(F.lit(1000).cast("long").alias("id"), "name")
    return H.get_or_create(existing, brands, ["name"]).select("name", "id")


_TREE = """RECURSIVE {m}, chosen AS (SELECT * FROM topics WHERE id % 13 != 0),
walk AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth FROM chosen WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM chosen)
  UNION ALL SELECT c.id, w.root_id, w.depth + 1 FROM chosen c JOIN walk w ON c.parent_id = w.id)"""


def _recursive(body: str) -> str:
    return "WITH " + body.replace("{m}", MODEL.strip())


@query("o45_topic_forest", _recursive(_TREE + " SELECT id, root_id, depth FROM walk"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return H.topic_forest(Model(spark, d).topics.filter("id % 13 != 0"))[0].select("id", "root_id", "depth")


@query(
    "o45_display_tree",
    _recursive(
        """RECURSIVE {m}, ordered AS (SELECT t.id, t.parent_id, row_number() OVER (ORDER BY s.name, c.sort_order, t.sort_order, t.id) AS r FROM topics t JOIN chapters c ON t.chapter_id = c.id JOIN subjects s ON c.subject_id = s.id WHERE t.id % 13 != 0),
walk AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, [r] AS k, CAST(id AS VARCHAR) AS path FROM ordered WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM ordered)
  UNION ALL SELECT o.id, w.root_id, w.depth + 1, list_append(w.k, o.r), w.path || '/' || o.id FROM ordered o JOIN walk w ON o.parent_id = w.id)
SELECT id, root_id, depth, path, (SELECT count(*) FROM ordered o WHERE o.parent_id = w.id) AS n_children, (SELECT count(*) FROM walk b WHERE b.path LIKE w.path || '/%') AS n_below, row_number() OVER (ORDER BY k) - 1 AS place FROM walk w"""
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    c = m.chapters.select(F.col("id").alias("chapter_id"), "subject_id", F.col("sort_order").alias("chapter_order"))
    s = m.subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    chosen = m.topics.filter("id % 13 != 0").join(c, "chapter_id").join(s, "subject_id")
    tree = H.display_tree(chosen, ["subject", "chapter_order", "sort_order"])
    return tree.join(H.topic_paths(chosen).select("id", F.array_join("path", "/").alias("path")), "id")


_MOVES = """moves AS (SELECT id, CASE WHEN id % 6 = 1 THEN id * 4 + 2 ELSE id * 7 + 3 END % (SELECT count(*) FROM topics) AS new_parent FROM topics WHERE id % 3 = 1),
up AS (SELECT m.id, m.new_parent, m.new_parent AS spot FROM moves m UNION ALL SELECT u.id, u.new_parent, t.parent_id FROM up u JOIN topics t ON u.spot = t.id WHERE t.parent_id IS NOT NULL),
bad AS (SELECT DISTINCT id, new_parent FROM up WHERE spot = id)"""


def _moves(m: Model) -> DataFrame:
    n = m.topics.count()
    return m.topics.filter("id % 3 = 1").select("id", (F.when(F.col("id") % 6 == 1, F.col("id") * 4 + 2).otherwise(F.col("id") * 7 + 3) % n).alias("new_parent"))


@query("o46_move_topics", _recursive("RECURSIVE {m}, " + _MOVES + " SELECT t.id, CASE WHEN m.id IS NOT NULL AND b.id IS NULL THEN m.new_parent ELSE t.parent_id END AS parent_id FROM topics t LEFT JOIN moves m ON m.id = t.id LEFT JOIN bad b ON b.id = t.id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return H.move_topics(m.topics, _moves(m))[0].select("id", "parent_id")


@query("o46_refused_moves", _recursive("RECURSIVE {m}, " + _MOVES + " SELECT id, new_parent FROM bad"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return H.move_topics(m.topics, _moves(m))[1]


_MERGES = "merges AS (SELECT id AS source_id, id + 1 AS target_id FROM topics WHERE id % 10 = 3)"


def _merged(m: Model) -> tuple[DataFrame, DataFrame]:
    merges = m.topics.filter("id % 10 = 3").select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    return H.merge_topics(m.topics, m.links, merges)


@query("o47_merged_links", model_sql(f"{_MERGES}, x AS (SELECT item_id, coalesce(target_id, topic_id) AS topic_id, role, weight, topic_id AS old, target_id IS NOT NULL AS moved FROM links LEFT JOIN merges ON topic_id = source_id) SELECT item_id, topic_id, role, CAST(weight AS DOUBLE) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY item_id, topic_id ORDER BY moved, old) AS n FROM x) WHERE n = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _merged(Model(spark, d))[1].select("item_id", "topic_id", "role", F.col("weight").cast("double").alias("weight"))


@query("o47_merged_topics", model_sql(f"{_MERGES} SELECT t.id, CASE WHEN m.source_id IS NULL THEN t.parent_id WHEN m.target_id = t.id THEN p.parent_id ELSE m.target_id END AS parent_id FROM topics t LEFT JOIN merges m ON t.parent_id = m.source_id LEFT JOIN topics p ON p.id = t.parent_id WHERE t.id NOT IN (SELECT source_id FROM merges)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _merged(Model(spark, d))[0].select("id", "parent_id")


@query("o48_canonicalise", model_sql("SELECT t.id, coalesce(a.canonical, t.name) AS name FROM topics t LEFT JOIN aliases a ON a.alias = t.name"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return V.canonicalise(m.topics.withColumn("name", F.concat(F.lit(" "), "name", F.lit("  "))), "name", m.aliases).select("id", "name")


@query("o48_canonicalise_lists", model_sql("SELECT t.chapter_id, string_agg(coalesce(a.canonical, t.name), ',' ORDER BY t.id) AS names FROM topics t LEFT JOIN aliases a ON a.alias = t.name GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    lists = m.topics.groupBy("chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("names"))
    return V.canonicalise_list(lists, "chapter_id", "names", m.aliases).select("chapter_id", F.array_join("names", ",").alias("names"))


_GROUPED = "g AS (SELECT c.name AS canonical, t.name AS alias, c.id AS group_id FROM topics t JOIN topics c ON c.id = t.id - t.id % 5 WHERE t.id % 5 < 3)"


def _groups(m: Model) -> DataFrame:
    base = F.col("t.id") - F.col("t.id") % 5
    joined = m.topics.alias("t").filter("id % 5 < 3").join(m.topics.alias("c"), F.col("c.id") == base)
    return joined.groupBy(F.col("c.id").alias("group_id"), F.col("c.name").alias("canonical")).agg(F.sort_array(F.collect_list("t.name")).alias("duplicates"))


@query("o49_apply_groups", model_sql(f"{_GROUPED} SELECT alias, canonical FROM g WHERE alias != canonical UNION ALL SELECT alias, canonical FROM aliases WHERE alias NOT IN (SELECT alias FROM g WHERE alias != canonical)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return V.apply_groups(m.aliases, _groups(m))[0]


@query("o49_groups_applied", model_sql(f"{_GROUPED} SELECT count(*) AS applied FROM g WHERE alias != canonical"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return V.apply_groups(m.aliases, _groups(m))[1]


@query("o50_canonical_names", model_sql("SELECT DISTINCT canonical AS name FROM aliases"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return V.canonical_names(Model(spark, d).aliases)


@query("o51_review_batches", model_sql(f"x AS (SELECT s.name AS subject, t.name, row_number() OVER (PARTITION BY s.id ORDER BY c.sort_order, t.sort_order, t.id) AS n, count(*) OVER (PARTITION BY s.id) AS total FROM {CHAIN}) SELECT subject, CAST(floor((n - 1) / 8.0) AS BIGINT) AS batch, count(*) AS n_names, string_agg('- ' || name, chr(10) ORDER BY n) AS names FROM x WHERE total >= 2 GROUP BY 1, 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return V.review_batches(m.topics, m.chapters, m.subjects, size=8)


@query("o48_suspect_aliases", model_sql("doubled AS (SELECT * FROM aliases UNION ALL SELECT canonical, canonical FROM aliases WHERE alias LIKE '%4') SELECT alias, canonical, CASE WHEN alias = canonical THEN 'self' ELSE 'chained' END AS reason FROM doubled d WHERE alias = canonical OR canonical IN (SELECT alias FROM doubled)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    a = Model(spark, d).aliases
    return V.suspect_aliases(a.union(a.filter("alias LIKE '%4'").select("canonical", "canonical")))


@query("o52_delete_chapters", model_sql("gone AS (SELECT id FROM topics WHERE chapter_id % 5 = 2) SELECT 'topic' AS kind, count(*) AS n, CAST(coalesce(sum(CASE WHEN parent_id IN (SELECT id FROM gone) THEN NULL ELSE parent_id END), 0) AS BIGINT) AS checksum FROM topics WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'link', count(*), CAST(coalesce(sum(item_id), 0) AS BIGINT) FROM links WHERE topic_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chapter', count(*), CAST(coalesce(sum(id), 0) AS BIGINT) FROM chapters WHERE id % 5 != 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    t = H.cascade_delete({"subjects": m.subjects, "chapters": m.chapters, "topics": m.topics, "items": m.items, "links": m.links, "item_tags": m.item_tags}, "chapters", m.chapters.filter("id % 5 = 2"))
    summed = lambda df, kind, col: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum(col), F.lit(0)).cast("bigint").alias("checksum"))
    return summed(t["topics"], "topic", "parent_id").union(summed(t["links"], "link", "item_id")).union(summed(t["chapters"], "chapter", "id"))


@query("o52_delete_items", model_sql("SELECT l.item_id, count(*) AS n_links FROM links l WHERE l.item_id NOT IN (SELECT id FROM items WHERE mastery_level = 5) GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    t = H.cascade_delete({"subjects": m.subjects, "chapters": m.chapters, "topics": m.topics, "items": m.items, "links": m.links, "item_tags": m.item_tags}, "items", m.items.filter("mastery_level = 5"))
    return t["links"].groupBy("item_id").agg(F.count("*").alias("n_links"))


# Imports: one entry for each order; names, chapters and subjects are spoiled by fixed rules.
_ENTRIES = """link_names AS (SELECT l.item_id AS entry_id, row_number() OVER (PARTITION BY l.item_id ORDER BY l.topic_id) - 1 AS spot, l.topic_id AS tid,
    CASE WHEN t.id % 11 = 5 AND l.item_id % 4 = 0 THEN t.name || '?' ELSE t.name END AS name,
    CASE WHEN t.id % 3 = 0 THEN '' WHEN (t.id + l.item_id) % 10 = 0 THEN 'NATION_1' ELSE c.name END AS chapter, l.role, l.weight, c.subject_id
  FROM links l JOIN topics t ON l.topic_id = t.id JOIN chapters c ON t.chapter_id = c.id),
entry_subject AS (SELECT entry_id, min(subject_id) AS sid FROM link_names GROUP BY 1),
spread AS (SELECT n.entry_id, n.spot, n.name, n.chapter, n.role, n.weight, CASE WHEN n.entry_id % 50 = 0 THEN 'Nowhere' ELSE s.name END AS subject_name
  FROM link_names n JOIN entry_subject e ON n.entry_id = e.entry_id AND n.subject_id = e.sid JOIN subjects s ON s.id = e.sid),
named AS (SELECT p.entry_id, p.spot, coalesce(a.canonical, p.name) AS name, p.chapter, p.role, p.weight, p.subject_name, s.id AS subject_id FROM spread p LEFT JOIN aliases a ON a.alias = p.name LEFT JOIN subjects s ON s.name = p.subject_name),
in_subject AS (SELECT c.subject_id, t.name, min(t.id) AS least, count(*) AS same_name FROM topics t JOIN chapters c ON t.chapter_id = c.id GROUP BY 1, 2),
resolved AS (SELECT n.*, CASE WHEN n.chapter = '' THEN i.least ELSE coalesce((SELECT min(t.id) FROM topics t JOIN chapters c ON t.chapter_id = c.id WHERE c.subject_id = n.subject_id AND c.name = n.chapter AND t.name = n.name), CASE WHEN i.same_name = 1 THEN i.least END) END AS topic_id
  FROM named n LEFT JOIN in_subject i ON i.subject_id = n.subject_id AND i.name = n.name),
state AS (SELECT entry_id, max(subject_id) AS subject_id, max(subject_name) AS subject_name, count(*) FILTER (WHERE topic_id IS NULL) AS n_lost, count(topic_id) AS n_found, string_agg(CASE WHEN topic_id IS NULL THEN name END, '、' ORDER BY spot) AS lost FROM resolved GROUP BY 1)"""


def entries(m: Model) -> DataFrame:
    t = m.topics.select(F.col("id").alias("topic_id"), "name", "chapter_id")
    c = m.chapters.select(F.col("id").alias("chapter_id"), F.col("name").alias("own_chapter"), "subject_id")
    named = m.links.join(small(t.join(F.broadcast(c), "chapter_id").drop("chapter_id")), "topic_id").withColumnRenamed("item_id", "entry_id")
    name = F.when((F.col("topic_id") % 11 == 5) & (F.col("entry_id") % 4 == 0), F.concat("name", F.lit("?"))).otherwise(F.col("name"))
    chapter = F.when(F.col("topic_id") % 3 == 0, "").when((F.col("topic_id") + F.col("entry_id")) % 10 == 0, "NATION_1").otherwise(F.col("own_chapter"))
    rows = named.select("entry_id", "subject_id", F.struct("topic_id", name.alias("name"), chapter.alias("chapter"), "role", "weight").alias("t"))
    s = m.subjects.select(F.col("id").alias("sid"), F.col("name").alias("known_subject"))
    least = rows.withColumn("sid", F.min("subject_id").over(Window.partitionBy("entry_id"))).filter("subject_id = sid")
    own = least.groupBy("entry_id", "sid").agg(F.array_sort(F.collect_list("t")).alias("t"))
    subject = F.when(F.col("entry_id") % 50 == 0, "Nowhere").otherwise(F.col("known_subject"))
    topics = F.transform("t", lambda x: F.struct(x["name"].alias("name"), x["chapter"].alias("chapter"), x["role"].alias("role"), x["weight"].alias("weight")))
    return own.join(s, "sid").select("entry_id", subject.alias("subject_name"), F.concat(F.lit("Entry "), "entry_id").alias("content"), topics.alias("topics"))


#: Where an entry stands: 500 entries a document, pages by number; and whether it is imported.
PAGED = """outcomes AS (SELECT entry_id, entry_id // 500 AS document_id, CAST(entry_id % 97 + 1 AS INTEGER) AS page, coalesce(subject_id IS NOT NULL AND n_lost = 0, false) AS good,
  CASE WHEN subject_id IS NULL THEN 'unknown subject' WHEN n_lost > 0 THEN 'unresolved topics' ELSE 'imported' END AS outcome,
  CASE WHEN subject_id IS NULL THEN 'unknown subject: ' || subject_name ELSE 'topics not in the catalogue: ' || lost END AS reason FROM state)"""


def paged_entries(m: Model) -> DataFrame:
    return entries(m).select("*", F.floor(F.col("entry_id") / 500).alias("document_id"), (F.col("entry_id") % 97 + 1).cast("int").alias("page"))


def _resolved(m: Model, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    e = materialize(entries(m) if given is None else given, "entries")
    return e, materialize(R.resolve_topics(e, m.aliases, m.topics, m.chapters, m.subjects), "resolved")


@query("o25_resolve_topics", model_sql(f"{_ENTRIES} SELECT entry_id, name, topic_id FROM resolved"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(Model(spark, d))[1].select("entry_id", "name", "topic_id")


@query("o26_refused_entries", model_sql(f"{_ENTRIES} SELECT entry_id, 'Entry ' || entry_id AS excerpt, CASE WHEN subject_id IS NULL THEN 'unknown subject: ' || subject_name ELSE 'topics not in the catalogue: ' || lost END AS reason FROM state WHERE subject_id IS NULL OR n_lost > 0"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return R.accept_entries(*_resolved(m), m.subjects)[1]


@query("o66_import_report", model_sql(f"{_ENTRIES} SELECT CASE WHEN subject_id IS NULL THEN 'unknown subject' WHEN n_lost > 0 THEN 'unresolved topics' ELSE 'imported' END AS outcome, count(*) AS n FROM state GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return R.import_report(*R.accept_entries(*_resolved(m), m.subjects))


@query(
    "o66_report_lines",
    model_sql(
        f"""{_ENTRIES}, {PAGED}, counted AS (SELECT grouping(document_id) + grouping(page) + grouping(outcome) AS g, document_id, page, outcome, count(*) FILTER (WHERE good) AS imported, count(*) FILTER (WHERE NOT good) AS skipped FROM outcomes GROUP BY ROLLUP (document_id, page, outcome))
SELECT CASE g WHEN 3 THEN 'total' WHEN 2 THEN 'document' WHEN 1 THEN 'page' ELSE 'outcome' END AS level, document_id, page, outcome, CAST(NULL AS BIGINT) AS entry_id, NULL AS excerpt, NULL AS reason, imported, skipped,
  CASE WHEN g = 1 THEN CAST(sum(imported) OVER w AS BIGINT) END AS imported_so_far, CASE WHEN g = 1 THEN CAST(sum(skipped) OVER w AS BIGINT) END AS skipped_so_far FROM counted WINDOW w AS (PARTITION BY g, document_id ORDER BY page ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT 'skipped', document_id, page, outcome, entry_id, 'Entry ' || entry_id, reason, NULL, NULL, NULL, NULL FROM outcomes WHERE NOT good"""
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    e, resolved = _resolved(m, paged_entries(m))
    accepted, refused = R.accept_entries(e, resolved, m.subjects)
    return R.report_lines(accepted, refused.join(e.select("entry_id", "document_id", "page"), "entry_id"))


@query("o78_write_entries", model_sql(f"{_ENTRIES}, good AS (SELECT entry_id, (SELECT max(id) FROM items) + row_number() OVER (ORDER BY entry_id) AS id FROM state WHERE subject_id IS NOT NULL AND n_lost = 0) SELECT g.id AS item_id, r.topic_id, arg_min(r.role, r.spot) AS role, CAST(arg_min(r.weight, r.spot) AS DOUBLE) AS weight FROM good g JOIN resolved r ON r.entry_id = g.entry_id GROUP BY 1, 2"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    accepted, _ = R.accept_entries(*_resolved(m), m.subjects)
    _, links = R.write_entries(accepted, m.items, m.links)
    return links.filter(F.col("item_id") >= next_id(m.items)).select("item_id", "topic_id", "role", F.col("weight").cast("double").alias("weight"))


_NEW_TAGS = "new AS (SELECT l.item_id, l.topic_id + 1 AS topic_id FROM links l WHERE l.item_id % 9 = 0), own AS (SELECT DISTINCT n.item_id, t.name FROM new n JOIN topics t ON t.id = n.topic_id)"


def _replaced(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    new = m.links.filter("item_id % 9 = 0").withColumn("topic_id", F.col("topic_id") + 1)
    return R.replace_links(m.links, materialize(m.tags, "tags"), m.item_tag_ids, new, m.topics)


@query("o53_replace_links", model_sql(f"{_NEW_TAGS} SELECT item_id, tag FROM item_tags WHERE item_id NOT IN (SELECT item_id FROM new) UNION ALL SELECT item_id, name FROM own"))
def _(spark: SparkSession, d: str) -> DataFrame:
    _, tags, item_tags = _replaced(Model(spark, d))
    return item_tags.join(tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), "tag_id").select("item_id", "tag")


@query("o53_tags", model_sql(f"{_NEW_TAGS} SELECT id, name FROM tags UNION ALL SELECT (SELECT max(id) FROM tags) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT name FROM own WHERE name NOT IN (SELECT name FROM tags))"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(Model(spark, d))[1].select("id", "name")


@query("o53_links", model_sql("SELECT item_id, CASE WHEN item_id % 9 = 0 THEN topic_id + 1 ELSE topic_id END AS topic_id, role, CAST(weight AS DOUBLE) AS weight FROM links"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(Model(spark, d))[0].select("item_id", "topic_id", "role", F.col("weight").cast("double").alias("weight"))


@query("o65_normalise_links", model_sql("SELECT item_id, topic_id, CASE WHEN role = 'primary' THEN greatest(w, 0.5) ELSE least(w, 0.5) END AS weight FROM (SELECT item_id, topic_id, role, greatest(0.1, least(1.0, CASE WHEN item_id % 7 = 0 THEN 1.0 ELSE CAST(weight AS DOUBLE) * 3 - 0.5 END)) AS w FROM links)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    spoiled = m.links.withColumn("weight", F.when(F.col("item_id") % 7 == 0, "x").otherwise((F.col("weight").cast("double") * 3 - 0.5).cast("string")))
    return R.normalise_links(spoiled, snap_roles=True).select("item_id", "topic_id", "weight")


_MARKS = "marks AS (SELECT event_id AS mark_id, event_id % (SELECT count(*) FROM orders) AS item_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 5 WHEN 'error' THEN 9 ELSE 3 END AS level, ts FROM events)"


def marks(m: Model, events: DataFrame | None = None) -> DataFrame:
    level = F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 5 WHEN 'error' THEN 9 ELSE 3 END")
    n = m._table("orders").count()
    events = m._table("events") if events is None else events
    return events.select(F.col("event_id").alias("mark_id"), (F.col("event_id") % n).alias("item_id"), level.alias("level"), F.col("ts").cast("timestamp").alias("ts"))


@query("o75_apply_marks", model_sql(f"{_MARKS}, last AS (SELECT item_id, arg_max(level, (ts, mark_id)) AS level, max(ts) AS ts FROM marks WHERE level BETWEEN 0 AND 5 GROUP BY 1) SELECT i.id, coalesce(l.level, i.mastery_level) AS mastery_level, coalesce(l.ts, i.updated_at) AS updated_at FROM items i LEFT JOIN last l ON l.item_id = i.id"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return U.apply_marks(m.items, marks(m)).select("id", "mastery_level", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("o76_set_source", model_sql("SELECT id, CASE WHEN subject_id = 3 THEN NULL ELSE source END AS source FROM items"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    return U.set_source(m.items, m.items.filter("subject_id = 3"), "  ").select("id", "source")


@query("o76_delete_items", model_sql("SELECT item_id, count(*) AS n_tags FROM item_tags WHERE item_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click') GROUP BY 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Model(spark, d)
    asked = m._table("events").filter("event_type = 'click'").select(F.col("event_id").alias("id"))
    return U.delete_items(m.items, m.links, m.item_tags, asked)[2].groupBy("item_id").agg(F.count("*").alias("n_tags"))
