"""Import of items: names to topics, acceptance, and what is written.

An entry table has entry_id, subject_name, content and topics, an array of
(name, chapter, role, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.ids import assign_ids, next_id
from itemloom.operators.hierarchy import get_or_create
from itemloom.operators.vocab import canonicalise
from itemloom.session import materialize, small

EXCERPT = 80
UNKNOWN_SUBJECT, UNRESOLVED = "unknown subject: ", "topics not in the catalogue"
LEAST_WEIGHT, MOST_WEIGHT = 0.1, 1.0


def safe_weight(weight: Column) -> Column:
    """A weight between 0.1 and 1; 1 where it isn't a number."""
    x = weight.cast("string").try_cast("double")
    x = F.when(F.isnan(x), 1.0).otherwise(F.coalesce(x, F.lit(1.0)))
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), x))


def normalise_links(links: DataFrame, snap_roles: bool = False) -> DataFrame:
    """Links with safe weights; with ``snap_roles`` primary ones weigh 0.5 or more, others 0.5 or less."""
    w = safe_weight(F.col("weight"))
    if snap_roles:
        w = F.when(F.col("role") == "primary", F.greatest(w, F.lit(0.5))).otherwise(F.least(w, F.lit(0.5)))
    return links.withColumn("weight", w)


def resolve_topics(entries: DataFrame, aliases: DataFrame, topics: DataFrame, chapters: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row for each named topic of each entry: entry_id, at, name, subject_id, topic_id.

    With a chapter, the topic of that name in the chapter counts, else the only one
    of that name in the subject. Without a chapter, the least id in the subject.
    """
    s = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"))
    spread = entries.select("entry_id", "subject_name", F.posexplode("topics").alias("at", "t")).select("entry_id", "subject_name", "at", F.coalesce("t.name", F.lit("")).alias("name"), F.trim(F.coalesce("t.chapter", F.lit(""))).alias("chapter"), F.col("t.role").alias("role"), F.col("t.weight").alias("weight"))
    named = canonicalise(spread, "name", aliases).filter("name != ''").join(s, "subject_name", "left")
    known = small(catalogue(topics, chapters))
    joined = named.join(known, ["subject_id", "name"], "left")
    unique = F.when(F.col("same_name") == 1, F.col("least"))
    chapter_topic = F.get(F.filter("by_chapter", lambda x: x["chapter"] == F.col("chapter")), F.lit(0))["topic"]
    topic = F.when(F.col("chapter") == "", F.col("least")).otherwise(F.coalesce(chapter_topic, unique))
    return joined.select("entry_id", "subject_id", "at", "name", "role", "weight", topic.alias("topic_id"))


def catalogue(topics: DataFrame, chapters: DataFrame) -> DataFrame:
    """What a name can mean in a subject: subject_id, name, the least topic, how many there are, and the least of each chapter's name.

    Of chapters of one name in a subject only the first is looked in.
    """
    first_chapter = chapters.groupBy("subject_id", F.col("name").alias("chapter")).agg(F.min("id").alias("first"))
    of = chapters.select(F.col("id").alias("chapter_id"), "subject_id", F.col("name").alias("chapter")).join(first_chapter, ["subject_id", "chapter"])
    each = topics.join(of, "chapter_id").groupBy("subject_id", "name", "chapter").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min(F.when(F.col("chapter_id") == F.col("first"), F.col("id"))).alias("topic"))
    here = F.when(F.col("topic").isNotNull(), F.struct("chapter", "topic"))
    return each.groupBy("subject_id", "name").agg(F.min("least").alias("least"), F.sum("n").alias("same_name"), F.collect_list(here).alias("by_chapter"))


def accept_entries(entries: DataFrame, resolved: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted entries with their links, and the refused ones with an excerpt and a reason.

    An entry is accepted whole: its subject is known, it names a topic, and every
    named topic was found. Both read one table, which is written here; it is for ``discard``.
    """
    lost = F.col("topic_id").isNull()
    named = F.struct("at", "topic_id", F.when(lost, F.col("name")).alias("name"), "role", "weight")
    both = resolved.groupBy("entry_id").agg(F.array_sort(F.collect_list(named)).alias("named"))
    links = F.transform(F.filter("named", lambda x: x["topic_id"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x["topic_id"].alias("topic_id"), x["role"].alias("role"), x["weight"].alias("weight")))
    state = both.select("entry_id", F.filter("named", lambda x: x["topic_id"].isNull()).alias("lost"), links.alias("links"))
    state = state.select("*", F.size("lost").alias("n_lost"), F.size("links").alias("n_found"))
    s = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"))
    joined = entries.join(s, "subject_name", "left").join(state, "entry_id", "left")
    good = F.col("subject_id").isNotNull() & (F.coalesce("n_found", F.lit(0)) > 0) & (F.coalesce("n_lost", F.lit(0)) == 0)
    names = F.array_join(F.transform("lost", lambda x: x["name"]), "、")
    reason = F.when(F.col("subject_id").isNull(), F.concat(F.lit(UNKNOWN_SUBJECT), F.coalesce("subject_name", F.lit("")))).when(F.col("n_lost") > 0, F.concat(F.lit(UNRESOLVED + ": "), names)).otherwise(UNRESOLVED)
    excerpt = F.substring(F.coalesce("content", F.lit("")), 1, EXCERPT)
    judged = materialize(joined.withColumn("_good", good).withColumn("_refused", F.when(~good, F.struct(excerpt.alias("excerpt"), reason.alias("reason")))).drop("n_lost", "n_found", "lost"), "judged")
    accepted, refused = judged.filter("_good").drop("_good", "_refused"), judged.filter("NOT _good").select("entry_id", "_refused.*")
    accepted._table_path = judged._table_path
    return accepted, refused


def _kind() -> Column:
    return F.when(F.col("reason").startswith(UNKNOWN_SUBJECT), "unknown subject").otherwise("unresolved topics")


def import_report(accepted: DataFrame, refused: DataFrame) -> DataFrame:
    """Totals by reason: imported, and each kind of refusal."""
    return accepted.agg(F.lit("imported").alias("outcome"), F.count("*").alias("n")).union(refused.groupBy(_kind().alias("outcome")).agg(F.count("*").alias("n")))


def _outcomes(accepted: DataFrame, refused: DataFrame) -> DataFrame:
    """One row for each entry: document_id, page, outcome, and 1 in the column where it counts."""
    good = accepted.select("document_id", "page", F.lit("imported").alias("outcome"), F.lit(1).alias("imported"), F.lit(0).alias("skipped"))
    return good.union(refused.select("document_id", "page", _kind().alias("outcome"), F.lit(0).alias("imported"), F.lit(1).alias("skipped")))


def page_lines(accepted: DataFrame, refused: DataFrame) -> DataFrame:
    """Per document and page the numbers of imported and of skipped entries."""
    return _outcomes(accepted, refused).groupBy("document_id", "page").agg(F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"))


def running_totals(lines: DataFrame) -> DataFrame:
    """Page lines, one for each page, with the document's totals up to and with the page."""
    once = lines.groupBy("document_id", "page").agg(F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"))
    so_far = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return once.select("*", F.sum("imported").over(so_far).alias("imported_so_far"), F.sum("skipped").over(so_far).alias("skipped_so_far"))


#: Levels of a report by the grouping id of (document_id, page, outcome).
LEVELS = {7: "total", 3: "document", 1: "page", 0: "outcome"}


def report_lines(accepted: DataFrame, refused: DataFrame) -> DataFrame:
    """The whole report of an import as one table: totals, lines of documents, pages and outcomes, and skipped entries.

    Both inputs have entry_id, document_id and page. ``level`` tells the kind of line: a total, a document's, a page's (with the document's
    totals so far), an outcome's on a page, or a skipped entry's with excerpt and reason. Pages are ordered by
    number, those of no page first. Counts are rolled up from the outcomes of a page, so no document's entries meet in one task.
    """
    rolled = _outcomes(accepted, refused).rollup("document_id", "page", "outcome").agg(F.grouping_id().alias("g"), F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"))
    level = F.coalesce(*[F.when(F.col("g") == g, name) for g, name in LEVELS.items()])
    so_far = Window.partitionBy("g", "document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda c: F.when(F.col("g") == 1, F.sum(c).over(so_far)).alias(f"{c}_so_far")
    none = lambda kind: F.lit(None).cast(kind)
    counted = rolled.select(level.alias("level"), "document_id", "page", "outcome", none(refused.schema["entry_id"].dataType).alias("entry_id"), none("string").alias("excerpt"), none("string").alias("reason"), "imported", "skipped", running("imported"), running("skipped"))
    skipped = refused.select(F.lit("skipped").alias("level"), "document_id", "page", _kind().alias("outcome"), "entry_id", "excerpt", "reason", *[none("long").alias(c) for c in ("imported", "skipped", "imported_so_far", "skipped_so_far")])
    return counted.unionByName(skipped)


def new_rows(accepted: DataFrame, start: int, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted entries as items with ids from ``start`` in an order (by entry_id), and their links; of an entry's links to one topic the first counts."""
    numbered = assign_ids(accepted, order or ["entry_id"], start, "id")
    by_topic = numbered.select("id", F.array_sort(F.transform("links", lambda x: F.struct(x["topic_id"].alias("topic_id"), x["at"].alias("at"), x["role"].alias("role"), x["weight"].alias("weight")))).alias("t"))
    first = lambda x, i: (i == 0) | (x["topic_id"] != F.get("t", i - 1)["topic_id"])
    spread = by_topic.select(F.col("id").alias("item_id"), F.explode(F.filter("t", first)).alias("l")).select("item_id", "l.*")
    links = spread.select("item_id", "topic_id", F.coalesce("role", F.lit("primary")).alias("role"), safe_weight(F.col("weight")).cast("decimal(6,4)").alias("weight"))
    return numbered.drop("links"), links


def write_entries(accepted: DataFrame, items: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and links after the import; of an entry's links to one topic the first counts."""
    new_items, new_links = new_rows(accepted, next_id(items))
    own = new_items.select(*[c for c in items.columns if c in new_items.columns])
    return items.unionByName(own, allowMissingColumns=True), links.unionByName(new_links)


def replace_links(links: DataFrame, tags: DataFrame, item_tags: DataFrame, new_links: DataFrame, topics: DataFrame, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, tags and item tags after the items of ``new_links`` get those links and no others.

    Their tags become the names of their topics; a name that ``tags`` (id, name) lacks gets the next id, in order of
    names. Of an item's new links to one topic the heaviest counts, weights are made safe, and a link without a
    role is primary. ``items`` (item_id) lists items that lose their links and tags even if ``new_links`` has none for them.
    """
    once = new_links.groupBy("item_id", "topic_id").agg(F.max_by(F.struct("role", "weight"), F.struct(safe_weight(F.col("weight")), "role")).alias("l"))
    kind = links.schema["weight"].dataType
    new = once.select("item_id", "topic_id", F.coalesce("l.role", F.lit("primary")).alias("role"), safe_weight(F.col("l.weight")).cast(kind).alias("weight"))
    touched = new.select("item_id")
    touched = (touched if items is None else touched.union(items.select("item_id"))).distinct()
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("name")).filter("coalesce(name, '') != ''")
    named = new.join(names, "topic_id").select("item_id", "name").distinct()
    known = get_or_create(tags, named.select("name"), ["name"])
    own = named.join(known.select("name", F.col("id").alias("tag_id")), "name").select("item_id", "tag_id")
    keep = lambda df: df.join(touched, "item_id", "left_anti")
    return keep(links).unionByName(new.select(*links.columns)), known, keep(item_tags).unionByName(own)
