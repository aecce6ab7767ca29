"""Loading, walking and changing the subject, chapter and topic hierarchy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemloom.functions.ids import assign_ids, next_id
from itemloom.session import discard, materialize, small

SYLLABUS = "exam_type string, subjects map<string, map<string, array<string>>>"


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and new rows for the wanted keys that it lacks, with the next ids.

    Columns that ``wanted`` doesn't have are null in new rows; of wanted rows with
    equal keys one with the least other values counts.
    """
    rest = [c for c in wanted.columns if c not in keys]
    once = wanted.groupBy(*keys).agg(*(F.min(c).alias(c) for c in rest)) if rest else wanted.select(*keys).distinct()
    match = [F.col(f"w.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    new = once.alias("w").join(existing.select(*keys).alias("e"), match, "left_anti")
    return existing.unionByName(assign_ids(new, keys, next_id(existing)), allowMissingColumns=True)


def flatten_syllabus(documents: DataFrame) -> DataFrame:
    """Rows (subject, chapter, chapter_order, topic, topic_order) of syllabus documents."""
    subject = documents.select(F.explode("subjects").alias("subject", "chapters"))
    chapter = subject.select("subject", F.posexplode(F.map_entries("chapters")).alias("chapter_order", "c"))
    return chapter.select("subject", F.col("c.key").alias("chapter"), "chapter_order", F.posexplode_outer("c.value").alias("topic_order", "topic"))


def load_syllabus(rows: DataFrame, subjects: DataFrame, chapters: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add the named rows that the hierarchy lacks; a second load adds nothing."""
    rows = materialize(rows, "syllabus")
    subjects = materialize(get_or_create(subjects, rows.select(F.col("subject").alias("name")), ["name"]), "subjects")
    of_subject = subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    wanted = rows.join(of_subject, "subject").select("subject_id", F.col("chapter").alias("name"), F.col("chapter_order").alias("sort_order"))
    chapters = materialize(get_or_create(chapters, wanted, ["subject_id", "name"]), "chapters")
    of_chapter = chapters.groupBy("subject_id", F.col("name").alias("chapter")).agg(F.min("id").alias("chapter_id")).join(of_subject, "subject_id")
    wanted = rows.filter("topic IS NOT NULL").join(of_chapter, ["subject", "chapter"]).select("chapter_id", F.col("topic").alias("name"), F.col("topic_order").alias("sort_order"))
    return subjects, chapters, get_or_create(topics, wanted, ["chapter_id", "name"])


def read_syllabus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return flatten_syllabus(spark.read.schema(SYLLABUS).option("multiLine", True).json(paths))


def seed(mapping: DataFrame, subjects: DataFrame, chapters: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load a syllabus into an empty hierarchy; one that has subjects stays as it is."""
    if not subjects.isEmpty():
        return subjects, chapters, topics
    return load_syllabus(mapping, subjects, chapters, topics)


def topic_forest(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Depth and root of every topic of the given set, and the topics that reach no root.

    A topic whose parent isn't in the set is a root. Each round doubles the distance
    that a topic looks up, so the rounds grow with the logarithm of the depth.
    """
    known = topics.select(F.col("id").alias("p"))
    up = topics.join(known, F.col("parent_id") == F.col("p"), "left").select("id", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.coalesce("p", "id").alias("root"))
    up = materialize(up, "forest")
    total = up.count()
    reach = 1
    while reach <= total and not up.filter("up IS NOT NULL").isEmpty():
        above = up.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("steps").alias("a_steps"), F.col("root").alias("a_root"))
        further = up.join(above, F.col("up") == F.col("a"), "left").select("id", F.col("a_up").alias("up"), (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"), F.coalesce("a_root", "root").alias("root"))
        older, up = up, materialize(further, "forest")
        discard(older)
        reach *= 2
    done = up.filter("up IS NULL").select("id", F.col("root").alias("root_id"), F.col("steps").alias("depth"))
    return topics.join(done, "id"), topics.join(up.filter("up IS NOT NULL").select("id"), "id", "left_semi")


def _tour(ranked: DataFrame) -> DataFrame:
    """The walk around a forest as a list: each node's entry (2n) and exit (2n + 1) with the step that follows.

    ``ranked`` has n, id and parent, numbered so that siblings stand together in order, roots first.
    """
    first = ranked.filter("parent IS NOT NULL").groupBy("parent").agg(F.min("n").alias("first")).withColumnRenamed("parent", "f")
    after = ranked.select((F.col("n") - 1).alias("a"), F.lit(True).alias("follows"), F.col("parent").alias("a_parent"))
    above = ranked.select(F.col("id").alias("p"), F.col("n").alias("p_n"))
    joined = ranked.join(first, F.col("id") == F.col("f"), "left").join(after, F.col("n") == F.col("a"), "left").join(above, F.col("parent") == F.col("p"), "left")
    sibling = F.coalesce("follows", F.lit(False)) & F.col("parent").eqNullSafe(F.col("a_parent"))
    entry = F.struct((F.col("n") * 2).alias("e"), F.coalesce(F.col("first") * 2, F.col("n") * 2 + 1).alias("next"), F.lit(1).cast("bigint").alias("seen"))
    leave = F.when(sibling, F.col("n") * 2 + 2).otherwise(F.col("p_n") * 2 + 1)  # null behind the last root
    exit_ = F.struct((F.col("n") * 2 + 1).alias("e"), leave.alias("next"), F.lit(0).cast("bigint").alias("seen"))
    return joined.select(F.inline(F.array(entry, exit_)))


def _ranked_list(steps: DataFrame) -> DataFrame:
    """List ranking: for each step the sum of ``seen`` from it to the end of the list.

    Each round a step adds what the one it points to has seen and points where that one points, so rounds
    grow with the logarithm of the list. Steps that have seen the end take no further part in joins.
    """
    steps = materialize(steps, "tour")
    while not (going := steps.filter("next IS NOT NULL")).isEmpty():
        ahead = steps.select(F.col("e").alias("a"), F.col("next").alias("a_next"), F.col("seen").alias("a_seen"))
        moved = going.join(ahead, F.col("next") == F.col("a")).select("e", F.col("a_next").alias("next"), (F.col("seen") + F.col("a_seen")).alias("seen"))
        older, steps = steps, materialize(steps.filter("next IS NULL").unionByName(moved), "tour")
        discard(older)
    return steps


def display_tree(topics: DataFrame, order: list[str]) -> DataFrame:
    """Where each topic of the given set stands when its forest is shown: id, root_id, depth, n_children, n_below, place.

    Roots, and the children of a topic, are in the given order of columns, then by id. Places count from 0 in that order with
    each topic before all below it. Topics that reach no root are left out. Siblings are numbered by ranges, and
    places come from ranking the walk around the forest as a list, so neither a deep chain nor a topic with very many
    children is more work than its number of topics, and no task gets a whole tree.
    """
    nodes, _ = topic_forest(topics)
    nodes = materialize(nodes.select("id", "root_id", "depth", F.when(F.col("depth") > 0, F.col("parent_id")).alias("parent"), *order), "nodes")
    ranked = materialize(assign_ids(nodes.select("id", "parent", *order), ["parent", *order, "id"], 0, "n").select("n", "id", "parent"), "siblings")
    steps = _ranked_list(_tour(ranked))
    n = F.floor(F.col("e") / 2).alias("n")
    both = steps.groupBy(n).agg(F.max("seen").alias("from_entry"), F.min("seen").alias("from_exit"))
    total = ranked.count()
    placed = ranked.join(both, "n").select("id", (F.lit(total) - F.col("from_entry")).alias("place"), (F.col("from_entry") - F.col("from_exit") - 1).alias("n_below"))
    children = ranked.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("n_children"))
    joined = nodes.join(placed, "id").join(children, F.col("id") == F.col("p"), "left")
    return joined.select("id", "root_id", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_below", "place")


def topic_paths(topics: DataFrame) -> DataFrame:
    """The ids from the root to each topic of the given set, both included: id, path.

    Each round a path is put behind that of the topic above it, which doubles it; topics that reach no root are left out.
    A path is as long as its topic is deep, so a chain of n topics gives n * n / 2 ids in all.
    """
    known = topics.select(F.col("id").alias("p"))
    paths = materialize(topics.join(known, F.col("parent_id") == F.col("p"), "left").select("id", F.col("p").alias("up"), F.array("id").alias("path")), "paths")
    total, reach = paths.count(), 1
    while reach <= total and not (going := paths.filter("up IS NOT NULL")).isEmpty():
        above = paths.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("path").alias("a_path"))
        longer = going.join(above, F.col("up") == F.col("a")).select("id", F.col("a_up").alias("up"), F.concat("a_path", "path").alias("path"))
        older, paths = paths, materialize(paths.filter("up IS NULL").unionByName(longer), "paths")
        discard(older)
        reach *= 2
    return paths.filter("up IS NULL").select("id", "path")


def move_topics(topics: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics after the moves (id, new_parent), and the moves that were refused.

    A topic can't move under itself or a descendant, nor under a topic that isn't
    there or reaches no root. All moves are judged on the tree as it was; null moves to the top.
    A new parent is a descendant if as many steps up from it as it is deeper lead to
    the topic; the steps are taken by doubling, so the rounds grow with the logarithm of
    the depth.
    """
    forest = materialize(topic_forest(topics)[0].select("id", "depth", "parent_id"), "depths")
    own, above = forest.select(F.col("id").alias("o"), F.col("depth").alias("own_depth")), forest.select(F.col("id").alias("n"), F.col("depth").alias("new_depth"))
    placed = moves.select("id", "new_parent").join(own, F.col("id") == F.col("o"), "left").join(above, F.col("new_parent") == F.col("n"), "left")
    lost = F.col("new_parent").isNotNull() & F.col("n").isNull()
    state = materialize(placed.select("id", "new_parent", F.col("new_parent").alias("at"), (F.col("new_depth") - F.col("own_depth")).alias("steps"), lost.alias("lost")), "moves")
    up = forest.select(F.col("id").alias("n"), F.col("parent_id").alias("up"))
    most, step = state.agg(F.max("steps")).first()[0] or 0, 1
    while step <= most:
        taken = (F.col("steps") > 0) & (F.col("steps").bitwiseAND(F.lit(step)) != 0)
        older, state = state, materialize(state.join(up, F.col("at") == F.col("n"), "left").select("id", "new_parent", F.when(taken, F.col("up")).otherwise(F.col("at")).alias("at"), "steps", "lost"), "moves")
        discard(older)
        further = up.select(F.col("n").alias("m"), F.col("up").alias("far"))
        up = materialize(up.join(further, F.col("up") == F.col("m"), "left").select("n", F.col("far").alias("up")), "up")
        step *= 2
    refused = F.col("lost") | F.coalesce((F.col("steps") >= 0) & (F.col("at") == F.col("id")), F.lit(False))
    taken = state.filter(~refused).groupBy("id").agg(F.max(F.struct("new_parent")).alias("to"))
    moved = topics.join(taken, "id", "left").withColumn("parent_id", F.when(F.col("to").isNotNull(), F.col("to.new_parent")).otherwise(F.col("parent_id"))).drop("to")
    return moved.select(*topics.columns), state.filter(refused).select("id", "new_parent")


def merge_topics(topics: DataFrame, links: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and links after merging each ``source_id`` into its ``target_id``.

    Links move to the target; where an item already has one, the target's own row
    stays, else that of the least source. Children of a source go to the target; a
    target that was such a child goes to the source's parent. A target must not be
    a source itself.
    """
    to = merges.select("source_id", "target_id").filter("source_id != target_id").groupBy("source_id").agg(F.min("target_id").alias("target_id"))
    mapped = links.join(small(to), F.col("topic_id") == F.col("source_id"), "left").withColumn("moved", F.col("source_id").isNotNull()).withColumn("new_topic", F.coalesce("target_id", "topic_id"))
    first = F.row_number().over(Window.partitionBy("item_id", "new_topic").orderBy("moved", "topic_id"))
    kept = mapped.withColumn("n", first).filter("n = 1").withColumn("topic_id", F.col("new_topic")).select(*links.columns)
    above = topics.select(F.col("id").alias("gone"), F.col("parent_id").alias("gone_parent"))
    rest = topics.join(to.select(F.col("source_id").alias("id")), "id", "left_anti")
    moved = rest.join(to, F.col("parent_id") == F.col("source_id"), "left").join(above, F.col("parent_id") == F.col("gone"), "left")
    parent = F.when(F.col("source_id").isNull(), F.col("parent_id")).when(F.col("target_id") == F.col("id"), F.col("gone_parent")).otherwise(F.col("target_id"))
    return moved.withColumn("parent_id", parent).select(*topics.columns), kept


def cascade_delete(tables: Mapping[str, DataFrame], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting the listed rows of ``root`` and all that hangs on them.

    ``tables`` has subjects, chapters, topics, items, links and item_tags. Deleting a
    topic makes its children roots. A subject that still has items isn't deleted.
    """
    t = dict(tables)
    gone = ids.select(F.col("id").alias("gone")).distinct()
    drop = lambda name, key, out: t[name].join(out, F.col(key) == F.col("gone"), "left_anti")
    hit = lambda name, key, out: t[name].join(out, F.col(key) == F.col("gone"), "left_semi").select(F.col("id").alias("gone"))
    if root == "subjects":
        gone = gone.join(t["items"].select(F.col("subject_id").alias("owner")), F.col("gone") == F.col("owner"), "left_anti")
        inner = hit("chapters", "subject_id", gone)
        t["subjects"] = drop("subjects", "id", gone)
        root, gone = "chapters", inner
    if root == "chapters":
        inner = hit("topics", "chapter_id", gone)
        t["chapters"] = drop("chapters", "id", gone)
        root, gone = "topics", inner
    if root == "topics":
        left = drop("topics", "id", gone)
        orphan = left.join(gone, F.col("parent_id") == F.col("gone"), "left")
        t["topics"] = orphan.withColumn("parent_id", F.when(F.col("gone").isNull(), F.col("parent_id"))).select(*left.columns)
        t["links"] = drop("links", "topic_id", gone)
    if root == "items":
        t["items"] = drop("items", "id", gone)
        t["links"], t["item_tags"] = drop("links", "item_id", gone), drop("item_tags", "item_id", gone)
    return t
