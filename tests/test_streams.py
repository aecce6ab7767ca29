"""Streams: pages in order, bounded state, repeated deliveries, and the latest mark of each item."""

import json
import random

import pytest
from pyspark.sql import functions as F

from itemloom.operators import resolve as R
from itemloom.session import child_names, materialize
from itemloom.streaming import streams

ENTRY = "entry_id long, subject_name string, content string, topics array<struct<name:string,chapter:string,role:string,weight:double>>, document_id long, page int"
MARK = "mark_id long, item_id long, level int, ts timestamp"


def entries_of(spark, rows):
    """Rows (entry_id, content, document_id, page); contents with a ``?`` are refused."""
    return spark.createDataFrame([(i, "math" if "?" not in c else "alchemy", c, [("a", "c1", "primary", 1.0)], d, p) for i, c, d, p in rows], ENTRY)


@pytest.fixture(scope="module")
def accept(spark):
    subjects = spark.createDataFrame([(1, "math")], "id long, name string")
    chapters = spark.createDataFrame([(1, 1, "c1", 0)], "id long, subject_id long, name string, sort_order int")
    topics = spark.createDataFrame([(5, 1, "a")], "id long, chapter_id long, name string")
    aliases = spark.createDataFrame([], "alias string, canonical string")
    return lambda b: R.accept_entries(b, R.resolve_topics(b, aliases, topics, chapters, subjects), subjects)


def deliver(spark, folder, planned, orders):
    """Write the planned entries as files, one for each list of entry contents, and return their stream."""
    for k, contents in enumerate(orders):
        planned.filter(F.col("content").isin(contents)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(planned.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, folder, stream, accept, **more):
    streams.import_stream(stream, accept, 100, f"{folder}/out", f"{folder}/checkpoint", **more).awaitTermination()
    items = {(r.document_id, r.page, r.content): r.id for r in spark.read.parquet(f"{folder}/out/items").collect()}
    totals = [tuple(r) for r in streams.import_totals(spark, f"{folder}/out").orderBy("document_id", "page").collect()]
    return items, totals


def test_pages_wait_for_those_before(spark, tmp_path, accept):
    rows = [(1, "a1", 1, 2), (2, "a2", 1, 2), (3, "b1", 1, 5), (None, "c1", 1, 9), (None, "c2", 1, 9), (None, "c2", 1, 9), (7, "d1?", 1, 9), (8, "e1", 2, 1), (9, "lost", 1, None)]
    planned = streams.with_page_plan(entries_of(spark, rows))
    # The last page comes first, the first page's second entry last; files repeat entries.
    orders = [["c1", "c2"], ["b1", "a1"], ["d1?"], ["e1", "c1"], ["a2", "b1"], ["a1", "c2", "d1?"]]
    items, totals = run(spark, tmp_path, deliver(spark, tmp_path, planned, orders), accept)
    assert set(items) == {(1, 2, "a1"), (1, 2, "a2"), (1, 5, "b1"), (1, 9, "c1"), (1, 9, "c2"), (2, 1, "e1")}
    assert sorted(items.values()) == list(range(100, 106))
    pages = [p for (d, p, _), _ in sorted(items.items(), key=lambda x: x[1]) if d == 1]
    assert pages == sorted(pages)
    assert totals == [(1, 2, 2, 0, 2, 0), (1, 5, 1, 0, 3, 0), (1, 9, 2, 1, 5, 1), (2, 1, 1, 0, 1, 0)]
    refused = spark.read.parquet(f"{tmp_path}/out/refused").collect()
    assert [(r.entry_id, r.excerpt, r.reason, r.page) for r in refused] == [(7, "d1?", "unknown subject: alchemy", 9)]


def test_state_holds_only_what_waits(spark, tmp_path, accept):
    rows = [(k, f"x{k}", k % 3, k // 30) for k in range(300)] + [(1000, "late", 0, 4)]
    planned = streams.with_page_plan(entries_of(spark, rows))
    contents = [f"x{k}" for k in range(300)]
    stream = deliver(spark, tmp_path, planned, [contents[:150], contents[150:]])
    items, totals = run(spark, tmp_path, stream, accept)
    # Document 0 waits for the late entry of page 4; the others are done and keep no entry.
    assert {p for d, p, _ in items if d == 0} == {0, 1, 2, 3} and len(items) == 240
    state = spark.read.format("statestore").load(f"{tmp_path}/checkpoint").select("value.*").collect()
    memories = {m["done"]: m for m in (json.loads(r.groupState.memory) for r in state)}
    assert memories[9]["waiting"] == {} and len(state) == 3
    assert {p: len(w["rows"]) for p, w in memories[3]["waiting"].items()} == {str(p): 10 for p in range(4, 10)}
    planned.filter("content = 'late'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    items, _ = run(spark, tmp_path, stream, accept)
    assert len(items) == 301 and sorted(items.values()) == list(range(100, 401))


def test_incomplete_pages_pass_when_patience_ends(spark, tmp_path, accept):
    planned = streams.with_page_plan(entries_of(spark, [(1, "a", 1, 1), (2, "b", 1, 1), (3, "c", 1, 2), (4, "other", 2, 1), (5, "more", 2, 2)]))
    stream = deliver(spark, tmp_path, planned, [["a", "c"]])
    items, _ = run(spark, tmp_path, stream, accept, patience="1 ms")
    for late in ("other", "b", "b"):
        planned.filter(F.col("content") == late).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        items, totals = run(spark, tmp_path, stream, accept, patience="1 ms")
    assert {c for d, _, c in items if d == 1} == {"a", "b", "c"}
    assert [t for t in totals if t[0] == 1] == [(1, 1, 2, 0, 2, 0), (1, 2, 1, 0, 3, 0)]


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path, accept):
    rows = [(k, f"x{k}" + "?" * (k % 4 == 0), 1, k // 5) for k in range(20)]
    gated = entries_of(spark, rows).select(F.concat(F.lit("="), F.col("entry_id").cast("string")).alias("entry_key"), F.lit(True).alias("complete"), "*")
    first, second = materialize(gated.filter("page < 2")), materialize(gated.filter("page >= 2"))

    def state():
        return {name: sorted(map(repr, spark.read.parquet(f"{tmp_path}/{name}").collect())) for name in ("items", "links", "refused", "pages", "totals")}

    streams.import_batch(first, 0, accept, 10, str(tmp_path))
    once = state()
    streams.import_batch(first, 0, accept, 10, str(tmp_path))
    assert state() == once
    streams.import_batch(second, 3, accept, 10, str(tmp_path))
    both = state()
    streams.import_batch(second, 3, accept, 10, str(tmp_path))
    assert state() == both
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/items").collect()) == list(range(10, 25))
    assert streams.import_totals(spark, str(tmp_path)).agg(F.max("imported_so_far"), F.max("skipped_so_far")).first()[:] == (15, 5)


def test_old_totals_go(spark, tmp_path, accept):
    one = entries_of(spark, [(1, "a", 1, 1)]).select(F.lit("=1").alias("entry_key"), F.lit(True).alias("complete"), "*")
    for n in range(3):
        streams.import_batch(one, n, accept, 1, str(tmp_path))
    assert len(child_names(spark, f"{tmp_path}/totals")) == 2
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/items").collect()) == [1, 2, 3]


def test_marks_keep_one_row_for_each_item(spark, tmp_path):
    rng = random.Random(1)
    marks = [(k, rng.randrange(20) if k % 10 else None, rng.randrange(-1, 8), f"2024-01-{1 + rng.randrange(9):02d} 00:00:00") for k in range(400)]
    df = spark.createDataFrame(marks, "mark_id long, item_id long, level int, ts string").withColumn("ts", F.to_timestamp("ts"))
    changed = []
    for part in (df.filter("mark_id >= 200"), df.filter("mark_id < 250"), df):  # late and repeated ones come after
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(MARK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streams.mark_stream(stream, f"{tmp_path}/checkpoint", lambda d, n: changed.append((n, d.count()))).awaitTermination()
    best = {}
    for mark, item, level, ts in marks:
        if item is not None and 0 <= level <= 5:
            best[item] = max(best.get(item, ("", 0, 0)), (ts, mark, level))
    got = streams.latest_of(spark, f"{tmp_path}/checkpoint").collect()
    assert {r.item_id: (str(r.ts), r.level) for r in got} == {i: (ts, level) for i, (ts, _, level) in best.items()}
    assert [n for n, _ in changed] == [0, 1, 2] and all(n <= 20 for _, n in changed)


def test_session_settings_stay_as_they_were(spark, tmp_path):
    before = {name: spark.conf.get(name, None) for name in streams.SETTINGS}
    spark.createDataFrame([], MARK).write.parquet(f"{tmp_path}/in")
    streams.mark_stream(spark.readStream.schema(MARK).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination()
    assert {name: spark.conf.get(name, None) for name in streams.SETTINGS} == before


def test_report_lines(spark):
    accepted = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, None)], "entry_id long, document_id long, page int")
    refused = spark.createDataFrame([(4, 1, 1, "e", "unknown subject: x"), (5, 1, 1, "f", "topics not in the catalogue"), (6, 2, 3, None, "topics not in the catalogue: q")], "entry_id long, document_id long, page int, excerpt string, reason string")
    lines = [tuple(r) for r in R.report_lines(accepted, refused).collect()]
    of = lambda level: {line[1:] for line in lines if line[0] == level}
    none = (None,) * 4
    assert of("total") == {(None, None, *none, 3, 3, None, None)}
    assert of("document") == {(1, None, *none, 2, 2, None, None), (2, None, *none, 0, 1, None, None), (None, None, *none, 1, 0, None, None)}
    assert of("page") == {(1, 1, *none, 1, 2, 1, 2), (1, 2, *none, 1, 0, 2, 2), (2, 3, *none, 0, 1, 0, 1), (None, None, *none, 1, 0, 1, 0)}
    assert {(x[0], x[1], x[2], x[6], x[7]) for x in of("outcome")} == {(1, 1, "imported", 1, 0), (1, 1, "unknown subject", 0, 1), (1, 1, "unresolved topics", 0, 1), (1, 2, "imported", 1, 0), (2, 3, "unresolved topics", 0, 1), (None, None, "imported", 1, 0)}
    assert {(x[0], x[1], x[3], x[4], x[5]) for x in of("skipped")} == {(1, 1, 4, "e", "unknown subject: x"), (1, 1, 5, "f", "topics not in the catalogue"), (2, 3, 6, None, "topics not in the catalogue: q")}
    assert R.report_lines(accepted.limit(0), refused.limit(0)).filter("imported + skipped > 0").count() == 0
