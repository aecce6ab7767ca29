"""Tasks that don't grow with the tables, and steps that aren't taken twice."""

import json

import pytest
from pyspark.sql import functions as F

from itemloom import session
from itemloom.functions.ids import assign_ids
from itemloom.operators import resolve as R
from itemloom.plans.bindings import Model
from itemloom.streaming import streams
from oracle import DATA
from test_streams import accept, deliver, entries_of  # noqa: F401


def test_links_are_dealt_by_rows(spark, monkeypatch):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    for rows in (lines // 10, lines // 40):
        monkeypatch.setattr(session, "TASK_ROWS", rows)
        links = Model(spark, DATA).links
        assert links.rdd.getNumPartitions() == -(-lines // rows)
        assert links.groupBy("item_id", "topic_id").count().filter("count > 1").isEmpty()


def test_acceptance_is_written_once(spark, accept):  # noqa: F811
    accepted, refused = accept(entries_of(spark, [(1, "a", 1, 1), (2, "b?", 1, 1)]))
    assert [r.entry_id for r in accepted.collect()] == [1] and [r.entry_id for r in refused.collect()] == [2]
    for df in (accepted, refused):
        assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_ids_are_numbered_when_written(spark, n):
    df = assign_ids(spark.range(n).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], 5, "n")
    assert "Window" not in df.select("k")._jdf.queryExecution().executedPlan().toString()
    assert [r.n for r in df.orderBy("k").collect()] == list(range(5, n + 5))


def test_the_first_link_to_a_topic_counts(spark):
    link = "array<struct<at:int,topic_id:long,role:string,weight:double>>"
    rows = [(7, [(0, 3, "secondary", 0.2), (1, 2, None, 0.3), (2, 3, "primary", 0.9), (3, 2, "x", 0.4)]), (9, [])]
    items, links = R.new_rows(spark.createDataFrame(rows, f"entry_id long, links {link}"), 100)
    assert {(r.id, r.entry_id) for r in items.collect()} == {(100, 7), (101, 9)}
    assert {(r.item_id, r.topic_id, r.role, float(r.weight)) for r in links.collect()} == {(100, 3, "secondary", 0.2), (100, 2, "primary", 0.3)}


def test_waiting_entries_are_short_and_come_back_whole(spark, tmp_path, accept):  # noqa: F811
    planned = streams.with_page_plan(entries_of(spark, [(1, "a", 1, 1), (2, "b", 1, 2)]))
    seen = []
    stream = deliver(spark, tmp_path, planned, [["b"]])

    def watched(batch):
        seen.append(batch.sparkSession)
        return accept(batch)

    start = lambda: streams.import_stream(stream, watched, 100, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    start().awaitTermination()
    memory = json.loads(spark.read.format("statestore").load(f"{tmp_path}/checkpoint").select("value.*").first().groupState.memory)
    (payload,) = memory["waiting"]["2"]["rows"].values()
    assert "subject_name" not in payload and "chapter" not in payload
    planned.filter("content = 'a'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start().awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/out/items").orderBy("entry_id").select(*planned.columns).collect()
    assert back == planned.orderBy("entry_id").collect()
    assert all(s is spark for s in seen)
