"""Incremental marks and imports as Structured Streaming.

What a stream has to remember is keyed state in its checkpoint, kept by RocksDB, so
that it may outgrow the executors' memory. Batches may be delivered again after a
failure: each starts from the state that the batch before it left, and writes the
same folders, so a second delivery changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from itemloom.operators.resolve import new_rows, page_lines, running_totals
from itemloom.session import child_names, delete, discard, materialize, quoted

#: Settings under which streams start: state in RocksDB, and no batches without data, which a stream with timeouts would make for ever.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: After this time without news of a document its waiting pages are imported as they are.
PATIENCE = "7 days"


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here have SETTINGS; the session keeps its own."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _start(writer: DataStreamWriter, spark: SparkSession, checkpoint: str) -> StreamingQuery:
    with _settings(spark):
        return writer.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def mark_stream(marks: DataFrame, checkpoint: str, changed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the latest mark of each item: by time, then mark id.

    ``marks`` is a stream of mark_id, item_id, level and ts. The state has one row for each item, whatever
    the number of marks and batches. Marks count however late they come, and repeats change nothing, as the
    greatest mark is the same in any order. Levels outside 0 to 5 and marks of no item are passed over.
    ``changed`` gets the items whose mark is new in a batch, and the batch's number. ``latest_of``
    reads the whole.
    """
    last = F.max(F.struct("ts", "mark_id", "level")).alias("last")
    kept = marks.filter(F.col("level").between(0, 5) & F.col("item_id").isNotNull()).groupBy("item_id").agg(last)
    writer = kept.writeStream
    if changed is None:
        return _start(writer.format("noop"), marks.sparkSession, checkpoint)
    return _start(writer.foreachBatch(lambda df, n: changed(_flat(df, F.col("last")), n)), marks.sparkSession, checkpoint)


def _flat(df: DataFrame, last: Column) -> DataFrame:
    return df.select("item_id", last["level"].alias("level"), last["ts"].alias("ts"))


def latest_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The latest mark of each item, as the stream's last finished batch left it: item_id, level, ts.

    Reads the state, so it costs as much as there are items, not batches.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return _flat(state.select("key.item_id", F.col("value.max").alias("last")), F.col("last"))


def _fields(kind: T.DataType, short: bool = False) -> T.DataType:
    """A type all of whose parts may be null; where ``short``, with a letter or two for each field's name, so that JSON doesn't say the names over and over."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f"{k:x}" if short else f.name, _fields(f.dataType, short)) for k, f in enumerate(kind.fields)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_fields(kind.elementType, short))
    return T.MapType(_fields(kind.keyType, short), _fields(kind.valueType, short)) if isinstance(kind, T.MapType) else kind


def _entry_key(entries: DataFrame) -> Column:
    """What an entry is known by: its entry_id, or all it says where it has none."""
    said = F.md5(F.to_json(F.struct(*quoted(entries))).cast("binary"))
    return F.coalesce(F.concat(F.lit("="), F.col("entry_id").cast("string")), F.concat(F.lit("#"), said))


def with_page_plan(entries: DataFrame) -> DataFrame:
    """Entries of whole documents with page_entries and page_before, by which a stream knows when a page is due.

    page_entries counts the different entries of the page; page_before is the page of the document before it that has entries, null for the first.
    Entries without a page are left out. Pages are counted before they are ordered, so only they are sorted by document.
    """
    paged = entries.filter("page IS NOT NULL")
    keys = paged.select("document_id", "page", _entry_key(paged).alias("key"))
    pages = keys.groupBy("document_id", "page").agg(F.count_distinct("key").cast("int").alias("page_entries"))
    plan = pages.withColumn("page_before", F.expr("lag(page) OVER (PARTITION BY document_id ORDER BY page)"))
    match = F.col("e.document_id").eqNullSafe(F.col("p.document_id")) & (F.col("e.page") == F.col("p.page"))
    return paged.alias("e").join(plan.alias("p"), match).select("e.*", "p.page_entries", "p.page_before")


_GATE_STATE = "memory string"
_GATED = "document_id string, page int, entry_key string, payload string, complete boolean"


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, patience: int) -> Iterator[pd.DataFrame]:
    """Let the entries of a document's pages pass when the page is whole and those before it have passed.

    Remembers the last page that has passed, the entries that wait, and of pages that passed incomplete what passed of them.
    """
    memory = json.loads(state.get[0]) if state.exists else {"done": None, "waiting": {}, "short": {}}
    done, waiting, short = memory["done"], {int(p): w for p, w in memory["waiting"].items()}, {int(p): set(k) for p, k in memory["short"].items()}
    passed: list[tuple] = []
    if state.hasTimedOut:
        for page in sorted(waiting):
            passed += [(page, k, payload, False) for k, payload in sorted(waiting[page]["rows"].items())]
            short[page] = set(waiting[page]["rows"])
            done = page if done is None else max(done, page)
        waiting = {}
    else:
        for frame in frames:
            for page, entry, payload, n, before in zip(*(frame[c].tolist() for c in ("page", "entry_key", "payload", "page_entries", "page_before")), strict=True):
                if done is not None and page <= done:  # a repeat, unless its page passed without it
                    if page in short and entry not in short[page]:
                        short[page].add(entry)
                        passed.append((page, entry, payload, False))
                    continue
                if (wait := waiting.get(page)) is None:
                    wait = waiting[int(page)] = {"n": int(n), "before": None if pd.isna(before) else int(before), "rows": {}}
                wait["rows"].setdefault(entry, payload)
        for page in sorted(waiting):
            wait = waiting[page]
            free = wait["before"] is None or (done is not None and wait["before"] <= done)
            if not free or len(wait["rows"]) < wait["n"]:
                break
            passed += [(page, k, payload, True) for k, payload in sorted(wait["rows"].items())]
            done = page
            del waiting[page]
    state.update((json.dumps({"done": done, "waiting": waiting, "short": {p: sorted(k) for p, k in short.items()}}),))
    if waiting:
        state.setTimeoutDuration(patience)
    name = None if pd.isna(key[0]) else str(key[0])
    yield pd.DataFrame([(name, *row) for row in passed], columns=["document_id", "page", "entry_key", "payload", "complete"])


def in_page_order(entries: DataFrame, patience: str = PATIENCE) -> DataFrame:
    """A stream's entries once the page they are on is due, with entry_key and complete.

    ``entries`` has the columns of ``with_page_plan``. A page is due when all its entries have come and the
    document's pages before it have passed; until then its entries wait in the state, which holds besides them
    one number for each document. An entry is known by its entry_id, one without an id by all it says: what comes
    again is passed over. If a document has no news for ``patience``, what waits of it passes with complete = false, in the next batch that has entries of any document; what such a page
    still lacks passes when it comes.
    """
    short = _fields(entries.schema, short=True)
    payload = F.to_json(F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(quoted(entries), short, strict=True)]))
    packed = entries.filter("page IS NOT NULL").select("document_id", F.col("page").cast("int").alias("page"), _entry_key(entries).alias("entry_key"), payload.alias("payload"), F.col("page_entries").cast("int").alias("page_entries"), F.col("page_before").cast("int").alias("page_before"))
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    gated = packed.groupBy("document_id").applyInPandasWithState(partial(_gate, patience=wait), _GATED, _GATE_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    return gated.select("entry_key", "complete", F.from_json("payload", short).cast(_fields(entries.schema)).alias("e")).select("entry_key", "complete", "e.*")


_TOTALS = "imported long, refused long"


def _before(spark: SparkSession, out: str, batch_id: int) -> tuple[int, int]:
    """Imported and refused entries of the batches before this one, from the last one's line."""
    older = sorted(n for name in child_names(spark, f"{out}/totals") if (n := int(name.removeprefix("batch="))) < batch_id)
    for n in older[:-1]:
        delete(spark, f"{out}/totals/batch={n}")
    return tuple(spark.read.schema(_TOTALS).parquet(f"{out}/totals/batch={older[-1]}").first()) if older else (0, 0)


def import_batch(batch: DataFrame, batch_id: int, accept: Callable[[DataFrame], tuple[DataFrame, DataFrame]], start: int, out: str, spark: SparkSession | None = None) -> None:
    """Import entries that are due: items, links, refused entries and page lines, each into a folder of this batch.

    Items get ids from ``start`` on by batch, document, page and key. A second call with the same number writes the same again.
    ``spark`` is the session that imports them, by default the batch's; a stream's own has adaptive plans switched off.
    """
    spark = spark or batch.sparkSession
    batch = materialize(batch.withColumnRenamed("entry_id", "given_id").withColumnRenamed("entry_key", "entry_id"), "batch", spark)
    write_to = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    before = _before(spark, out, batch_id)
    accepted, judged = accept(batch)
    own = batch.select("entry_id", "given_id", "document_id", "page")
    accepted = accepted if hasattr(accepted, "_table_path") else materialize(accepted, "accepted")
    refused = materialize(judged.join(own, "entry_id"), "refused")
    items, links = new_rows(accepted, start + before[0], ["document_id", "page", "entry_id"])
    named = lambda df: df.drop("entry_id").withColumnRenamed("given_id", "entry_id")
    write_to(named(items), "items")
    write_to(links, "links")
    write_to(named(refused), "refused")
    write_to(page_lines(accepted, refused), "pages")
    totals = [(before[0] + accepted.count(), before[1] + refused.count())]
    write_to(spark.createDataFrame(totals, _TOTALS).coalesce(1), "totals")
    discard(batch, accepted, refused)


def import_stream(entries: DataFrame, accept: Callable[[DataFrame], tuple[DataFrame, DataFrame]], start: int, out: str, checkpoint: str, patience: str = PATIENCE) -> StreamingQuery:
    """Import a stream of entries page by page, as ``in_page_order`` lets them pass.

    ``accept`` gives the accepted and the refused of a table of entries. No batch reads what earlier ones wrote but for one
    line of totals. Each table is a folder of ``out`` with a folder for each batch; ``import_totals`` reads
    the lines of pages.
    """
    due = in_page_order(entries, patience)
    return _start(due.writeStream.foreachBatch(lambda batch, n: import_batch(batch, n, accept, start, out, entries.sparkSession)), entries.sparkSession, checkpoint)


def import_totals(spark: SparkSession, out: str) -> DataFrame:
    """Per document and page what was imported and skipped, and the totals of the document so far."""
    return running_totals(spark.read.parquet(f"{out}/pages").drop("batch"))
