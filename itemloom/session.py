"""Session and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the setting is absent and all runs in one process (tests), a new temporary
    folder is made the checkpoint folder. On a cluster that would split the data
    among machines, so its absence is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        spark.conf.set("spark.checkpoint.dir", f"file://{found}")
        return f"file://{found}"
    return found


def materialize(df: DataFrame, name: str = "t", reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, in the session ``reader`` if it isn't to be the same.

    Cuts the lineage without a second computation and survives lost executors.
    Tables that only serve steps on the way are for ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = (reader or spark).read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    system, at = _folder(spark, path)
    system.delete(at, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it isn't there."""
    system, at = _folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df._table_path)


#: Most rows of a table that is broadcast: some 100 MB of names and ids.
BROADCAST_ROWS = 500_000
#: Rows of one task where rows are dealt by key, about: some 60 MB of ids and numbers in a hash table or a sort.
TASK_ROWS = 250_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, where it has BROADCAST_ROWS at most; so ``df`` should be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def in_tasks(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many rows, dealt by its keys to tasks of TASK_ROWS, so that a task's memory doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
