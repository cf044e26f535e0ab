"""Runs as streams: progress events folded into a state, and snapshots merged into a metadata table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.operators import changes, monitor


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one where that is unset and the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="layerloom-")
    return f"{top.rstrip('/')}/layerloom/{name}-{uuid.uuid4().hex}"


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table called name in a folder as a stream: new files of that name, or new files below it if it is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def follow_runs(events: DataFrame, out: str, checkpoint: str) -> None:
    """Fold a stream of events into the state of each run, written as a table after every batch; ends with the input."""

    def save(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(out)

    query = events.groupBy("run").agg(*monitor.state_columns()).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_snapshots(rows: DataFrame, table: str, checkpoint: str, key: str) -> int:
    """Upsert every batch of rows into a metadata table; returns the newest generation, -1 for none.

    Generation n is written beside n - 1, so a batch can run again. Of rows of one key in a batch the least hash decides,
    so a repeated batch gives the same table."""
    newest = -1

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        nonlocal newest
        rest = [c for c in batch.columns if c != key]
        row = F.struct(*[F.col(c) for c in rest])
        latest = batch.groupBy(key).agg(F.min_by(row, F.xxhash64(*rest)).alias("_row")).select(key, "_row.*") if rest else batch.distinct()
        if n:
            latest = changes.upsert(spark.read.parquet(f"{table}/{n - 1}"), latest, key)
        latest.select(*batch.columns).write.mode("overwrite").parquet(f"{table}/{n}")
        newest = max(newest, n)

    rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    return newest
