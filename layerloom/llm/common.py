"""Helpers shared by the training-data operators: scratch tables, size-checked broadcasts, let-bindings."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word classes of the contracts define it: blank and \x09-\x0D.
SPACE = "[ \\x09-\\x0D]"

#: Rows up to which a lookup table is broadcast; beyond it the join is shuffled. At 100 bytes a row this is 5 MB.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one where that is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="layerloom-"))
            held = spark.sparkContext.getCheckpointDir()
        found = held
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/layerloom/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, so a lost executor costs one read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._layerloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df._layerloom_path)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage. For steps
    that end in stored(): nothing reads their shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows (counted here unless given) and BROADCAST_BYTES; else df, whose joins shuffle.

    The bytes are those of the files that stored() wrote, or else the rows by the widths of their types."""
    n = df.count() if rows is None else rows
    path = getattr(df, "_layerloom_path", None)
    size = _file_bytes(df.sparkSession, path) if path else n * df._jdf.schema().defaultSize()
    return F.broadcast(df) if n <= most and size <= BROADCAST_BYTES else df


def _file_bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def unused(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ and so on that df has no column of (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of anything but white space; null has none."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+")),
    )
