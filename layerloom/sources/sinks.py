"""Knowledge-base files and metadata as tables and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, root: str) -> None:
    """Pages (path, content) as one table of Parquet files below root, sorted by path: the layout that scales."""
    pages.sort("path").write.mode("overwrite").parquet(root)


def export_pages(pages: DataFrame, root: str) -> int:
    """Each page as a file of its own below root. Rows stream through the driver one partition at a time."""
    spark = pages.sparkSession
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for row in pages.select("path", "content").toLocalIterator():
        to = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{row['path']}")
        out = to.getFileSystem(conf).create(to, True)
        out.write(bytearray((row["content"] or "").encode()))
        out.close()
        n += 1
    return n


def write_metadata(meta: DataFrame, path: str) -> None:
    """Metadata as JSON lines, written beside and committed as a whole."""
    meta.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).coalesce(1).write.mode("overwrite").json(path)


def delete_paths(paths: DataFrame, root: str) -> int:
    """Remove files and folders (path) of vanished components."""
    spark = paths.sparkSession
    n = 0
    for row in paths.select("path").distinct().toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{row['path'].rstrip('/')}")
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return n


def append_events(events: DataFrame, path: str, started: float) -> None:
    """Append events as JSON lines with ts (UTC) and elapsed (seconds since started, to one place)."""
    now = F.current_timestamp()
    elapsed = F.bround(F.unix_micros(now) / 1e6 - F.lit(started), 1)
    stamped = events.withColumn("ts", F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).withColumn("elapsed", elapsed)
    stamped.write.mode("append").json(path)
