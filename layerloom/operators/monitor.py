"""The state of a run from its events, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_columns() -> list[Column]:
    """Aggregates over (seq, event, idx, tokens, name): later events win, progress is the greatest index seen."""
    kind = lambda k: F.col("event") == k
    return [
        F.max_by("name", F.when(kind("phase_start"), F.col("seq"))).alias("phase"),
        F.coalesce(F.max(F.when(kind("comp_done"), F.col("idx"))), F.lit(0)).cast("long").alias("done"),
        F.coalesce(F.sum(F.when(kind("comp_done"), F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"),
        F.count_if(kind("llm_call")).alias("llm_calls"),
        F.count_if(kind("pkg_done")).alias("packages"),
        F.count_if(kind("error")).alias("errors"),
        F.coalesce(F.bool_or(kind("finished")), F.lit(False)).alias("finished"),
        F.max("seq").alias("last_seq"),
    ]


def run_state(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each run (by), or for all events."""
    return events.groupBy(*by).agg(*state_columns()) if by else events.agg(*state_columns())


def tail(events: DataFrame, n: int, by: str) -> DataFrame:
    """The last n events of each run."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("_n") <= n).drop("_n")


def parsed(lines: DataFrame) -> DataFrame:
    """(seq, event, idx, tokens, name) of JSON lines (seq, line); blank and broken lines are left out."""
    schema = "event string, index long, in_tokens long, name string, phase string"
    made = lines.select("seq", F.from_json("line", schema).alias("e")).where("e.event IS NOT NULL")
    return made.select("seq", "e.event", F.col("e.index").alias("idx"), F.coalesce("e.in_tokens", F.lit(0)).alias("tokens"), F.coalesce("e.name", "e.phase").alias("name"))


def newest_files(files: DataFrame, by: str) -> DataFrame:
    """(by, path, mtime): of each group's progress files the one changed last, of equal times that with the greatest path."""
    return files.groupBy(by).agg(F.max(F.struct("mtime", "path")).alias("_n")).select(by, "_n.path", "_n.mtime")
