"""Markdown documents split into sections at their headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerloom.functions.markdown import anchor, strip


def sections(docs: DataFrame, key: str, text: str, level: int = 2) -> DataFrame:
    """(key, line_start, line_end, level, heading, content): parts that start at headings up to a level.

    What stands before the first is '(preamble)' of level 0; a text without such headings is one '(document)'. Blank
    parts are left out. A document is folded in its own row, so nothing is shuffled; its lines are read once.
    """
    lines = F.split(F.col(text), "\n", -1)
    mark = lambda x: F.length(F.regexp_extract(x, "^(#{1,6})\\s+(.+)$", 1))
    starts = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), mark(x).alias("level"), strip(F.regexp_extract(x, "^(#{1,6})\\s+(.+)$", 2)).alias("heading"))), lambda s: (s["level"] > 0) & (s["level"] <= level))
    listed = docs.select(key, lines.alias("_lines"), starts.alias("_s")).withColumn("_n", F.size("_lines"))
    first = F.coalesce(F.get("_s", F.lit(0))["at"], F.col("_n"))
    head = F.struct(F.lit(0).alias("at"), F.lit(0).alias("level"), F.when(F.size("_s") == 0, "(document)").otherwise("(preamble)").alias("heading"))
    parts = F.when(first > 0, F.concat(F.array(head), "_s")).otherwise(F.col("_s"))
    cut = F.transform(parts, lambda s, i: F.struct(s["at"].alias("at"), s["level"].alias("level"), s["heading"].alias("heading"), (F.coalesce(F.get(parts, i + 1)["at"], F.col("_n"))).alias("end")))
    rows = listed.select(key, "_lines", F.explode(cut).alias("p"))
    body = strip(F.array_join(F.slice("_lines", F.col("p.at") + 1, F.col("p.end") - F.col("p.at")), "\n"))
    out = rows.select(key, (F.col("p.at") + 1).cast("long").alias("line_start"), F.col("p.end").cast("long").alias("line_end"), F.col("p.level").cast("long").alias("level"), F.col("p.heading").alias("heading"), body.alias("content"))
    return out.where("content <> ''")


def with_anchors(parts: DataFrame, key: str) -> DataFrame:
    """parts with anchor; a second one of the same name in a document gets its line."""
    named = parts.withColumn("anchor", anchor(F.col("heading")))
    n = F.row_number().over(Window.partitionBy(key, "anchor").orderBy("line_start"))
    return named.withColumn("_n", n).withColumn("anchor", F.when(F.col("_n") > 1, F.concat("anchor", F.lit("-L"), F.col("line_start").cast("string"))).otherwise(F.col("anchor"))).drop("_n")
