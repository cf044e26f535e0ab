"""Leaf, fragment, component, package and index texts, assembled from rows.

The summarizer is a function from a column of prompts to a column of texts; the one that is used by default lists what
a batch holds, so results need no service. Ordered texts are built by one aggregation each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerloom.functions import markdown as M

Summarizer = Callable[[Column], Column]


def _joined(order: Column, text: Column, between: str = "\n\n") -> Column:
    """Texts of a group in order, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), between)


joined = _joined


def batch_contents(batches: DataFrame, entries: DataFrame, doc: bool = False) -> DataFrame:
    """(component, batch_idx, content): a batch's entries (entry_keys, in that order; missing ones left out) under separators."""
    keyed = batches.select("component", "batch_idx", F.posexplode("entry_keys").alias("pos", "entry_key"))
    found = keyed.join(entries.select("component", "entry_key", "rel", "text"), ["component", "entry_key"])
    head = F.concat(F.lit("### From: "), "rel", F.lit("\n\n")) if doc else F.concat(F.lit("// --- "), "rel", F.lit(" ---\n"))
    return found.groupBy("component", "batch_idx").agg(_joined(F.col("pos"), F.concat(head, "text")).alias("content"))


def leaves(contents: DataFrame, summarize: Summarizer | None = None, doc: bool = False) -> DataFrame:
    """contents with summary; one that looks cut off is replaced by the listing."""
    required = M.DOC_HEADINGS if doc else M.CODE_HEADINGS
    plain = M.fallback_summary(F.col("content"), doc)
    if summarize is None:
        return contents.withColumn("summary", plain)
    made = contents.withColumn("_made", summarize(F.col("content")))
    return made.withColumn("summary", F.when(M.looks_truncated(F.coalesce("_made", F.lit("")), required), plain).otherwise(F.col("_made"))).drop("_made")


def fragments(parts: DataFrame, group: list[str]) -> DataFrame:
    """(group..., text): summaries of several batches as numbered fragments, by index."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy("batch_idx"))
    numbered = parts.withColumn("_n", n)
    return numbered.groupBy(*group).agg(_joined(F.col("_n"), F.concat(F.lit("### Fragment "), F.col("_n").cast("string"), F.lit("\n"), "summary")).alias("text"))


def overview_input(parts: DataFrame, group: list[str], name: str, text: str, note: Column | None = None) -> DataFrame:
    """(group..., text): '### name (note)' and a text for each part, by name."""
    title = F.concat(F.lit("### "), F.col(name)) if note is None else F.concat(F.lit("### "), F.col(name), F.lit(" ("), note, F.lit(")"))
    made = _joined(F.col(name), F.concat(title, F.lit("\n"), F.col(text))).alias("text")
    return parts.groupBy(*group).agg(made) if group else parts.agg(made)


def with_kept_texts(current: DataFrame, fresh: DataFrame, on_disk: DataFrame, meta: DataFrame, key: str = "comp_key") -> DataFrame:
    """(key, text): a component's new text, else the one on disk, else what its status says; without any, no row."""
    said = F.when(F.col("status") == "failed", "*Generation failed.*").when(F.col("status") == "skipped", "*Skipped.*")
    joined = current.select(key).join(fresh.withColumnRenamed("text", "_f"), key, "left").join(on_disk.withColumnRenamed("text", "_d"), key, "left").join(meta.select(key, "status"), key, "left")
    return joined.select(key, F.coalesce("_f", "_d", said).alias("text")).where("text IS NOT NULL")


def component_files(results: DataFrame, threshold: int = 10) -> DataFrame:
    """(path, content) of a component's files. results: source, package, component, file_count, batch_count, overview, leaves (a map).

    Small components have one file; others an overview and a file for each leaf that is not blank."""
    base = F.concat_ws("/", "source", "package", M.component_file(F.col("component")))
    small = (F.col("batch_count") <= 1) & (F.col("file_count") < threshold)
    over = F.struct(F.concat(base, F.lit(".md")).alias("path"), F.col("overview").alias("content"))
    from layerloom.functions.paths import leaf_file

    own = F.transform(F.filter(F.array_sort(F.map_entries("leaves")), lambda e: M.strip(e["value"]) != ""), lambda e: F.struct(F.concat(base, F.lit("/"), leaf_file(e["key"])).alias("path"), e["value"].alias("content")))
    return results.select(F.explode(F.when(small, F.array(over)).otherwise(F.concat(F.array(over), own))).alias("f")).select("f.*")


def directory_contents(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """(component, batch_idx, content) of batches (component, batch_idx, dirs) that name directories: the entries (component,
    entry_key, dir, rel, text) of these, in order of their keys. '' and '.' both stand for the directory at the top."""
    top = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("."))
    wanted = batches.select("component", "batch_idx", F.explode("dirs").alias("dir")).select("component", "batch_idx", top("dir").alias("dir")).distinct()
    found = wanted.join(entries.withColumn("dir", top("dir")), ["component", "dir"])
    line = F.concat(F.lit("// --- "), "rel", F.lit(" ---\n"), "text", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("entry_key", line.alias("line"))))
    return found.groupBy("component", "batch_idx").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))
