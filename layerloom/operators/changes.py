"""What changed since the last build: two-tier hashes, classes, dirty packages, upserts of the metadata table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("unchanged", "changed", "new", "deleted", "failed")


def _ordered_md5(rows: Column) -> Column:
    """md5 of the strings s of an array of structs (parts, s), in the order of parts."""
    return F.md5(F.array_join(F.transform(F.array_sort(rows), lambda x: x["s"]), "\n"))


def fast_hash(files: DataFrame, key: str) -> DataFrame:
    """(key, source_hash) of path, time to the second (half to even) and size of each file, by path parts.

    Each group's list has one short string for each file; contents are not read."""
    entry = F.concat_ws(":", "rel", F.bround("mtime", 0).cast("long").cast("string"), F.col("size").cast("string"))
    return files.groupBy(key).agg(_ordered_md5(F.collect_list(F.struct(F.split("rel", "/").alias("parts"), entry.alias("s")))).alias("source_hash"))


def content_hash(files: DataFrame, key: str) -> DataFrame:
    """(key, content_hash) of path and md5 of the bytes of each file, by path parts: bytes stay where they are read."""
    entry = F.concat_ws(":", "rel", F.md5(F.col("content").cast("binary")))
    return files.groupBy(key).agg(_ordered_md5(F.collect_list(F.struct(F.split("rel", "/").alias("parts"), entry.alias("s")))).alias("content_hash"))


def classify(current: DataFrame, meta: DataFrame, key: str = "comp_key") -> DataFrame:
    """(key, change): current(key, source_hash, content_hash) against meta(key, status, source_hash, content_hash).

    Failed and partial components are tried again; a component is unchanged if its fast hash is as before, or else its
    content hash is. A component without a stored fast hash counts as changed."""
    c, m = current.alias("c"), meta.alias("m")
    joined = c.join(m, F.col(f"c.{key}") == F.col(f"m.{key}"), "full_outer")
    same = (F.coalesce("m.source_hash", F.lit("")) != "") & (
        (F.col("m.source_hash") == F.col("c.source_hash")) | ((F.coalesce("m.content_hash", F.lit("")) != "") & (F.col("m.content_hash") == F.col("c.content_hash")))
    )
    change = (
        F.when(F.col(f"c.{key}").isNull(), "deleted").when(F.col(f"m.{key}").isNull(), "new")
        .when(F.col("m.status").isin("failed", "partial"), "failed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    )
    return joined.select(F.coalesce(f"c.{key}", f"m.{key}").alias(key), change.alias("change"))


def dirty_packages(changes: DataFrame, key: str = "comp_key") -> DataFrame:
    """(package_key): source/package of every component that is not unchanged."""
    parts = F.split(key, "/")
    return changes.where("change <> 'unchanged'").where(F.size(parts) >= 2).select(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("package_key")).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str = "comp_key") -> DataFrame:
    """The rows of new, and those of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def owned_files(deleted: DataFrame, key: str = "comp_key") -> DataFrame:
    """Files and folders that the components of deleted keys (source/package/name) own."""
    parts = F.split(key, "/", 3)
    base = F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.replace(F.get(parts, F.lit(2)), F.lit("/"), F.lit("_")))
    return deleted.where(F.size(parts) == 3).select(key, F.explode(F.array(F.concat(base, F.lit(".md")), F.concat(base, F.lit("/")))).alias("path"))


def meta_totals(meta: DataFrame) -> DataFrame:
    """One row: tokens in and out, components, and those that have not failed."""
    return meta.agg(F.sum(F.coalesce("tokens_in", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("output_tokens"), F.count(F.lit(1)).alias("total_components"), F.count_if(F.col("status") != "failed").alias("completed"))


def status_counts(meta: DataFrame, by: str = "source") -> DataFrame:
    """Counts by source and in total (null source); partial counts as done."""
    return meta.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(~F.col("status").isin("failed", "skipped")).alias("done"),
    )


def derived_status(components: DataFrame, leaves: DataFrame, key: str = "comp_key") -> DataFrame:
    """(key, status): failed with an error, skipped with a reason, partial with an empty summary among its leaves, else done.

    components: key, error, reason; leaves: key, summary."""
    bare = leaves.groupBy(key).agg(F.bool_or(F.coalesce(F.btrim("summary"), F.lit("")) == "").alias("_bare"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("reason", F.lit("")) != "", "skipped").when(F.col("_bare"), "partial").otherwise("done")
    return components.join(bare, key, "left").select(key, status.alias("status"))


def upsert_failed(meta: DataFrame, failed: DataFrame, key: str = "comp_key") -> DataFrame:
    """meta with a row of status failed for each row of failed (key, error), without hashes, so that it is tried again.

    Columns of meta that failed lacks are null in these rows."""
    base = meta if "error" in meta.columns else meta.withColumn("error", F.lit(None).cast("string"))
    rest = [F.col(key), F.lit("failed").alias("status"), F.col("error")]
    new = failed.select(*rest)
    return upsert(base, base.limit(0).unionByName(new, allowMissingColumns=True), key)
