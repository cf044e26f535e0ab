"""Files of a tree as rows, by Spark's readers only, so that any file system will do."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.functions.paths import MAX_CODE_BYTES, MAX_DOCUMENT_BYTES, extension, line_count

COLUMNS = ("source", "package", "rel", "content")


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 text, with a replacement character for what is not."""
    return F.make_valid_utf8(data.cast("string"))


def code_files(spark: SparkSession, root: str, source: str, max_bytes: int = MAX_CODE_BYTES) -> DataFrame:
    """(source, package, rel, size, mtime, content) of all files up to a size; the size filter reaches the scan.

    What is not UTF-8 in a file becomes a replacement character, so one bad byte costs no file and no scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.regexp_replace(full, "^" + _quoted(_plain(root)) + "/", "")
    return raw.select(
        F.lit(source).alias("source"),
        F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1)).otherwise("_root").alias("package"),
        F.when(F.contains(below, F.lit("/")), F.regexp_replace(below, "^[^/]*/", "")).otherwise(below).alias("rel"),
        F.col("length").alias("size"),
        F.unix_micros("modificationTime").cast("double").alias("_us"),
        decoded(F.col("content")).alias("content"),
    ).withColumn("mtime", F.col("_us") / 1e6).drop("_us")


def document_files(spark: SparkSession, root: str, source: str) -> DataFrame:
    return code_files(spark, root, source, MAX_DOCUMENT_BYTES)


def with_markdown(files: DataFrame) -> DataFrame:
    """files with md and reason: Markdown and text as they are, HTML converted, other formats left null with a reason."""
    from layerloom.functions.html import to_markdown

    ext = extension(F.substring_index("rel", "/", -1))
    md = F.when(ext.isin(".md", ".txt", ".rst"), F.col("content")).when(ext.isin(".html", ".htm"), to_markdown(F.col("content")))
    return files.withColumn("md", md).withColumn("reason", F.when(F.col("md").isNull(), F.concat(F.lit("no converter for "), ext)))


def file_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("source", "package").agg(F.count(F.lit(1)).alias("files"), F.sum(line_count(F.col("content"))).alias("lines"))


def json_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A metadata file as rows; missing or broken files give none."""
    try:
        text = spark.read.option("wholetext", "true").text(path)
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return text.select(F.explode(F.from_json("value", f"array<struct<{', '.join(':'.join(f.split()) for f in schema.split(', '))}>>")).alias("r")).select("r.*")


def _plain(root: str) -> str:
    return "/" + re.sub(r"^[a-z]+:/*", "", root).strip("/")


def _quoted(path: str) -> str:
    return re.sub(r"([^\w/ -])", r"\\\1", path)
