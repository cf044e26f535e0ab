"""A whole build: scan, changes, extraction, packing, summaries, pages and metadata, incrementally.

A knowledge base is a folder with generations of two Parquet tables, ``meta`` and ``pages``. A build reads the newest
generation, works on components that are new, changed or failed before, and writes the next one beside it; the last
thing it writes is what makes the generation count, so a build that dies leaves the former one in place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.functions import markdown as M
from layerloom.functions import paths as P
from layerloom.functions import skeletons
from layerloom.functions import tokens as T
from layerloom.operators import changes, packing, scan, sections, summaries
from layerloom.sources import files as sources

META = "comp_key string, status string, reason string, source_hash string, content_hash string, file_count long, total_lines long, batch_count long, tokens long"
PAGES = "comp_key string, package string, component string, path string, content string"


@dataclass(frozen=True)
class Settings:
    source: str = "source"
    kind: str = "code"
    budget: int = packing.BUDGET
    min_tokens: int = packing.MIN_TOKENS
    chars_per_token: float = 1.5
    threshold: int = 200
    level: int = 2
    min_component_tokens: int = 50
    exclude: tuple[str, ...] = ()
    summarize: Callable[[Column], Column] | None = None


def code_entries(files: DataFrame) -> DataFrame:
    """(comp_key, entry_key, dir, content, tokens, language): a skeleton for each source file; an implementation beside
    a header of its name shows only what the header lacks."""
    named = files.withColumn("component", F.col("comp_key"))
    beside = scan.header_matches(named).withColumnRenamed("is_supplementary", "_beside").distinct()
    marked = named.join(beside, ["component", "rel"], "left").withColumn("_beside", F.coalesce("_beside", F.lit(False)))
    made = skeletons.extract(marked, "_beside")
    return made.select(F.col("component").alias("comp_key"), F.col("rel").alias("entry_key"), P.parent(F.col("rel")).alias("dir"), F.col("skeleton").alias("content"), "tokens", "language")


def document_entries(files: DataFrame, level: int = 2) -> DataFrame:
    """The same for documents: a row for each section, named by file and anchor; the file is its directory for packing."""
    md = sources.with_markdown(files).where("md IS NOT NULL").select(F.struct("comp_key", "rel").alias("id"), M.refer_images(F.col("md")).alias("md"))
    parts = sections.with_anchors(sections.sections(md, "id", "md", level), "id")
    whole = F.col("heading") == "(document)"
    key = F.when(whole, F.col("id.rel")).otherwise(F.concat("id.rel", F.lit("#"), "anchor"))
    return parts.select("id.comp_key", key.alias("entry_key"), F.col("id.rel").alias("dir"), "content", T.quick_tokens(F.col("content")).alias("tokens"), F.lit("markdown").alias("language"))


def newest(spark: SparkSession, out: str) -> int:
    """The number of the newest whole generation; -1 for none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/meta")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1
    names = [s.getPath() for s in fs.listStatus(path)]
    whole = [int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(whole, default=-1)


def load(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(meta, pages) of the newest generation, empty ones for none."""
    n = newest(spark, out)
    if n < 0:
        return spark.createDataFrame([], META), spark.createDataFrame([], PAGES)
    return spark.read.schema(META).parquet(f"{out}/meta/{n}"), spark.read.schema(PAGES).parquet(f"{out}/pages/{n}")


def components_of(files: DataFrame, s: Settings) -> DataFrame:
    """files of the wanted kinds with component and comp_key (source/package/component)."""
    code = s.kind == "code"
    kept = scan.included(files, P.CODE_EXTENSIONS if code else P.DOCUMENT_EXTENSIONS, s.exclude, binary=code)
    placed = scan.component_of(kept) if code else scan.document_component_of(kept)
    return placed.withColumn("comp_key", F.concat_ws("/", "source", "package", "component"))


def detected(files: DataFrame, meta: DataFrame) -> DataFrame:
    """(comp_key, change, source_hash, content_hash, file_count, total_lines); only counts remain null where deleted."""
    stats = files.groupBy("comp_key").agg(F.count(F.lit(1)).alias("file_count"), F.sum(P.line_count(F.col("content"))).alias("total_lines"))
    current = changes.fast_hash(files, "comp_key").join(changes.content_hash(files, "comp_key"), "comp_key").join(stats, "comp_key")
    return changes.classify(current, meta).join(current, "comp_key", "left")


def build(spark: SparkSession, root: str, out: str, s: Settings = Settings()) -> DataFrame:
    """Build or renew the knowledge base of the tree below root in the folder out; returns (change, n), a row for each class."""
    old_meta, old_pages = load(spark, out)
    read = sources.code_files if s.kind == "code" else sources.document_files
    files = components_of(read(spark, root, s.source), s)
    number = newest(spark, out) + 1
    found = detected(files, old_meta)
    found.write.mode("overwrite").parquet(f"{out}/changes/{number}")
    found = spark.read.schema(found.schema).parquet(f"{out}/changes/{number}")
    due = found.where(F.col("change").isin("new", "changed", "failed"))
    todo = files.join(due.select("comp_key"), "comp_key", "left_semi")
    entries = code_entries(todo) if s.kind == "code" else document_entries(todo, s.level)
    pages, done = written(entries, due, s, f"{out}/work/{number}")
    stay = old_pages.join(found.where("change = 'unchanged'").select("comp_key"), "comp_key", "left_semi")
    kept_meta = old_meta.join(found.where("change = 'unchanged'").select("comp_key"), "comp_key", "left_semi")
    stay.unionByName(pages).write.mode("overwrite").parquet(f"{out}/pages/{number}")
    kept_meta.unionByName(done).write.mode("overwrite").parquet(f"{out}/meta/{number}")
    return found.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df written and read again, as several results are made of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(entries: DataFrame, due: DataFrame, s: Settings, work: str) -> tuple[DataFrame, DataFrame]:
    """(pages, meta) of the components due, from their entries. Intermediate tables go below work."""
    entries = _kept(entries, f"{work}/entries")
    total = entries.groupBy("comp_key").agg(F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"))
    sized = due.select("comp_key", "source_hash", "content_hash", "file_count", "total_lines").join(total, "comp_key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    enough = sized.where(F.col("tokens") >= s.min_component_tokens)
    todo = _kept(entries.join(enough.select("comp_key"), "comp_key", "left_semi").withColumnRenamed("comp_key", "component"), f"{work}/todo")
    packed = packing.pack_components(todo, s.budget, s.min_tokens, s.chars_per_token)
    doc = s.kind != "code"
    head = F.concat(F.lit("### From: "), "entry_key", F.lit("\n\n")) if doc else F.concat(F.lit("// --- "), "entry_key", F.lit(" ---\n"))
    contents = packed.groupBy("component", "batch_idx", "group_key").agg(summaries.joined(F.col("pos"), F.concat(head, "content")).alias("content"))
    leaves = summaries.leaves(contents, s.summarize, doc)
    # batches of one group make one submodule
    parts = leaves.groupBy("component", F.col("group_key").alias("name")).agg(
        F.when(F.count(F.lit(1)) == 1, F.first("summary")).otherwise(summaries.joined(F.col("batch_idx"), F.concat(F.lit("### Part "), (F.col("batch_idx") + 1).cast("string"), F.lit("\n"), "summary"))).alias("summary"),
        summaries.joined(F.col("batch_idx"), F.col("content")).alias("content"), F.count(F.lit(1)).alias("n"),
    )
    parts = _kept(parts, f"{work}/parts")
    over = summaries.overview_input(parts, ["component"], "name", "summary").withColumnRenamed("text", "overview")
    counted = parts.groupBy("component").agg(F.sum("n").alias("batch_count"), F.min("summary").alias("only"), F.min("content").alias("only_content"))
    results = counted.join(over, "component").withColumnRenamed("component", "comp_key").join(enough, "comp_key")
    single = (F.col("batch_count") <= 1) & (F.col("file_count") < s.threshold)
    lang = F.lit("markdown") if doc else F.col("languages")
    place = lambda f, key="comp_key": F.element_at(F.split(key, "/", 3), f)
    base = F.concat_ws("/", place(1), place(2), M.component_file(place(3)))
    own = results.select("comp_key", F.concat(base, F.lit(".md")).alias("path"), F.when(single, M.append_original(F.col("only"), F.col("only_content"), lang)).otherwise(F.col("overview")).alias("content"))
    many = parts.withColumnRenamed("component", "comp_key").join(results.where(~single).select("comp_key", "languages"), "comp_key")
    below = many.select("comp_key", F.concat(base, F.lit("/"), P.leaf_file(F.col("name"))).alias("path"), M.append_original(F.col("summary"), F.col("content"), lang).alias("content"))
    pages = own.unionByName(below).select("comp_key", place(2).alias("package"), place(3).alias("component"), "path", "content")
    meta = sized.join(results.select("comp_key", "batch_count"), "comp_key", "left").select(
        "comp_key", F.when(F.col("tokens") < s.min_component_tokens, "skipped").otherwise("done").alias("status"), F.when(F.col("tokens") < s.min_component_tokens, "tokens_below_threshold").alias("reason"),
        "source_hash", "content_hash", "file_count", "total_lines", F.coalesce("batch_count", F.lit(0)).cast("long").alias("batch_count"), "tokens",
    )
    return pages, meta


def overviews(meta: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, content): a page for each package and the index, from the components' own pages (above their rule)."""
    parts = F.split("path", "/")
    own = pages.where(F.size(parts) == 3).join(meta.select("comp_key", "file_count"), "comp_key").select(F.get(parts, F.lit(0)).alias("source"), "package", "component", "file_count", M.summary_part(F.col("content")).alias("summary"))
    package = summaries.overview_input(own, ["source", "package"], "component", "summary", F.concat(F.col("file_count").cast("string"), F.lit(" files")))
    listed = own.groupBy("source", "package").agg(F.count(F.lit(1)).alias("n"), F.sum("file_count").alias("files"))
    line = F.format_string("- [%s](%s/%s.md): %d components, %d files", "package", "source", "package", "n", "files")
    index = listed.groupBy("source").agg(summaries.joined(F.col("package"), line, "\n").alias("text"))
    return package.select(F.concat_ws("/", "source", F.concat("package", F.lit(".md"))).alias("path"), F.concat(F.lit("# "), "package", F.lit("\n\n"), "text").alias("content")).unionByName(
        index.select(F.concat_ws("/", "source", F.lit("INDEX.md")).alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n"), "text").alias("content"))
    )
