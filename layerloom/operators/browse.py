"""Reading a knowledge base: a table of files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerloom.functions import markdown as M
from layerloom.functions import paths as P


def knowledge_bases(files: DataFrame) -> DataFrame:
    """(dir): folders that hold both the metadata file and the index."""
    named = files.select(P.parent(F.col("path")).alias("dir"), P.base_name(F.col("path")).alias("name"))
    return named.groupBy("dir").agg(F.bool_or(F.col("name") == "_meta.json").alias("m"), F.bool_or(F.col("name") == "INDEX.md").alias("i")).where("m AND i").select("dir")


def first_roots(sources: DataFrame) -> DataFrame:
    """(name, root_idx, path): of sources with one name that of the first root."""
    return sources.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("root_idx", "path"))).where("_n = 1").drop("_n")


def navigation(files: DataFrame) -> DataFrame:
    """(package, component, has_overview, leaves): components by their overview file or their folder of leaves."""
    parts = F.split("path", "/")
    md = files.where(F.endswith("path", F.lit(".md")))
    tops = md.where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("package"), P.stem(F.get(parts, F.lit(1))).alias("component"), F.lit(True).alias("_o"))
    below = md.where(F.size(parts) == 3).groupBy(F.get(parts, F.lit(0)).alias("package"), F.get(parts, F.lit(1)).alias("component")).agg(F.array_sort(F.collect_list(P.stem(F.get(parts, F.lit(2))))).alias("_l"))
    joined = tops.join(below, ["package", "component"], "full_outer")
    return joined.select("package", "component", F.coalesce("_o", F.lit(False)).alias("has_overview"), F.coalesce("_l", F.array().cast("array<string>")).alias("leaves"))


def symbol_search(files: DataFrame, symbol: str) -> DataFrame:
    """(path, rank): files that name a symbol: 1 a declaration file, 2 a core file, 3 an overview of that name, 4 others."""
    name = F.lower(P.base_name(F.col("path")))
    rank = (
        F.when(name.rlike("interface|declaration|api"), 1).when(name.rlike("core|impl"), 2)
        .when(name == symbol.lower() + ".md", 3).otherwise(4)
    )
    return files.where(F.contains("content", F.lit(symbol))).select("path", rank.alias("rank"))


def browse(files: DataFrame, package: str | None = None) -> DataFrame:
    """(package, n_files, n_components) of all packages, or the (package, component) pairs of one."""
    nav = navigation(files)
    if package is not None:
        return nav.where(F.col("package") == package).select("package", "component")
    return nav.groupBy("package").agg(F.sum(F.size("leaves") + F.col("has_overview").cast("int")).alias("n_files"), F.count(F.lit(1)).alias("n_components"))


def relationships(parts: DataFrame, key: str, heading: str = "Dependencies") -> DataFrame:
    """(key, content) of the sections of one heading."""
    return parts.where(F.col("heading") == heading).select(key, "content")


def page(files: DataFrame, path: str) -> DataFrame:
    """(path, summary, original) of one page; none for a path that leaves the root."""
    safe = files.where((F.col("path") == path) & ~P.unsafe(F.lit(path)))
    return safe.select("path", M.summary_part(F.col("content")).alias("summary"), F.col("content").alias("original"))


def sources_listing(components: DataFrame) -> DataFrame:
    """(name, components, model, generated_at) of components (name, model, generated_at): the newest state of each source.

    Of states of one time that with the greatest model name counts."""
    newest = F.max(F.struct("generated_at", "model"))
    return components.groupBy("name").agg(F.count(F.lit(1)).alias("components"), newest.alias("_n")).select("name", "components", F.coalesce("_n.model", F.lit("")).alias("model"), "_n.generated_at")


def drill_down(files: DataFrame) -> DataFrame:
    """(path, parent): every page with the page above it: the index, a package, a component, a leaf.

    A page whose next page above is missing goes to the nearest that is there; the index has none."""
    parts = F.split(P.stem(F.col("path")), "/")
    top = F.col("path") == "INDEX.md"
    above = F.when(top, F.array().cast("array<string>")).when(F.size(parts) == 1, F.array(F.lit("INDEX.md"))).otherwise(
        F.concat(F.array(F.lit("INDEX.md")), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit(".md"))))
    )
    md = files.where(F.endswith("path", F.lit(".md"))).select("path").distinct()
    links = md.select("path", F.posexplode_outer(above).alias("level", "above"))
    found = links.join(md.select(F.col("path").alias("_p")), F.col("above") == F.col("_p"), "left")
    return found.groupBy("path").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("level"))).alias("parent"))
