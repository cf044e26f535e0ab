"""Components and their statistics from a table of files.

A file row has source, package, rel (path below the package's root) and content. All of this is grouping; a path's
prefixes are exploded where ancestors matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.functions import paths as P


def with_names(files: DataFrame) -> DataFrame:
    """files with name, ext and dir of rel."""
    return files.withColumn("name", P.base_name(F.col("rel"))).withColumn("ext", P.extension(P.base_name(F.col("rel")))).withColumn("dir", P.parent(F.col("rel")))


def included(files: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...] = (), binary: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Files of included suffixes that no exclude pattern fits, none below a skipped directory or above a size."""
    named = with_names(files)
    kept = named.where(P.is_included(F.col("ext"), include, binary))
    kept = kept.where(~F.exists(F.filter(F.split("dir", "/"), lambda x: x != ""), P.skipped))
    if exclude:
        kept = kept.where(~P.matches_any(F.col("rel"), exclude))
    return kept if max_bytes is None else kept.where(F.octet_length("content") <= max_bytes)


def component_of(files: DataFrame) -> DataFrame:
    """files with component: the first directory of rel, '_root' for files without one where no sibling has any.

    A package with directories keeps its direct files in '<package>._root'.
    """
    top = F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1))
    deep = files.groupBy("source", "package").agg(F.bool_or(F.contains("rel", F.lit("/"))).alias("_deep"))
    joined = files.join(deep, ["source", "package"])
    return joined.withColumn("component", F.coalesce(top, F.when(F.col("_deep"), F.concat("package", F.lit("._root"))).otherwise(F.col("package")))).drop("_deep")


def document_component_of(files: DataFrame) -> DataFrame:
    """files with component, for documents: each directory's direct files, named by the directory.

    Direct files of a package are '<package>._root', those of the whole tree '_root'. rel becomes the file's name."""
    name = F.when(F.col("package") == "_root", "_root").when(F.col("dir") == "", F.concat("package", F.lit("._root"))).otherwise(F.col("dir"))
    return with_names(files).withColumn("component", name).withColumn("rel", F.col("name"))


def directories(files: DataFrame) -> DataFrame:
    """(source, package, dir, depth): every directory above a file, below no skipped one."""
    parts = F.filter(F.split(P.parent(F.col("rel")), "/"), lambda x: x != "")
    whole = files.where(~F.exists(parts, P.skipped)).select("source", "package", parts.alias("p")).where(F.size("p") > 0)
    return whole.select("source", "package", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(F.array_join(F.slice("p", 1, n), "/").alias("dir"), n.alias("depth")))).alias("d")).select("source", "package", "d.*").distinct()


def component_stats(files: DataFrame) -> DataFrame:
    """Files, physical lines and bytes of each component."""
    return files.groupBy("source", "package", "component").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum(P.line_count(F.col("content"))).alias("total_lines"), F.sum(F.octet_length("content")).alias("total_bytes")
    )


def detected_extensions(files: DataFrame, supported: tuple[str, ...] = P.CODE_EXTENSIONS + P.DOCUMENT_EXTENSIONS, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The supported suffixes that occur, less the ignored ones."""
    return with_names(files).where(F.col("ext").isin(*supported) & (~F.col("ext").isin(*ignored) if ignored else F.lit(True))).select("ext").distinct()


def subprojects(dirs: DataFrame) -> DataFrame:
    """(component, child) rows of components with two children or more that hold a source or include directory.

    dirs: component, path (of directories below it that hold a file)."""
    parts = F.split("path", "/")
    held = dirs.where((F.size(parts) >= 2) & F.lower(F.get(parts, F.lit(1))).isin("src", "include", "source")).select("component", F.get(parts, F.lit(0)).alias("child")).distinct()
    many = held.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return held.join(many, "component", "left_semi")


def nearest_parents(dirs: DataFrame, key: str = "component") -> DataFrame:
    """(key, dir, parent_dir): the longest proper prefix of dir that is in the set too, else dir itself."""
    parts = F.split("dir", "/")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    up = dirs.select(key, "dir", F.explode(prefixes).alias("_up"))
    known = dirs.select(F.col(key).alias("_k"), F.col("dir").alias("_d")).distinct()
    best = up.join(known, (F.col(key) == F.col("_k")) & (F.col("_up") == F.col("_d"))).groupBy(key, "dir").agg(F.max_by("_up", F.length("_up")).alias("_best"))
    return dirs.select(key, "dir").distinct().join(best, [key, "dir"], "left").select(key, "dir", F.coalesce("_best", "dir").alias("parent_dir"))


def header_matches(files: DataFrame, header: tuple[str, ...] = (".h", ".hpp", ".hxx"), impl: tuple[str, ...] = (".cpp", ".cc", ".cxx", ".c")) -> DataFrame:
    """Implementation files with is_supplementary: whether a header of the same lower-cased stem is in the component."""
    named = with_names(files).withColumn("_stem", F.lower(P.stem(F.col("name"))))
    heads = named.where(F.col("ext").isin(*header)).select("component", "_stem").distinct().withColumn("_has", F.lit(True))
    return named.where(F.col("ext").isin(*impl)).join(heads, ["component", "_stem"], "left").select("component", "rel", F.coalesce("_has", F.lit(False)).alias("is_supplementary"))


def page_tree(pages: DataFrame, max_depth: int = 10, key: str = "page_id", parent: str = "parent_id") -> DataFrame:
    """(page_id, root_id, depth) of all pages reached from roots (null parent), by one join for each level."""
    level = pages.where(F.col(parent).isNull()).select(F.col(key).alias("page_id"), F.col(key).alias("root_id"), F.lit(0).alias("depth"))
    child = pages.where(F.col(parent).isNotNull()).select(F.col(key).alias("_c"), F.col(parent).alias("_p"))
    out = level
    for d in range(1, max_depth + 1):
        level = level.join(child, F.col("page_id") == F.col("_p")).select(F.col("_c").alias("page_id"), "root_id", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out
