"""File names, paths and glob patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which files and directories count decides the results.
CODE_EXTENSIONS = (".h", ".hpp", ".hxx", ".cpp", ".cc", ".cxx", ".c", ".py", ".pyi", ".cs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
DOCUMENT_EXTENSIONS = (".md", ".rst", ".txt", ".html", ".htm", ".pdf", ".docx", ".doc", ".pptx", ".xlsx", ".xls", ".csv", ".epub", ".ipynb", ".json", ".xml")
BINARY_EXTENSIONS = (
    ".o", ".obj", ".a", ".lib", ".so", ".dll", ".dylib", ".exe", ".pdb", ".class", ".jar", ".war", ".pyc", ".pyo",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".mp3", ".wav", ".ogg", ".mp4", ".avi", ".mov",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".db", ".sqlite", ".dat", ".bin",
    ".ttf", ".otf", ".woff", ".woff2",
    ".pak", ".asset", ".meta", ".fbx", ".uasset",
)
SKIPPED_DIRS = ("__pycache__", "node_modules", ".git", ".svn", ".hg", "__pypackages__", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "venv", ".venv", "env", ".env", "_images")
FALLBACK_EXTENSIONS = (".h", ".hpp", ".cpp", ".cc")
MAX_CODE_BYTES, MAX_DOCUMENT_BYTES = 1_000_000, 1_048_576


def extension(name: Column) -> Column:
    """The lower-cased last suffix with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, "(?<=.)\\.[^.]+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def is_included(ext: Column, include: tuple[str, ...], binary: bool = True) -> Column:
    """A binary suffix is refused before the included ones are looked at; document sources pass binary=False."""
    wanted = ext.isin(*include)
    return wanted & ~ext.isin(*BINARY_EXTENSIONS) if binary else wanted


def normal_extension(raw: Column) -> Column:
    """' *.MD' as '.md'; null if nothing is left."""
    core = F.lower(F.regexp_replace(F.trim(raw), "^\\*+", ""))
    return F.when(core == "", None).when(F.startswith(core, F.lit(".")), core).otherwise(F.concat(F.lit("."), core))


def skipped(part: Column) -> Column:
    return F.startswith(part, F.lit(".")) | part.isin(*SKIPPED_DIRS)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern whose stars cross slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + pattern.startswith("!", i))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def matches_any(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the path or its last part fits one of the shell patterns."""
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob_regex(p)) | base_name(path).rlike(glob_regex(p))
    return found


def line_count(text: Column) -> Column:
    """Physical lines: a last line without its end counts, an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def unsafe(path: Column) -> Column:
    """Whether a requested path leaves its root."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def safe_name(raw: Column, most: int = 200) -> Column:
    """A file name: forbidden characters and runs of white space as underscores, cut to most characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(raw, '[<>:"/\\\\|?*]', "_"), "\\s+", "_"), 1, most)


def source_name(raw: Column, default: str = "source") -> Column:
    """Lower-case letters and digits, anything else as '-', none at the ends."""
    core = F.btrim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(core == "", default).otherwise(core)


def leaf_file(name: Column) -> Column:
    flat = F.regexp_replace(name, "[/\\\\]", "_")
    return F.when(F.endswith(F.lower(flat), F.lit(".md")), flat).otherwise(F.concat(flat, F.lit(".md")))


def converted_extensions(include: Column) -> Column:
    """Suffixes of an array that need a converter: all but Markdown and plain text, sorted."""
    return F.array_sort(F.array_except(include, F.array(F.lit(".md"), F.lit(".txt"))))
