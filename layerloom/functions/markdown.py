"""Markdown texts: headings, images, appended originals, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "asset://"
RULE = "\n\n---\n\n"
CODE_HEADINGS = ("## Responsibility", "## Key Types and Relationships", "## Source Files", "## Dependencies")
DOC_HEADINGS = ("## Topic Summary", "## Key Concepts and Definitions", "## Actionable Information", "## Related Topics")
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def anchor(heading: Column) -> Column:
    """Lower case, without signs, blanks and underscores as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(heading), "[^\\p{L}\\p{N}_\\s-]", ""), "[\\s_]+", "-")


def drop_images(text: Column) -> Column:
    return F.regexp_replace(text, "!\\[[^\\]]*\\]\\([^)]*\\)", "")


def refer_images(text: Column) -> Column:
    """Local image targets become placeholders; absolute, fragment, http, data and file targets stay."""
    return F.regexp_replace(text, "!\\[([^\\]]*)\\]\\((?!/|#|https?:|data:|file:)(?:\\./)?([^)]+)\\)", "![$1](" + PLACEHOLDER + "$2)")


def resolve_assets(text: Column, prefix: Column) -> Column:
    """Placeholders as paths below prefix."""
    return F.replace(text, F.lit("](" + PLACEHOLDER), F.concat(F.lit("]("), prefix, F.lit("/")))


def legacy_assets(text: Column, prefix: Column) -> Column:
    """Targets below _images/ moved below prefix."""
    return F.replace(text, F.lit("](_images/"), F.concat(F.lit("]("), prefix, F.lit("/_images/")))


def asset_dir(component: Column, single_file: Column) -> Column:
    return F.when(single_file, F.concat(F.lit("__assets/"), component)).otherwise(F.concat(component, F.lit("/__assets")))


def append_original(summary: Column, original: Column, language: Column) -> Column:
    """The summary with its source below a rule: documents as they are, code in a fence; blank sources add nothing."""
    doc = F.concat(summary, F.lit(RULE + "## Original Content\n\n"), original)
    code = F.concat(summary, F.lit(RULE + "## Complete API Signatures\n\n```"), language, F.lit("\n"), original, F.lit("\n```"))
    return F.when(strip(original) == "", summary).when(language == "markdown", doc).otherwise(code)


def summary_part(text: Column) -> Column:
    """What stands above the first rule, without white space at its end."""
    at = F.locate("\n---\n", text)
    return F.rtrim(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.lit(_SPACE))


def has_headings(text: Column, required: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for h in required:
        found = found & F.contains(text, F.lit(h))
    return found


def looks_truncated(text: Column, required: tuple[str, ...]) -> Column:
    """Empty, lacking a heading, ending in an opening sign, or with an odd number of backticks."""
    s = F.rtrim(text, F.lit(_SPACE))
    odd = (F.length(s) - F.length(F.replace(s, F.lit("`"), F.lit("")))) % 2 == 1
    return (s == "") | ~has_headings(s, required) | s.rlike("[`(\\[:\\-]$") | odd


def marked_paths(content: Column, doc: bool = False) -> Column:
    """The distinct paths named by separators, in order."""
    lines = F.transform(F.split(content, "\n|\r\n?|\x0b|\x0c|\x1c|\x1d|\x1e|\x85| | "), strip)
    if doc:
        found = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("### From: "))), lambda x: strip(F.substring(x, 11, 1_000_000)))
    else:
        hit = F.filter(lines, lambda x: F.startswith(x, F.lit("// --- ")) & F.endswith(x, F.lit(" ---")) & (F.length(x) >= 11))
        found = F.transform(hit, lambda x: strip(F.substring(x, F.lit(8), F.length(x) - 11)))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def fallback_summary(content: Column, doc: bool = False) -> Column:
    """A summary that names what a batch holds, for when no summarizer answers."""
    paths = F.transform(F.slice(marked_paths(content, doc), 1, 12), lambda p: F.concat(F.lit("- "), p))
    none = "Nothing could be summarized from this excerpt."
    listed = F.when(F.size(paths) > 0, F.array_join(paths, "\n")).otherwise("- Nothing listed.")
    a, b, c, d = DOC_HEADINGS if doc else CODE_HEADINGS
    return F.concat(F.lit(f"{a}\n{none}\n\n{b}\n{none}\n\n{c}\n"), listed, F.lit(f"\n\n{d}\n{none}"))


def keep_last_sections(text: Column, budget: int, chars_per_token: float = 3.0) -> Column:
    """The last sections (from a line of two or three '#') that fit the budget together, with a note of how many were left out.

    Kept sections are measured as they are joined: rounded down one by one, they could fit while the whole text does not."""
    size = lambda n: F.greatest(F.lit(1).cast("long"), F.floor(n / chars_per_token))
    parts = F.split(text, "\n(?=###?\\s)")
    most = int(budget * chars_per_token)
    kept = F.aggregate(
        F.reverse(parts),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(-1).cast("long").alias("used"), F.lit(False).alias("full")),
        lambda acc, x: F.when(
            ~acc["full"] & (size(acc["used"] + 1 + F.length(x)) <= budget),
            F.struct(F.array_prepend(acc["out"], x).alias("out"), (acc["used"] + 1 + F.length(x)).alias("used"), F.lit(False).alias("full")),
        ).otherwise(F.struct(acc["out"].alias("out"), acc["used"].alias("used"), F.lit(True).alias("full"))),
        lambda acc: acc["out"],
    )
    cut = F.concat(F.substring(F.element_at(parts, -1), 1, most), F.lit("\n\n*[truncated]*"))
    some = F.concat(F.lit("*["), F.size(parts) - F.size(kept), F.lit(" section(s) omitted]*\n\n"), strip(F.array_join(kept, "\n")))
    hard = F.concat(F.substring(text, 1, most), F.lit("\n\n*[truncated: input too large]*"))
    return F.when(size(F.length(text)) <= budget, text).when(F.size(parts) <= 1, hard).when(F.size(kept) == 0, cut).otherwise(some)


def keep_tail(text: Column, allowed_tokens: int, chars_per_token: float = 3.0, note: str = "*[truncated to fit context]*\n\n") -> Column:
    """The end of a text that fits, after a note."""
    most = int(allowed_tokens * chars_per_token)
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / chars_per_token))
    return F.when((size <= allowed_tokens) | (most <= 0), text).otherwise(F.concat(F.lit(note[:most]), F.right(text, F.lit(max(0, most - len(note))))))


def component_file(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def index_links(text: Column, packages: Column) -> Column:
    """Link targets of packages (an array of 'source/package' keys) rewritten to their files; longer keys first."""
    ordered = F.array_sort(packages, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = lambda k: F.regexp_replace(k, "([^\\p{L}\\p{N}/_ -])", "\\\\$1")
    held = lambda k: F.regexp_replace(k, "([\\\\$])", "\\\\$1")
    named = lambda t, label, key: F.regexp_replace(t, F.concat(F.lit("\\["), quoted(label), F.lit("\\]\\([^)]*\\)")), F.concat(F.lit("["), held(label), F.lit("]("), held(key), F.lit(".md)")))
    full = F.aggregate(ordered, text, lambda t, k: F.when(F.contains(k, F.lit("/")), named(t, k, k)).otherwise(t))
    return F.aggregate(ordered, full, lambda t, k: F.when(F.contains(k, F.lit("/")), named(t, F.regexp_replace(k, "^[^/]*/", ""), k)).otherwise(t))
