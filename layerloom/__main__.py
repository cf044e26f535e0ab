"""python -m layerloom generate|status|search|browse|export: builds and reads a knowledge base."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from layerloom import build as B
from layerloom.operators import browse
from layerloom.session import session, ship
from layerloom.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="layerloom")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="verb", required=True)
    g = sub.add_parser("generate", help="build or renew a knowledge base")
    g.add_argument("root")
    g.add_argument("out")
    g.add_argument("--name", default="source")
    g.add_argument("--kind", choices=("code", "document"), default="code")
    g.add_argument("--budget", type=int, default=B.Settings.budget)
    g.add_argument("--exclude", action="append", default=[])
    for verb, text in (("status", "counts by status"), ("browse", "packages and components"), ("search", "pages that name a symbol"), ("export", "pages as files")):
        s = sub.add_parser(verb, help=text)
        s.add_argument("out")
        if verb == "search":
            s.add_argument("symbol")
        if verb == "export":
            s.add_argument("to")
    return p


def main(args: list[str]) -> int:
    a = parser().parse_args(args)
    spark = ship(session(a.master))
    if a.verb == "generate":
        B.build(spark, a.root, a.out, B.Settings(source=a.name, kind=a.kind, budget=a.budget, exclude=tuple(a.exclude))).show()
        return 0
    meta, pages = B.load(spark, a.out)
    if a.verb == "status":
        from layerloom.operators.changes import status_counts

        status_counts(meta.withColumn("source", F.substring_index("comp_key", "/", 1))).show(truncate=False)
    elif a.verb == "browse":
        meta.groupBy(F.element_at(F.split("comp_key", "/", 3), 2).alias("package")).agg(F.count(F.lit(1)).alias("components"), F.sum("file_count").alias("files")).orderBy("package").show(1000, truncate=False)
    elif a.verb == "search":
        browse.symbol_search(pages, a.symbol).orderBy("rank", "path").show(100, truncate=False)
    else:
        n = sinks.export_pages(pages.select("path", "content").unionByName(B.overviews(meta, pages)), a.to)
        print(f"{n} files")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
