"""Trees, sinks and streams on a local folder."""

import os

from layerloom.sources import files, sinks
from layerloom.streaming import runs


def test_tree(spark, tmp_path):
    for path, text in {"p/a/x.md": "# X\n", "p/y.html": "<p>a &amp; b</p>", "z.pdf": "x", "p/big.txt": "a" * 2_000_000}.items():
        to = tmp_path / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(text)
    got = files.with_markdown(files.document_files(spark, str(tmp_path), "s")).collect()
    assert {(r.package, r.rel, r.md, r.reason) for r in got} == {("p", "a/x.md", "# X\n", None), ("p", "y.html", "a & b", None), ("_root", "z.pdf", None, "no converter for .pdf")}


def test_metadata(spark, tmp_path):
    schema = "comp_key string, n long"
    assert files.json_metadata(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    assert files.json_metadata(spark, str(tmp_path / "bad.json"), schema).count() == 0
    (tmp_path / "ok.json").write_text('[{"comp_key": "a", "n": 1}]')
    assert [tuple(r) for r in files.json_metadata(spark, str(tmp_path / "ok.json"), schema).collect()] == [("a", 1)]


def test_export(spark, tmp_path):
    pages = spark.createDataFrame([("p/a.md", "é\n"), ("INDEX.md", "i")], "path string, content string")
    assert sinks.export_pages(pages, f"file://{tmp_path}") == 2
    assert (tmp_path / "p/a.md").read_text() == "é\n"
    assert sinks.delete_paths(pages.where("path = 'p/a.md'"), f"file://{tmp_path}") == 1 and not os.path.exists(tmp_path / "p/a.md")
    sinks.write_pages(pages, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_snapshots_in_batches(spark, tmp_path):
    for i, rows in enumerate(([("a", "1"), ("b", "1")], [("b", "2"), ("c", "2")])):
        spark.createDataFrame(rows, "k string, h string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("k string, h string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    runs.merge_snapshots(stream, str(tmp_path / "t"), str(tmp_path / "c"), "k")
    last = max(int(x) for x in os.listdir(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / f"t/{last}")).count() == 3


def test_streams_of_folders(spark, sf, tmp_path):
    """Tables are one file or a folder of part files, beside others; both streams read all of either."""
    from layerloom.plans.catalogue import QUERIES

    for name in ("pages", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("incremental_stream", "stream_monitor"):
        got, want = ({tuple(r) for r in QUERIES[name](spark, at).collect()} for at in (str(tmp_path), sf))
        assert got and got == want


def test_bad_bytes_and_folders(spark, tmp_path):
    """One bad byte costs no file, and folders named build or bin are sources as any other."""
    from layerloom.functions.paths import CODE_EXTENSIONS
    from layerloom.operators.scan import included
    from layerloom.sources.files import code_files

    for name, data in (("p/build/y.py", b"x = 1\xff\n"), ("p/bin/z.c", b"int z;"), ("p/__pypackages__/q.py", b"q"), ("p/env/e.py", b"e")):
        path = tmp_path / name
        path.parent.mkdir(parents=True)
        path.write_bytes(data)
    rows = included(code_files(spark, str(tmp_path), "s"), CODE_EXTENSIONS).collect()
    assert {(r.rel, r.content) for r in rows} == {("build/y.py", "x = 1\ufffd\n"), ("bin/z.c", "int z;")}


def test_event_sink(spark, tmp_path):
    from layerloom.sources.sinks import append_events

    events = spark.createDataFrame([("comp_done", 3)], "event string, index long")
    for _ in range(2):
        append_events(events, str(tmp_path / "progress"), 0.0)
    rows = spark.read.json(str(tmp_path / "progress")).collect()
    assert len(rows) == 2 and all(r.event == "comp_done" and r["index"] == 3 and r.elapsed > 0 and r.ts.endswith("+00:00") for r in rows)
