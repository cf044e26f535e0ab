"""Column functions and operators that SQL does not cover, against plain Python."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from layerloom.functions import html as H
from layerloom.functions import markdown as M
from layerloom.functions import paths as P
from layerloom.operators import changes, monitor, packing, scan, sections


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize("pattern", ["*/test/*", "*.py", "a?c.[hc]", "[!a]*.md", "x*y*z", "plain", "a.b"])
def test_glob(spark, pattern):
    names = ["a/test/b.py", "test/x.py", "abc.h", "abc.c", "b.md", "a.md", "x1y2z", "plain", "aXb", "a.b", "q/a.b", ""]
    want = [fnmatch.fnmatchcase(n, pattern) or fnmatch.fnmatchcase(n.rsplit("/", 1)[-1], pattern) for n in names]
    assert column(spark, names, lambda x: P.matches_any(x, (pattern,))) == want


def test_names(spark):
    assert column(spark, ["a.tar.GZ", ".bashrc", "x", "b.Md"], P.extension) == [".gz", "", "", ".md"]
    assert column(spark, [" *.MD ", "cs", ".h", "*", ""], P.normal_extension) == [".md", ".cs", ".h", None, None]
    assert column(spark, ["", "a", "a\n", "a\nb", "\n"], P.line_count) == [0, 1, 1, 2, 1]
    assert column(spark, ["My Repo!", "--", "a_b"], P.source_name) == ["my-repo", "source", "a-b"]
    assert column(spark, ["a/b\\c", "x.MD"], P.leaf_file) == ["a_b_c.md", "x.MD"]
    assert column(spark, ["/a", "a/../b", "a/b"], P.unsafe) == [True, True, False]


def test_anchor(spark):
    assert column(spark, ["Über uns & more", "a_b  c", "É-1"], M.anchor) == ["über-uns-more", "a-b-c", "é-1"]


def test_images(spark):
    text = ["![a](./i/x.png) ![b](http://h/x.png) ![c](#f) ![d](p q.png)"]
    assert column(spark, text, M.refer_images) == ["![a](asset://i/x.png) ![b](http://h/x.png) ![c](#f) ![d](asset://p q.png)"]
    assert column(spark, text, M.drop_images) == ["   "]


def test_summaries(spark):
    content = "// --- a.h ---\nint f();\n// --- b.h ---\n// --- a.h ---\n//---\n"
    assert column(spark, [content], M.marked_paths) == [["a.h", "b.h"]]
    made = column(spark, [content, "none"], M.fallback_summary)
    assert "- a.h\n- b.h" in made[0] and "- Nothing listed." in made[1]
    assert column(spark, made + ["", "## Responsibility"], lambda x: M.looks_truncated(x, M.CODE_HEADINGS)) == [False, False, True, True]
    page = column(spark, ["sum"], lambda x: M.append_original(x, F.lit("code"), F.lit("cpp")))[0]
    assert page.endswith("```cpp\ncode\n```") and column(spark, [page], M.summary_part) == ["sum"]


def test_index_links(spark):
    text = "[a/b.c](x) [b.c](y) [a/b](z) [q](w)"
    keys = F.array(F.lit("a/b"), F.lit("a/b.c"))
    assert column(spark, [text], lambda x: M.index_links(x, keys)) == ["[a/b.c](a/b.c.md) [b.c](a/b.c.md) [a/b](a/b.md) [q](w)"]


def test_html(spark):
    assert column(spark, ["<h2>T &amp; U</h2><p>a <b>b</b></p><br/><ul><li>x</li></ul>"], H.to_markdown) == ["## T & U\na **b**\n\n- x"]
    nested = '<ac:structured-macro ac:name="toc"><ac:structured-macro ac:name="css">x</ac:structured-macro></ac:structured-macro><p>keep</p><style>s</style>'
    assert column(spark, [nested], H.clean_storage) == ["<p>keep</p>"]
    page = '<h1>Tea</h1><h2>Green tea</h2><a href="/a&amp;b">One</a><a href="/a&amp;b">One</a><a href="/c">Tea</a>'
    assert column(spark, [page], lambda x: H.navigation(x, F.lit("Tea"))) == ["# Tea\n\n*(Navigation page with little text of its own.)*\n\n## Sections\n  - Green tea\n\n## Links\n- [One](/a&b)"]


def test_noise(spark):
    lines = ["50%", "color: #fff;", "}", ".x {", "font-size: 3", "center", "Real text.", "", "a:hover x", "span x", "display:none", "the centre"]
    assert column(spark, lines, H.is_noise) == [True, True, True, True, True, True, False, False, True, True, True, False]


def test_postprocess(spark):
    text = "# T\n.a {\ncolor: red\nkept?\n}\ntext\n\n\n\n/* x\ny */more\n50%\nend"
    assert column(spark, [text], H.postprocess) == ["# T\ntext\n\nmore\nend"]


def merged(sizes, least, budget):
    batches = [([i], t) for i, t in enumerate(sizes)]
    i = 0
    while i < len(batches):
        if batches[i][1] < least and len(batches) > 1:
            if i > 0 and batches[i - 1][1] + batches[i][1] <= budget:
                a, b = batches[i - 1], batches.pop(i)
                batches[i - 1] = (a[0] + b[0], a[1] + b[1])
                continue
            if i < len(batches) - 1 and batches[i + 1][1] + batches[i][1] <= budget:
                a, b = batches.pop(i), batches[i]
                batches[i] = (a[0] + b[0], a[1] + b[1])
                continue
        i += 1
    return batches


def test_merge_small(spark):
    rng = random.Random(5)
    groups = [[rng.randrange(1, 14) for _ in range(rng.randrange(1, 9))] for _ in range(120)]
    rows = [(g, i, t) for g, sizes in enumerate(groups) for i, t in enumerate(sizes)]
    got = packing.merge_small(spark.createDataFrame(rows, "g int, batch_idx long, tokens long"), ["g"], 6, 12).collect()
    found = {}
    for r in got:
        found.setdefault(r.g, {}).setdefault(r.merged_idx, set()).add(r.batch_idx)
    for g, sizes in enumerate(groups):
        want = {n: set(m) for n, (m, _) in enumerate(merged(sizes, 6, 12))}
        assert found[g] == want, (sizes, found[g], want)


def test_greedy(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([5, 5, 1, 20, 3, 3, 3])], "g string, i int, t long")
    assert [r.batch_idx for r in packing.greedy_batches(rows, ["g"], ["i"], "t", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 3]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "pre\n# A\nx\n### deep\n## A\ny\n\n## \n"), (2, "none"), (3, " \n"), (4, None)], "k int, t string")
    got = sections.with_anchors(sections.sections(docs, "k", "t"), "k").orderBy("k", "line_start").collect()
    assert [(r.k, r.line_start, r.line_end, r.level, r.heading, r.anchor) for r in got] == [
        (1, 1, 1, 0, "(preamble)", "preamble"), (1, 2, 4, 1, "A", "a"), (1, 5, 9, 2, "A", "a-L5"), (2, 1, 1, 0, "(document)", "document"),
    ]


def test_hashes(spark):
    base = [("c", "b/x", 1.0, 3, b"abc"), ("c", "a", 2.0, 1, b"z")]
    frame = lambda rows: spark.createDataFrame(rows, "k string, rel string, mtime double, size long, content binary")
    fast = lambda rows: changes.fast_hash(frame(rows), "k").first().source_hash
    deep = lambda rows: changes.content_hash(frame(rows), "k").first().content_hash
    touched, edited = [("c", "b/x", 3.0, 3, b"abc"), base[1]], [("c", "b/x", 1.0, 4, b"abcd"), base[1]]
    assert fast(base) == fast(base[::-1]) and fast(base) != fast(touched) and fast(base) != fast(edited)
    assert deep(base) == deep(touched) and deep(base) != deep(edited)


def test_classify(spark):
    now = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "2", "y"), ("d", "1", "x"), ("e", "1", "x"), ("h", "1", "x")], "comp_key string, source_hash string, content_hash string")
    old = spark.createDataFrame([("a", "done", "1", "q"), ("b", "done", "1", "x"), ("c", "done", "1", "x"), ("d", "failed", "1", "x"), ("f", "done", "1", "x"), ("h", "done", None, "x")], "comp_key string, status string, source_hash string, content_hash string")
    assert {r.comp_key: r.change for r in changes.classify(now, old).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "failed", "e": "new", "f": "deleted", "h": "changed"}


def test_discovery(spark):
    files = spark.createDataFrame([("s", "p", "a/x.py", "1\n"), ("s", "p", "y.py", ""), ("s", "q", "z.py", "a\nb"), ("s", "p", ".git/k.py", "1"), ("s", "p", "a/k.png", "1")], "source string, package string, rel string, content string")
    got = scan.component_stats(scan.component_of(scan.included(files, P.CODE_EXTENSIONS))).collect()
    assert {(r.package, r.component, r.file_count, r.total_lines) for r in got} == {("p", "a", 1, 1), ("p", "p._root", 1, 0), ("q", "q", 1, 2)}


def test_nearest_parents(spark):
    dirs = spark.createDataFrame([("c", d) for d in ("core", "core/a", "core/a/b", "x/y", "corex/z")], "component string, dir string")
    assert {r.dir: r.parent_dir for r in scan.nearest_parents(dirs).collect()} == {"core": "core", "core/a": "core", "core/a/b": "core/a", "x/y": "x/y", "corex/z": "corex/z"}


def test_events(spark):
    lines = spark.createDataFrame([(1, '{"event":"phase_start","phase":"scan"}'), (2, "broken"), (3, ""), (4, '{"event":"comp_done","index":3,"in_tokens":5}'), (5, '{"event":"finished"}')], "seq long, line string")
    s = monitor.run_state(monitor.parsed(lines)).first()
    assert (s.phase, s.done, s.tokens, s.finished) == ("scan", 3, 5, True)


def test_settings():
    from layerloom.functions.config import merged

    base = {"llm": {"model": "a", "tries": 3}, "out": "x", "keep": [1]}
    assert merged(base, {"llm": {"model": "b"}, "out": {"dir": "y"}}) == {"llm": {"model": "b", "tries": 3}, "out": {"dir": "y"}, "keep": [1]}
    assert base["llm"]["model"] == "a" and merged({}, base) == base and merged(base, {"llm": None})["llm"] is None


def test_errors_and_bytes(spark):
    from layerloom.functions.routing import retryable
    from layerloom.sources.files import decoded

    rows = spark.createDataFrame([("Empty content", None, b"a\xffb"), ("bad key", "RateLimitError", b"\xe2\x82"), ("bad key", "ValueError", b""), ("HTTP 503", None, None)], "m string, k string, b binary")
    got = rows.select(retryable(F.col("m"), F.col("k")), decoded(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, "a\ufffdb"), (True, "\ufffd"), (False, ""), (True, None)]


def test_last_sections_fit_together(spark):
    """What is kept fits the budget as it is joined, whatever each section loses in rounding down."""

    def kept(text, budget):
        if len(text) // 3 <= budget:
            return text
        parts = re.split(r"\n(?=###?\s)", text)
        if len(parts) == 1:
            return text[: budget * 3] + "\n\n*[truncated: input too large]*"
        for i in range(1, len(parts)):
            if len("\n".join(parts[i:])) // 3 <= budget:
                return f"*[{i} section(s) omitted]*\n\n" + "\n".join(parts[i:]).strip()
        return parts[-1][: budget * 3] + "\n\n*[truncated]*"

    texts = ["## A\n" + "x" * n + "\n### B\n" + "y" * m for n in range(8, 17) for m in range(8, 17)]
    texts += ["\n".join(f"## {i}\n" + "z" * k for i in range(6)) for k in range(1, 12)] + ["", "w" * 40, "## A\n\n### B\n" + "v" * 40]
    assert column(spark, texts, lambda x: M.keep_last_sections(x, 10)) == [kept(t, 10) for t in texts]
