"""Whole builds over a small tree: first run, nothing changed, one file edited, one component gone."""

from layerloom import build as B


def lay(root, tree):
    for path, text in tree.items():
        to = root / path
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(text)


def counts(df):
    return {r.change: r.n for r in df.collect()}


def test_code(spark, tmp_path):
    body = "".join(f"def work_{i}(x: int, y: str) -> bool:\n    return bool(x)\n\n\n" for i in range(30))
    tree = {"app/core/a.py": body, "app/core/deep/b.py": body, "app/net/c.py": body, "app/tiny/d.py": "x = 1\n", "app/main.py": body, "tool/t.py": body}
    root, out = tmp_path / "src", str(tmp_path / "kb")
    lay(root, tree)
    s = B.Settings(source="s", budget=600, min_tokens=100)
    assert counts(B.build(spark, str(root), out, s)) == {"new": 5}
    meta, pages = B.load(spark, out)
    status = {r.comp_key: r.status for r in meta.collect()}
    assert status == {"s/app/core": "done", "s/app/net": "done", "s/app/tiny": "skipped", "s/app/app._root": "done", "s/tool/tool": "done"}
    assert meta.where("comp_key = 's/app/core' AND batch_count > 1").count() == 1
    paths = {r.path: r.content for r in pages.collect()}
    assert "s/app/core.md" in paths and not any("tiny" in p for p in paths)
    text = "\n".join(paths.values())
    assert all(f"def work_{i}(x: int, y: str) -> bool: ..." in text for i in range(30)) and "return bool" not in text
    made = {r.path for r in B.overviews(meta, pages).collect()}
    assert made == {"s/INDEX.md", "s/app.md", "s/tool.md"}
    assert counts(B.build(spark, str(root), out, s)) == {"unchanged": 5}
    lay(root, {"app/net/c.py": body.replace("work_", "job_")})
    (root / "tool/t.py").unlink()
    assert counts(B.build(spark, str(root), out, s)) == {"unchanged": 3, "changed": 1, "deleted": 1}
    meta, pages = B.load(spark, out)
    assert {r.comp_key for r in meta.collect()} == {"s/app/core", "s/app/net", "s/app/tiny", "s/app/app._root"}
    assert any("job_3(" in r.content for r in pages.collect()) and not any(r.path.startswith("s/tool") for r in pages.collect())


def test_documents(spark, tmp_path):
    text = "intro\n\n# One\n" + "words and words " * 40 + "\n## Two\n![p](_images/p.png) " + "more words " * 40
    root, out = tmp_path / "docs", str(tmp_path / "kb")
    lay(root, {"guide/a.md": text, "guide/deep/b.md": text, "guide/deep/er/c.txt": text, "top.md": text, "guide/x.pdf": "x"})
    assert counts(B.build(spark, str(root), out, B.Settings(source="d", kind="document"))) == {"new": 4}
    meta, pages = B.load(spark, out)
    assert {r.comp_key for r in meta.collect()} == {"d/guide/guide._root", "d/guide/deep", "d/guide/deep/er", "d/_root/_root"}
    paths = {r.path: r.content for r in pages.collect()}
    assert set(paths) == {"d/guide/guide._root.md", "d/guide/deep.md", "d/guide/deep_er.md", "d/_root/_root.md"}
    assert "### From: a.md#one" in paths["d/guide/guide._root.md"] and "asset://_images/p.png" in paths["d/guide/deep.md"]


def test_empty(spark, tmp_path):
    lay(tmp_path / "src", {"a/readme.xyz": "x"})
    assert counts(B.build(spark, str(tmp_path / "src"), str(tmp_path / "kb"))) == {}
    meta, pages = B.load(spark, str(tmp_path / "kb"))
    assert meta.count() == pages.count() == 0 and B.newest(spark, str(tmp_path / "none")) == -1
