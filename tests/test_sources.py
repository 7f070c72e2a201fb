import pytest
from pyspark.sql import functions as F

from loomdex.sources import changes, files


def test_read_tree(spark, tmp_path):
    for name, text in {"src/a.ts": "let a\nb", "src/deep/b.py": "x = 1", "dist/c.js": "no", "d.txt": "no", ".loomdex/e.ts": "no", "node_modules/f.ts": "no", "z/dist/g.js": "no", "sp ace.go": "package x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = {r.path: r for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/a.ts", "src/deep/b.py", "sp ace.go"} == {r.path for r in files.read_tree(spark, f"file://{tmp_path}/").collect()}
    assert rows["src/a.ts"].content == "let a\nb" and rows["src/a.ts"].size_bytes == 7 and rows["src/deep/b.py"].language == "python"


def test_settings():
    assert files.Settings(provider="local").max_chunk_chars() == 2000 and files.Settings(provider="openai-compat").max_chunk_chars() == 15_184
    assert files.Settings(provider="openai").max_chunk_chars() == 60_000 and files.Settings(provider="openai").effective_rpm() == 12
    assert len(files.Settings().extensions) == 20 and len(files.Settings().excludes) == 10 and not files.Settings(provider="local").batch_files()


def test_include_entries(spark):
    d = spark.createDataFrame([(p, i) for i, p in enumerate(["src/a.ts", "src/b/c.ts", "lib/d.ts", "srcx/e.ts"])], "path string, seq long")
    got = lambda *e: sorted(r.path for r in files.include_scan(d, spark.createDataFrame([(x,) for x in e], "entry string")).collect())
    assert got("src") == ["src/a.ts", "src/b/c.ts"] and got("src/", "./src/b", "lib/d.ts") == ["lib/d.ts", "src/a.ts", "src/b/c.ts"] and len(got(".")) == 4 and got("nope") == []


@pytest.mark.parametrize("html,want", [
    ("<template/>\n\n<script lang=\"ts\">\nfoo\n</script>", ("\nfoo\n", "typescript", 2)), ("<script setup>x</script><script>y</script>", ("x", "javascript", 0)), ("<p/>", None), (None, None),
])
def test_vue(spark, html, want):
    r = spark.createDataFrame([(html,)], "c string").select(files.vue_script(F.col("c")).alias("s")).first().s
    assert (tuple(r) if r else None) == want


def test_changes(spark):
    status = changes.name_status(spark.createDataFrame([("A\ta",), ("M\tb c",), ("D\td",), ("R087\told\tnew",), ("C100\tfrom\tcopy",), ("",)], "line string"))
    assert {(r.path, r.change) for r in status.collect()} == {("a", "added"), ("b c", "modified"), ("d", "deleted"), ("old", "deleted"), ("new", "added"), ("copy", "added")}
    table = lambda **kw: spark.createDataFrame(list(kw.items()), "path string, content_hash string")
    assert {(r.path, r.change) for r in changes.snapshot_diff(table(a="1", b="2", c="3"), table(a="1", b="x", d="4")).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_relevant(spark):
    c = spark.createDataFrame([("a", True, False), ("b", True, False), ("c", False, True), ("d", False, True)], "path string, needs_analysis boolean, deleted boolean")
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert {tuple(r) for r in changes.relevant(c, paths("a"), paths("c")).collect()} == {("a", "analyze"), ("c", "delete")}


def test_collect_and_small_files(spark, tmp_path):
    root = str(tmp_path)
    for name in ("src/a.ts", "lib/b.ts", "main.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("let x = 1")
    paths = lambda: sorted(r.path for r in files.collect(spark, root).collect())
    assert paths() == ["lib/b.ts", "main.ts", "src/a.ts"]
    where = files.write_default_include(spark, root)
    assert paths() == ["src/a.ts"] and files.read_text(spark, where) == files.DEFAULT_INCLUDE
    (tmp_path / ".loomdex/include").write_text("lib\n")
    (tmp_path / ".loomdex/.include.crc").unlink(missing_ok=True)
    assert files.write_default_include(spark, root) == where and paths() == ["lib/b.ts"]
    assert files.read_text(spark, f"{root}/none") is None and files.size_kb(spark, f"{root}/none") == 0 and files.size_kb(spark, f"{root}/main.ts") == 9 / 1024
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    assert files.read_json(spark, f"{root}/good.json", "a int").first().a == 1
    assert files.read_json(spark, f"{root}/bad.json", "a int") is None and files.read_json(spark, f"{root}/none.json", "a int") is None


def test_git(spark, tmp_path):
    import subprocess

    from loomdex.sources import git

    root = str(tmp_path)
    do = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    assert git.branch(root) == "default" and git.head(root) is None
    do("init", "-q", "-b", "main")
    for name, text in (("a.ts", "one"), ("b.ts", "two"), ("c.ts", "three")):
        (tmp_path / name).write_text(text)
    do("add", "-A")
    do("commit", "-q", "-m", "first")
    first = git.head(root)
    (tmp_path / "a.ts").write_text("changed")
    do("rm", "-q", "c.ts")
    do("add", "-A")
    do("commit", "-q", "-m", "second")
    (tmp_path / "b.ts").write_text("edited")
    (tmp_path / "new.ts").write_text("new")
    assert git.branch(root) == "main" and git.probe(root)() == ("main", git.head(root)) and git.head(root) != first
    got = {r.path: (r.needs_analysis, r.deleted) for r in git.changed(spark, root, first).collect()}
    assert got == {"a.ts": (True, False), "b.ts": (True, False), "c.ts": (False, True), "new.ts": (True, False)}
    from loomdex.functions import text as T

    mine = spark.createDataFrame([("b.ts", "two"), ("a.ts", "changed")], "path string, content string").select("path", T.git_blob_hash(F.col("content")).alias("git_hash"))
    assert mine.join(git.blobs(spark, root), ["path", "git_hash"]).count() == 2
    assert git.blob_hash(root, first, "c.ts") and git.blob_hash(root, "HEAD", "c.ts") == ""
    do("checkout", "-q", "--detach")
    assert git.branch(root) == git.head(root)[: len(git.branch(root))] and git.branch(root) != "HEAD"
