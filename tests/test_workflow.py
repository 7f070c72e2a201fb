import time

import pytest

from loomdex.operators import index, providers, sinks
from loomdex.plans import workflow
from loomdex.sources.files import Settings
from loomdex.streaming import events

TREE = {
    "src/a.ts": "import { helper } from './u';\n\nexport function main() {\n  return helper(1, 2, 3);\n}\n" + "// tail\n" * 5,
    "src/u.ts": "export function helper(a, b, c) {\n  return a + b + c;\n}\nexport class Store {\n  get(key) { return this.items[key]; }\n}\n",
    "src/empty.ts": "export {};",
    "app/v.py": "from .m import run\n\ndef view():\n    return run('this is long enough to be no trivial file')\n",
    "app/m.py": "def run(x):\n    return x  # this module is long enough to be no trivial file\n",
}


def files(spark, tree):
    from loomdex.sources.files import files as table

    return table(spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(sorted(tree.items()))], "path string, content string, seq long"))


class Failing:
    def complete(self, messages, max_tokens=1):
        raise OSError("bad key")


def test_full_run(spark):
    out = workflow.full_run(files(spark, TREE))
    contexts = {r.path: r for r in out["contexts"].collect()}
    assert set(contexts) == set(TREE) and contexts["src/empty.ts"].overview == index.TRIVIAL_OVERVIEW and contexts["src/empty.ts"].chunk_count == 0
    assert contexts["src/a.ts"].dependencies == ["src/u.ts"] and [s.name for s in contexts["src/u.ts"].symbols] == ["helper", "Store", "get"]
    assert contexts["src/u.ts"].symbols[0].used_by == ["src/a.ts"] and contexts["app/v.py"].dependencies == ["app/m.py"]
    assert {r.path: r.imported_by for r in out["index_files"].collect()}["src/u.ts"] == ["src/a.ts"]
    assert {r.word for r in out["index_keywords"].collect()} >= {"helper", "store", "defines"}
    assert tuple(out["index_totals"].first()) == (5, 6) and out["graph_symbols"].count() == 6


def test_cached_contexts_keep_their_own_paths(spark):
    tree = TREE | {"src/copy.ts": TREE["src/u.ts"]}
    store = workflow.full_run(files(spark, TREE))["cache"].cache()
    out = workflow.full_run(files(spark, tree), store, make=Failing)
    c = {r.path: r for r in out["contexts"].collect()}
    assert c["src/copy.ts"].overview == "Overview of src/u.ts." and c["src/u.ts"].chunk_count == 1 and len(c) == 6


def test_incremental(spark):
    first = workflow.full_run(files(spark, TREE))
    contexts, branch = first["contexts"].cache(), first["branch"].cache()
    tree = {**TREE, "src/u.ts": TREE["src/u.ts"].replace("Store", "Shelf"), "src/new.ts": "export function fresh() { return 'long enough to be no trivial file'; }"}
    del tree["app/m.py"]
    out = workflow.incremental_run(files(spark, tree), branch, contexts, analyzed_at="later")
    c = {r.path: r for r in out["contexts"].collect()}
    assert set(c) == set(tree) and {p for p in c if c[p].analyzed_at == "later"} == {"src/u.ts", "src/new.ts"} and [s.name for s in c["src/u.ts"].symbols][1] == "Shelf"
    failed = workflow.incremental_run(files(spark, tree), branch, contexts, make=Failing)
    kept = {r.path: r for r in failed["contexts"].collect()}
    assert [s.name for s in kept["src/u.ts"].symbols][1] == "Store" and "src/new.ts" not in kept
    state = {r.path: r.content_hash for r in failed["branch"].collect()}
    assert "src/new.ts" not in state and "app/m.py" not in state and state["src/u.ts"] == {r.path: r.content_hash for r in branch.collect()}["src/u.ts"]


class Counting(providers.Stub):
    """Fails for prompts with a marker, and names itself in each overview."""

    def complete(self, messages, max_tokens=1):
        if "BROKEN" in messages[-1].content:
            raise OSError("bad key")
        return super().complete(messages)


def test_only_new_chunks_are_asked_about(spark):
    settings = Settings(provider="local")  # 2,000 characters a group
    body = lambda n: f"export function part{n}() {{\n" + f"  work({n});\n" * 60 + "}\n"
    tree = {"src/big.ts": "".join(body(n) for n in range(8))}
    first = workflow.full_run(files(spark, tree), settings=settings)
    before, n = first["chunks"].cache(), first["usage"].first()
    assert n.request_count > 2 and (n.files_analyzed, n.files_from_cache, n.errors, n.provider) == (1, 0, 0, "local") and before.count() == 8
    assert first["contexts"].first().overview == "Overview of src/big.ts."
    edited = {"src/big.ts": tree["src/big.ts"].replace("work(5)", "play(5)")}
    out = workflow.incremental_run(files(spark, edited), first["branch"].cache(), first["contexts"].cache(), settings, previous=before, head="abc")
    assert out["usage"].first().request_count == 1 and out["chunks"].count() == 8 and out["state"].first().head == "abc"
    assert {r.chunk_index for r in out["chunks"].where("NOT reused").collect()} == {5}
    c = out["contexts"].first()
    assert sorted(s.name for s in c.symbols) == sorted(f"part{n}" for n in range(8)) and c.overview == "Overview of src/big.ts."
    broken = {"src/big.ts": tree["src/big.ts"].replace("work(5)", "BROKEN(5)")}
    out = workflow.incremental_run(files(spark, broken), first["branch"], first["contexts"], settings, make=Counting, previous=before)
    assert out["usage"].first().errors == 1 and {r.chunk_index for r in out["chunks"].collect()} == {0, 1, 2, 3, 4, 6, 7}


def test_history_grows_by_a_row_a_run(spark, tmp_path):
    for k in (1, 2):
        workflow.full_run(files(spark, TREE), history=f"{tmp_path}/runs")
        assert spark.read.parquet(f"{tmp_path}/runs").count() == k


def test_changes_narrow_the_work(spark):
    first = workflow.full_run(files(spark, TREE))
    tree = {p: c + "\n// more" for p, c in TREE.items()}
    changed = spark.createDataFrame([("src/a.ts", True, False)], "path string, needs_analysis boolean, deleted boolean")
    out = workflow.incremental_run(files(spark, tree), first["branch"].cache(), first["contexts"].cache(), analyzed_at="later", changed=changed)
    assert {r.path for r in out["contexts"].where("analyzed_at = 'later'").collect()} == {"src/a.ts"}


def test_stream_keeps_the_index(spark, tmp_path):
    root, now = f"{tmp_path}/index", dict(TREE)
    first = workflow.full_run(files(spark, TREE))
    sinks.publish({n: first[n] for n in ("branch", "contexts", "chunks")}, root, "first")
    now["src/u.ts"] = TREE["src/u.ts"].replace("Store", "Shelf")
    del now["app/m.py"]
    spark.createDataFrame([("src/u.ts",), ("app/m.py",)], "path string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string").parquet(f"{tmp_path}/in")
    q = workflow.keep_indexed(stream, lambda: files(spark, now), root, f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    c = {r.path: r for r in sinks.current(spark, root, "contexts").collect()}
    assert set(c) == set(now) and [s.name for s in c["src/u.ts"].symbols] == ["helper", "Shelf", "get"]
    assert {r.path for r in sinks.current(spark, root, "branch").collect()} == set(now)


def test_restart_on_new_settings(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("let a = 1")
    (tmp_path / "src/no.txt").write_text("no")

    def build(settings):
        s = events.file_changes(spark, f"{tmp_path}/src", settings)
        return s.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)

    r = events.Restartable(build)
    assert r.apply(Settings()) and r.query is None and not r.apply(Settings())
    assert r.apply(Settings(auto_update=True)) and r.query is not None
    r.query.awaitTermination(100)
    assert [(x.path, x.content) for x in spark.table("seen").collect()] == [("a.ts", "let a = 1")]
    r.stop()
    assert r.query is None


def test_batches_and_fallback(spark):
    class Forgetful:
        """Answers batches by base name for one file, and not at all for those with a marker."""

        def complete(self, messages, max_tokens=1):
            p = messages[-1].content
            if p.startswith(providers.BATCH_HEAD):
                return providers.Reply("sorry" if "secret" in p else '{"u.ts": {"overview": "By name.", "symbols": [{"name": "q"}]}}')
            return providers.Stub().complete(messages)

    f = files(spark, TREE)
    symbols, edges = workflow.parse(f)
    c = {r.path: r for r in workflow.analyze_batches(f, symbols, edges)["contexts"].collect()}
    assert set(c) == set(TREE) and c["src/u.ts"].overview == "Overview of src/u.ts." and c["src/u.ts"].chunk_count == 1 and c["src/empty.ts"].chunk_count == 0
    c = {r.path: r for r in workflow.analyze_batches(f, symbols, edges, make=Forgetful)["contexts"].collect()}
    assert c["src/u.ts"].overview == "By name." and [s.name for s in c["src/u.ts"].symbols] == ["q"] and c["src/a.ts"].overview == ""
    f = files(spark, TREE | {"src/secret.ts": "// secret\n" + TREE["src/u.ts"]})
    symbols, edges = workflow.parse(f)
    c = {r.path: r for r in workflow.analyze_batches(f, symbols, edges, make=Forgetful)["contexts"].collect()}
    assert c["src/u.ts"].overview == "Overview of src/u.ts." and c["src/u.ts"].chunk_count == 3


def test_poll(spark, tmp_path):
    answers = iter([("main", "1"), ("main", "2"), ("dev", "2")])
    state, told = [("main", "1")], []

    def probe():
        state[0] = next(answers, state[0])
        return state[0]

    q = events.poll(spark, probe, lambda *x: told.append(x), f"{tmp_path}/c", "200 milliseconds").start()
    for _ in range(300):
        if len(told) == 2:
            break
        time.sleep(0.1)
    q.stop()
    assert told == [("commit", "main", "2"), ("branch", "dev", "2")]


def test_single_file_and_failure(spark):
    assert [r.path for r in workflow.single_file(files(spark, TREE), "src/a.ts").collect()] == ["src/a.ts"]
    r = workflow.single_file(files(spark, TREE), "src/a.ts", make=Failing).first()
    assert (r.overview, r.symbols, r.chunk_count) == ("", [], 0)


def test_overview(spark):
    out = workflow.full_run(files(spark, TREE))
    stats = out["index_totals"].selectExpr("*", "3 AS total_edges")
    s = out["index_symbols"].selectExpr("*")
    lines = [r.line for r in index.overview(out["index_files"], s.replace("symbol", "function", ["kind"]), stats, "T").orderBy("section", "key", "place").collect()]
    assert "- **Total files analyzed:** 5" in lines and "### `src/`" in lines and any(x.startswith("- **`helper`** (function) in `src/u.ts`") for x in lines)


SCHEMA = "path string, user string, ts timestamp, v int"


def _write(spark, folder, rows, n):
    spark.createDataFrame([(p, u, time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(t)), v) for p, u, t, v in rows], "path string, user string, ts string, v int").selectExpr("path", "user", "timestamp(ts) AS ts", "v").coalesce(1).write.mode("append").parquet(folder)


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    _write(spark, src, [("a", "u", 0, 1), ("a", "u", 1, 2), ("b", "u", 2, 3), ("a", "u", 30, 4), ("a", "w", 100, 5)], 1)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    q = events.keep_current(stream(), f"{tmp_path}/table", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    _write(spark, src, [("b", "u", 200, 6), ("c", "u", 200, 7)], 2)
    q = events.keep_current(stream(), f"{tmp_path}/table", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.path: r.v for r in events.latest(spark, f"{tmp_path}/table").collect()} == {"a": 5, "b": 6, "c": 7}
    q = events.bursts(stream(), "user").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user, r.n) for r in spark.table("bursts").collect()} >= {("u", 3), ("u", 1)}
    q = events.limited(stream(), "user", 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = sorted((r.ts.timestamp(), r.allowed) for r in spark.table("limited").where("user = 'u'").collect())
    assert [ok for _, ok in rows] == [True, True, False, False, True, True]


@pytest.mark.parametrize("kind", ["stub"])
def test_provider_is_offline_by_default(kind):
    assert isinstance(providers.make_provider(kind), providers.Stub)
