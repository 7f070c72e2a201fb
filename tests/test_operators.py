import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import cache, chunks, graph, index, sinks, usage
from loomdex.operators.order import numbered


def files(spark, **contents):
    return spark.createDataFrame([(k.replace("__", "."), v, i, len(v.encode())) for i, (k, v) in enumerate(contents.items())], "path string, content string, seq long, size_bytes long")


def symbols(spark, *rows):
    return spark.createDataFrame([(p, i, n, k, line) for i, (p, n, k, line) in enumerate(rows)], "path string, pos int, name string, kind string, line int")


def test_chunks_of_two_functions(spark):
    f = files(spark, a__ts='import { helper } from "./utils";\n\nfunction foo() {\n  return 1;\n}\n\nfunction bar() {\n  return helper();\n}', u__ts="export function helper() {}")
    s = symbols(spark, ("a.ts", "foo", "function", 3), ("a.ts", "bar", "function", 7), ("u.ts", "helper", "function", 1))
    c = chunks.chunks(s, f)
    rows = {(r.path, r.chunk_index): r for r in c.collect()}
    assert rows["a.ts", 0].content == "function foo() {\n  return 1;\n}\n" and rows["a.ts", 1].content == "function bar() {\n  return helper();\n}"
    assert rows["a.ts", 0].preamble == 'import { helper } from "./utils";\n' and (rows["a.ts", 1].start_line, rows["a.ts", 1].end_line) == (6, 8) and rows["a.ts", 1].id == "a.ts::chunk_1"
    e = spark.createDataFrame([("a.ts", 0, "u.ts")], "src string, pos int, dst string")
    refs = chunks.references(c, e, s)
    assert [tuple(r) for r in refs.collect()] == [("a.ts", 1, "helper")]
    assert chunks.dependency_context(refs, e, s, ["chunk_index"]).first().dep_context == "`u.ts`: helper(function)"
    assert chunks.export_context(e, s).first().dep_context == "`u.ts` exports: helper(function)"


def test_decorators(spark):
    f = files(spark, a="import x\nfunction a() {}\n// doc b\nfunction b() {}", b='import d;\n\n@Injectable()\n// note\nclass S {}', c="class A { m() {} }")
    s = symbols(spark, ("a", "a", "function", 2), ("a", "b", "function", 4), ("b", "S", "class", 5), ("c", "A", "class", 1), ("c", "m", "method", 1))
    got = lambda **kw: {(r.path, r.chunk_index): r.content for r in chunks.chunks(s, f, **kw).collect()}
    assert got() == {("a", 0): "function a() {}\n// doc b", ("a", 1): "function b() {}", ("b", 0): "@Injectable()\n// note\nclass S {}", ("c", 0): "class A { m() {} }", ("c", 1): ""}
    assert got(attach_decorators=True)["a", 1] == "// doc b\nfunction b() {}" and got(attach_decorators=True)["a", 0] == "function a() {}"


def test_files_without_symbols(spark):
    f = files(spark, a="/* " + "x" * 200 + " */", b="", c="export {};", d="  \n")
    rows = chunks.chunks(symbols(spark, ("q", "n", "k", 1)), f).collect()
    assert [(r.path, r.chunk_index, r.symbol_names, r.start_line, r.end_line) for r in rows] == [("a", 0, [], 0, 0)]


def test_long_region_is_cut_by_lines(spark):
    f = files(spark, a="head\n" + "\n".join(f"line {i}" for i in range(50)))
    rows = sorted(chunks.chunks(symbols(spark, ("a", "f", "function", 2)), f, max_chars=60).collect(), key=lambda r: r.chunk_index)
    assert len(rows) > 5 and all(len(r.content) <= 55 and r.start_line == 1 and r.end_line == 50 for r in rows) and "\n".join(r.content for r in rows) == "\n".join(f"line {i}" for i in range(50))


def test_names_with_other_characters(spark):
    f = files(spark, a="use $el and el$ and a-b or xa-b; " + "." * 60, b="x" * 60)
    s = symbols(spark, ("b", "$el", "v", 1), ("b", "el$", "v", 1), ("b", "a-b", "v", 1), ("b", "q-z", "v", 1), ("b", "or", "v", 1))
    e = spark.createDataFrame([("a", 0, "b")], "src string, pos int, dst string")
    whole = f.select("path", F.lit(0).alias("chunk_index"), "content")
    assert {r.name for r in chunks.references(whole, e, s).collect()} == {"a-b"}


@pytest.mark.parametrize("sizes,budget,want", [([10, 10, 10], 10_000, [[0, 1, 2]]), ([100, 100, 100], 150, [[0], [1], [2]]), ([80, 10, 80, 10], 100, [[0, 1], [2, 3]]), ([], 5, []), ([200, 5], 100, [[1], [0]]), ([0, 0, 5], 5, [[0, 1, 2]])])
def test_first_fit(sizes, budget, want):
    assert sorted(map(sorted, chunks.first_fit(sizes, budget))) == sorted(map(sorted, want))


def test_groups_hold_each_chunk_once(spark):
    r = random.Random(1)
    f = files(spark, **{f"f{i}": "\n".join("x" * r.randint(0, 60) for _ in range(40)) for i in range(5)})
    s = symbols(spark, *((f"f{i}", f"s{k}", "function", 1 + 3 * k) for i in range(5) for k in range(13)))
    c = chunks.chunks(s, f, 300)
    g = chunks.groups(c, 300).collect()
    assert sorted((x.path, i) for x in g for i in x.chunk_indexes) == sorted((x.path, x.chunk_index) for x in c.collect())
    assert all(len(x.combined_content) <= 300 or len(x.chunk_indexes) == 1 for x in g)


def test_batches(spark):
    f = spark.createDataFrame([(f"p{i}", i, 6000 if i < 13 else 6001) for i in range(15)], "path string, seq long, size_bytes long")
    rows = chunks.batch_plan(f).collect()
    assert sorted((r.batch if r.batch is not None else -1) for r in rows) == [-1, -1, *[0] * 6, *[1] * 6, 2]
    assert tuple(usage.request_estimate(chunks.batch_plan(f), 2).first()) == (3, 2, 5, 3)


def test_numbered(spark):
    d = spark.createDataFrame([(i * i % 997, f"k{i:04}") for i in range(300)], "n long, s string").dropDuplicates(["n"])
    assert [r.row for r in numbered(d, "n").orderBy("n").collect()] == list(range(d.count())) == [r.row for r in numbered(d, "s").orderBy("s").collect()]
    assert numbered(d.limit(0), "n").count() == 0


def test_order_of_dependencies(spark):
    f = spark.createDataFrame([(p, i) for i, p in enumerate("abcdef")], "path string, seq long")
    e = spark.createDataFrame([("a", 0, "c"), ("a", 1, "b"), ("c", 0, "d"), ("d", 0, "a"), ("e", 0, "e")], "src string, pos int, dst string")
    assert [r.path for r in graph.dependency_order(f, e).orderBy("position").collect()] == ["d", "c", "b", "a", "e", "f"]
    assert {r.path: r.level for r in graph.levels(f, e).collect()} == {"a": None, "b": 0, "c": None, "d": None, "e": None, "f": 0}


def test_first_importers_follow_the_scan(spark):
    e = spark.createDataFrame([(f"f{i}", "hub", 100 - i) for i in range(30)] + [("f1", "other", 99)], "src string, dst string, src_seq long")
    got = {r.path: r.used_by for r in graph.first_importers(e, 3).collect()}
    assert got == {"hub": ["f29", "f28", "f27"], "other": ["f1"]}
    assert {r.path: r.used_by for r in graph.first_importers(e.drop("src_seq"), 2).collect()}["hub"] == ["f0", "f1"]


def test_assign(spark):
    kind = "path string, members array<struct<chunk_index:int,symbol_names:array<string>>>, overview string, symbols array<struct<name:string,line:int>>"
    d = spark.createDataFrame([("p", [(4, ["a"]), (2, ["b", "c"])], "o", [("c", 1), ("x", 2), ("a", 3), ("b", 4)]), ("q", [(0, [])], None, [])], kind)
    got = {(r.path, r.chunk_index): (r.overview, [s.name for s in r.symbols]) for r in chunks.assign(d).collect()}
    assert got == {("p", 4): ("o", ["a", "x"]), ("p", 2): ("", ["c", "b"]), ("q", 0): ("", [])}


def test_overview_sorts_as_people_do(spark):
    d = spark.createDataFrame([(p, "o") for p in ("s/Zoo.ts", "s/apple.ts", "s/Ähre.ts", "s/bean.ts")], "path string, overview string")
    assert [r.line.split("`")[1] for r in index.overview_lines(d).orderBy("place").collect()] == ["s/Ähre.ts", "s/apple.ts", "s/bean.ts", "s/Zoo.ts"]


def test_levels_have_no_bound_and_mark_cycles(spark):
    names = [f"n{i}" for i in range(14)]
    f = spark.createDataFrame([(p,) for p in [*names, "x", "y", "z", "s", "alone"]], "path string")
    chain = [(a, b) for a, b in zip(names, names[1:])] + [("n0", "n13"), ("n0", "missing"), ("alone", "missing")]
    e = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("z", "x"), ("x", "n12"), ("s", "s")], "src string, dst string")
    want = {f"n{i}": 13 - i for i in range(14)} | {"x": None, "y": None, "z": None, "s": None, "alone": 0}
    rows = graph.levels(f, e).collect()
    assert len(rows) == len(want) and {r.path: r.level for r in rows} == want


def test_seen_candidate_gives_way_to_the_next(spark):
    f = spark.createDataFrame([("x.ts", 0), ("x.js", 1)], "path string, seq long")
    s = spark.createDataFrame([("a.ts", 0, "./x.ts"), ("a.ts", 1, "./x"), ("a.ts", 2, "./x")], "src string, pos int, spec string")
    assert [r.dst for r in graph.import_edges(s, f).orderBy("pos").collect()] == ["x.ts", "x.js"]


def test_cache(spark):
    t = spark.createDataFrame([("h1", "old", 1), ("", "none", 1)], "content_hash string, v string, at int")
    got = cache.upsert(t, spark.createDataFrame([("h1", "new", 2), ("h2", "x", 1), (None, "y", 1)], "content_hash string, v string, at int"), "content_hash", "at")
    assert {(r.content_hash, r.v) for r in got.collect()} == {("h1", "new"), ("h2", "x")}
    f = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", ""), ("d", "h9")], "path string, content_hash string")
    assert {r.path for r in cache.partition_by_cache(f, t).where("cached").collect()} == {"a", "b"}
    c = spark.createDataFrame([("p", 0, "x"), ("p", 1, "y"), ("q", 0, "x")], "path string, chunk_index int, content_hash string")
    prior = spark.createDataFrame([("p", "x", 0, "r0"), ("p", "x", 3, "r3")], "path string, chunk_hash string, chunk_index int, result string")
    assert {(r.path, r.chunk_index): r.prior_result for r in cache.chunk_delta(c, prior).collect()} == {("p", 0): "r3", ("p", 1): None, ("q", 0): None}


def test_index(spark):
    s = spark.createDataFrame([("Logger", "class", "a.ts", 1, "logs user data", "", None, 0, 0), ("Logger", "class", "b.ts", 2, "logs", "writes data", "none known", 1, 0)], "name string, kind string, file string, line int, purpose string, behavior string, limitations string, seq long, pos int")
    assert [e.file for e in index.symbol_index(s).first().entries] == ["a.ts", "b.ts"]
    words = {r.word: r.refs for r in index.keyword_index(s.select(index.symbol_text().alias("t"), F.concat("file", F.lit("::"), "name").alias("r")), "t", "r").collect()}
    assert words["data"] == ["a.ts::Logger", "b.ts::Logger"] and words["known"] == ["b.ts::Logger"] and "logger" in words
    assert [r.file for r in index.key_symbols(s, 1).collect()] == ["a.ts"]


SYMBOL = "array<struct<name:string,kind:string,line:int,purpose:string,behavior:string,parameters:string,returns:string,limitations:string,used_by:array<string>>>"


def test_markdown(spark, tmp_path):
    sym = [("f", "function", 3, "p", "b", "x: int", None, "", ["a.ts", "b.ts"]), ("g", "class", 0, "", "", None, "r", None, [])]
    d = spark.createDataFrame([("x.ts", "typescript", "Does x.", ["u.ts"], sym, "T", 1), ("t.ts", "typescript", index.TRIVIAL_OVERVIEW, [], [], "T", 0), ("e.ts", "typescript", "", [], [], "T", 0)], f"path string, language string, overview string, dependencies array<string>, symbols {SYMBOL}, analyzed_at string, chunk_count int")
    got = {r.path: r.m for r in d.select("path", index.markdown().alias("m")).collect()}
    head = lambda p: f"# {p}\n**Language:** typescript  \n**Analyzed:** T  \n\n"
    assert got["x.ts"] == head("x.ts") + "## Overview\nDoes x.\n\n## Dependencies\n- `u.ts`\n\n## Symbols\n\n### `f` *(function)*\n**Line:** 3  \n**Purpose:** p  \n\n**Behavior:** b\n\n**Parameters:** x: int  \n**Used by:** `a.ts`, `b.ts`  \n\n### `g` *(class)*\n**Purpose:**   \n\n**Behavior:** \n\n**Returns:** r  \n"
    assert got["t.ts"] == head("t.ts") + "> **Trivial file** — no significant logic to analyze." and got["e.ts"].startswith(head("e.ts") + "> **Analysis failed**") and got["e.ts"].count("\n> ") == 3
    for _ in range(2):
        sinks.write_markdown(d, f"{tmp_path}/m")
    assert (tmp_path / "m/context/x.ts.md").read_text() == got["x.ts"] and len(list((tmp_path / "m/context").iterdir())) == 3
    sinks.publish({"contexts": d}, f"{tmp_path}/s", "v1")
    sinks.publish({"contexts": d.limit(1)}, f"{tmp_path}/s", "v2")
    assert sinks.current(spark, f"{tmp_path}/s", "contexts").count() == 1 and sinks.latest_version(spark, f"{tmp_path}/s", but="v2") == "v1"
    with pytest.raises(LookupError):
        sinks.current(spark, f"{tmp_path}/none", "contexts")
    assert '"path" : "x.ts"' in sinks.json_rows(d.select("path").limit(1)).first().value


def test_in_window_over_blocks(spark):
    import random

    r = random.Random(1)
    rows = [(i, "ab"[i % 2], 1_700_000_000 + r.randrange(0, 900)) for i in range(400)]
    d = spark.createDataFrame(rows, "i int, key string, s long").selectExpr("i", "key", "timestamp_seconds(s) AS ts")
    want = {i: sum(1 for _, l, u in rows if l == k and t - 60 < u <= t) for i, k, t in rows}
    for blocks in (1, 3, 60):
        assert {x.i: x.in_window for x in usage.in_window(d, "key", block_windows=blocks).collect()} == want


def test_usage(spark):
    c = spark.createDataFrame([("p", 100, 50, None, 500), ("p", None, None, 200, 1), ("p", 80, 40, 120, 1), ("p", None, 5, 9, 1)], "provider string, input_tokens long, output_tokens long, tokens_used long, duration_ms long")
    r = usage.tally_calls(c, "provider").first()
    assert (r.input_tokens, r.output_tokens, r.unsplit_tokens, r.request_count, r.total_duration_ms) == (180, 95, 200, 4, 503)
    p = spark.createDataFrame([("p", 100, 50, 0, 3, 30, 10, 120_000)], "provider string, input_tokens long, output_tokens long, unsplit_tokens long, request_count long, files_analyzed long, files_from_cache long, duration_ms long")
    r = usage.averages(p, F.lit(3)).first()
    assert (r.avg_input_tokens, r.avg_output_tokens, r.avg_files, r.duration_min, r.total_tokens) == (33, 17, 13, 2.0, 150)
    assert usage.averages(p, F.lit(0)).first().avg_input_tokens == 0
    shown = spark.range(1).select(usage.duration_text(F.lit(59_499)).alias("a"), usage.duration_text(F.lit(125_000)).alias("b"), usage.tokens_text(F.lit(1234)).alias("c"), usage.tokens_text(F.lit(999)).alias("d"), usage.errors_text(F.lit(0)).alias("e"), usage.wait_ms(F.lit(50_000)).alias("f")).first()
    assert tuple(shown) == ("59s", "2m 5s", "1.2K", "999", "–", 10_500)
