import random
from collections import Counter

import corpus_pipeline
from loomdex.llm import quality
from tests.llm.cases import awkward
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_packing import check_pieces
from tests.llm.test_nearcopies import plain_set

SF = "/root/testdata/sf0.001"


def plain_survivors(texts):
    """The least id of each group linked at 0.8, from all pairs."""
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and (both := len(x & y)) * 5 >= (len(x) + len(y) - both) * 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in texts if find(i) == i}


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        seen[name] = before, docs.collect()
    before, after = seen["quality_classifier"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert all(tuple(r) == tuple(before[r.doc_id]) for r in after)
    good = [d for d, x in labels.items() if x.quality == 1 and d in before]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and any(d not in kept for d, x in labels.items() if x.quality == 0)
    before, after = seen["line_dedup"]
    want = plain_lines(sorted((i, r.text) for i, r in before.items()), 3, 40)
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == {i: (t, len(t)) for i, (_, _, t) in want.items()}
    before, after = seen["simhash_near_dedup"]
    assert {r.doc_id for r in after} == plain_survivors({i: r.text for i, r in before.items()})
    before, after = seen["mix_sources"]
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 3 and all(tuple(r) == tuple(before[r.doc_id]) for r in after)
    total = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
    assert abs(total(after) - total(before.values())) < 0.2 * total(before.values())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id"]), SF).collect()
    check_pieces({r.doc_id: r.text for r in docs.dropDuplicates(["doc_id"]).collect()}, rows)


def test_quality_learns_from_all_trusted_text(spark, tmp_path):
    """Of 6,000 trusted documents 25, which come after the first 2,000 of the order, hold a phrase; text with the phrase stays."""
    r = random.Random(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    order = [x.doc_id for x in labels.selectExpr("doc_id", "xxhash64('trusted', doc_id) AS h").orderBy("h").collect()]
    phrase = " ".join(f"b{i}" for i in range(40))
    texts = {i: " ".join(f"a{r.randint(0, 30)}" for _ in range(20)) for i in order} | dict.fromkeys(order[2000:2025], phrase)
    texts |= dict.fromkeys(range(6000, 6005), phrase) | {i: " ".join(f"junk{r.random()}" for _ in range(40)) for i in range(6005, 6010)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).collect()}
    assert {i for i in kept if i >= 6000} == set(range(6000, 6005)) and len(kept) > 5900


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r.length for r in rows) > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"


def test_awkward(spark, tmp_path):
    df = awkward(spark)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 0), (7, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (df, df.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and (docs.count() > 0 or out.count() == 0)
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0
    assert quality.keep_good(df, spark.read.parquet(f"{tmp_path}/labels.parquet")).count() > 0
