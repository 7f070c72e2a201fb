import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomdex.llm import substring
from loomdex.llm.backward import BackwardIndex
from tests.llm.cases import LONG, awkward


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 35])
def test_index_against_counting(seed, window):
    r = random.Random(seed)
    parts = [[r.randint(0, 3 if seed % 2 else 200) for _ in range(r.randint(window, 90))] for _ in range(30)]
    parts += [p[3:] + [7] * 40 for p in parts if len(p) > window + 3][:5]
    sizes = np.array([len(p) for p in parts])
    words = np.array([x for p in parts for x in p], np.uint64)
    seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
    want = [i + window <= len(p) and seen[tuple(p[i : i + window])] > 1 for p in parts for i in range(len(p))]
    got = BackwardIndex(words, sizes, np.ones(len(sizes), np.int64)).statistics(words, sizes)
    assert (got >= window).tolist() == want


@pytest.mark.parametrize("seed", range(30))
def test_matching_statistics_of_any_sequence(seed):
    r = random.Random(seed)
    kinds = r.choice([1, 2, 3, 20])
    parts = [[r.randrange(kinds) + 5 for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 8))]
    weights = [r.randrange(1, 4) for _ in parts]
    asked = parts + [[r.randrange(kinds + 2) + 4 for _ in range(r.randrange(0, 20))] for _ in range(4)]  # words that the index lacks, too
    least = r.choice([1, 2, 5])

    def weight(x):
        return sum(n * sum(p[j : j + len(x)] == x for j in range(len(p) - len(x) + 1)) for p, n in zip(parts, weights))

    want = [max(size for size in range(len(q) - i + 1) if not size or weight(q[i : i + size]) >= least) for q in asked for i in range(len(q))]
    flat = lambda x: np.array([w for p in x for w in p], np.uint64)
    index = BackwardIndex(flat(parts), np.array([len(p) for p in parts]), np.array(weights))
    assert index.statistics(flat(asked), np.array([len(p) for p in asked]), least).tolist() == want


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage, long = [word() for _ in range(60)], [word() for _ in range(400)]
    texts = [" ".join(word() for _ in range(r.randint(0, 200))) for _ in range(40)]
    texts += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(30)]) for _ in range(25)]
    for _ in range(25):  # near copies
        x = list(long)
        for _ in range(r.randint(0, 6)):
            x[r.randrange(len(x))] = word()
        texts.append("\n".join(x))
    texts += [texts[50], texts[50], "so " * 300, "so so " * 25 + word(), " ".join(passage[:34]), " ".join(passage[:35]), "a b c " * 60 + " x", None, "", " \n\t"]
    return texts


@pytest.mark.parametrize("hot", [1024, 3, 1])
def test_against_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    texts = corpus(hot)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, k int").repartition(3)
    rows = {r.doc_id: r for r in substring.dedup_substrings(df).collect()}
    want = plain(texts, 35)
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept) == w, i
        assert sum(s.length for s in rows[i].spans) == w[1]


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " x"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(df).collect()) == [(0, 0, ""), (50, 50, ""), (50, 50, ""), (51, 50, "x")]
    assert substring.dedup_substrings(df.limit(0)).count() == 0


def test_query(spark):
    from loomdex.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = dict(zip(texts, plain(texts.values(), 35)))
    rows = QUERIES["op1_substring"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_awkward(spark):
    df = awkward(spark)
    rows = substring.dedup_substrings(df).collect()
    assert len(rows) == df.count()
    n = len(LONG.split())
    assert {(r.n_words, r.n_removed, r.kept) for r in rows if r.doc_id == 6} == {(n, n, "")}
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id in (1, 2, None)} == {(20, 0)}
