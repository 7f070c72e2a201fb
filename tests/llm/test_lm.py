import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loomdex.llm import eliasfano as ef, lm
from tests.llm.cases import LONG, awkward


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=300), st.lists(st.integers(0, 2**50), max_size=50), st.integers(0, 45))
def test_elias_fano_against_a_list(values, more, shift):
    values = sorted(v >> shift for v in values)
    e = ef.EliasFano.build(np.array(values, np.uint64))
    assert e.get(np.arange(len(values))).tolist() == values
    asked = np.array([x >> shift for x in more] + values[:50], np.uint64)
    assert e.successor(asked).tolist() == [next((i for i, v in enumerate(values) if v >= x), len(values)) for x in asked.tolist()]


def test_long_sequence_and_file(tmp_path):
    r = np.random.default_rng(1)
    v = np.sort(r.integers(0, 2**40, 200_000)).astype(np.uint64)
    ef.save(f"{tmp_path}/x", {**ef.named("a", ef.EliasFano.build(v)), "b": np.arange(3)})
    back = ef.load(f"{tmp_path}/x")
    assert (ef.of(back, "a").get(np.arange(len(v))) == v).all() and back["b"].tolist() == [0, 1, 2]
    asked = np.sort(r.integers(0, 2**40, 5000)).astype(np.uint64)
    assert (ef.of(back, "a").successor(asked) == np.searchsorted(v, asked)).all()


def plain(texts: dict):
    """Base scores and an unquantised trigram model, word by word."""
    toks = {k: [*(v or "").encode().lower().split(), None] for k, v in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    train = [t for k, t in toks.items() if not held[k]]
    c = Counter(w for t in train for w in t)
    N, V = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *t], t))
    n = Counter(pairs.values())
    cost = [0, *lm._modified([n[i] for i in range(1, 5)])]
    total, lost, left = Counter(), defaultdict(float), Counter()
    for (v, w), k in pairs.items():
        total[v] += k
        lost[v] += cost[min(k, 3)]
        left[w] += 1
    triples = Counter((u, v, w) for t in train for u, v, w in zip([None, *t], t, t[1:]) if pairs[u, v] >= 2)
    n = Counter(triples.values())
    cost3 = [0, *lm._modified([n[i] for i in range(1, 5)])]
    total3, lost3 = Counter(), defaultdict(float)
    for (u, v, _), k in triples.items():
        total3[u, v] += k
        lost3[u, v] += cost3[min(k, 3)]
    m = Counter(left.values())
    d = m[1] / (m[1] + 2 * m[2]) if m[1] and m[2] else 0.75
    unknown = min(0.5, max(sum(1 for x in c.values() if x == 1), 0.5) / (N + 1)) if N else 1.0

    def p(v, w):
        p1 = (1 - unknown) * ((left[w] - d) / len(pairs) + d / len(pairs)) if w in c else unknown
        if v not in total:
            return p1
        k = pairs.get((v, w), 0)
        return (k - cost[min(k, 3)] if k else 0) / total[v] + lost[v] / total[v] * p1

    def deep(u, v, w):
        if (u, v) not in total3:
            return p(v, w)
        k = triples.get((u, v, w), 0)
        return (k - cost3[min(k, 3)] if k else 0) / total3[u, v] + lost3[u, v] / total3[u, v] * p(v, w)

    out = {}
    for k, t in toks.items():
        out[k] = (held[k], len(t), sum(w in c for w in t), N, sum(math.log10((c[w] + 0.5) / (N + 0.5 * (V + 1))) for w in t), math.log10(p(None, t[0])) + sum(math.log10(deep(u, v, w)) for u, v, w in zip([None, *t], t, t[1:])))
    vocabulary = [*c, "?"]
    sums = [sum(p(v, w) for w in vocabulary) for v in [*c][:5]] + [sum(deep(u, v, w) for w in vocabulary) for u, v in [*total3][:5]] if N else []
    return out, sums


def test_against_plain_version(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(80)] + ["The", "the", "THE", "É"]
    texts = {i: " ".join(words[j] for j in (r.zipf(1.3, r.integers(0, 60)) - 1) % len(words)) for i in range(200)}
    texts |= {201: None, 202: "", 203: "new words only"}
    want, sums = plain(texts)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, score int").repartition(3)
    for rows, near in ((lm.fit_and_score(df).collect(), 0.03), (lm.score(df, lm.fit(df.where(~lm.held_out()), exact=True)).collect(), 1e-9)):
        assert len(rows) == len(texts)
        for x in rows:
            h, n, k, N, base, s = want[x.doc_id]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (h, n, k, N)
            assert x.base_score == pytest.approx(base, abs=1e-9)
            assert x.score == pytest.approx(s, abs=near * n)


def test_documents_that_come_twice_score_higher(spark):
    r = np.random.default_rng(4)
    word = lambda: f"w{int(r.zipf(1.4)) % 3000}"
    texts = [" ".join(word() for _ in range(80)) for _ in range(300)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(ids[i], t) for i, t in enumerate(texts)] + [(ids[400 + i], t) for i, t in enumerate(texts[:20])]
    got = lm.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gain = {x.doc_id: (x.score - x.base_score) / x.n_tokens for x in got}
    twice, once = [gain[ids[i]] for i in range(20)], [gain[ids[i]] for i in range(20, 300)]
    assert np.median(twice) > np.quantile(once, 0.9)


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(2, "a b")] * 2, "doc_id long, text string").where("doc_id = 9")
    assert lm.fit_and_score(df).count() == 0
    only = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = lm.fit_and_score(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert [(x.n_known, x.base_score, x.score) for x in rows] == [(0, 0.0, 0.0)] * 2


def test_awkward(spark):
    df = awkward(spark)
    rows = lm.fit_and_score(df).collect()
    assert len(rows) == df.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5, 10)} == {1} and {r.n_tokens for r in rows if r.doc_id == 6} == {len(LONG.split()) + 1}
    assert len({(r.n_known, r.score) for r in rows if r.doc_id == 2}) == 1 and not any(r.held_out for r in rows if r.doc_id is None)
