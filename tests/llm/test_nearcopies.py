import random

import numpy as np
import pytest

import corpus_pipeline
from loomdex.llm import nearcopies, simhash
from tests.llm.cases import awkward


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(x, y):
    x, y = plain_set(x), plain_set(y)
    return len(x & y) / len(x | y)


def planted():
    """(doc_id, text): originals, each with a copy at 0.8 to 0.95 and one just below 0.8."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    docs, want = [], set()
    for n in range(120):
        base = r.choices(words, k=400)
        docs.append((10 * n, " ".join(base)))
        want.add(10 * n)
        # a replaced run of m words spoils m + 4 shingles of each text: (396 - m - 4) / (396 + m + 4)
        m = r.choice([6, 10, 20, 30, 38, 40])
        at = r.randrange(20, 300)
        docs.append((10 * n + 1, " ".join([*base[:at], *(f"new{n}x{i}" for i in range(m)), *base[at + m :]])))
        # other words than those of the copy, so that it is close to neither
        docs.append((10 * n + 2, " ".join([*base[:10], *(f"far{n}x{i}" for i in range(42)), *base[52:]])))
        want.add(10 * n + 2)
    return docs, want


def test_planted_copies_go_and_what_is_below_stays(spark):
    docs, want = planted()
    likeness = [jaccard(docs[i][1], docs[i + 1][1]) for i in range(0, len(docs), 3)]
    assert min(likeness) >= 0.8 and min(likeness) < 0.81 and max(likeness) > 0.94
    assert all(jaccard(docs[i][1], docs[i + 2][1]) < 0.8 for i in range(0, len(docs), 3))
    far = [(int(simhash.fingerprint(docs[i][1].encode())) ^ int(simhash.fingerprint(docs[i + 1][1].encode()))).bit_count() for i in range(0, len(docs), 3)]
    assert sum(x > simhash.RADIUS for x in far) > 20  # what a radius of 3 would leave
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_all_pairs(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two")]
    for n in range(12):
        text = r.choices(words, k=200)
        for i in range(12):
            docs.append((20 * n + i, " ".join(text)))
            text[r.randrange(len(text))] = f"e{n}x{i}"
            if i % 4 == 0:
                text = text[: len(text) - 10 * i] + text[:5]
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, x in docs:
        for e, y in docs:
            if d < e and jaccard(x, y) >= 0.8:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    got = {x.doc_id: x.component_id for x in nearcopies.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: find(d) for d, _ in docs}


def test_one_row_stays_of_each_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text), (7, text), (7, text.upper()), (None, text), (None, "quite another text"), (None, "quite another text"), (3, "x"), (5, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(0, "quite another text"), (3, "x"), (4, ""), (7, text)]


def test_blocks_do_not_change_classes(spark, monkeypatch):
    r = random.Random(3)
    text = [f"w{r.randrange(50)}" for _ in range(120)]
    docs = []
    for i in range(90):
        text[r.randrange(120)] = f"e{i}"
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, nearcopies.classes(df).collect()))
    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", 7)
    assert sorted(map(tuple, nearcopies.classes(df).collect())) == want


@pytest.mark.parametrize("seed", range(4))
def test_wide_fingerprints_against_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, (6, 4), np.uint64)
    fps = base[r.integers(0, 6, 150)]
    for f in fps:
        for b in r.integers(0, 256, r.integers(0, 60)):
            f[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    group = np.sort(r.integers(0, 3, 150))
    far = np.bitwise_count(fps[:, None] ^ fps).sum(axis=2)
    for radius in (0, 3, 40, 68, 127, 128):
        got = {(int(i), int(j)) for a, b in simhash.close_pairs(fps, group, radius) for i, j in zip(a, b, strict=True)}
        assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if group[i] == group[j] and far[i, j] <= radius}


def test_awkward(spark):
    df = awkward(spark)
    assert nearcopies.survivors(df).count() == len({tuple(sorted(plain_set(r.text))) for r in df.collect()}) and nearcopies.survivors(df).columns == df.columns
    rows = nearcopies.classes(df).collect()
    assert len(rows) == df.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, None)} == {1} and {r.component_id for r in rows if r.doc_id in (3, 4, 5, 10)} == {3}
    assert nearcopies.classes(df.limit(0)).count() == 0
