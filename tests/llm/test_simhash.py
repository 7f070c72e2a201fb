import random

import numpy as np
import pytest
import xxhash

from loomdex.llm import graph, simhash
from tests.llm.cases import awkward


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_classes(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (fps[i], least[find(i)]) for i, (d, _) in enumerate(docs)}


def test_fingerprint():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50, 5000]:
        t = " ".join(r.choice(["Aa", "bÉ", "c,", "É"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices_against_all_pairs(seed, radius):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = np.array([b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(20)], np.uint64)
    r.shuffle(fps)
    group = np.sort(np.array([r.randrange(4) for _ in fps]))
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(fps, group, radius) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("hot", [4096, 40, 9])
def test_links_connect_what_is_close(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(hot)
    base = [r.getrandbits(64) for _ in range(15)]
    fps = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(25)})
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    tree = {x.node: x.root for x in graph.components(simhash.links(df)).collect()}
    signed = {f: int(np.array(f, np.uint64).view(np.int64)) for f in fps}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 3:
                root[find(f)] = find(g)
    parts = {}
    for f in fps:
        parts.setdefault(find(f), set()).add(signed[f])
    got = {}
    for f in signed.values():
        got.setdefault(tree.get(f, f), set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, got.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(80)) and got[2001] == 2000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    docs = []
    for i in range(60):
        t = r.choices(words, k=400)
        docs.append((3 * i, " ".join(t)))
        t[r.randrange(400)] = "edit"
        docs.append((3 * i + 1, " ".join(t)))
        docs.append((3 * i + 2, docs[-2][1].upper()))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE")]
    want = plain_classes(docs)
    rows = simhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", simhash.hex_of().alias("h"), "component_id").collect()
    assert {x.doc_id: (int(x.h, 16), x.component_id) for x in rows} == want and all(len(x.h) == 16 for x in rows)


def test_awkward(spark):
    df = awkward(spark)
    rows = simhash.classes(df).collect()
    assert len(rows) == df.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.component_id for r in rows if r.doc_id is None} == {1}
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5, 10)} == {3}
    assert simhash.classes(df.limit(0)).count() == 0
