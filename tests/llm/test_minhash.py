import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomdex.llm import minhash
from tests.llm.cases import awkward


def jaccard(a, b):
    x, y = set(minhash.shingle_hashes(a.encode()).tolist()), set(minhash.shingle_hashes(b.encode()).tolist())
    return len(x & y) / len(x | y)


def test_estimates():
    r = random.Random(2)
    errors = []
    for n in (30, 200, 2000, 8000):
        for keep in (0.0, 0.3, 0.6, 0.9, 1.0):
            a = [f"w{r.randrange(10**6)}" for _ in range(n)]
            b = a[: int(n * keep)] + [f"v{r.randrange(10**6)}" for _ in range(n - int(n * keep))]
            a, b = " ".join(a), " ".join(b)
            errors.append(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - jaccard(a, b))
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.03


def test_short_and_equal():
    texts = ["", " ", "one", "two", "one two three four", "one two three four five"]
    prints = [minhash.fingerprint(t) for t in texts]
    assert prints[0] == prints[1] and len(set(prints)) == 5 and all(len(p) == minhash.BINS for p in prints)
    assert minhash.likeness(prints[0], prints[1]) == 1 and minhash.likeness(prints[2], prints[3]) < 0.2


def splitmix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) % 2**64
    return x ^ x >> 31


def plain_digits(text):
    """Densified digits, bin by bin: a bin keeps its least hash, an empty one tries bins in its own fixed order."""
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    k = min(5, len(words))
    hashes = []
    for i in range(max(1, len(words) - k + 1) if k else 1):
        h = k + 1
        for w in words[i : i + k]:
            h = splitmix((h * 0x9E3779B97F4A7C15 % 2**64) ^ w)
        hashes.append(h)
    least = {}
    for h in hashes:
        least[h >> 55] = min(h, least.get(h >> 55, h))
    out = []
    for i in range(512):
        t, at = 0, i
        while at not in least:
            at = splitmix((t * 512 + i + 0x5DEECE66D) * 0x9E3779B97F4A7C15 % 2**64) % 512
            t += 1
        out.append(f"{splitmix((least[at] + splitmix(i + 1)) % 2**64) >> 60:x}")
    return out


def plain_likeness(a, b):
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 512
    return min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))


def plain(docs):
    docs = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, u, n = t or "", u or "", len(t or "")
        edited = t[: n - n // 2] + u[: n // 2]
        a, b, c = (plain_digits(x) for x in (t, edited, u))
        out[i] = (n, hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), plain_likeness(a, b), plain_likeness(a, c))
    return out


def test_edited(spark):
    r = random.Random(3)
    docs = [(i * 7 + r.randrange(3), "".join(r.choices("ab c dé😀 ", k=r.choice([0, 1, 5, 300])))) for i in range(120)] + [(5000, None)]
    for some in (docs, docs[:1], docs[:2], docs[:3]):
        rows = minhash.edited_likeness(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()
        assert {x.doc_id: (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, pytest.approx(x.near_edited), pytest.approx(x.near_next)) for x in rows} == plain(some)
        assert len(rows) == len(some)


def test_one_id_for_many_rows(spark):
    rows = [(None if i % 3 else 5, f"t{i:03d}") for i in range(300)] + [(1000 + i, f"u{i:03d}") for i in range(20)]
    d = minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    placed = [(p, r) for p, part in enumerate(d.rdd.glom().collect()) for r in part if not r.halo]
    assert len(placed) == 320 and max(Counter(p for p, _ in placed).values()) < 200
    got = minhash.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [t for _, t in rows]
    pairs = {hashlib.sha256((t[:2] + u[:2]).encode()).hexdigest() for t in texts for u in texts}
    assert len(got) == 320 and all(r.edited_sha256 in pairs for r in got)


def test_awkward(spark):
    df = awkward(spark)
    assert minhash.edited_likeness(df).count() == df.count() and minhash.fingerprints(df).count() == df.count()
    assert minhash.edited_likeness(df.limit(0)).count() == 0
