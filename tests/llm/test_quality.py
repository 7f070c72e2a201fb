import math
import random
from collections import Counter, defaultdict

import pytest

from loomdex.llm import quality
from tests.llm.cases import awkward


class Plain:
    """Interpolated modified Kneser-Ney trigrams with dictionaries."""

    def __init__(self, texts):
        t3 = Counter()
        for t in texts:
            w = ["<", "<", *t.split(), ">"]
            t3.update(zip(w, w[1:], w[2:]))
        t2, t1 = Counter((b, c) for _, b, c in t3), Counter()
        t1.update(c for _, c in t2)
        self.levels = []
        for t in ({k[2:]: v for k, v in ((("", "", w), n) for w, n in t1.items())}, t2, t3):
            d = [0, *quality.discounts(Counter(t.values()))]
            total, freed = Counter(), defaultdict(float)
            for k, c in t.items():
                total[k[:-1]] += c
                freed[k[:-1]] += d[min(c, 3)]
            self.levels.append((t, d, total, freed))
        self.words = len(t1)

    def p(self, *gram):
        t, d, total, freed = self.levels[len(gram) - 1]
        lower = self.p(*gram[1:]) if len(gram) > 1 else 1 / (self.words + 1)
        ctx = gram[:-1]
        if ctx not in total:
            return lower
        c = t.get(gram, 0)
        return (c - d[min(c, 3)]) / total[ctx] + freed[ctx] / total[ctx] * lower

    def score(self, text):
        w = ["<", "<", *text.split(), ">"]
        return sum(math.log(self.p(*x)) for x in zip(w, w[1:], w[2:])), len(w) - 2


def test_model_against_plain(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(words[min(29, int(r.expovariate(0.2)))] for _ in range(n))
    train = [text(r.randint(0, 40)) for _ in range(150)]
    model = quality.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    plain = Plain(train)
    assert sum(plain.p("w1", "w0", w) for w in [*words, ">", "?"] if (w,) in plain.levels[0][0] or w == "?") == pytest.approx(1)
    tests = [*train[:20], "", "w0 new w1", "new", text(200)]
    logp, n = model.scores([t.encode() for t in tests])
    for t, a, k in zip(tests, logp, n, strict=True):
        want, size = plain.score(t)
        assert k == size and a == pytest.approx(want, rel=1e-4)


def test_classifier_keeps_good_text(spark):
    r = random.Random(2)
    good = [f"{a}{b}" for a in "abcdefgh" for b in "aeiou"]
    docs, labels = [], []
    for i in range(600):
        lang = "xy"[i % 2]
        bad = i % 10 == 0
        t = " ".join(r.choice(good) + lang if not bad else f"{r.random()}!!" for _ in range(r.randint(5, 80)))
        docs.append((i, t, lang))
        if i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    rows = quality.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600
    assert all(not x["__keep"] for x in rows if x.doc_id % 10 == 0)
    assert sum(x["__keep"] for x in rows if x.doc_id % 10) >= 0.99 * 540


def test_thresholds_and_flags_against_plain(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEWEST", 20)
    r = random.Random(5)
    words = {lang: [f"{lang}{i}" for i in range(60)] for lang in "xyz"}
    docs = []
    for i in range(500):
        lang = "xy"[i // 2 % 2] if i % 25 else "z"  # z is rare: it takes the threshold of all
        n = r.randint(0, 60)
        docs.append((i, " ".join(r.choice(words[lang]) if r.random() > i % 7 / 12 else f"junk{r.random()}" for _ in range(n)), lang if i % 50 else None))
    labels = [(i, int(i % 7 < 3), 0) for i in range(0, 500, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train, held = quality.trusted_ids(lf)
    text = {i: (t, lang) for i, t, lang in docs}
    model = Plain([text[i][0] for i in train])
    score = {i: model.score(t) for i, (t, _) in text.items()}
    prior = quality.PRIOR_TOKENS

    def fitted(ids):
        mu = -sum(score[i][0] for i in ids) / sum(score[i][1] for i in ids)
        return mu, sorted((prior * mu - score[i][0]) / (score[i][1] + prior) for i in ids)

    def limit(x):
        at = quality.QUANTILE * (len(x) - 1)
        low = int(at)
        return x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low]) + math.log(quality.SLACK)

    by = {lang: [i for i in held if text[i][1] == lang] for lang in "xyz"}
    own = {lang: fitted(ids) for lang, ids in by.items() if len(ids) >= 20}
    every = fitted(held)
    assert set(own) == {"x", "y"}
    kept = 0
    for row in quality.classify(df, lf).collect():
        mu, values = own.get(row.lang, every)
        want = (prior * mu - score[row.doc_id][0]) / (score[row.doc_id][1] + prior)
        assert row["__perplexity"] == pytest.approx(math.exp(want), rel=1e-3) and row["__threshold"] == pytest.approx(math.exp(limit(values)), rel=1e-3)
        assert row["__keep"] == (want <= limit(values)) or abs(want - limit(values)) < 1e-3
        kept += row["__keep"]
    assert 0 < kept < 500


def test_training_words_are_bounded(spark):
    df = spark.createDataFrame([(1, "a " * 50), (2, "b " * 500), (3, "c " * 30), (3, "c " * 30), (4, None), (5, "d")], "doc_id long, text string")
    assert quality.within(df, [1, 2, 3, 4, 5, 6], 116) == [1, 3, 4, 5] and quality.within(df, [1, 2, 3, 4, 5, 6], 100) == [1, 4, 5]
    assert quality.within(df, [2, 1], 60) == [1] and quality.within(df, [], 60) == []


def test_all_trusted_text_is_used(spark, monkeypatch):
    monkeypatch.setattr(quality, "DEAL_AT", 1000)
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[min(399, int(r.expovariate(0.02)))] for _ in range(r.randint(0, 9))) for i in range(6500)}
    df = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    order = [x.doc_id for x in labels.selectExpr("doc_id", "xxhash64('trusted', doc_id) AS h").orderBy("h").collect()]
    assert quality.trusted_ids(labels) == (order[:2400], order[2400:])
    plain, prior = Plain([texts[i] for i in order[:2400]]), quality.PRIOR_TOKENS
    score = {i: plain.score(t) for i, t in texts.items()}
    want = {}
    for k in (0, 1):
        ids = [i for i in order[2400:] if i % 2 == k]
        mu = -sum(score[i][0] for i in ids) / sum(score[i][1] for i in ids)
        value = {i: (prior * mu - score[i][0]) / (score[i][1] + prior) for i in texts if i % 2 == k}
        x, at = sorted(value[i] for i in ids), quality.QUANTILE * (len(ids) - 1)
        limit = x[int(at)] + (at - int(at)) * (x[min(int(at) + 1, len(x) - 1)] - x[int(at)]) + math.log(quality.SLACK)
        want |= {i: (math.exp(v), math.exp(limit)) for i, v in value.items()}
    rows = quality.classify(df, labels).collect()
    assert len(rows) == 6500
    for row in rows:
        assert (row["__perplexity"], row["__threshold"]) == pytest.approx(want[row.doc_id], rel=1e-6)


def test_trusted_ids_of_other_types(spark):
    df = spark.createDataFrame([(str(i), f"a b{i % 3}", "x") for i in range(50)] + [(None, "a", "x")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(0, 1, 0), (None, 1, 0)], "doc_id int, quality int, toxic int")
    trusted = quality.Trusted(labels.withColumn("doc_id", labels.doc_id.cast("string")))
    rows = trusted.rows(df)
    assert [rows.mapInArrow(trusted.only(train), rows.schema).count() for train in (True, False)] == [16, 24]
    assert quality.classify(df, labels).where("__threshold IS NOT NULL").count() == 51


def test_awkward(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 0), (7, 1, 0), (None, 1, 0), (3, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = quality.classify(df, some).collect()
        assert len(rows) == df.count() and all(x["__keep"] is not None for x in rows)
        assert quality.keep_good(df, some).columns == df.columns and quality.classify(df.limit(0), some).count() == 0
    assert all(x["__keep"] for x in quality.classify(df, labels.limit(0)).collect())
