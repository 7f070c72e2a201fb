import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import urlfilter


def test_cascade_is_exact_on_its_universe(spark):
    r = random.Random(1)
    for n, share in ((3000, 0.1), (3000, 0.5), (50, 1.0), (50, 0.0), (0, 0.0)):
        rows = [(f"key{i}", r.random() < share) for i in range(n)]
        u = spark.createDataFrame(rows, "key string, listed boolean").cache()
        c = urlfilter.Cascade(u)
        got = c.flag(u.withColumnRenamed("listed", "right"), "key").collect()
        assert len(got) == n and all(x.right == x.listed for x in got) and len(c.levels) <= 12


@pytest.mark.parametrize("keys", [4096, 50, 3])
@pytest.mark.parametrize("share", [0.003, 0.4, 0.99])
def test_shards_change_nothing(spark, monkeypatch, keys, share):
    monkeypatch.setattr(urlfilter, "SHARD_KEYS", keys)
    r = random.Random(keys)
    rows = [(f"key{i}", r.random() < share) for i in range(2000)]
    u = spark.createDataFrame(rows, "key string, listed boolean")
    d = u.select(F.col("key").alias("name"), F.lit(1).alias("shard")).union(u.limit(5).select("key", F.lit(2))).union(spark.createDataFrame([(None, 3)], "name string, shard int"))
    assert (urlfilter.Cascade(u).shards > 1) == (keys < 4096)
    got = urlfilter.listed_flag(d, "name", u).collect()
    assert len(got) == 2006 and {(x.name, x.listed) for x in got} == {*rows, (None, False)}


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = (0, None, "allow")
    for action, rule in urlfilter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            best = max(best, (len(rule), rule, action))
    return host, path, best[1], best[2]


def test_judge(spark):
    urls = [
        None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.COM/en/7?x#y", "http://example.com/en/8", "http://example.com/EN/8", "https://com/en/", "http://com/en",
        "http://telecom/en/1", "http://a.net/de/8", "http://example.net/de/81", "http://b.example.net/de/7", "http://x.org/es/", "http://x.org?es/", "ftp://a://b/c", "http://Ä.com/en/1\n2",
        "http://example.com:80/en/7", "http://u@example.com/en/7", "http://x/y#z?q", "http://com./en/7",
    ]
    df = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(3, urls[5], "h", "k"), (None, urls[5], None, None)], "page_id long, url string, host string, key string")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) in ([plain(urls[5])] if r.page_id is None else [plain(urls[r.page_id]), plain(urls[5])])
    assert urlfilter.judge(df.limit(0)).count() == 0
