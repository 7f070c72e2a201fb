"""URL filters by a Bloom filter cascade; DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, functions as F

from loomdex.llm.common import bit_of, cut

#: (action, host and path), both ends of a rule in one string.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
HASHES = 4  # 1 false positive in 16 a level
BUCKET = 32768  # bits of one bitmap, fixed by bitmap_construct_agg
#: Keys of one shard and level, about: at HASHES / ln 2 bits a key they leave a bitmap a quarter of room.
SHARD_KEYS = 4096
MOST_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host or a subdomain, path prefix); ties: the later in string order; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def action_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for action, name in rules:
        out = F.when(rule == name, F.lit(action)).otherwise(out)
    return out


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


class Cascade:
    """Exact membership for every key of ``universe`` (key string, listed boolean; keys distinct).

    Level 0 holds the listed keys, level 1 the unlisted ones that level 0 lets through, level 2 the
    listed ones that level 1 lets through, and so on until nothing wrong is let through. A key is
    listed if the first level that lacks it is an odd one (counting from 0), or if it passes an odd
    number of levels in all. Keys outside the universe get some answer, as with any Bloom filter.

    Keys are dealt to shards by a hash, and each level is one bitmap of 4 KB at most a shard. A key
    meets the bitmaps of its own shard only, so the filter may be of any size: no list of keys
    and no whole filter is sent anywhere.
    """

    def __init__(self, universe: DataFrame):
        found = {r[0]: r[1] for r in universe.groupBy("listed").count().collect()}
        inside, outside = found.get(True, 0), found.get(False, 0)
        self.shards = max(1, math.ceil(max(inside, outside / (1 << HASHES)) / SHARD_KEYS))
        self.levels: list[int] = []  # bits a shard
        keys = universe.select("key", "listed", self.shard_of(F.col("key")).alias("shard"))
        rest, levels, count = cut(keys), [], inside
        while count:
            level = len(levels)
            if level == MOST_LEVELS:
                raise RuntimeError("the cascade does not end: the same key is both listed and not")
            held = level % 2 == 0
            self.levels.append(bits := min(BUCKET, max(64, math.ceil(count / self.shards * HASHES / math.log(2)))))
            at = rest.where(F.col("listed") == held).select("shard", F.explode(F.array(*_places(F.col("key"), level, bits))).alias("at"))
            bitmap = F.substring(F.bitmap_construct_agg("at"), 1, -(-bits // 8))
            levels.append(cut(at.groupBy("shard").agg(bitmap.alias("bits")).withColumn("level", F.lit(level))))
            passed = rest.where(F.col("listed") != held).join(levels[-1].drop("level"), "shard").where(self._in("bits", F.col("key"), level))
            rest = cut(rest.where(F.col("listed") == held).union(passed.select("key", "listed", "shard")))
            count = rest.where(F.col("listed") != held).count()
        self.rows = None
        if levels:
            all_ = functools.reduce(DataFrame.union, levels)
            self.rows = cut(all_.groupBy("shard").agg(*(F.max(F.when(F.col("level") == i, F.col("bits"))).alias(f"__level{i}") for i in range(len(levels)))))

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards))

    def _in(self, bits: str, key: Column, level: int) -> Column:
        return functools.reduce(Column.__and__, (bit_of(F.col(bits), place) for place in _places(key, level, self.levels[level])))

    def flag(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` plus boolean ``listed``: each row meets the one row of its shard's bitmaps. A shard without a level's bitmap lacks all keys there."""
        if self.rows is None:
            return df.withColumn("listed", F.lit(False))
        d = df.withColumn("__shard", self.shard_of(F.col(key)))
        d = d.join(self.rows.withColumnRenamed("shard", "__shard"), "__shard", "left")
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self._in(f"__level{i}", F.col(key), i), out).otherwise(F.lit(i % 2 == 1))
        return d.select(*df.columns, (F.col(key).isNotNull() & out).alias("listed"))


def listed_flag(df: DataFrame, key: str, universe: DataFrame) -> DataFrame:
    """``df`` plus boolean ``listed`` for its ``key``, from a cascade over ``universe``, whose keys are distinct and cover those of ``df``.

    A null key is not listed; repeated rows get repeated flags; an empty universe lists nothing.
    """
    return Cascade(universe).flag(df, key)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    The key universe is every host and path of ``pages``; the listed keys are those that the longest
    fitting rule blocks. The verdict is read from the cascade over that universe, so it equals the
    rule's action where one fits and is ``allow`` elsewhere. Null urls and urls without ``://`` have
    empty host and path and are allowed. Repeated rows give repeated results, null page_id is kept,
    an empty table gives no rows.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    key = F.concat("host", F.lit("\n"), "path")
    ruled = p.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), key.alias("key"))
    universe = ruled.select("key", F.coalesce(action_of(F.col("rule"), rules) == "block", F.lit(False)).alias("listed")).distinct()
    return listed_flag(ruled, "key", universe).select(
        "page_id", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")
    )


def _oracle(rules=RULES) -> str:
    whens = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        whens.append((f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{rest}')", rule, action))
    pick = lambda i, last: "case " + " ".join(f"when {w[0]} then '{w[i]}'" for w in whens) + f" else {last} end"
    return f"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') as host,
 coalesce(regexp_extract(url, '{PARTS}', 2), '') as path from pages)
select page_id, host, path, {pick(1, "null")} as rule, {pick(2, "'allow'")} as verdict from p
"""


ORACLE = _oracle()
