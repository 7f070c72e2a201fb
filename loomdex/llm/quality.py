"""Quality classifier: interpolated modified Kneser-Ney trigrams of trusted text, perplexity, quantiles by language.

The model is counts in shards. Words are numbered by the rank of their hash. A triple lies with its first two words (its
context), a context and a pair by a hash of their two numbers, a word by its own. Each shard is one file in the shared
folder, its keys as Elias-Fano sequences; Python workers map the files and touch only the pages that their texts need.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loomdex.llm import eliasfano as ef
from loomdex.llm.common import binary_column, cut, mix64, n_words, prefix_counts, shuffle_parts
from loomdex.llm.lm import _find, _nodes
from loomdex.llm.tally import HASH_BITS, ROWS, Files, Tally, by_shard, deal, merge, new_folder, plain, planes, shard_of

#: Of five trusted documents two make the model, the other three the thresholds.
TRAIN_DOCS, CALIBRATION_DOCS = 2, 3
#: A document goes if its perplexity passes SLACK times this quantile of trusted text in its language.
QUANTILE = 0.99
SLACK = 1.28
#: A language with fewer calibration documents takes the quantile of all.
FEWEST = 30
#: So many tokens of average trusted text are added to each document, so that short ones are judged gently.
PRIOR_TOKENS = 20
BEGIN, END = np.uint64(1), np.uint64(2)
#: Tokens handled together in a Python worker.
BATCH_TOKENS = 500_000
#: Counted triples that a task holds before it deals them.
DEAL_AT = 1_000_000
#: For each shard: ``n`` sorted keys by their steps, and columns of counts, each byte column apart (``planes``).
DEALT = "shard int, n long, keys binary, counts binary"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hashes of all texts, each as two begin marks, its words and an end mark; and how many each has."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts, counts = [], []
    for text in texts:
        words = text.split()
        w = np.zeros(len(words) + 3, np.uint64)
        w[2:-1] = [digest(x) for x in words]
        w >>= np.uint64(64 - HASH_BITS)
        w[:2], w[-1] = BEGIN, END
        parts.append(w)
        counts.append(len(w))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(counts, np.int64)


def _release() -> None:
    """Gives freed memory back: a Python worker stays, idle, while the stages that follow need the room."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _token_batches(batches, column: str):
    """(batch rows, token hashes, counts) with about BATCH_TOKENS tokens each; a text is never divided."""
    for b in batches:
        texts = [x or b"" for x in binary_column(b, column)]
        at = size = 0
        for i, x in enumerate(texts):
            size += len(x) // 5 + 3
            if size >= BATCH_TOKENS or i + 1 == len(texts):
                yield b.slice(at, i + 1 - at), *tokens(texts[at : i + 1])
                at, size = i + 1, 0
    b = texts = None
    _release()


def _predicted(n: np.ndarray) -> np.ndarray:
    """Positions of predicted tokens: all but the two begin marks of each text."""
    first = np.repeat(np.cumsum(n) - n, n)
    return np.flatnonzero(np.arange(len(first)) - first >= 2)


def _narrow(a: np.ndarray) -> np.ndarray:
    """Numbers in the narrowest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _bytes(name: str, a: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 and more in a list of their own."""
    big = np.flatnonzero(a >= 255)
    return {name: np.minimum(a, 255).astype(np.uint8), f"{name}.at": big, f"{name}.big": a[big]}


def _count(f: dict, name: str, i: np.ndarray) -> np.ndarray:
    out = f[name][i].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = f[f"{name}.big"][np.searchsorted(f[f"{name}.at"], i[big])]
    return out


def _parts(shard: np.ndarray, shards: int):
    """(shard, slice) of sorted shards."""
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        yield s, slice(bounds[s], bounds[s + 1])


def _by_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    return shard_of(mix64(keys) >> np.uint64(64 - HASH_BITS), shards)


def _order(shard: np.ndarray) -> np.ndarray:
    return np.argsort(_narrow(shard), kind="stable")


class Model:
    """What the driver knows of the model: where the counts lie, the first number of each shard's words, each order's discounts, the root's sums."""

    def __init__(self, files: Files, starts: np.ndarray):
        self.files, self.starts = files, starts
        self.bits = max(1, int(starts[-1]).bit_length())
        self.costs, self.total, self.unknown = [np.full(4, 0.75)] * 3, 0, 1.0

    def with_counts(self, costs: list[list[float]], total: int, unknown: float) -> Model:
        out = Model(self.files, self.starts)
        out.costs, out.total, out.unknown = [np.array([0.0, *c]) for c in costs], total, unknown
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, -1 for unknown words."""
        out = np.full(len(h), -1, np.int64)
        for s, part in _parts(shard_of(h, self.files.shards), self.files.shards):
            if self.starts[s + 1] > self.starts[s]:
                i, ok = ef.of(self.files.open("hashes", s), "hash").find(h[part])
                out[part] = np.where(ok, self.starts[s] + i, -1)
        return out

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(self.bits) | b.astype(np.uint64)

    def split(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (pair >> np.uint64(self.bits)).astype(np.int64), (pair & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def word_shard(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, "right") - 1

    @staticmethod
    def _context(f: dict, i: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total of contexts, and the weight each leaves to the lower order (1 where it has no n-grams)."""
        total = _count(f, "total", i)
        freed = sum(cost[k] * _count(f, f"n{k}", i) for k in (1, 2, 3))
        return total, np.where(total > 0, freed / np.maximum(total, 1), 1.0)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(natural log probability, predicted tokens) of each text, end mark included."""
        return self.scores_of(*tokens(texts))

    def scores_of(self, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``scores`` of texts from their tokens and token counts."""
        cost1, cost2, cost3 = self.costs
        less = lambda c, cost: c - cost[np.minimum(c, 3)]
        files, shards, at = self.files, self.files.shards, _predicted(n)
        words, word = np.unique(w, return_inverse=True)
        ids = self.ids(words)
        p1, total1, weight1 = np.full(len(ids), self.unknown), np.zeros(len(ids)), np.ones(len(ids))
        known = np.flatnonzero(ids >= 0)
        for s, part in _parts(self.word_shard(ids[known]), shards):
            to = known[part]
            f, i = files.open("words", s), ids[to] - self.starts[s]
            p1[to] += less(_count(f, "count", i), cost1) / max(self.total, 1)
            total1[to], weight1[to] = self._context(f, i, cost2)
        p = weight1[word[at - 1]] * p1[word[at]]

        ids = ids[word]
        here = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1  # what spans two texts is not asked for below
        pairs, back = np.unique(self.pair(ids[here - 1], ids[here]), return_inverse=True)
        shard = _by_hash(pairs, shards)
        order = _order(shard)
        pairs, shard = pairs[order], shard[order]
        place = np.full(len(w), len(pairs))  # the last place stands for all unknown pairs
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        place[here] = rank[back]
        count, context = np.zeros(len(pairs) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
        total2, weight2 = np.zeros(len(pairs) + 1), np.ones(len(pairs) + 1)
        for s, part in _parts(shard, shards):
            if files.has("pairs", s):
                f = files.open("pairs", s)
                i, ok = ef.of(f, "pair").find(pairs[part])
                count[part][ok] = _count(f, "count", i[ok])
            if files.has("triples", s):
                f = files.open("triples", s)
                i, ok = ef.of(f, "context").find(pairs[part])
                context[part] = i
                total2[part][ok], weight2[part][ok] = self._context(f, i[ok], cost3)
        before, now = place[at - 1], place[at]
        seen = np.flatnonzero(count[now])
        p[seen] += less(count[now[seen]], cost2) / total1[word[at[seen] - 1]]
        p *= weight2[before]

        deep = np.flatnonzero((total2[before] > 0) & (count[now] > 0))
        deep = deep[np.argsort(self.pair(before[deep], ids[at[deep]]))]
        for s, part in _parts(shard[before[deep]], shards):
            f, to = files.open("triples", s), deep[part]
            i, ok = _find(f, context[before[to]], ids[at[to]])
            p[to[ok]] += less(_count(f, "count", i[ok]), cost3) / total2[before[to[ok]]]
        predicted = n - 2
        starts = np.cumsum(predicted) - predicted
        return (np.add.reduceat(np.log(p), starts) if len(n) else np.zeros(0)), predicted


def discounts(counts: dict[int, int]) -> list[float]:
    """Chen and Goodman's D1, D2, D3+ from how many n-grams have count 1 to 4; 0.75 of the count where these are too few."""
    n = [counts.get(i, 0) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.75, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.75 for i in range(3)]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def _rows(shard: np.ndarray, shards: int, keys: np.ndarray, *counts: np.ndarray):
    """Tuples of DEALT, one a shard that has some of the sorted ``keys``."""
    order = _order(shard)
    for s, part in _parts(shard[order], shards):
        at = order[part]
        yield s, len(at), planes(np.diff(keys[at], prepend=np.uint64(0))), planes(_narrow(np.concatenate([c[at] for c in counts])))


def _read(table, columns: int) -> list[np.ndarray]:
    """Keys and columns that ``_rows`` dealt to one shard (a pandas frame of DEALT)."""
    out = []
    for n, keys, counts in table[["n", "keys", "counts"]].itertuples(index=False):
        numbers = plain(counts, f"u{len(counts) // (n * columns)}").reshape(columns, n)
        out.append((np.cumsum(plain(keys, np.uint64), dtype=np.uint64), *(c.astype(np.int64) for c in numbers)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _sums(order: np.ndarray, keys: tuple[np.ndarray, ...], *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ``order``, which sorts them, and the sums of their columns."""
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return *(k[first] for k in keys), *(np.add.reduceat(c[order], first) if len(first) else c for c in columns)


def _folded(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    return _sums(np.argsort(keys), (keys,), *columns)


def _as_context(c: np.ndarray) -> list[np.ndarray]:
    """What n-grams of counts ``c`` add to their contexts: the count, and one of count 1, of 2, or of more."""
    return [c, *(x.astype(np.int64) for x in (c == 1, c == 2, c >= 3))]


def _context_bytes(total: np.ndarray, *n: np.ndarray) -> dict[str, np.ndarray]:
    out = _bytes("total", total)
    for k, x in enumerate(n, 1):
        out |= _bytes(f"n{k}", x)
    return out


def _tells(c: np.ndarray) -> list[int]:
    """Sum and number of counts above 0, and how many are 1 to 4."""
    return [int(c.sum()), int((c > 0).sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))]


def fit(trusted: DataFrame, text: str = "text", only=iter) -> Model:
    """The model of every text of ``trusted`` that ``only`` passes; counts are merged by shard and stay in files. Two passes over the texts.

    Trigrams are counted as they are; pairs and words by the distinct words that precede them
    (continuation counts). Unknown words share one more place in the uniform distribution below.
    An empty table gives a model to which every word is unknown.
    """
    spark = trusted.sparkSession
    shards = max(shuffle_parts(spark), trusted.rdd.getNumPartitions())
    files = Files(new_folder(spark, "quality"), shards)

    def count_words(batches):
        tally = Tally()
        for _, w, _n in _token_batches(only(batches), text):
            w = np.unique(w)
            tally.add(w, np.ones(len(w), np.int64))
        h, c = tally.fold()
        yield from deal(shard_of(h, shards), shards, h, np.ones_like(c))

    def keep_hashes(key, table):
        import pandas as pd

        h, _ = merge(table)
        ef.save(files.path("hashes", int(key[0])), ef.named("hash", ef.EliasFano.build(h)))
        return pd.DataFrame({"shard": [int(key[0])], "words": [len(h)]})

    sizes = np.zeros(shards, np.int64)
    for r in by_shard(trusted.mapInArrow(count_words, ROWS), shards, keep_hashes, "shard int, words long").collect():
        sizes[r.shard] = r.words
    model = Model(files, np.r_[0, np.cumsum(sizes)])
    if not sizes.any():
        return model
    if model.bits > 31:
        raise ValueError("the numbers of two words take 62 bits")

    def folded(pair, word, c):
        return _sums(np.lexsort((word, pair)), (pair, word), c)

    def count_triples(batches):
        import pyarrow as pa

        def dealt():
            pair, word, c = folded(*(np.concatenate(x) for x in zip(*held, strict=True)))
            rows = list(_rows(_by_hash(pair, shards), shards, pair, word, c))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "n", "keys", "counts"])

        held, size = [], 0
        for _, w, n in _token_batches(only(batches), text):
            words, word = np.unique(w, return_inverse=True)
            ids, at = model.ids(words)[word], _predicted(n)
            held.append(folded(model.pair(ids[at - 2], ids[at - 1]), ids[at], np.ones(len(at), np.int64)))
            size += len(held[-1][0])
            if size >= DEAL_AT:
                yield dealt()
                held, size = [], 0
        if size:
            yield dealt()

    def frame(rows):
        import pandas as pd

        return pd.DataFrame(rows, columns=["shard", "n", "keys", "counts"])

    def keep_triples(key, table):
        """All triples of a context are here. Gives each last pair, and how many triples end in it."""
        pair, word, c = folded(*_read(table, 2))
        contexts, parent = np.unique(pair, return_inverse=True)
        sums = [np.bincount(parent, x, len(contexts)).astype(np.int64) for x in _as_context(c)]
        told = {**ef.named("context", ef.EliasFano.build(contexts)), **_context_bytes(*sums), "tells": np.array(_tells(c))}
        ef.save(files.path("triples", int(key[0])), {**told, **_nodes(parent, word, len(contexts)), **_bytes("count", c)})
        last, many = _folded(model.pair(model.split(pair)[1], word), np.ones(len(pair), np.int64))
        return frame(list(_rows(_by_hash(last, shards), shards, last, many)))

    def keep_pairs(key, table):
        """Gives each word: how many pairs end in it, and its sums as a context."""
        pair, c = _folded(*_read(table, 1))
        ef.save(files.path("pairs", int(key[0])), {**ef.named("pair", ef.EliasFano.build(pair)), **_bytes("count", c), "tells": np.array(_tells(c))})
        a, b = model.split(pair)
        none = np.zeros(len(pair), np.int64)
        words, *sums = _folded(np.r_[b, a], np.r_[none + 1, none], *(np.r_[none, x] for x in _as_context(c)))
        return frame(list(_rows(model.word_shard(words), shards, words.astype(np.uint64), *sums)))

    def keep_words(key, table):
        import pandas as pd

        s = int(key[0])
        words, *columns = _read(table, 5)
        count, *sums = (np.bincount(words.astype(np.int64) - model.starts[s], x, sizes[s]).astype(np.int64) for x in columns)
        ef.save(files.path("words", s), {**_bytes("count", count), **_context_bytes(*sums)})
        return pd.DataFrame({"tells": [_tells(count)]})

    pairs = by_shard(by_shard(trusted.mapInArrow(count_triples, DEALT), shards, keep_triples, DEALT), shards, keep_pairs, DEALT)
    told = [[r.tells for r in by_shard(pairs, shards, keep_words, "tells array<long>").collect()]]
    told += [[files.open(kind, s)["tells"] for s in range(shards) if files.has(kind, s)] for kind in ("pairs", "triples")]
    told = [np.sum(x, axis=0).tolist() for x in told]
    costs = [discounts(dict(enumerate(t[2:], 1))) for t in told]
    total, words, once, twice, *_ = told[0]
    freed = np.dot(costs[0], [once, twice, words - once - twice])
    return model.with_counts(costs, total, float(freed) / total / (words + 1))


def perplexities(docs: DataFrame, model: Model, text: str = "text", only=iter) -> DataFrame:
    """``docs``, as far as ``only`` passes them, plus __logp and __tokens, by the mapped files of a model. No shuffle.

    Null or empty texts are the end mark alone; repeated rows get repeated results; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        for part, w, n in _token_batches(only(batches), text):
            logp, n = model.scores_of(w, n)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logp), pa.array(n)], [*part.schema.names, "__logp", "__tokens"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__logp", DoubleType()), StructField("__tokens", LongType())]))


def _drawn(doc_id: Column) -> Column:
    return F.xxhash64(F.lit("trusted"), doc_id)


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def trusted_ids(labels: DataFrame) -> tuple[list, list]:
    """All doc_id labelled good and not toxic, in the order of a hash: for the model, for thresholds.

    The first get two fifths of them, the others the rest. These are lists on the driver, to look at;
    ``Trusted`` divides the same way and keeps the ids in files.
    """
    ids = [r[0] for r in _good(labels).orderBy(_drawn(F.col("doc_id")), "doc_id").collect()]
    n = len(ids) * TRAIN_DOCS // (TRAIN_DOCS + CALIBRATION_DOCS)
    return ids[:n], ids[n:]


class Trusted:
    """The hashes of all trusted ids, sorted, in shards that workers map; the first two fifths are for the model."""

    def __init__(self, labels: DataFrame):
        spark = labels.sparkSession
        shards = max(shuffle_parts(spark), labels.rdd.getNumPartitions())
        files = self.files = Files(new_folder(spark, "quality"), shards)

        def keep(key, table):
            import pandas as pd

            h = np.unique(table["h"].to_numpy().view(np.uint64))
            ef.save(files.path("ids", int(key[0])), {"key": h})
            return pd.DataFrame({"shard": [int(key[0])], "n": [len(h)]})

        h = _good(labels).select(self.hash(F.col("doc_id")).alias("h"))
        shard = F.shiftright(F.shiftrightunsigned("h", 32) * shards, 32).cast("int").alias("shard")
        told = sorted(tuple(r) for r in by_shard(h.select(shard, "h"), shards, keep, "shard int, n long").collect())
        left = sum(n for _, n in told) * TRAIN_DOCS // (TRAIN_DOCS + CALIBRATION_DOCS)
        self.border = np.uint64(0)
        for s, n in told:
            if left < n:
                self.border = files.open("ids", s)["key"][left]
                break
            left -= n

    @staticmethod
    def hash(doc_id: Column) -> Column:
        """Rises, read as unsigned, with the signed hash that orders the ids."""
        return _drawn(doc_id).bitwiseXOR(F.lit(-(2**63)))

    def rows(self, docs: DataFrame) -> DataFrame:
        """What ``only`` reads of ``docs``: the hash of the id, lang and text."""
        return docs.where("doc_id IS NOT NULL").select(self.hash(F.col("doc_id")).alias("h"), "lang", "text")

    def only(self, train: bool):
        """Passes those of ``rows``, in Arrow batches, that are for the model, or for the thresholds."""
        files, border = self.files, self.border

        def run(batches):
            import pyarrow as pa

            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                order = np.argsort(h)
                h = h[order]
                take = np.zeros(len(h), bool)
                for s, part in _parts(shard_of(h >> np.uint64(64 - HASH_BITS), files.shards), files.shards):
                    if files.has("ids", s):
                        good = files.open("ids", s)["key"]
                        i = np.minimum(np.searchsorted(good, h[part]), len(good) - 1)
                        take[order[part]] = (good[i] == h[part]) & ((h[part] < border) == train)
                yield b.filter(pa.array(take))

        return run


def within(docs: DataFrame, ids: list, most: int) -> list:
    """Those of ``ids``, taken in their order, whose texts hold ``most`` words together; rows of one id count together.

    For a model of a bounded part of the trusted text; ``classify`` takes all of it.
    """
    words = {r[0]: r[1] for r in docs.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.sum(n_words(F.col("text")) + 1)).collect()} if ids else {}
    out = []
    for i in ids:
        if i in words and words[i] <= most:
            out.append(i)
            most -= words[i]
    return out


def _quantiles(values: DataFrame) -> dict:
    """The QUANTILE of ``x`` by ``lang`` (never null), exact, between neighbours by proportion; no sort in a single task."""
    ranked = cut(prefix_counts(values.groupBy("lang", "x").agg(F.count(F.lit(1)).alias("n")), "lang", "x"))
    place = F.lit(QUANTILE) * (F.col("size") - 1)
    groups = ranked.groupBy("lang").agg(F.min("before").alias("start"), F.sum("n").alias("size")).select("lang", "start", place.alias("place"))
    at = F.col("before") - F.col("start")
    has = lambda k: (at <= k) & (k < at + F.col("n"))
    low = F.floor("place")
    found = ranked.join(F.broadcast(groups), "lang")  # one row a language
    found = found.groupBy("lang").agg(F.max(F.when(has(low), F.col("x"))).alias("low"), F.max(F.when(has(low + 1), F.col("x"))).alias("high"), F.first(F.col("place") - low).alias("rest"))
    return {r.lang: r.low + r.rest * ((r.high if r.high is not None else r.low) - r.low) for r in found.collect()}


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` plus __perplexity, __threshold and __keep.

    Trusted are all documents with quality 1 and toxic 0 in ``labels``: two fifths of them, in the order of a hash, make
    the model, the others the thresholds. Null or empty texts are the end mark alone and
    are judged like others; a null or rare language takes the threshold of all; with no trusted
    documents everything is kept. Repeated rows get repeated results; other columns pass through.
    The model and the ids lie in mapped files below spark.checkpoint.dir, which must be a mounted shared folder.
    """
    trusted = Trusted(labels.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)))
    rows = trusted.rows(docs)
    model = fit(rows, only=trusted.only(True))
    scored = perplexities(docs, model)
    seen = cut(perplexities(rows, model, only=trusted.only(False)).select("lang", "__logp", "__tokens"))
    sums = [F.count(F.lit(1)).alias("rows"), (-F.sum("__logp") / F.sum("__tokens")).alias("mu")]
    every = seen.agg(*sums).first()
    if not every["rows"]:
        return scored.select(*docs.columns, F.exp(-F.col("__logp") / F.col("__tokens")).alias("__perplexity"), F.lit(None).cast("double").alias("__threshold"), F.lit(True).alias("__keep"))
    mu = every["mu"]
    known = {r.lang: r.mu for r in seen.where("lang IS NOT NULL").groupBy("lang").agg(*sums).where(F.col("rows") >= FEWEST).collect()}

    def pick(values: dict, other: float) -> Column:
        out = F.lit(other)
        for lang, v in values.items():
            out = F.when(F.col("lang") == lang, F.lit(v)).otherwise(out)
        return out

    def entropy(mu) -> Column:
        return (PRIOR_TOKENS * mu - F.col("__logp")) / (F.col("__tokens") + PRIOR_TOKENS)

    def limits(values: DataFrame) -> dict:
        return {lang: x + math.log(SLACK) for lang, x in _quantiles(values).items()}

    own = limits(seen.where(F.col("lang").isin(list(known))).select("lang", entropy(pick(known, mu)).alias("x"))) if known else {}
    threshold = pick(own, limits(seen.select(F.lit("").alias("lang"), entropy(F.lit(mu)).alias("x")))[""])
    judged = entropy(pick(known, mu))
    return scored.select(*docs.columns, F.exp(judged).alias("__perplexity"), F.exp(threshold).alias("__threshold"), (judged <= threshold).alias("__keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``classify`` keeps, columns as they were."""
    return classify(docs, labels).where("__keep").select(*docs.columns)
