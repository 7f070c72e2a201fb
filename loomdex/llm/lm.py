"""LM scoring: a trigram Kneser-Ney model in an Elias-Fano trie, built and read in shards.

Level 1 of the trie is the vocabulary as sorted word hashes; a word's number is its rank. Level 2
holds each word's successors; a pair's number is its place there. Level 3 holds the successors of
each pair that training saw at least twice. Levels 1 and 2 are sharded by ranges of the word hash,
level 3 by ranges of the pair number, so the shards of a level together are one sequence, and a
frequent word's triples spread over many. Each shard is one file in the shared folder; Python
workers map the files and touch only the pages that their texts need.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomdex.llm import eliasfano as ef
from loomdex.llm.common import binary_column, cut, shuffle_parts
from loomdex.llm.tally import HASH_BITS, ROWS, Files, Tally, by_shard, deal, merge, new_folder, planes, shard_of

FOLDS, HELD = 5, 1
#: Pairs seen less often have no successors of their own in level 3.
LEAST_CONTEXT = 2
#: Shards for each partition of the input, so that a shard's size does not follow the input's.
SHARDS_A_PART = 2
#: Tokens handled together in a Python worker.
BATCH_TOKENS = 1_000_000


def held_out():
    """crc32(doc_id as text) mod 5 is 1; a null doc_id trains."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hashes of all tokens (words with A-Z lower-cased, then one end token a text), and counts."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    end = digest(b"\n")  # no word holds a line feed
    out, counts = [], []
    for text in texts:
        words = text.lower().split()
        h = [digest(x) for x in words]
        h.append(end)
        out.append(np.array(h, np.uint64))
        counts.append(len(h))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)) >> np.uint64(64 - HASH_BITS), np.array(counts, np.int64)


def _token_batches(batches):
    """(batch rows, hashes, counts) with about BATCH_TOKENS tokens each; a text is never divided."""
    for b in batches:
        texts = [x or b"" for x in binary_column(b, "text")]
        at = size = 0
        for i, x in enumerate(texts):
            size += len(x) // 5 + 1
            if size >= BATCH_TOKENS or i + 1 == len(texts):
                yield b.slice(at, i + 1 - at), *_hashes(texts[at : i + 1])
                at, size = i + 1, 0


def _put(out: dict, name: str, p: np.ndarray, exact: bool) -> None:
    """Probabilities as 8-bit codes and their book, or as they are."""
    if exact:
        out[name] = p
    else:
        out[name], out[f"{name}.book"] = ef.logs_to_bytes(p)


def _get(f: dict, name: str, at: np.ndarray) -> np.ndarray:
    return f[f"{name}.book"][f[name][at]] if f"{name}.book" in f else f[name][at]


def _least(c: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return c.astype(np.min_scalar_type(int(c.max(initial=0))))


def _nodes(parent: np.ndarray, child: np.ndarray, parents: int) -> dict[str, np.ndarray]:
    """A level: pointers to each parent's children, and the children, each relative to the last one of the parent before."""
    many = np.bincount(parent, minlength=parents)
    lasts = np.zeros(parents, np.int64)
    lasts[parent] = child  # child rises within its parent, so the last one stays
    step = np.where(many > 0, lasts + 1, 0)
    base = np.cumsum(step) - step
    return {**ef.named("pointers", ef.EliasFano.build(np.r_[0, np.cumsum(many)])), **ef.named("successors", ef.EliasFano.build(base[parent] + child))}


def _find(f: dict, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, there or not) of pairs sorted by parent, then child, by context-relative successor search:
    a parent's children lie between two pointers, above the last child of the parent before, so one
    search over the whole level finds a child in its parent's range or not at all."""
    pointers, successors = ef.of(f, "pointers"), ef.of(f, "successors")
    local, back = np.unique(parent, return_inverse=True)
    begin, end = pointers.get(local).astype(np.int64), pointers.get(local + 1).astype(np.int64)
    base = np.zeros(len(local), np.uint64)
    base[begin > 0] = successors.get(begin[begin > 0] - 1) + np.uint64(1)
    i, ok = successors.find(base[back] + child.astype(np.uint64))
    return i, ok & (i >= begin[back]) & (i < end[back])


def _smoothed(f: dict, parents: int, cost: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Discounted probabilities of a level's nodes, and the weight that each parent leaves to the level above (1 without children)."""
    many = np.diff(ef.of(f, "pointers").get(np.arange(parents + 1)).astype(np.int64))
    c = f["count"].astype(np.int64)
    parent, lost = np.repeat(np.arange(parents), many), np.array([0.0, *cost])[np.minimum(c, 3)]
    total = np.bincount(parent, c, minlength=parents)
    return (c - lost) / total[parent], np.where(total > 0, np.bincount(parent, lost, minlength=parents) / np.maximum(total, 1), 1.0)


class Model:
    """What the driver knows of a fitted trie; the rest is in the files."""

    def __init__(self, files: Files, starts: np.ndarray, tokens: int, unknown: float):
        self.files, self.starts, self.tokens, self.unknown = files, starts, tokens, unknown
        self.words = int(starts[-1])
        self.bits = max(1, self.words.bit_length())
        self.pair_starts = self.ranges = np.zeros(files.shards + 1, np.int64)

    def with_pairs(self, sizes: np.ndarray) -> Model:
        out = Model(self.files, self.starts, self.tokens, self.unknown)
        out.pair_starts = np.r_[0, np.cumsum(sizes)]
        out.ranges = np.array([int(out.pair_starts[-1]) * t // self.files.shards for t in range(self.files.shards + 1)], np.int64)
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, -1 for unknown words."""
        out = np.full(len(h), -1, np.int64)
        bounds = np.searchsorted(shard_of(h, self.files.shards), np.arange(self.files.shards + 1))
        for s in range(self.files.shards):
            a, b = bounds[s], bounds[s + 1]
            if a < b and self.starts[s + 1] > self.starts[s]:
                i, ok = ef.of(self.files.open("words", s), "hash").find(h[a:b])
                out[a:b] = np.where(ok, self.starts[s] + i, -1)
        return out

    def _by_shard(self, v: np.ndarray, starts: np.ndarray):
        """(shard, from, to) for sorted numbers."""
        bounds = np.searchsorted(v, starts)
        for s in range(self.files.shards):
            if bounds[s] < bounds[s + 1]:
                yield s, bounds[s], bounds[s + 1]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted word numbers."""
        out = np.zeros(len(ids), np.int64)
        for s, a, b in self._by_shard(ids, self.starts):
            out[a:b] = self.files.open("words", s)["count"][ids[a:b] - self.starts[s]]
        return out

    def words_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unigram probability, weight left to it after the word as context) of sorted word numbers."""
        p, weight = np.zeros(len(ids)), np.ones(len(ids))
        for s, a, b in self._by_shard(ids, self.starts):
            f, local = self.files.open("trie", s), ids[a:b] - self.starts[s]
            p[a:b], weight[a:b] = _get(f, "p1", local), _get(f, "weight", local)
        return p, weight

    def pairs(self, v: np.ndarray, w: np.ndarray):
        """Yields (slice, numbers or -1, shard, places, there or not) of pairs sorted by v, then w."""
        for s, a, b in self._by_shard(v, self.starts):
            i, ok = _find(self.files.open("pairs", s), v[a:b] - self.starts[s], w[a:b])
            yield slice(a, b), np.where(ok, self.pair_starts[s] + i, -1), s, i, ok

    def triples(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Discounted p(x | pair) of sorted pair numbers and words; 0 where the triple is not there."""
        out = np.zeros(len(p))
        for t, a, b in self._by_shard(p, self.ranges):
            i, ok = _find(self.files.open("triples", t), p[a:b] - self.ranges[t], x[a:b])
            out[a:b][ok] = _get(self.files.open("trie3", t), "p3", i[ok])
        return out

    def weights(self, p: np.ndarray) -> np.ndarray:
        """Weight left to level 2 after sorted pair numbers."""
        out = np.ones(len(p))
        for t, a, b in self._by_shard(p, self.ranges):
            out[a:b] = _get(self.files.open("trie3", t), "weight", p[a:b] - self.ranges[t])
        return out

    def numbered(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, each token's place among them, and that of the token before it (a text begins after an end)."""
        distinct, back = np.unique(h, return_inverse=True)
        first = np.cumsum(n) - n
        before = np.r_[0, back[:-1]]
        before[first] = back[first + n - 1]
        return distinct, back, before

    def scores(self, h: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """n_known, base_score and score of texts from their tokens' hashes and token counts."""
        distinct, back, before = self.numbered(h, n)
        starts = np.cumsum(n) - n
        ids = self.ids(distinct)
        known = ids >= 0
        count = np.zeros(len(ids), np.int64)
        count[known] = self.counts(ids[known])
        p1, weight = np.full(len(ids), self.unknown), np.ones(len(ids))
        p1[known], weight[known] = self.words_of(ids[known])
        p = weight[before] * p1[back]
        seen = np.flatnonzero(known[before] & known[back])
        key = ids[before[seen]].astype(np.uint64) << np.uint64(self.bits) | ids[back[seen]].astype(np.uint64)
        pair, pair_back = np.unique(key, return_inverse=True)
        number, p2 = np.full(len(pair), -1), np.zeros(len(pair))
        mask = np.uint64((1 << self.bits) - 1)
        for part, found, s, i, ok in self.pairs((pair >> np.uint64(self.bits)).astype(np.int64), (pair & mask).astype(np.int64)):
            number[part] = found
            p2[part][ok] = _get(self.files.open("trie", s), "p2", i[ok])
        p[seen] += p2[pair_back]
        at = np.full(len(h), -1)
        at[seen] = number[pair_back]
        context = np.r_[-1, at[:-1]]
        context[starts] = -1  # the first token of a text follows an end alone
        deep = np.flatnonzero(context >= 0)
        numbers, number_back = np.unique(context[deep], return_inverse=True)
        p[deep] *= self.weights(numbers)[number_back]
        deep = deep[known[back[deep]]]
        key = context[deep].astype(np.uint64) << np.uint64(self.bits) | ids[back[deep]].astype(np.uint64)
        triple, triple_back = np.unique(key, return_inverse=True)
        p[deep] += self.triples((triple >> np.uint64(self.bits)).astype(np.int64), (triple & mask).astype(np.int64))[triple_back]
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        total = lambda x: np.add.reduceat(x, starts)
        return {"n_known": total(known[back].astype(np.int64)), "base_score": total(base[back]), "score": total(np.log10(p))}


def _modified(n) -> list[float]:
    from loomdex.llm.quality import discounts

    return discounts({i + 1: int(x) for i, x in enumerate(n)})


def _count_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def fit(train: DataFrame, exact: bool = False) -> Model:
    """The model of every text of ``train``. Counts are folded in each task and merged by shard; no shard meets another.

    Levels 2 and 3 have modified Kneser-Ney discounts of their counts, level 1 continuation counts
    with one discount. Level 3 takes pairs that come LEAST_CONTEXT times or more as contexts: what
    follows a pair once tells nothing of what follows it again. Unknown words are one class,
    with the share of tokens that training saw once. ``exact`` keeps probabilities unquantised.
    """
    spark = train.sparkSession
    shards = max(shuffle_parts(spark), SHARDS_A_PART * train.rdd.getNumPartitions())
    files = Files(new_folder(spark, "lm"), shards)
    texts = train.select("text")

    def count_words(batches):
        tally = Tally()
        for _, h, _n in _token_batches(batches):
            tally.add(*np.unique(h, return_counts=True))
        h, c = tally.fold()
        yield from deal(shard_of(h, shards), shards, h, c)

    def keep_words(key, table):
        import pandas as pd

        h, c = merge(table)
        ef.save(files.path("words", int(key[0])), {**ef.named("hash", ef.EliasFano.build(h)), "count": _least(c)})
        return pd.DataFrame({"shard": [key[0]], "words": [len(h)], "tokens": [int(c.sum())], "once": [int((c == 1).sum())]})

    told = by_shard(texts.mapInArrow(count_words, ROWS), shards, keep_words, "shard int, words long, tokens long, once long").collect()
    sizes = np.zeros(shards, np.int64)
    for r in told:
        sizes[r.shard] = r.words
    starts = np.r_[0, np.cumsum(sizes)]
    tokens, once = sum(r.tokens for r in told), sum(r.once for r in told)
    unknown = min(0.5, max(once, 0.5) / (tokens + 1))
    words = Model(files, starts, tokens, unknown if tokens else 1.0)
    if not words.words:
        return words
    bits, mask = words.bits, np.uint64((1 << words.bits) - 1)
    if bits > 31:
        raise ValueError("the numbers of two words take 62 bits")

    def count_pairs(batches):
        tally = Tally()
        for _, h, n in _token_batches(batches):
            distinct, back, before = words.numbered(h, n)
            ids = words.ids(distinct).astype(np.uint64)
            tally.add(*np.unique(ids[before] << np.uint64(bits) | ids[back], return_counts=True))
        keys, c = tally.fold()
        yield from deal(np.searchsorted(starts, (keys >> np.uint64(bits)).astype(np.int64), "right") - 1, shards, keys, c)

    def keep_pairs(key, table):
        import pandas as pd

        keys, c = merge(table)
        shard = int(key[0])
        v, w = (keys >> np.uint64(bits)).astype(np.int64) - starts[shard], keys & mask
        ef.save(files.path("pairs", shard), {**_nodes(v, w.astype(np.int64), int(sizes[shard])), "count": _least(c)})
        w, times = np.unique(w, return_counts=True)
        to = np.searchsorted(starts, w.astype(np.int64), "right") - 1
        out = [(-1, None, None, [shard, len(keys), *_count_counts(c)])]
        bounds = np.searchsorted(to, np.arange(shards + 1))
        for s in range(shards):
            a, b = bounds[s], bounds[s + 1]
            if a < b:
                out.append((s, planes(w[a:b]), planes(times[a:b].astype(np.uint64)), None))
        return pd.DataFrame(out, columns=["shard", "keys", "counts", "n"])

    merged = cut(by_shard(texts.mapInArrow(count_pairs, ROWS), shards, keep_pairs, f"{ROWS}, n array<long>"))
    n = np.array([r.n for r in merged.where("shard < 0").select("n").collect()])
    cost2, pair_sizes = _modified(n[:, 2:].sum(axis=0)), np.zeros(shards, np.int64)
    pair_sizes[n[:, 0]] = n[:, 1]
    model = words.with_pairs(pair_sizes)
    pairs = int(pair_sizes.sum())
    if pairs.bit_length() + bits > 62:
        raise ValueError("the numbers of a pair and a word take 62 bits")

    def keep_continuations(key, table):
        import pandas as pd

        w, c = merge(table)
        ef.save(files.path("lefts", int(key[0])), {"word": w, "count": _least(c)})
        return pd.DataFrame({"once": [int((c == 1).sum())], "twice": [int((c == 2).sum())]})

    lefts = by_shard(merged.where("shard >= 0").drop("n"), shards, keep_continuations, "once long, twice long").agg(F.sum("once"), F.sum("twice")).first()
    discount = lefts[0] / (lefts[0] + 2 * lefts[1]) if lefts[0] and lefts[1] else 0.75
    uniform = discount / pairs  # each word's discount goes back to all words alike

    def count_triples(batches):
        tally = Tally()
        for _, h, n in _token_batches(batches):
            distinct, back, before = words.numbered(h, n)
            ids = words.ids(distinct).astype(np.uint64)
            pair, pair_back = np.unique(ids[before] << np.uint64(bits) | ids[back], return_inverse=True)
            number = np.full(len(pair), -1)
            for part, found, s, i, _ok in model.pairs((pair >> np.uint64(bits)).astype(np.int64), (pair & mask).astype(np.int64)):
                number[part] = np.where(files.open("pairs", s)["count"][i] >= LEAST_CONTEXT, found, -1)
            context = np.r_[-1, number[pair_back][:-1]]
            context[np.cumsum(n) - n] = -1
            deep = np.flatnonzero(context >= 0)
            tally.add(*np.unique(context[deep].astype(np.uint64) << np.uint64(bits) | ids[back[deep]], return_counts=True))
        keys, c = tally.fold()
        yield from deal(np.searchsorted(model.ranges, (keys >> np.uint64(bits)).astype(np.int64), "right") - 1, shards, keys, c)

    def keep_triples(key, table):
        import pandas as pd

        keys, c = merge(table)
        t = int(key[0])
        p = (keys >> np.uint64(bits)).astype(np.int64) - model.ranges[t]
        ef.save(files.path("triples", t), {**_nodes(p, (keys & mask).astype(np.int64), int(model.ranges[t + 1] - model.ranges[t])), "count": _least(c)})
        return pd.DataFrame({"n": [_count_counts(c)]})

    n = [r.n for r in by_shard(texts.mapInArrow(count_triples, ROWS), shards, keep_triples, "n array<long>").collect()]
    cost3 = _modified(np.array(n or [[0] * 4]).sum(axis=0))

    def build(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                size, out = int(sizes[s]), {}
                if size:
                    if not files.has("pairs", s):
                        none = np.zeros(0, np.int64)
                        ef.save(files.path("pairs", s), {**_nodes(none, none, size), "count": none})
                    p2, weight = _smoothed(files.open("pairs", s), size, cost2)
                    left, p1 = files.open("lefts", s), np.full(size, uniform)
                    p1[left["word"].astype(np.int64) - starts[s]] += (left["count"] - discount) / pairs
                    for name, p in (("p2", p2), ("weight", weight), ("p1", p1 * (1 - unknown))):
                        _put(out, name, p, exact)
                    ef.save(files.path("trie", s), out)
                size, out = int(model.ranges[s + 1] - model.ranges[s]), {}
                if size:
                    if not files.has("triples", s):
                        none = np.zeros(0, np.int64)
                        ef.save(files.path("triples", s), {**_nodes(none, none, size), "count": none})
                    p3, weight = _smoothed(files.open("triples", s), size, cost3)
                    _put(out, "p3", p3, exact)
                    _put(out, "weight", weight, exact)
                    ef.save(files.path("trie3", s), out)
            yield b

    spark.range(0, shards, 1, shards).mapInArrow(build, "id long").count()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        import pyarrow as pa

        for b, h, n in _token_batches(batches):
            s = model.scores(h, n)
            columns = [b.column(0), b.column(1), pa.array(n), pa.array(s["n_known"]), pa.array(np.full(len(n), model.tokens)), pa.array(s["base_score"]), pa.array(s["score"])]
            yield pa.RecordBatch.from_arrays(columns, names)

    d = docs.select("doc_id", held_out().alias("held_out"), "text")
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fit_and_score(docs: DataFrame) -> DataFrame:
    """Trains on the documents that are not held out, scores all.

    Null text counts as empty (one end token); null doc_id trains; repeated rows train and are
    scored as often as they come; with nothing to train on every probability is 1 and every score 0.
    """
    return score(docs, fit(docs.where(~held_out())))
