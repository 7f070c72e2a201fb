"""Substring dedup: FM-indexes over content-dealt shards find every window of words that recurs.

Two equal windows have the same least 16-word hash, so a corpus is cut into segments of consecutive
windows that share it, and equal windows meet wherever segments are dealt by that hash (minimisers,
as k-mer counting does). Segments whose hash occurs once are unique and stay home. Equal segments
become one with a weight; those with a common hash go to a shard, which indexes their words and
streams them through backward search: a window recurs where the matching statistic reaches its length.
Only a segment that no other one shares its hash with needs no search: its weight is that of all its intervals.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomdex.llm import eliasfano as ef
from loomdex.llm.common import binary_column, cut, mix64, shuffle_parts, slices
from loomdex.llm.backward import BackwardIndex
from loomdex.llm.tally import HASH_BITS, ROWS, Files, Tally, by_shard, deal, merge, new_folder, shard_of

WINDOW = 35
GRAM = 16
BATCH_TOKENS = 500_000
#: A hash with more distinct segments than this is split by longer context.
HOT = 1024
#: Distinct segments of one shard of the index, about.
SHARD_SEGMENTS = 8192
#: Shards of the hash sets for each partition of the input, so that their size does not follow the input's.
SHARDS_A_PART = 2

_B = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BATCH_TOKENS)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_B, pow(_B, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class Sequence:
    """Word hashes of several texts behind each other, with hashes of any run of words in constant time."""

    def __init__(self, w: np.ndarray):
        self.w = w
        up, self.down = _powers(len(w) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(w * up[: len(w)])])

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return mix64((self.sums[start + size] - self.sums[start]) * self.down[start] + np.uint64(_B) * np.asarray(size, np.uint64))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = [np.array([digest(x) for x in t.split()], np.uint64) for t in texts]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def segments(w: np.ndarray, n: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Maximal runs of windows of one text with the same least hash: where (start), windows (size), hash (m), own
    hash (whole), text number (doc), and whether the least hash occurs twice in the run (twice)."""
    gram = min(GRAM, window)
    seq, total, reach = Sequence(w), len(w), window - gram + 1
    names = ("start", "size", "doc", "m", "whole", "twice")
    if total < window:
        return {k: np.zeros(0, np.int64) for k in names} | {"seq": seq}
    g = seq.hash(np.arange(total - gram + 1), gram) >> np.uint64(64 - HASH_BITS)
    low, width = g, 1
    while 2 * width <= reach:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.arange(total) + window <= ends[doc])
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in names} | {"seq": seq}
    m = low[at]
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (m[1:] != m[:-1])])
    start, size, m = at[first], np.diff(np.r_[first, len(at)]), m[first]
    twice = np.empty(len(start), bool)
    for a in range(0, len(start), 1 << 16):
        s, z, v = start[a : a + (1 << 16)], size[a : a + (1 << 16)], m[a : a + (1 << 16), None]
        left = s + (g[s[:, None] + np.arange(reach)] == v).argmax(axis=1)
        last = s + z + reach - 2
        right = last - (g[last[:, None] - np.arange(reach)] == v).argmax(axis=1)
        twice[a : a + (1 << 16)] = left != right
    return {"start": start, "size": size, "doc": doc[start], "m": m, "whole": seq.hash(start, size + window - 1), "twice": twice, "seq": seq}


def _batches(batches):
    """(rows, segments, first word of each text, counts) of about BATCH_TOKENS words."""
    for b in batches:
        texts = [x or b"" for x in binary_column(b, "text")]
        at = size = 0
        for i, x in enumerate(texts):
            size += len(x) // 6 + 1
            if size >= BATCH_TOKENS or i + 1 == len(texts):
                yield b.slice(at, i + 1 - at), *_words(texts[at : i + 1])
                at, size = i + 1, 0


def _present(files: Files, kind: str, keys: np.ndarray) -> np.ndarray:
    """Which keys are in the set kept as ``kind``, one mapped file a key range."""
    distinct, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), bool)
    bounds = np.searchsorted(shard_of(distinct, files.shards), np.arange(files.shards + 1))
    for s in range(files.shards):
        a, b = bounds[s], bounds[s + 1]
        if a < b and files.has(kind, s):
            out[a:b] = ef.of(files.open(kind, s), "keys").find(distinct[a:b])[1]
    return out[back]


def _place(k: np.ndarray, th: np.ndarray, start: np.ndarray) -> np.ndarray:
    """62-bit name of a segment's place in the corpus."""
    x = mix64(k.view(np.uint64) * np.uint64(_B) + th.view(np.uint64))
    return mix64(x + start.astype(np.uint64) * np.uint64(_B)) >> np.uint64(64 - HASH_BITS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows equal in doc_id and text have equal (k, th); nothing else needs to tell documents apart."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("k"), F.xxhash64("text").alias("th"), "text")


def recurring_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, th, start, size, offsets): segments with windows that recur; offsets from start, null for all of them."""
    spark = docs.sparkSession
    shards = max(shuffle_parts(spark), SHARDS_A_PART * docs.rdd.getNumPartitions())
    files = Files(new_folder(spark, "substring"), shards)
    d = _keyed(docs).drop("doc_id")

    def count(batches):
        tally = Tally()
        for _, w, n in _batches(batches):
            s = segments(w, n, window)
            keys, back = np.unique(s["m"].astype(np.uint64), return_inverse=True)
            tally.add(keys, np.bincount(back, 1 + s["twice"], minlength=len(keys)).astype(np.int64))
        m, c = tally.fold()
        yield from deal(shard_of(m, shards), shards, m, np.minimum(c, 2))

    def keep(kind, least):
        def run(key, table):
            import pandas as pd

            m, c = merge(table)
            m = m[c >= least]
            ef.save(files.path(kind, int(key[0])), ef.named("keys", ef.EliasFano.build(m)))
            return pd.DataFrame({"n": [len(m)]})

        return run

    by_shard(d.select("text").mapInArrow(count, ROWS), shards, keep("twice", 2), "n long").count()

    def find(batches):
        import pyarrow as pa

        for b, w, n in _batches(batches):
            s = segments(w, n, window)
            ok = np.flatnonzero(_present(files, "twice", s["m"].astype(np.uint64)))
            k, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            doc, first = s["doc"][ok], np.cumsum(n) - n
            columns = [s["m"][ok].astype(np.int64), s["whole"][ok].astype(np.uint64).view(np.int64), k[doc], th[doc], s["start"][ok] - first[doc], s["size"][ok], s["twice"][ok]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "whole", "k", "th", "start", "size", "twice"])

    found = cut(d.mapInArrow(find, "m long, whole long, k long, th long, start long, size long, twice boolean"))
    wholes = cut(found.groupBy("m", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "th", "start")).alias("at"), F.max("twice").alias("twice")))
    # written first, so that the join has an exchange on either side and Spark may split a hot hash
    variants = cut(wholes.groupBy("m").agg(F.count(F.lit(1)).alias("variants")))
    asked = wholes.join(variants, "m").where("variants > 1 OR twice")

    def name(batches):
        for b in batches:
            keys = np.unique(_place(*(b.column(i).to_numpy() for i in range(3))))
            yield from deal(shard_of(keys, shards), shards, keys, np.ones(len(keys), np.int64))

    by_shard(asked.select("at.k", "at.th", "at.start").mapInArrow(name, ROWS), shards, keep("asked", 1), "n long").count()

    def fetch(batches):
        import pyarrow as pa

        for b, w, n in _batches(batches):
            s = segments(w, n, window)
            k, th = (b.column(i).to_numpy() for i in range(2))
            first = np.cumsum(n) - n
            ok = np.flatnonzero(_present(files, "asked", _place(k[s["doc"]], th[s["doc"]], s["start"] - first[s["doc"]])))
            words = [w[a : a + z + window - 1].tobytes() for a, z in zip(s["start"][ok], s["size"][ok], strict=True)]
            columns = [pa.array(s["m"][ok].astype(np.int64)), pa.array(s["whole"][ok].astype(np.uint64).view(np.int64)), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["m", "whole", "words"])

    texts = d.mapInArrow(fetch, "m long, whole long, words binary").join(asked.select("m", "whole", "n", "variants"), ["m", "whole"])
    texts = cut(texts.select("m", "whole", "words", "n", "variants"))
    hot = texts.where(F.col("variants") > HOT).dropDuplicates(["m", "whole"])
    hot = hot.select(F.col("m").alias("key"), F.col("whole").alias("piece"), "m", "whole", F.lit(0).alias("at"), "n", "words")
    todo, places = [texts.where(F.col("variants") <= HOT).select(F.col("m").alias("key"), F.col("whole").alias("piece"), "n", "words", F.lit(True).alias("all"))], None
    reach = window - min(GRAM, window) + 1
    room = reach
    while room > 1 and not hot.isEmpty():
        room = max(1, room // 2)
        pieces = cut(split(hot, window, room))
        distinct = pieces.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
        distinct = cut(distinct)
        counts = cut(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("variants")))
        many = counts.where(F.col("variants") > HOT).select("key")
        settled = pieces.join(many, "key", "left_anti").select("key", "piece", "m", "whole", "at")
        places = settled if places is None else places.union(settled)
        todo.append(distinct.join(many, "key", "left_anti").select("key", "piece", "n", "words", F.lit(False).alias("all")))
        hot = pieces.join(many, "key", "left_semi")
    if places is not None:
        places = cut(places)
    texts = functools.reduce(DataFrame.union, todo)
    indexes = max(shards, texts.count() // SHARD_SEGMENTS)

    def index(_, table):
        import pandas as pd

        table = table.drop_duplicates(["key", "piece"])
        parts = [np.frombuffer(x, np.uint64) for x in table["words"]]
        words, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        again = BackwardIndex(words, sizes, table["n"].to_numpy()).statistics(words, sizes) >= window
        starts = np.cumsum(sizes) - sizes
        offsets = [np.flatnonzero(again[a : a + z]).tolist() for a, z in zip(starts, sizes, strict=True)]
        return pd.DataFrame({"key": table["key"], "piece": table["piece"], "all": table["all"], "offsets": offsets})

    in_shard = F.pmod(F.xxhash64("key"), F.lit(indexes)).alias("shard")
    indexed = by_shard(texts.select("*", in_shard), indexes, index, "key long, piece long, all boolean, offsets array<int>").where(F.size("offsets") > 0)
    every = wholes.join(variants.where("variants = 1"), "m").where("n > 1 AND NOT twice").select("m", "whole", F.lit(None).cast("array<int>").alias("offsets"))
    if places is None:
        some = indexed.select(F.col("key").alias("m"), F.col("piece").alias("whole"), "offsets")
    else:
        indexed = cut(indexed)
        some = indexed.where("all").select(F.col("key").alias("m"), F.col("piece").alias("whole"), "offsets")
        # a segment's pieces are at most its windows, so a list of lists is no longer than the segment
        back = places.join(indexed.where("NOT all"), ["key", "piece"]).select("m", "whole", F.transform("offsets", lambda x: x + F.col("at")).alias("offsets"))
        some = some.union(back.groupBy("m", "whole").agg(F.flatten(F.collect_list("offsets")).alias("offsets")))
    return found.join(some.union(every), ["m", "whole"]).select("k", "th", "start", "size", "offsets")


def split(rows: DataFrame, window: int, room: int) -> DataFrame:
    """Rows (key, piece, m, whole, at, n, words) cut up so that fewer pieces share a key.

    A window knows where its least word run lies (the first of equal ones). Windows where that
    place falls in the same ``room`` words share at least ``window + 1 - room`` words around the
    run, and that context is the new key: equal windows keep equal keys. With a room of one word
    the context is the window itself, so a key then has one piece. ``at`` counts from the segment's start.
    """
    gram = min(GRAM, window)
    reach = window - gram + 1

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 256):
            out = []
            for _, _, m, whole, at, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = np.frombuffer(data, np.uint64)
                seq = Sequence(w)
                g = seq.hash(np.arange(len(w) - gram + 1), gram) >> np.uint64(64 - HASH_BITS)
                z = len(w) - window + 1
                place = np.concatenate([(g[a + np.arange(min(z - a, 1 << 16))[:, None] + np.arange(reach)]).argmin(axis=1) for a in range(0, z, 1 << 16)])
                part = place // room
                context = np.arange(z) + place - part * room
                size = gram + np.minimum(part * room, reach - 1) + np.maximum(reach - (part + 1) * room, 0)
                key = mix64(seq.hash(context, size) + part.astype(np.uint64) + np.uint64(room << 8))
                first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (part[1:] != part[:-1])])
                length = np.diff(np.r_[first, z])
                piece = seq.hash(first, length + window - 1)
                for f, c, k, p in zip(first.tolist(), length.tolist(), key[first].view(np.int64).tolist(), piece.view(np.int64).tolist(), strict=True):
                    out.append((k, p, m, whole, at + f, n, w[f : f + c + window - 1].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, b.schema.types, strict=True)], b.schema.names)

    return rows.select("key", "piece", "m", "whole", "at", "n", "words").mapInArrow(run, "key long, piece long, m long, whole long, at int, n long, words binary")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, one space between), spans (word ranges taken out), for every row.

    A word goes if a window of ``window`` words around it also starts anywhere else. Null text has no
    words; texts under ``window`` words are kept; a row that comes twice recurs whole; null doc_id is
    kept; an empty table gives no rows; other columns are ignored. Texts are compared by 64-bit word
    hashes and routed by 62-bit ones.
    """
    found = recurring_windows(docs, window)
    per = found.groupBy(F.col("k").alias("k2"), F.col("th").alias("th2")).agg(F.collect_list(F.struct("start", "size", "offsets")).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = _keyed(docs)
    joined = d.join(per, (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2")), "left").select("doc_id", "text", "found")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for text, found in zip(binary_column(part, "text"), part.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    if not found:
                        rows.append((len(words), 0, b" ".join(words), []))
                        continue
                    change = np.zeros(len(words) + 1, np.int64)
                    for f in found:
                        if f["offsets"] is None:
                            change[f["start"]] += 1
                            change[f["start"] + f["size"] + window - 1] -= 1
                        else:
                            starts = f["start"] + np.array(f["offsets"])
                            np.add.at(change, starts, 1)
                            np.add.at(change, starts + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    spans = [{"start": int(a), "length": int(z - a)} for a, z in zip(edges[::2], edges[1::2], strict=True)]
                    rows.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g), spans))
                n, removed, kept, spans = zip(*rows, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    out = joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary, spans array<struct<start:long,length:long>>")
    return out.withColumn("kept", F.col("kept").cast("string"))


ORACLE = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
x as (select doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) as k from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from x) where n > 1),
g as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as p, true as gone from r),
a as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
s as (select a.doc_id, count(gone) as n_removed, string_agg(word, ' ' order by a.p) filter (gone is null) as kept from a left join g on a.doc_id = g.doc_id and a.p = g.p group by a.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join s using (doc_id)
"""
