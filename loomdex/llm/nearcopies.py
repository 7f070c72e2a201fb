"""Near copies by SimHash: bit-sliced comparison of wide fingerprints finds candidates, exact Jaccard counts decide.

The 64 bits and radius of 3 of ``simhash.classes`` are far too strict for a similarity of 0.8, where
15 % of the bits differ. Here fingerprints have 256 bits and a radius to match, and a bucket is named
by a band of least shingle hashes: bands of fingerprint bits would fill up by chance as a corpus
grows, these only hold texts that share shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from loomdex.llm.common import binary_column, cut, mix64, shuffle_parts, slices, whole_runs
from loomdex.llm.graph import components
from loomdex.llm.minhash import shingle_hashes
from loomdex.llm.simhash import join_trees, spanning_batches, wide_fingerprint

SHINGLE = 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
#: A pair at 0.8 shares no band with probability (1 - 0.8^4)^24, 3 in a million.
BANDS, ROWS = 24, 4
#: 64-bit words of a fingerprint. Of 256 bits a pair at 0.8 differs in 39 on average, with a deviation of 6.
WORDS = 4
RADIUS = 68
#: Candidate groups of more texts, or more shingles, are dealt as pairs of blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 20

_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text's word shingles (A-Z lower-cased) as sorted hashes."""
    return np.unique(shingle_hashes((text or b"").lower(), SHINGLE))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Names of the buckets of a set: each band joins ROWS least values."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in mix64(least).reshape(BANDS, ROWS).T:
        keys = mix64((keys * np.uint64(0x9E3779B97F4A7C15)) ^ row)
    return keys.view(np.int64)


def marks(docs: DataFrame) -> DataFrame:
    """``docs`` plus __row (a number of the row), __sig (equal shingle sets have one), __bands, __fp, __n (shingles). No shuffle."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in slices(batches, 512):
            sigs, keys, fps, counts = [], [], [], []
            for text in binary_column(b, "text"):
                h = shingles(text)
                sigs.append(xxhash.xxh64_intdigest(h.tobytes()))
                keys.append(band_keys(h))
                fps.append(wide_fingerprint(h, WORDS).tobytes())
                counts.append(len(h))
            n = len(sigs)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys) if n else np.zeros(0, np.int64)))
            made = [pa.array(np.array(sigs, np.uint64).view(np.int64)), bands, pa.array(fps, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "__sig", "__bands", "__fp", "__n"])

    d = docs.select("*", F.monotonically_increasing_id().alias("__row"))
    new = [StructField("__sig", LongType()), StructField("__bands", ArrayType(LongType())), StructField("__fp", BinaryType()), StructField("__n", LongType())]
    return d.mapInArrow(run, StructType([*d.schema.fields, *new]))


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b): links that connect all of ``sets`` (sig, bands, fp) that share a band and differ in RADIUS bits or fewer.

    Sets without a partner in any band drop out as two longs a band; fingerprints follow for the
    others only. A bucket streams through one task; only a spanning set of its links leaves it.
    """
    parts = shuffle_parts(sets.sparkSession)
    keyed = sets.select("sig", F.explode("bands").alias("key")).repartition(parts, "key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = keyed.join(shared, "key", "left_semi").join(sets.select("sig", "fp"), "sig")
    dealt = members.select("key", "sig", "fp").repartition(parts, "key").sortWithinPartitions("key", "sig")

    def run(batches):
        def read(b):
            fps = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
            return b.column(0).to_numpy(), b.column(1).to_numpy(), fps

        yield from spanning_batches(batches, read, RADIUS)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect the sets with a similarity of LEAST or more; all pairs are counted exactly.

    Shingles of one set only cannot be shared; the others make a 0/1 matrix, in strips, whose product
    with itself holds the sizes of all intersections.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = counts[ids] > 1
    order = np.argsort(ids[some], kind="stable")
    owner, ids = owner[some][order], ids[some][order]
    column = np.cumsum(np.r_[False, ids[1:] != ids[:-1]]) if len(ids) else ids
    both = np.zeros((m, m), np.float32)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        strip = np.zeros((m, min(width, int(column[b - 1]) + 1 - first)), np.float32)
        strip[owner[a:b], column[a:b] - first] = 1
        both += strip @ strip.T
    close = both * LEAST[1] >= (sizes[:, None] + sizes - both) * LEAST[0]
    i, j = np.nonzero(np.triu(close, 1))
    root = np.arange(m)
    join_trees(root, i, j)
    i = np.flatnonzero(root != np.arange(m))
    return i, root[i]


def links(members: DataFrame) -> DataFrame:
    """(a, b): links that connect the texts of each candidate group, ``members`` (root, sig, n, text), at LEAST or more.

    A group goes to one task; one of many texts or shingles is cut into blocks, and each pair of
    blocks goes to a task of its own, so that no task holds more than two blocks.
    """
    parts = shuffle_parts(members.sparkSession)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = members.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")
    cut_up = members.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    dealt = cut_up.select("root", "sig", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "sig", "text")
    keyed = keyed.repartition(parts, "key").sortWithinPartitions("key", "sig")

    def run(batches):
        import pyarrow as pa

        def read(b):
            texts = np.empty(b.num_rows, object)
            texts[:] = binary_column(b, "text")
            return b.column(0).to_numpy(), b.column(1).to_numpy(), texts

        for key, sig, texts in whole_runs(slices(batches, 512), read, 512):
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            found = [np.zeros((2, 0), np.int64)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1:
                    i, j = linked([shingles(t) for t in texts[lo:hi]])
                    found.append(np.stack([sig[lo + i], sig[lo + j]]))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marked rows, and (sig, root) of all their sets."""
    f = cut(marks(docs))
    sets = cut(f.groupBy(F.col("__sig").alias("sig")).agg(F.min(F.struct("__row", "__bands", "__fp")).alias("one")).select("sig", "one.*"))
    weak = components(candidates(sets.select("sig", F.col("__bands").alias("bands"), F.col("__fp").alias("fp"))))
    asked = weak.join(sets.select(F.col("sig").alias("node"), "__row"), "node")
    members = f.join(asked, "__row").select("root", F.col("node").alias("sig"), F.col("__n").alias("n"), "text")
    tree = components(links(cut(members)))
    return f, sets.select("sig").join(tree, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): component_id is the least doc_id reachable over links of LEAST or more.

    Null or empty texts, and texts of one word sequence shorter than a shingle, are equal sets. Rows with
    null doc_id take part and name a component only where nothing else can. Repeated rows give
    repeated results; empty input gives no rows.
    """
    f, named = _classes(docs)
    f = f.select("doc_id", F.col("__sig").alias("sig"))
    least = f.groupBy("sig").agg(F.min("doc_id").alias("least")).join(named, "sig")
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return f.join(least.join(names, "root").select("sig", "component_id"), "sig").select("doc_id", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` a class, that of the least doc_id (null last); of rows that share it, any one. Columns named __* are reserved.

    Null and empty texts are one class. Repeated rows and rows without doc_id are rows like others,
    so exactly one stays of a class whatever its ids; empty input gives no rows.
    """
    f, named = _classes(docs)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    least = f.groupBy(F.col("__sig").alias("sig")).agg(F.min(at).alias("at")).join(named, "sig")
    kept = least.groupBy("root").agg(F.min("at").alias("at")).select("at.__row")
    return f.join(kept, "__row", "left_semi").select(*docs.columns)
