"""Document fingerprints: one-permutation MinHash, optimal densification, packed b-bit values."""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomdex.llm.common import mix64, shuffle_parts

BINS = 512
BITS = 4  # one hexadecimal digit a bin
SHINGLE = 5
TRIES = 4096  # rows of the densification table


_SALTS = mix64(np.arange(1, BINS + 1, dtype=np.uint64))


@functools.cache
def _probes() -> np.ndarray:
    """For try t and empty bin i, the bin to borrow from: a universal hash of (i, t), the same for every document."""
    at = np.arange(TRIES * BINS, dtype=np.uint64) + np.uint64(0x5DEECE66D)
    return (mix64(at * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(TRIES, BINS)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's word shingles; fewer words: the whole sequence is one; no words: one fixed shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in text.split()], np.uint64)
    n = min(len(w), width)
    h = np.full(max(1, len(w) - n + 1) if n else 1, n + 1, np.uint64)
    for k in range(n):
        h = mix64((h * np.uint64(0x9E3779B97F4A7C15)) ^ w[k : len(w) - n + 1 + k])
    return h


def sketch(hashes: np.ndarray) -> str:
    """BINS hexadecimal digits: four bits of each bin's least hash, empty bins filled by borrowing.

    The bits are drawn by a hash of the bin's own, so that two different values that fill many bins
    agree in a sixteenth of them, not in all or none.
    """
    h = np.sort(hashes)
    bins = (h >> np.uint64(55)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    value = np.zeros(BINS, np.uint64)
    value[bins[first]] = h[first]
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    probes = _probes()
    for at in range(0, TRIES, 64):
        if not len(empty):
            break
        tried = probes[at : at + 64, empty]
        hit = full[tried]
        some = hit.any(axis=0)
        value[empty[some]] = value[tried[hit.argmax(axis=0)[some], np.flatnonzero(some)]]
        empty = empty[~some]
    if len(empty):  # hardly ever: the nearest full bin to the right
        right = np.flatnonzero(full)
        value[empty] = value[right[np.searchsorted(right, empty) % len(right)]]
    digits = (mix64(value + _SALTS) >> np.uint64(64 - BITS)).astype(np.uint8)
    return (digits[::2] << 4 | digits[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Jaccard estimate from two sketches, without the agreement that 4-bit values have by chance; 0 to 1."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    d = x ^ y
    same = (np.count_nonzero((d >> 4) == 0) + np.count_nonzero((d & 15) == 0)) / BINS
    chance = 1 / (1 << BITS)
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprint(text: str | bytes | None) -> str:
    return sketch(shingle_hashes(text.encode() if isinstance(text, str) else text or b""))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; null text counts as empty. No shuffle."""
    from loomdex.llm.common import binary_column

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x) for x in binary_column(b, "text")], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (p, halo, doc_id, text), one range of doc_id a partition, each sorted by falling doc_id.

    A range ends with the first row of the next lower one (halo), the lowest with the highest
    of all, so each row's next is the row below it in its own partition: texts move once.
    Range bounds are approximate quantiles; a doc_id that is several of them (null, say) is cut
    into ranges of a text hash. Bounds and one highest row a range are all the driver sees, at
    most two a shuffle partition. Null doc_id comes last; rows of one doc_id follow by that hash.
    """
    parts = shuffle_parts(docs.sparkSession)
    least, most = -(1 << 63), (1 << 63) - 1
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("k"), "doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    found = Counter(d.agg(F.percentile_approx("k", [(i + 1) / parts for i in range(parts - 1)] or [0.5], 10000)).first()[0] or [])
    bounds = [(k, t) for k, n in sorted(found.items()) for t in ([*(least + j * (1 << 64) // n for j in range(n)), most] if n > 1 else [most])]
    at = lambda k, t, *more: F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t"), *more)
    below = lambda s: (s["k"] < F.col("k")) | ((s["k"] == F.col("k")) & (s["t"] < F.col("th")))
    part = F.size(F.filter(F.array(*(at(*b) for b in bounds)), below)) if bounds else F.lit(0)
    tops = sorted((r[0], tuple(r[1])) for r in d.groupBy(part.alias("p")).agg(F.max(F.struct("k", "th"))).collect())
    send = F.array(*(at(*top, F.lit(p).alias("p")) for (p, _), (_, top) in zip(tops, [*tops[-1:], *tops[:-1]], strict=True))) if tops else None
    none = F.array().cast("array<struct<p:int,halo:boolean>>")
    halo = none if send is None else F.transform(F.filter(send, lambda s: (s["k"] == F.col("k")) & (s["t"] == F.col("th"))), lambda s: F.struct(s["p"].alias("p"), F.lit(True).alias("halo")))
    placed = d.select("k", "th", "doc_id", "text", F.explode(F.concat(F.array(F.struct(part.alias("p"), F.lit(False).alias("halo"))), halo)).alias("to"))
    placed = placed.select(F.col("to.p").alias("p"), F.col("to.halo").alias("halo"), "k", "th", "doc_id", "text")
    return placed.repartitionById(max(parts, len(bounds) + 1), "p").sortWithinPartitions("p", "halo", F.desc("k"), F.desc("th")).drop("k", "th")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is that of the next lower doc_id (after the last: the first; alone: itself).
    Null or empty text: the fingerprint of no words. Rows that share a doc_id follow by a hash of
    their text; doc_id is an integer;
    repeated rows are documents of their own; empty input gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        import hashlib

        import pyarrow as pa

        last = None
        for b in batches:
            rows, id_type = [], b.schema.field("doc_id").type
            for p, halo, doc_id, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("p", "halo", "doc_id", "text")), strict=True):
                if halo and (last is None or last[0] != p):
                    continue
                own = fingerprint(text)
                if last is not None and last[0] == p:
                    _, at, before, mark = last
                    n = len(before)
                    edited = (before[: n - n // 2] + text[: n // 2]).encode()
                    new = fingerprint(edited)
                    rows.append((at, n, hashlib.sha256(edited).hexdigest(), mark, new, likeness(mark, new), likeness(mark, own)))
                last = None if halo else (p, doc_id, text, own)
            if rows:
                kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return with_next(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
