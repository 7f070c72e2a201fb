"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomdex.llm.common import binary_column, cut, mix64, shuffle_parts, slices, whole_runs
from loomdex.llm.graph import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets with more fingerprints than this are dealt again by bands of their other bits.
HOT = 4096
PLANES_AT_ONCE = 8
ROWS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats included); no words: 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hash_of = xxhash.xxh64_intdigest
    h = np.array([hash_of(g, SEED) for g in grams], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 * ``words`` bits over a set of shingle hashes: word j mixes each hash with a salt of its own; no hashes: zero."""
    counts = np.zeros(64 * words, np.int64)
    salts = mix64(np.arange(1, words + 1, dtype=np.uint64))
    for at in range(0, len(hashes), 2048):
        h = mix64(hashes[at : at + 2048, None] ^ salts)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): every row's SimHash as a signed long; null or empty text has fp 0. No shuffle."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 512):
            fps = np.array([fingerprint(x or b"", width) for x in binary_column(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, vertical: row b holds bit b of all fingerprints (rows of words), 64 to a word, a zero word behind."""
    n, width = fps.shape
    out = np.zeros((64 * width, -(-n // 64) + 1), np.uint64)
    for at in range(0, n, ROWS_AT_ONCE):
        part = np.ascontiguousarray(fps[at : at + ROWS_AT_ONCE])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8 * width), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        out.view(np.uint8).reshape(64 * width, -1)[:, at // 8 : at // 8 + packed.shape[1]] = packed
    return out


def _differences(planes: np.ndarray, at: np.ndarray, skip: int, shift: int) -> np.ndarray:
    """Planes XOR (planes moved by 64 * skip + shift), for the words ``at`` only."""
    last = planes.shape[1] - 1
    other = planes[:, np.minimum(at + skip, last)]
    if shift:
        other = (other >> np.uint64(shift)) | (planes[:, np.minimum(at + skip + 1, last)] << np.uint64(64 - shift))
    return planes[:, at] ^ other


def _count(counters: np.ndarray, over: np.ndarray, planes: list[np.ndarray]) -> None:
    """Carry-save addition: each plane adds 0 or 1 to 64 counters a word; ``counters`` has a row a binary digit, ``over`` what passed the last."""
    for digit in counters:
        carries = []
        while len(planes) > 1:
            x, y = planes.pop(), planes.pop()
            half = x ^ y
            carries.append((x & y) | (half & digit))
            digit ^= half
        if planes:
            x = planes.pop()
            carries.append(x & digit)
            digit ^= x
        planes = carries
    for x in planes:
        over |= x


def _passed(counters: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Where a counter is above ``radius``."""
    above, equal = over.copy(), ~np.zeros_like(over)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, root: np.ndarray | None = None):
    """Yields (i, j), arrays of positions in the same run of ``group`` at ``radius`` or fewer differing bits.

    ``fps`` are 64-bit numbers, or rows of them for longer fingerprints. Position i is compared with
    i + d for each d up to the longest run, 64 pairs to a machine word: the planes' differences
    enter carry-save counters eight at a time, and words whose pairs have all passed the radius are
    abandoned. With ``root``, which the caller keeps up, pairs of one tree are not compared.
    """
    n = len(fps)
    if not n:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    runs = np.diff(np.r_[starts, n])
    left = np.repeat(starts + runs, runs) - np.arange(n)  # rows from here to the end of the run
    planes = _planes(fps.reshape(n, -1))
    digits = max(1, radius.bit_length())
    active = np.arange(n)
    for d in range(1, int(runs.max(initial=1))):
        active = active[left[active] > d]
        if root is not None and d & (d - 1) == 0:  # at times, forget runs that are one tree already
            split = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
            active = active[np.repeat(split, runs)[active]]
        if not len(active):
            return
        asked = active if root is None else active[root[active] != root[active + d]]
        valid = np.zeros(planes.shape[1] * 64, bool)
        valid[asked] = True
        valid = np.packbits(valid, bitorder="little").view(np.uint64)
        at = np.flatnonzero(valid)
        alive = valid[at]
        counters, over = np.zeros((digits, len(at)), np.uint64), np.zeros(len(at), np.uint64)
        skip, shift = divmod(d, 64)
        for b in range(0, len(planes), PLANES_AT_ONCE):
            if not len(at):
                break
            _count(counters, over, list(_differences(planes[b : b + PLANES_AT_ONCE], at, skip, shift)))
            if b + PLANES_AT_ONCE <= radius:
                continue
            ok = alive & ~_passed(counters, over, radius)
            keep = np.flatnonzero(ok)
            if len(keep) < len(at):
                at, alive, counters, over = at[keep], ok[keep], np.ascontiguousarray(counters[:, keep]), over[keep]
            else:
                alive = ok
        if len(at):
            word, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = at[word] * 64 + bit
            yield i, i + d


def join_trees(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Links i-j put into ``root``, which names the least position of each tree."""
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def spanning(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what ``close_pairs`` connects: those that join two trees when they come."""
    root = np.arange(len(fps))
    out = []
    for i, j in close_pairs(fps, group, radius, root):
        out.append((i, j))
        join_trees(root, i, j)
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def spanning_batches(batches, read, radius: int):
    """Arrow batches (a, b) of links that connect the rows of each bucket; ``read`` gives a batch's (bucket, id, fingerprints), sorted by bucket."""
    import pyarrow as pa

    for group, ids, fps in whole_runs(batches, read, ROWS_AT_ONCE):
        i, j = spanning(fps, group, radius)
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])


def _dealt(rows: DataFrame, bits: int, radius: int) -> tuple[DataFrame, int]:
    """Rows (fp, key, rest) keyed anew by each band of the ``bits`` low bits of rest; the rest of those; how many bits that has.

    By the pigeonhole principle two rests within the radius agree in one of radius + 1 bands.
    """
    edges = [i * bits // (radius + 1) for i in range(radius + 2)]
    bands = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        band = F.expr(f"shiftrightunsigned(rest, {low}) & {(1 << high - low) - 1}")
        below = F.expr(f"rest & {(1 << low) - 1}")
        above = F.expr(f"shiftleft(shiftrightunsigned(rest, {high}), {low})") if high < 64 else F.lit(0).cast("long")
        bands.append(F.struct(F.xxhash64("key", F.lit(low), band).alias("key"), below.bitwiseOR(above).alias("rest")))
    return rows.select("fp", F.explode(F.array(*bands)).alias("to")).select("fp", "to.key", "to.rest"), bits - edges[1]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``distinct`` (fp) at 3 or fewer differing bits.

    Each fingerprint goes to four buckets by its 16-bit bands. A bucket of over HOT is dealt again
    by four bands of its other bits, and so on; a bucket whose members agree in more and more bits
    ends with few, so none is unbounded and no link is lost. A bucket streams through one task as
    longs; only a spanning set of its links leaves it.
    """
    spark = distinct.sparkSession
    keyed, bits = _dealt(distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), 64, RADIUS)
    buckets = []
    while True:
        keyed = cut(keyed)
        hot = keyed.groupBy("key").count().where(F.col("count") > HOT).select("key") if 1 << bits > HOT else None
        if hot is None or hot.isEmpty():
            buckets.append(keyed)
            break
        hot = cut(hot)
        buckets.append(keyed.join(hot, "key", "left_anti"))
        keyed, bits = _dealt(keyed.join(hot, "key", "left_semi"), bits, RADIUS)
    dealt = functools.reduce(DataFrame.union, buckets).select("key", "fp").repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "fp")

    def run(batches):
        def read(b):
            key, f = (b.column(i).to_numpy() for i in range(2))
            return key, f, f.view(np.uint64)

        yield from spanning_batches(batches, read, RADIUS)

    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links.

    Equal fingerprints are one class and are compared once. Null or empty texts have fingerprint 0;
    rows with null doc_id take part and never name a component unless nothing else can (null then).
    Repeated rows give repeated results; empty input gives no rows; other columns are ignored.
    """
    f = cut(fingerprints(docs, width=width))
    least = f.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(links(least.select("fp")))
    named = least.join(tree, least.fp == tree.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return f.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
