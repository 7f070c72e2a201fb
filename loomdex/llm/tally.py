"""Sharded tallies: counts of 62-bit keys folded in each task, merged by key range, kept as mapped files."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomdex.llm import eliasfano as ef
from loomdex.llm.common import shared_dir

HASH_BITS = 62
#: A tally folds when so many keys have come in since the last time.
FOLD_AT = 4_000_000
ROWS = "shard int, keys binary, counts binary"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a plain path: workers map files there."""
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"files are mapped: spark.checkpoint.dir must be a mounted shared folder, not {where.geturl()}")
    folder = f"{where.path}/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together: what sorted numbers share becomes runs that Spark's compression removes."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def plain(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def add(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in pairs])
    counts = np.concatenate([c for _, c in pairs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[first], np.add.reduceat(counts, first)) if len(keys) else (keys, counts)


class Tally:
    """Sums of counts by key, folded together whenever enough has come in, so that memory follows the distinct keys."""

    def __init__(self):
        self.done, self.new, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.size += len(keys)
        if self.size > FOLD_AT:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        parts = self.done + self.new
        self.done = [add(parts)] if parts else []
        self.new, self.size = [], 0
        return self.done[0] if self.done else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Files:
    """Where the shards lie, and the mapped ones of this process."""

    _open: dict[str, dict[str, np.ndarray]] = {}

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def path(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}-{shard}"

    def has(self, kind: str, shard: int) -> bool:
        return self.path(kind, shard) in self._open or os.path.exists(self.path(kind, shard))

    def open(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        path = self.path(kind, shard)
        if path not in self._open:
            if len(self._open) > 4096:
                self._open.clear()
            self._open[path] = ef.load(path)
        return self._open[path]


def deal(shard: np.ndarray, shards: int, keys: np.ndarray, counts: np.ndarray):
    """ROWS of a folded tally, one a shard; ``shard`` rises with ``keys``."""
    import pyarrow as pa

    bounds = np.searchsorted(shard, np.arange(shards + 1))
    for s in range(shards):
        a, b = bounds[s], bounds[s + 1]
        if a < b:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([planes(keys[a:b])]), pa.array([planes(counts[a:b].astype(np.uint64))])], ["shard", "keys", "counts"])


def merge(table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of one shard's rows (a pandas frame of ROWS)."""
    return add([(plain(k, np.uint64), plain(c, np.uint64).astype(np.int64)) for k, c in zip(table["keys"], table["counts"], strict=True)])


def by_shard(rows: DataFrame, shards: int, fn, schema: str) -> DataFrame:
    """``fn(key, frame)`` for each ``shard`` of ``rows``, one partition a shard, so that no two large ones meet in a task."""

    def run(frames):
        import pandas as pd

        parts = [f for f in frames if len(f)]
        if parts:
            table = pd.concat(parts, ignore_index=True)
            yield fn((table["shard"].iloc[0],), table)

    return rows.repartitionById(shards, F.col("shard").cast("int")).mapInPandas(run, schema)
