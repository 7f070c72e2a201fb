"""Content-hash cache: hits and misses, chunk deltas, upserts, branch state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def partition_by_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` (path, content_hash, ...) plus ``cached``. Empty hashes never hit. The requested path stays,
    whatever path the cached entry was made for, so files with equal bytes all keep their rows."""
    known = cache.where("content_hash <> ''").select("content_hash", F.lit(True).alias("cached")).distinct()
    return files.join(known, "content_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def chunk_delta(chunk: DataFrame, previous: DataFrame) -> DataFrame:
    """``chunk`` plus ``reused`` and ``prior_result``: the entry of the former version of the file with the same
    chunk hash, the last by index where there are several. previous: (path, chunk_hash, chunk_index, result)."""
    prior = previous.groupBy("path", F.col("chunk_hash").alias("content_hash")).agg(F.max_by("result", "chunk_index").alias("prior_result"), F.lit(True).alias("reused"))
    return chunk.join(prior, ["path", "content_hash"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, key: str, newest: str) -> DataFrame:
    """The union with one row a key, the last by ``newest``; rows with an empty or null key are dropped."""
    both = table.unionByName(rows, allowMissingColumns=True).where(F.col(key).isNotNull() & (F.col(key) != ""))
    rest = [c for c in both.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), newest).alias("r"))
    return last.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge_branch(state: DataFrame, updates: DataFrame, deleted: DataFrame) -> DataFrame:
    """(path, content_hash) of a branch after updates, without what is deleted."""
    s, u = state.select("path", F.col("content_hash").alias("old")), updates.select("path", F.col("content_hash").alias("new"))
    return s.join(u, "path", "full").select("path", F.coalesce("new", "old").alias("content_hash")).join(deleted.select("path"), "path", "left_anti")


def merge_contexts(existing: DataFrame, fresh: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """Contexts after an update: fresh ones, and former ones of paths that are not deleted and have no fresh one.

    A changed file whose analysis failed has no fresh context and keeps the former one.
    """
    kept = existing.join(deleted.select("path"), "path", "left_anti").join(fresh.select("path"), "path", "left_anti")
    return kept.unionByName(fresh.join(deleted.select("path"), "path", "left_anti"), allowMissingColumns=True)
