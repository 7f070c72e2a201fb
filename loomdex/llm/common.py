"""Shared helpers: storage that every executor sees, word rules, Arrow plumbing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomdex.operators.storage import checkpoint_dir

#: A word is a run of anything but ASCII white space; ``bytes.split()`` follows the same rule.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir."""
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends, executors may be lost."""
    path = f"{shared_dir(df.sparkSession)}/loomdex-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words; null text has none. Each word becomes one letter, so no array of words is built."""
    letters = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_column(batch, name: str) -> list:
    """A string column of an Arrow batch as bytes, without decoding it."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches, rows: int):
    """Arrow batches in parts of at most ``rows`` rows, so that copies made of a part stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_runs(batches, read, rows: int):
    """Tuples of arrays of at least ``rows`` rows (the last: fewer) that never divide a run of equal values of the first array.

    ``read`` makes such a tuple of an Arrow batch. A run longer than ``rows`` is gathered whole, in steps that double.
    """
    parts, size, least = [], 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        parts.append(read(b))
        size += b.num_rows
        if size >= least:
            whole = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            group = whole[0]
            at = int(np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[-1])
            if at:
                yield tuple(x[:at] for x in whole)
            parts, size = [tuple(x[at:] for x in whole)], size - at
            least = max(rows, 2 * size)
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def bit_of(bits: Column, at: Column) -> Column:
    """Bit ``at`` (from 0) of a bitmap of Spark's bitmap functions; false outside it or where it is null."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def prefix_counts(counts: DataFrame, *names: str) -> DataFrame:
    """Rows (names, n), distinct in their names, plus ``before``: the sum of n of all rows before in their order, without a single-task sort."""
    parts = shuffle_parts(counts.sparkSession)
    d = cut(counts.select(*names, "n").repartitionByRange(parts, *names).select(*names, "n", F.spark_partition_id().alias("part")))
    sums = d.groupBy("part").agg(F.sum("n").alias("s"))
    first = sums.select("part", (F.sum("s").over(W.orderBy("part")) - F.col("s")).alias("first"))
    inside = W.partitionBy("part").orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    d = d.select(*names, "n", "part", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    return d.join(F.broadcast(first), "part").select(*names, "n", (F.col("first") + F.col("inside")).alias("before"))  # at most one row a shuffle partition


def dense_ranks(keys: DataFrame, *names: str) -> DataFrame:
    """Distinct rows ``names`` plus ``rank``, from 0 in their order, without a single-task sort.

    Ranges are sorted apart; a range's first rank comes from a prefix sum over one count a range.
    """
    parts = shuffle_parts(keys.sparkSession)
    d = cut(keys.select(*names).repartitionByRange(parts, *names).select(*names, F.spark_partition_id().alias("part")))
    counts = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    inside = d.select(*names, "part", F.row_number().over(W.partitionBy("part").orderBy(*names)).alias("rn"))
    return inside.join(F.broadcast(first), "part").select(*names, (F.col("first") + F.col("rn") - 1).alias("rank"))  # at most one row a shuffle partition
