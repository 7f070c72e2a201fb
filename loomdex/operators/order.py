"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loomdex.operators.storage import kept


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` plus ``row``, from 0 in the order of ``by`` (unique): ranges are sorted apart, and a prefix sum
    over one count a range gives each its first number."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if dict(df.dtypes)[by] == "string":
        # written once, so that the ranges of both uses are the same ones
        d = kept(df.repartitionByRange(parts, by).withColumn("__part", F.spark_partition_id()))
    else:
        bounds = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0]
        splits = F.array(*(F.lit(b) for b in sorted(set(bounds or [0]))))
        d = df.withColumn("__part", F.size(F.filter(splits, lambda s: s < F.col(by))))
    counts = d.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__first"))
    inside = d.withColumn("__rn", F.row_number().over(W.partitionBy("__part").orderBy(by)))
    return inside.join(F.broadcast(first), "__part").select(*df.columns, (F.col("__first") + F.col("__rn") - 1).alias("row"))  # at most one row a shuffle partition
