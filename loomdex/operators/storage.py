"""Where intermediate tables go: the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, made the session's checkpoint folder; a temporary one only where none is named and Spark runs on this machine alone."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if now.isEmpty():
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="loomdex-"))
    return (where or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
