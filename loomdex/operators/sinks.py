"""Publishing: versioned folders, Markdown, JSON and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomdex.operators.index import markdown

MARKS = "_versions"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of the store that ``path`` lies in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _marks(spark: SparkSession, root: str) -> list[str]:
    fs, p = _folder(spark, f"{root}/{MARKS}")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def publish(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Writes every table below root/version, then an empty mark that sorts last. Nothing is deleted or replaced that a
    reader may look at: readers take the version of the last mark, so they see a whole one at any time."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    number = max((int(m.split("-", 1)[0]) for m in _marks(spark, root)), default=0) + 1
    fs, p = _folder(spark, f"{root}/{MARKS}/{number:012d}-{version}")
    fs.create(p, False).close()


def latest_version(spark: SparkSession, root: str, but: str | None = None) -> str:
    """The version last published (other than ``but``); LookupError where there is none."""
    names = [m.split("-", 1)[1] for m in _marks(spark, root)]
    names = [n for n in names if n != but]
    if not names:
        raise LookupError(f"nothing is published below {root}")
    return names[-1]


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{latest_version(spark, root)}/{name}")


def write_files(rows: DataFrame, root: str) -> None:
    """One file a row (path, text) below ``root``, written where the row is; an existing file is replaced.

    ``root`` is an address that Arrow's file systems know: a path, file:, hdfs:, s3: and the like.
    """

    def run(batches):
        import os

        from pyarrow import fs

        where, base = (fs.LocalFileSystem(), root) if "://" not in root and not root.startswith("file:") else fs.FileSystem.from_uri(root)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = f"{base.rstrip('/')}/{path}"
                where.create_dir(os.path.dirname(target), recursive=True)
                with where.open_output_stream(target) as f:
                    f.write((text or "").encode())
            yield b.slice(0, 0)

    rows.select("path", "text").mapInArrow(run, "path string, text string").foreach(lambda _: None)


def context_file(path: Column) -> Column:
    return F.concat(F.lit("context/"), path, F.lit(".md"))


def write_markdown(contexts: DataFrame, root: str) -> None:
    """context/<path>.md below ``root`` for each context."""
    write_files(contexts.select(context_file(F.col("path")).alias("path"), markdown().alias("text")), root)


def markdown_rows(contexts: DataFrame) -> DataFrame:
    return contexts.select("path", markdown().alias("markdown"))


def json_rows(df: DataFrame, pretty: bool = True) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()}).alias("value"))
