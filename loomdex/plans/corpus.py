"""The driver's tables seen as a source tree: files, symbols, specifiers, edges, calls, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomdex.functions import text as T
from loomdex.operators import graph

KINDS = ("class", "function", "method", "interface", "struct")
EXT_OF_LANG = {"en": ".ts", "fr": ".py", "de": ".rs", "es": ".java"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(source: Column, lang: Column, doc_id: Column) -> Column:
    return F.concat(source, F.lit("/"), lang, F.lit("/doc_"), doc_id.cast("string"), T.lookup(lang, EXT_OF_LANG, ".txt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document."""
    d = table(spark, sf_dir, "documents")
    path = path_of(F.col("source"), F.col("lang"), F.col("doc_id"))
    return d.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"), F.col("doc_id").alias("seq")).withColumn("language", T.language_of(F.col("path")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, dealt over all cores where the scan has fewer parts than there are cores (one small file is one part).

    A large table has parts enough and is not moved.
    """
    f, cores = files(spark, sf_dir), spark.sparkContext.defaultParallelism
    return f.repartition(cores) if f.rdd.getNumPartitions() < cores else f


def symbols(f: DataFrame) -> DataFrame:
    """Every third line, from the second, declares its first word."""
    lines = f.select("path", "seq", F.posexplode(F.split("content", "\n", -1)).alias("idx", "text"))
    word = F.regexp_extract("text", r"([^ \t]+)", 1)
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.floor(F.col("idx") / 3) % len(KINDS) + 1).cast("int"))
    return lines.where((F.col("idx") % 3 == 1) & (word != "")).select("path", "seq", F.floor(F.col("idx") / 3).cast("int").alias("pos"), word.alias("name"), kind.alias("kind"), (F.col("idx") + 1).alias("line"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relative specifiers a file, without extension: documents (7 i + 1) and (3 i + 2) modulo their number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    n = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    want = d.select(path_of(F.col("source"), F.col("lang"), F.col("doc_id")).alias("src"), F.posexplode(F.array((F.col("doc_id") * 7 + 1) % n, (F.col("doc_id") * 3 + 2) % n)).alias("pos", "to"))
    spec = F.concat(F.lit("../../"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("to").cast("string"))
    return want.join(d, F.col("to") == F.col("doc_id")).select("src", "pos", spec.alias("spec"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.import_edges(specs(spark, sf_dir), files(spark, sf_dir).select("path", "seq"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: the provider is the event's type; every third call tells a total only."""
    e = table(spark, sf_dir, "events")
    tokens, whole = (F.col("value") * 100).cast("long"), F.col("event_id") % 3 == 0
    return e.select(
        "event_id", "ts", F.col("event_type").alias("provider"), F.when(~whole, tokens).alias("input_tokens"), F.when(~whole, F.floor(tokens / 2)).alias("output_tokens"),
        F.when(whole, tokens).alias("tokens_used"), F.get_json_object("props", "$.k").cast("long").alias("duration_ms"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) tables (path, content_hash): old lacks every tenth document; new has every seventh altered and lacks every thirteenth."""
    f = files(spark, sf_dir)
    old = f.where("seq % 10 <> 0").select("path", T.content_hash(F.col("content")).alias("content_hash"))
    changed = F.when(F.col("seq") % 7 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    return old, f.where("seq % 13 <> 5").select("path", T.content_hash(changed).alias("content_hash"))
