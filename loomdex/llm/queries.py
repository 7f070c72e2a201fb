"""Queries over the driver's tables, one for each operator, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomdex.llm import linededup, lm, media, minhash, mixing, packing, quality, simhash, substring, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring.dedup_substrings(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(_table(spark, sf_dir, "documents"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 on instruction data: whole conversations under limits on tokens, segments and loss-bearing tokens."""
    examples = packing.conversation_examples(_table(spark, sf_dir, "conversations"))
    return packing.pack_examples(examples, packing.CONVERSATION_LIMITS)


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's suffix array in full: the maximal repeated runs of lines."""
    return linededup.maximal_runs(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(_table(spark, sf_dir, "documents"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return d.select("doc_id", "lang", F.col("__perplexity").alias("perplexity"), F.col("__threshold").alias("threshold"), F.col("__keep").alias("keep"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_mixing": op2_mixing,
    "op3_media": op3_media,
    "op4_packing": op4_packing,
    "pack_conversations": pack_conversations,
    "op5_simhash": op5_simhash,
    "op6_linededup": op6_linededup,
    "line_runs": line_runs,
    "op7_minhash": op7_minhash,
    "op8_urlfilter": op8_urlfilter,
    "op9_lm": op9_lm,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {"op1_substring": substring.ORACLE, "op2_mixing": mixing.ORACLE, "op6_linededup": linededup.ORACLE, "op8_urlfilter": urlfilter.ORACLE}
