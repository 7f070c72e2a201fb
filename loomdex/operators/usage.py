"""Usage: calls added up, runs by provider, averages, sliding windows, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WINDOW_MS = 60_000
WAIT_BUFFER_MS = 500
RECENT = 20


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp as it reads, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def tally_calls(calls: DataFrame, *by: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """Calls, time and tokens: input and output where a call tells either, else its total as unsplit."""
    split = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("request_count"), total("duration_ms").alias("total_duration_ms"), total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"), total(F.when(~split, F.col("tokens_used"))).alias("unsplit_tokens"), *more,
    )


def by_provider(runs: DataFrame) -> DataFrame:
    """Sums over runs; provider figures are derived, not kept as counters."""
    names = ("input_tokens", "output_tokens", "unsplit_tokens", "request_count", "files_analyzed", "files_from_cache", "errors", "duration_ms")
    return runs.groupBy("provider").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.max("ts").alias("last_used"))


def averages(providers: DataFrame, workflow_runs: Column) -> DataFrame:
    """Totals and averages over all runs, whoever the provider; 0 without runs; halves are rounded up."""
    mean = lambda x: F.coalesce(F.round(x / F.nullif(workflow_runs, F.lit(0))), F.lit(0)).cast("long")
    c = F.col
    return providers.select(
        "provider", "input_tokens", "output_tokens", (c("input_tokens") + c("output_tokens") + c("unsplit_tokens")).alias("total_tokens"), "request_count",
        mean(c("input_tokens")).alias("avg_input_tokens"), mean(c("output_tokens")).alias("avg_output_tokens"),
        mean(c("files_analyzed") + c("files_from_cache")).alias("avg_files"), (F.round(c("duration_ms") / 60000 * 10) / 10).alias("duration_min"),
    )


def recent_runs(runs: DataFrame, most: int = RECENT) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("seq")).limit(most)


def duration_text(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def tokens_text(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%.1fK", F.round(n / 1000, 1))).otherwise(n.cast("string"))


def errors_text(n: Column) -> Column:
    return F.when(n > 0, n.cast("string")).otherwise(F.lit("–"))


def in_window(events: DataFrame, key: str, ts: str = "ts", window_ms: int = WINDOW_MS, block_windows: int = 60) -> DataFrame:
    """``events`` plus ``in_window``: acquisitions of the key in the window that ends with each; one that is as old as the window is out.

    A key's time is cut into blocks of ``block_windows`` windows, and events of a block's last window go to the next
    block too, so a key with very many events is counted in many tasks.
    """
    window = window_ms * 1000
    size = window * block_windows
    d = events.withColumn("__at", micros(ts)).withColumn("__own", F.floor(F.col("__at") / size))
    late = F.col("__at") >= (F.col("__own") + 1) * size - window
    d = d.withColumn("__block", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    w = W.partitionBy(key, "__block").orderBy("__at").rangeBetween(-(window - 1), 0)
    return d.withColumn("in_window", F.count(F.lit(1)).over(w)).where("__block = __own").select(*events.columns, "in_window")


def wait_ms(age_ms: Column, window_ms: int = WINDOW_MS) -> Column:
    return F.greatest(F.lit(window_ms) - age_ms + WAIT_BUFFER_MS, F.lit(0))


def request_estimate(plan: DataFrame, rpm: int) -> DataFrame:
    """(batches, large, requests, minutes) of a batch plan (is_small, batch)."""
    d = plan.agg(F.count_distinct("batch").alias("batches"), F.coalesce(F.sum((~F.col("is_small")).cast("long")), F.lit(0)).alias("large"))
    return d.select("batches", "large", (F.col("batches") + F.col("large")).alias("requests"), F.ceil((F.col("batches") + F.col("large")) / rpm).alias("minutes"))


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """(key, start, fires_at, n): bursts of events that end ``gap`` after their last one."""
    w = F.session_window(ts, gap)
    return events.groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("fires_at"), "n")


def run_record(calls: DataFrame, provider: str, *by: str) -> DataFrame:
    """One run's row for the history (with ``by``: several): provider, request_count, duration_ms, tokens, errors (calls that failed)."""
    t = tally_calls(calls, *by, more=(F.count("error").alias("errors"),))
    return t.withColumnRenamed("total_duration_ms", "duration_ms").withColumn("provider", F.lit(provider))


def append_runs(runs: DataFrame, path: str) -> None:
    """History is append-only and unbounded; displays take the last of it."""
    runs.write.mode("append").parquet(path)


def reset_runs(runs: DataFrame, path: str) -> None:
    runs.limit(0).write.mode("overwrite").parquet(path)
