"""Structured Streaming forms of the change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomdex.operators.cache import upsert
from loomdex.sources.files import Settings, below, keep_source


def bursts(events: DataFrame, key: str, gap: str = "3 seconds", delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """(key, start, fires_at, n): a burst closes ``gap`` after its last event; late events are waited for ``delay``."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, delay).groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("fires_at"), "n")


def keep_current(stream: DataFrame, path: str, checkpoint: str, key: str = "path", newest: str = "ts", each: Callable[[DataFrame, int], None] | None = None):
    """A running query that folds (key, newest, ...) rows into the table at ``path``, one row a key.

    Each batch writes a new version next to the old one and names it in a file of its own, so a
    batch that is run again gives the same table.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, path, below=number)
        rows = upsert(before if before is not None else batch.limit(0), batch, key, newest)
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")
        if each:
            each(batch, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version, or the newest before batch ``below``; None without one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [n for n in done if below is None or n < below]
    return spark.read.parquet(f"{path}/v={max(done)}") if done else None


def limited(events: DataFrame, key: str, limit: int, window_ms: int = 60_000, ts: str = "ts") -> DataFrame:
    """(key, ts, allowed) for a stream: at most ``limit`` allowed events of a key in any window, in order of arrival.

    The state of a key is the times of its allowed events in the last window: ``limit`` numbers.
    """

    def step(k, frames, state):
        import pandas as pd

        taken = list(state.get[0]) if state.exists else []
        for f in frames:
            rows = []
            for t in sorted(f[ts]):
                at = t.value // 1_000_000
                taken = [x for x in taken if at - x < window_ms]
                ok = len(taken) < limit
                taken += [at] if ok else []
                rows.append((k[0], t, ok))
            yield pd.DataFrame(rows, columns=[key, ts, "allowed"])
        state.update((taken,))

    kind = dict(events.dtypes)[key]
    return events.select(key, ts).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, allowed boolean", "taken array<long>", "append", "NoTimeout")


def file_changes(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """A stream (path, content, ts) of files below ``root`` as they are created or written anew; deletions are not seen by a file source."""
    glob = "*{" + ",".join(settings.extensions) + "}"
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    d = raw.select(below(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("ts"))
    return keep_source(d, settings)


class Restartable:
    """A stream that is built from settings and built anew when they change; it goes on from its own checkpoint."""

    def __init__(self, build: Callable[[Settings], object]):
        self.build, self.settings, self.query = build, None, None

    def apply(self, settings: Settings) -> bool:
        """Starts, or stops and starts again where ``settings`` differ; without auto_update there is no stream. True where something was done."""
        if settings == self.settings:
            return False
        self.stop()
        self.settings = settings
        self.query = self.build(settings).start() if settings.auto_update else None
        return True

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query.awaitTermination()
        self.query = None


def poll(spark: SparkSession, probe: Callable[[], tuple[str, str]], act: Callable[[str, str, str], None], checkpoint: str, every: str = "5 seconds"):
    """Asks ``probe`` for (branch, commit) at each tick and tells ``act`` (kind, branch, commit) what changed: 'branch' or 'commit'."""
    last: list[tuple[str, str]] = []

    def tick(_batch: DataFrame, _number: int) -> None:
        now = probe()
        if last and now != last[0]:
            act("branch" if now[0] != last[0][0] else "commit", *now)
        last[:] = [now]

    return spark.readStream.format("rate").load().writeStream.foreachBatch(tick).trigger(processingTime=every).option("checkpointLocation", checkpoint)
