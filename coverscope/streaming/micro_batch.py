"""Incremental batches, event-time windows, and a limiter of requests, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from coverscope.sources.sinks import write_run

#: How long after its time a batch may come: eight steps of 15 minutes.
LATENESS = "120 minutes"
LIMIT, WINDOW = 120, "60 seconds"
#: Triggers for which a batch that was passed on can still get files.
KEPT_TRIGGERS = 8
#: The steps of time that windows are put together from.
PANE = "15 minutes"
#: What the limiter's state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 3) -> DataFrame:
    """Landed Parquet files as a stream, some at a time; coherent puts the files of a batch together."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Folder:
    """A folder of small marks and partitions on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._of = path.rstrip("/"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._fs.exists(self._of(f"{self.path}/{name}"))

    def mark(self, name: str) -> None:
        self._fs.create(self._of(f"{self.path}/{name}"), True).close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._of(f"{self.path}/{name}"), True)

    def names(self, name: str = "") -> list[str]:
        at = self._of(f"{self.path}/{name}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []


def coherent(each: Callable[[DataFrame, int], None], folder: str, parts: int = 3, keep: int = KEPT_TRIGGERS) -> Callable[[DataFrame, int], None]:
    """Passes on whole batches: the rows of each batch_id once all its `parts` kinds have come, in whatever triggers; again and whole when more of it comes, for `keep` triggers after that. `each` must bear a replay.

    Rows have batch_id and kind. In `folder` are: pending, the rows by batch and trigger; passed, which batches a trigger passed on; closed, a mark for each batch that was; late, rows that came for closed ones. A trigger reads the
    batches that it brings and no others, and closes those that were passed on `keep` triggers before, whose rows go; so it takes as long after a thousand batches as at first. A trigger that is done again
    writes the same, finds the same (what it needs isn't removed before it is committed), and passes on the same.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")

    def close(spark: SparkSession, n: int) -> None:
        """Closes batches that the triggers before n - keep passed on, and none since."""
        passed, pending, closed = Folder(spark, f"{folder}/passed"), Folder(spark, f"{folder}/pending"), Folder(spark, f"{folder}/closed")
        triggers = {t: passed.names(t) for t in passed.names()}
        since = {b for t, names in triggers.items() if int(t) >= n - keep for b in names}
        for t, names in triggers.items():
            if int(t) < n - keep:
                for b in set(names) - since:
                    closed.mark(b)
                    pending.remove(f"batch_id={b}")
                passed.remove(t)

    def handle(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        close(spark, n)
        brought = sorted(r["batch_id"] for r in batch.select("batch_id").distinct().collect())  # as many as a trigger's files have
        closed = Folder(spark, f"{folder}/closed")
        late = [b for b in brought if closed.has(b)]
        now = [b for b in brought if b not in late]
        rows = batch.withColumn("trigger", F.lit(n))
        for names, to in ((now, "pending"), (late, "late")):
            if names:
                rows.where(F.col("batch_id").isin(*names)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "trigger").parquet(f"{folder}/{to}")
        if not now:
            return
        there = spark.read.schema(rows.schema).option("basePath", f"{folder}/pending").parquet(*[f"{folder}/pending/batch_id={b}" for b in now]).where(F.col("trigger") <= n)
        kinds = there.groupBy("batch_id").agg(F.countDistinct("kind").alias("kinds")).where(F.col("kinds") == parts)
        if whole := sorted(r["batch_id"] for r in kinds.collect()):
            each(there.where(F.col("batch_id").isin(*whole)).select(*batch.columns), n)
            for b in whole:
                Folder(spark, f"{folder}/passed").mark(f"{n}/{b}")

    return handle


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles what has come since the last time, then stops; a batch that was begun is done again from its start."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent_write(path: str, run_col: str = "run_id") -> Callable[[DataFrame, int], None]:
    """A writer of batches that replaces the runs it brings, so a replay changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        write_run(batch, path, run_col)

    return write


def rolling_counts(events: DataFrame, time_col: str, keys: list[str], window: str = "24 hours", slide: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    """Counts in sliding windows of event time; rows later than `lateness` are left out. The same over a table or a stream."""
    return events.withWatermark(time_col, lateness).groupBy(F.window(time_col, window, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def panes(events: DataFrame, time_col: str, keys: list[str], distinct: str, width: str = PANE) -> DataFrame:
    """(pane, keys, distinct, n, first, last): partial counts of each pane of time, from which windows are put together (window_of). They can be merged: those of parts of the events add up (merged_panes).

    Counts keep the values of `distinct` (an outlet, say) apart, so that distinct ones are exact in any window.
    """
    own = events.where(F.col(time_col).isNotNull())
    return own.groupBy(F.window(time_col, width).start.alias("pane"), *keys, distinct).agg(F.count(F.lit(1)).alias("n"), F.min(time_col).alias("first"), F.max(time_col).alias("last"))


def merged_panes(parts: DataFrame, keys: list[str], distinct: str) -> DataFrame:
    return parts.groupBy("pane", *keys, distinct).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def add_to_panes(path: str, time_col: str, keys: list[str], distinct: str, width: str = PANE) -> Callable[[DataFrame, int], None]:
    """A writer of micro-batches that keeps the panes' partial counts at path, by trigger, so that a replay replaces what it wrote. compacted_panes merges them."""

    def write(batch: DataFrame, n: int) -> None:
        own = panes(batch, time_col, keys, distinct, width).withColumn("trigger", F.lit(n)).withColumn("day", F.date_format("pane", "yyyyMMdd"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trigger", "day").parquet(path)

    return write


def compacted_panes(spark: SparkSession, path: str, to: str, keys: list[str], distinct: str) -> None:
    """Writes the merged panes of all triggers at path to another place, by day."""
    merged_panes(spark.read.parquet(path), keys, distinct).withColumn("day", F.date_format("pane", "yyyyMMdd")).write.mode("overwrite").partitionBy("day").parquet(to)


def window_of(parts: DataFrame, events: DataFrame, time_col: str, keys: list[str], distinct: str, end: Column, width: str, pane: str = PANE) -> DataFrame:
    """(keys, n, distinct_n, first, last) of the events from end - width to end, both included: counts of the panes that lie within, and of the events themselves in the two panes that the window cuts.

    parts: panes, merged or not. Of events only those of the cut panes are read, if they are stored by time.
    """
    start = end - F.expr(f"interval {width}")
    size = F.expr(f"interval {pane}")
    within = parts.where((F.col("pane") > start) & (F.col("pane") + size <= end)).select(*keys, distinct, "n", "first", "last")
    at = F.col(time_col)
    # Panes that begin by the start, or end after the end.
    near = events.where(at.between(start, end) & ((at < start + size) | (at >= end - size)))
    cut = near.withColumn("_w", F.window(time_col, pane)).where((F.col("_w.start") <= start) | (F.col("_w.end") > end)).select(*keys, distinct, F.lit(1).cast("long").alias("n"), at.alias("first"), at.alias("last"))
    return within.unionAll(cut).groupBy(*keys).agg(F.sum("n").alias("n"), F.countDistinct(distinct).alias("distinct_n"), F.min("first").alias("first"), F.max("last").alias("last"))


class Limiter(StatefulProcessor):
    """Counts a source's requests in windows of fixed width, and decides of each as it comes. State is one number for each open window, which a timer removes once it is over and can get no more requests."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "start long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        done = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            out = []
            for at in frame.sort_values("at")["at"]:
                ms = int(at.value // 1_000_000)
                start = ms // self.window_ms * self.window_ms
                end = start + self.window_ms
                late = end <= done
                if late:
                    out.append((key[0], at, pd.Timestamp(start, unit="ms"), None, None, None, True))
                    continue
                n = self.counts.getValue((start,))[0] + 1 if self.counts.containsKey((start,)) else 1
                if n == 1:
                    self.handle.registerTimer(end)
                self.counts.updateValue((start,), (n,))
                out.append((key[0], at, pd.Timestamp(start, unit="ms"), n > self.limit, max(0, self.limit - n), max(1, -(-(end - ms) // 1000)), False))
            yield pd.DataFrame(out, columns=["source", "at", "window_start", "limited", "remaining", "retry_after_seconds", "late"]).astype({"limited": "boolean", "remaining": "Int64", "retry_after_seconds": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        start = expiredTimerInfo.getExpiryTimeInMs() - self.window_ms
        if self.counts.containsKey((start,)):
            self.counts.removeKey((start,))
        return iter(())

    def close(self) -> None:
        pass


def decided(requests: DataFrame, source_col: str, time_col: str, limit: int = LIMIT, window: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """(source, at, window_start, limited, remaining, retry_after_seconds, late): a decision on each request of a stream, as it comes.

    Requests of a micro-batch are taken in order of time, and those that come later but are earlier count when they come; so of each window as many are limited as `limited` says. A request of a window that is
    over by more than `lateness` is late, and not decided. Needs the RocksDB state store (STATE_STORE). A source's requests are one task's of a micro-batch, in portions; its state is its open windows.
    """
    kind = requests.schema[source_col].dataType.simpleString()
    ms = int(pd.Timedelta(window).total_seconds() * 1000)
    schema = f"source {kind}, at timestamp, window_start timestamp, limited boolean, remaining long, retry_after_seconds long, late boolean"
    own = requests.select(F.col(source_col).alias("source"), F.col(time_col).cast("timestamp").alias("at")).withWatermark("at", lateness)
    return own.groupBy("source").transformWithStateInPandas(Limiter(limit, ms), schema, "Append", "EventTime")


def limited(requests: DataFrame, source_col: str, time_col: str, limit: int = LIMIT, window: str = WINDOW) -> DataFrame:
    """(window_start, source, requests, over): requests of each source in fixed windows, and how many were over the limit.

    Counts are aggregates with partial sums, so one busy source is no task's work.
    """
    counted = requests.groupBy(F.window(time_col, window).alias("w"), source_col).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select(F.col("w.start").alias("window_start"), source_col, "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("over"))
