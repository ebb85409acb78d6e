"""Live operators: streaming DataFrame in, streaming DataFrame out.

Event time is ``ts`` with a 10-minute watermark and append mode, so a window is
final when it is emitted. Sources, sinks and triggers are the caller's;
``run_available`` drives a stream over what has arrived and returns the table
it wrote.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracefield.functions.scalars import lookup
from tracefield.session import work_dir

LATE = "10 minutes"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The parquet files of one table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir)


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append", out: str | None = None, checkpoint: str | None = None) -> str:
    """Process everything that has arrived, then stop; returns the output folder.

    Output and offsets live in the shared work folder. Without ``batch`` rows go
    to a parquet file sink, which commits each batch once.
    """
    base = work_dir(stream.sparkSession) + "/stream-" + uuid.uuid4().hex
    out, checkpoint = out or base + "/out", checkpoint or base + "/offsets"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if batch is not None:
        query = writer.foreachBatch(batch).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return out


def _ts(stream: DataFrame) -> DataFrame:
    # watermarks need an instant; the given tables carry local times
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def stream_counters(packets: DataFrame, window: str = "1 second") -> DataFrame:
    """Packets and bytes per tumbling window, with rates per second."""
    w = F.window("ts", window)
    g = _ts(packets).groupBy(w).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
    secs = (F.unix_micros(F.col("window.end").cast("timestamp")) - F.unix_micros(F.col("window.start").cast("timestamp"))) / 1e6
    return g.select(
        F.col("window.start").alias("window_start"), "packets", "bytes",
        (F.col("packets") / secs).alias("packets_per_second"), (F.col("bytes") / secs).alias("bytes_per_second"),
    )


def stream_bursts(events: DataFrame, n: int = 10) -> DataFrame:
    g = _ts(events).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > n)
    return g.select(F.col("window.start").alias("first_seen"), F.col("window.end").alias("last_seen"), "occurrences")


def stream_thresholds(samples: DataFrame, changes: int = 50, connections: int = 100, memory: float = 85.0, cpu: float = 90.0, window: str = "1 minute", slide: str = "10 seconds") -> DataFrame:
    """samples(ts, kind, value): windows in which one of the four limits is passed."""
    k = F.col("kind")
    g = _ts(samples).groupBy(F.window("ts", window, slide)).agg(
        F.sum((k == "change").cast("bigint")).alias("changes"), F.sum((k == "connection").cast("bigint")).alias("connections"),
        F.max(F.when(k == "memory", F.col("value"))).alias("memory"), F.max(F.when(k == "cpu", F.col("value"))).alias("cpu"),
    )
    no = F.lit(False)
    return g.filter(
        (F.col("changes") > changes) | (F.col("connections") > connections) | F.coalesce(F.col("memory") > memory, no) | F.coalesce(F.col("cpu") > cpu, no)
    ).select(F.col("window.start").alias("window_start"), "changes", "connections", "memory", "cpu")


def stream_sessions(packets: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Sessions closed by inactivity."""
    g = _ts(packets).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "packets", "bytes")


def compare(value, op, limit):
    return (
        F.when(op == ">", value > limit).when(op == "<", value < limit).when(op == ">=", value >= limit)
        .when(op == "<=", value <= limit).when(op == "==", value == limit).when(op == "!=", value != limit)
    )


def keyed_timers(spark: SparkSession) -> None:
    """Timers and list state need the RocksDB state store; queries started later in this session use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class HeldConditions(StatefulProcessor):
    """Per (rule, subject): since when the condition holds, and a timer for when it will have held long enough."""

    def __init__(self, forget: int):
        self.forget = forget * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "since bigint, fired boolean, last bigint, duration bigint")

    def handleInputRows(self, key, rows, timerValues):
        parts = [p[["us", "holds", "duration"]].to_numpy("int64") for p in rows]
        seen = np.concatenate(parts)
        seen = seen[np.lexsort((1 - seen[:, 1], seen[:, 0]))]
        since, fired, last, duration = self.now.get() if self.now.exists() else (-1, False, -1, int(seen[0, 2]) * 1_000_000)
        out = []
        for us, holds in seen[:, :2].tolist():
            if since >= 0 and not fired and us >= since + duration:
                fired = True
                out.append((*key, since, since + duration))
            if not holds or (last >= 0 and us - last > self.forget):
                since, fired = -1, False
            if holds and since < 0:
                since = us
            last = max(last, us)
        self._keep(since, fired, last, duration)
        yield self._alerts(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.now.exists():
            since, fired, last, duration = self.now.get()
            if since >= 0 and not fired and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= since + duration:
                fired = True
                out.append((*key, since, since + duration))
            if expiredTimerInfo.getExpiryTimeInMs() * 1000 > last + self.forget:
                self.now.clear()
            else:
                self._keep(since, fired, last, duration)
        yield self._alerts(out)

    def _keep(self, since: int, fired: bool, last: int, duration: int) -> None:
        """State and its one timer; a condition that does not hold needs neither."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if since < 0:
            if self.now.exists():
                self.now.clear()
            return
        self.now.update((since, fired, last, duration))
        self.handle.registerTimer((last + self.forget if fired else since + duration) // 1000 + 1)

    @staticmethod
    def _alerts(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["rule_id", "subject", "started_us", "fired_us"]).astype({"started_us": "int64", "fired_us": "int64"})


def alert_rules(metrics: DataFrame, rules: DataFrame, forget: int = 86_400) -> DataFrame:
    """metrics(ts, metric, subject, value), rules(rule_id, metric, op, threshold, duration): an
    alert once a condition has held for ``duration`` seconds, again only after it broke.

    A value holds until the next one, so an alert needs no row to confirm it: a
    timer fires it when the watermark has passed the time; a later row of the
    series does so at once. State: two numbers while the condition holds, gone
    when it breaks or, after the alert, when no row came for ``forget`` seconds
    (not under a rule's duration). Rows of a batch are taken in time order, those
    that break last; rows older than the watermark do not count.
    """
    keyed_timers(metrics.sparkSession)
    joined = _ts(metrics).join(rules, "metric").select(
        "rule_id", "subject", "ts", F.unix_micros("ts").alias("us"),
        F.coalesce(compare(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False)).alias("holds"), F.col("duration").cast("bigint").alias("duration"),
    )
    return joined.groupBy("rule_id", "subject").transformWithStateInPandas(
        HeldConditions(forget), "rule_id string, subject string, started_us bigint, fired_us bigint", "Append", "EventTime"
    )


class AcceptedTimes(StatefulProcessor):
    """Per user: the accepted times of the last span; a timer clears them when none can count any more."""

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us bigint")

    def handleInputRows(self, key, rows, timerValues):
        kept = deque(sorted(r[0] for r in self.kept.get()) if self.kept.exists() else [])
        parts = [p[["us", "request_id"]].to_numpy("int64") for p in rows]
        asked = np.concatenate(parts)
        asked = asked[np.lexsort((asked[:, 1], asked[:, 0]))]
        for start in range(0, len(asked), 10_000):
            part, verdict = asked[start : start + 10_000], []
            for us in part[:, 0].tolist():
                while kept and us - kept[0] >= self.span:
                    kept.popleft()
                verdict.append(len(kept) < self.limit)
                if verdict[-1]:
                    kept.append(us)
            yield pd.DataFrame({"user_id": key[0], "request_id": part[:, 1], "us": part[:, 0], "accepted": verdict})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.kept.put([(t,) for t in kept])
            self.handle.registerTimer((kept[-1] + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.kept.clear()
        yield pd.DataFrame({"user_id": pd.Series([], dtype="int64"), "request_id": pd.Series([], dtype="int64"), "us": pd.Series([], dtype="int64"), "accepted": pd.Series([], dtype="bool")})


def stream_rate_limit(requests: DataFrame, limit: int, span_seconds: int = 3600) -> DataFrame:
    """requests(ts, request_id, user_id): exact accept or refuse.

    A request is refused when ``limit`` accepted ones lie within the last
    ``span_seconds``; refused ones do not count. State: at most ``limit`` times,
    gone when the watermark has passed the last of them by the span.
    """
    keyed_timers(requests.sparkSession)
    r = _ts(requests).select("user_id", "request_id", "ts", F.unix_micros("ts").alias("us"))
    return r.groupBy("user_id").transformWithStateInPandas(
        AcceptedTimes(limit, span_seconds * 1_000_000), "user_id bigint, request_id bigint, us bigint, accepted boolean", "Append", "EventTime"
    )


def stream_error_first(log: DataFrame) -> DataFrame:
    """First sight of each (code, message, context); repeats within the watermark are dropped."""
    return _ts(log).dropDuplicatesWithinWatermark(["code", "message", "context"]).select("code", "message", "context", "ts")


def stream_error_counts(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Count and last time per error and window (update mode); the state of a window goes when the watermark has passed it."""
    w = F.window("ts", window)
    return _ts(log).groupBy(w, "code", "message", "context").agg(F.count(F.lit(1)).alias("occurrences"), F.max("ts").alias("last_seen")).select(
        F.col("window.start").alias("window_start"), "code", "message", "context", "occurrences", "last_seen"
    )


def error_history(spark: SparkSession, folder: str) -> DataFrame:
    """Count and last time per error from ``stream_error_counts`` written by ``append_batches``."""
    keys = ["code", "message", "context"]
    last = latest_state(spark, folder, ["window_start", *keys])
    return last.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), F.max("last_seen").alias("last_seen"))


def append_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that is safe to repeat: each batch owns one sub-folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def latest_state(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Last version of each key of an update-mode stream written by ``append_batches``."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def stream_watchlist(tx: DataFrame, listed: DataFrame) -> DataFrame:
    """Transactions that touch a watched address, one alert per address."""
    ends = tx.select("*", F.explode(F.array_distinct(F.array("from_addr", "to_addr"))).alias("addr"))
    return ends.join(listed.select("addr").distinct(), "addr").withColumn("severity", F.lit("HIGH"))

