"""Structured Streaming forms of the operators (STR-1..10).

All streams read files with a declared schema, cast event time to `timestamp`
once, and set a watermark. Sinks are files in the shared checkpoint folder the
session names (`spark.checkpoint.dir`); keyed results are upserted without
Delta by appending each micro-batch under `batch=<id>` and reading the newest
row per key (merge on read), which survives restarts: a replayed batch id
overwrites its own partition.
"""

from __future__ import annotations

import datetime
import itertools
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import checkpoint_dir

DEFAULT_WATERMARK = "2 minutes"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run inside the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


# --------------------------------------------------------------------------- STR-1 / SRC-1
def read_events(spark: SparkSession, folder: str, schema: str, ts: str = "ts", glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """File-stream source over a folder (optionally only files matching `glob`)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def ingest_bronze(stream: DataFrame, sink: str, checkpoint: str, partition_by=None):
    """Append raw rows with `_ingested_at` to a bronze parquet table; runs until the input is drained."""
    out = stream.withColumn("_ingested_at", F.current_timestamp())
    w = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w.start()


# --------------------------------------------------------------------------- sinks
def upsert_sink(stream: DataFrame, sink: str, checkpoint: str, mode: str = "update"):
    """Run a keyed aggregation to completion, writing each micro-batch to `sink/batch=<id>`."""

    def write(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_upserted(spark: SparkSession, sink: str, keys) -> DataFrame:
    """Newest row per key over all written micro-batches (merge on read, SRC-8 for streams)."""
    d = spark.read.parquet(sink)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_batch", "batch")


# --------------------------------------------------------------------------- STR-9
class LateSplit:
    """Rows of a stream dealt to an on-time and a late table before any watermark can drop them.

    One foreachBatch writes both, with a row of counts. A row is late if it is older than `delay_s` before the newest event time of
    all earlier batches, which the counts of those batches hold; so the decision of a batch doesn't change
    when it is run again, and a replayed batch replaces its own folders. Windows that read the on-time table with the same delay lose
    nothing; late rows stay for a correction job.
    """

    def __init__(self, spark: SparkSession, sink: str, ts: str = "ts", delay_s: float = 120):
        self.spark, self.sink, self.ts, self.delay_s = spark, sink.rstrip("/"), ts, delay_s

    def _newest_before(self, batch_id: int):
        done = [f"{self.sink}/counts/batch={b}" for b in range(batch_id)]
        return self.spark.read.parquet(*done).agg(F.max("newest")).first()[0] if done else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        newest = self._newest_before(batch_id)
        late = F.lit(False) if newest is None else F.coalesce(F.col(self.ts) < F.lit(newest) - F.make_dt_interval(secs=F.lit(float(self.delay_s))), F.lit(True))
        marked = batch.withColumn("_late", late).persist()
        marked.filter("not _late").drop("_late").write.mode("overwrite").parquet(f"{self.sink}/on_time/batch={batch_id}")
        marked.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{self.sink}/late/batch={batch_id}")
        (marked.agg(F.count(F.when(~F.col("_late"), 1)).alias("on_time"), F.count(F.when(F.col("_late"), 1)).alias("late"),
                    F.greatest(F.max(self.ts), F.lit(newest).cast("timestamp")).alias("newest"))
         .write.mode("overwrite").parquet(f"{self.sink}/counts/batch={batch_id}"))
        marked.unpersist()

    def run(self, stream: DataFrame, checkpoint: str):
        """Deals out what has arrived since the last run."""
        q = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    def on_time(self, schema) -> DataFrame:
        """The on-time table as a stream, batch after batch."""
        return self.spark.readStream.schema(schema).parquet(f"{self.sink}/on_time/*")

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sink}/late")

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sink}/counts")


# --------------------------------------------------------------------------- STR-2 / STR-3
def sliding_signal(stream: DataFrame, key: str, value: str, size: str, slide: str, ts: str = "ts",
                   watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Signal per sliding window (e.g. 5 minutes sliding by 1 minute)."""
    return (stream.withWatermark(ts, watermark).groupBy(key, F.window(ts, size, slide).alias("w"))
            .agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n")))


def tumbling_counts(stream: DataFrame, key: str, size: str, ts: str = "ts", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Tumbling per-period counts (per-minute health metrics)."""
    return stream.withWatermark(ts, watermark).groupBy(key, F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- STR-4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


APPEND_ROWS = 10_000  # alerts that go to the state store in one message


class _FirstInWindow(StatefulProcessor):
    """Keeps an alert if its key has kept none in the window before it, by event time whatever the order of arrival.

    Alerts wait until the watermark has passed them, so no earlier one can come. One event-time timer, for the earliest that
    waits, wakes the key; all that are due are then decided in one pass, so the work grows with the alerts and not with their
    square. Another timer clears the last kept alert when its window has passed, so an idle key has no state.
    """

    def __init__(self, window_ms: int, fields: list[str], ts: str, row_id: str):
        self.window_ms, self.fields, self.ts, self.row_id = window_ms, fields, ts, row_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, id long")
        self.wake = handle.getValueState("wake", "at long")  # when the earliest that waits is due
        self.last = handle.getValueState("last", "ts timestamp")

    def _wake_at(self, at: int) -> None:
        """A timer that this one forestalls stays: it may also be that of the last kept alert."""
        if not self.wake.exists() or at < self.wake.get()[0]:
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        while part := [(r[self.ts], r[self.row_id]) for r in itertools.islice(rows, APPEND_ROWS)]:
            first = min(at for at, _ in part)
            earliest = first if earliest is None else min(earliest, first)
            self.waiting.appendList(part)
        if earliest is not None:
            self._wake_at(_millis(earliest) + 1)
        return iter(())

    def _due(self, passed: int) -> list:
        """Takes the alerts that the watermark has passed out of those that wait, in order."""
        if not self.wake.exists() or self.wake.get()[0] > passed:
            return []
        self.wake.clear()
        due, rest = [], []
        for r in self.waiting.get():
            (due if _millis(r[0]) < passed else rest).append(tuple(r))
        self.waiting.clear()
        for i in range(0, len(rest), APPEND_ROWS):
            self.waiting.appendList(rest[i:i + APPEND_ROWS])
        if rest:
            self._wake_at(_millis(min(at for at, _ in rest)) + 1)
        return sorted(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        before = last = self.last.get()[0] if self.last.exists() else None
        window, kept = datetime.timedelta(milliseconds=self.window_ms), []
        for at, row_id in self._due(passed):
            if last is None or at - last > window:
                last = at
                kept.append((at, row_id))
        if last is not None and _millis(last) + self.window_ms < passed:
            self.last.clear()
        elif last != before:
            self.last.update((last,))
            self.handle.registerTimer(_millis(last) + self.window_ms + 1)
        for at, row_id in kept:
            yield Row(**dict(zip(self.fields, key)), created_at=at, **{self.row_id: row_id})

    def close(self) -> None:
        pass


def _millis(at) -> int:
    """Milliseconds of a time that Spark hands to Python in the session's zone, which the library sets to UTC."""
    return int(at.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def dedup_alerts(stream: DataFrame, keys, window_s: float = 600, delay_s: float = 120, ts: str = "ts", row_id: str = "event_id") -> DataFrame:
    """One alert per key in `window_s`: after a kept one the next is the first by event time beyond the window.

    Alerts up to `delay_s` out of order are put in order. Needs the RocksDB state store (`start_stateful` sets it).
    Of alerts at one time the one with the smaller id is kept.
    """
    fields = {f.name: f for f in stream.schema.fields}
    out = T.StructType([fields[k] for k in keys] + [T.StructField("created_at", T.TimestampType()), T.StructField(row_id, T.LongType())])
    rows = stream.withWatermark(ts, f"{int(delay_s)} seconds").groupBy(*keys)
    return rows.transformWithState(_FirstInWindow(int(window_s * 1000), list(keys), ts, row_id), out, "Append", "EventTime")


def start_stateful(writer):
    """Starts a query whose operators keep their state in RocksDB; other queries of the session keep their own setting."""
    key, spark = "spark.sql.streaming.stateStore.providerClass", SparkSession.active()
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


# --------------------------------------------------------------------------- STR-6
def correlate(a: DataFrame, b: DataFrame, key_a: str, key_b: str, ts_a: str, ts_b: str, within: str,
              watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Stream-stream interval join: rows of b within `within` of a row of a (both watermarked).

    Time is cut into slots twice as long as `within`: a row of b is in one slot, a row of a in each that its interval meets, and
    rows join by key and slot. So a row meets the rows near it alone and not all that its key has in state, and a
    frequent key is dealt over the tasks by its slots. A pair has one slot and appears once.
    """
    span = F.expr(f"INTERVAL {within}")
    length = F.greatest(2 * F.unix_micros(F.timestamp_seconds(F.lit(0)) + span), F.lit(1))

    def slot(at):
        return F.floor(F.unix_micros(at) / length)

    slots = F.sequence(slot(F.col(ts_a) - span), slot(F.col(ts_a) + span))
    aw = a.withWatermark(ts_a, watermark).withColumn("_slot_of_a", F.explode(slots))
    bw = b.withWatermark(ts_b, watermark).withColumn("_slot_of_b", slot(F.col(ts_b)))
    cond = ((F.col(key_a) == F.col(key_b)) & (F.col("_slot_of_a") == F.col("_slot_of_b"))
            & F.col(ts_b).between(F.col(ts_a) - span, F.col(ts_a) + span))
    return aw.join(bw, cond, "inner").drop("_slot_of_a", "_slot_of_b")


# --------------------------------------------------------------------------- STR-8
def freshness(stream: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Latest event time per source; freshness = as_of - last seen (computed on read)."""
    return stream.groupBy(key).agg(F.max(ts).alias("last_seen"))


# --------------------------------------------------------------------------- STR-10
def error_sessions(stream: DataFrame, key: str, gap: str, ts: str = "ts", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Error episodes: session windows closed by a gap without errors."""
    return (stream.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("errors")))


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


# --------------------------------------------------------------------------- STR-5
HYST_OUT = "application_id int, period long, errors long, bad int, ok int, status string, late boolean"
HYST_STATE = "status string, bad int, ok int, last_period long"


def hysteresis_stream(stream: DataFrame, key: str = "application_id", start: str = "HEALTHY", min_errors: int = 1,
                      degrade: int = 4, critical: int = 8, recover: int = 5, healthy: int = 8, idle_ms: int | None = None) -> DataFrame:
    """Recovery hysteresis over a stream of (key, period, errors) rows, state kept per key.

    The same transitions as the batch `recovery_status`; rows of a key inside one
    micro-batch are applied in period order. A row whose period is not after the state's comes too late to
    change it: it is returned with `late` true and the status of that time is left as it is, so a
    caller can route such rows to a side table and replay them. A key that is idle for `idle_ms`
    (for streams that run on; a drained one has no use for it) starts anew.
    """

    def nxt(st, bad, ok):
        if st in ("HEALTHY", "RECOVERING") and bad >= critical:
            return "CRITICAL"
        if st in ("HEALTHY", "RECOVERING") and bad >= degrade:
            return "DEGRADED"
        if st == "DEGRADED" and bad >= critical:
            return "CRITICAL"
        if st in ("DEGRADED", "CRITICAL") and ok >= recover:
            return "RECOVERING"
        if st == "RECOVERING" and ok >= healthy:
            return "HEALTHY"
        return st

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            st, bad, ok, last = state.get
        else:
            st, bad, ok, last = start, 0, 0, -(2 ** 62)
        rows = []
        for pdf in pdfs:
            rows.append(pdf)
        if not rows:
            return
        df = pd.concat(rows).sort_values("period")
        out = []
        for period, errors in zip(df["period"].tolist(), df["errors"].tolist()):
            if period <= last:
                out.append((k[0], period, errors, bad, ok, st, True))
                continue
            if errors >= min_errors:
                bad, ok = bad + 1, 0
            else:
                bad, ok = 0, ok + 1
            st = nxt(st, bad, ok)
            last = period
            out.append((k[0], period, errors, bad, ok, st, False))
        state.update((st, bad, ok, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["application_id", "period", "errors", "bad", "ok", "status", "late"])

    return stream.groupBy(key).applyInPandasWithState(fn, HYST_OUT, HYST_STATE, "append", _timeout(idle_ms))


# --------------------------------------------------------------------------- STR-7
HOLT_OUT = "metric_id string, recorded_at timestamp, level double, trend double, sse double, n long, late boolean"
HOLT_STATE = "level double, trend double, sse double, n long, y0 double, y1 double, last_ts timestamp"


def holt_stream(stream: DataFrame, alpha: float = 0.3, beta: float = 0.1, idle_ms: int | None = None) -> DataFrame:
    """Holt level / trend / Σe² kept per metric as values arrive (same recursion as the batch fold).

    Values of one time are all applied, in ascending order. A value older than the state's time can't be applied any
    more: it is returned with `late` true and the state as it is. A metric that is idle for `idle_ms`
    (for streams that run on) starts anew.
    """

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            level, trend, sse, n, y0, y1, last = state.get
        else:
            level, trend, sse, n, y0, y1, last = None, 0.0, 0.0, 0, None, None, None

        def step(lv, tr, e2, y):
            lvl = alpha * y + (1 - alpha) * (lv + tr)
            return lvl, beta * (lvl - lv) + (1 - beta) * tr, e2 + (y - (lv + tr)) ** 2

        df = pd.concat(list(pdfs)).sort_values(["recorded_at", "value"])
        out = []
        for ts, y in zip(df["recorded_at"].tolist(), df["value"].tolist()):
            if last is not None and ts < last:
                out.append((k[0], ts, level, trend, sse, n, True))
                continue
            n += 1
            if n == 1:
                y0, level, trend = y, y, 0.0      # fewer than 3 points: flat at the last value
            elif n == 2:
                y1, level, trend = y, y, 0.0
            elif n == 3:                          # initialise as the batch fold, then apply y1, y2
                level, trend, sse = y0, (y - y0) / 2.0, 0.0
                for v in (y1, y):
                    level, trend, sse = step(level, trend, sse, v)
            else:
                level, trend, sse = step(level, trend, sse, y)
            last = ts
            out.append((k[0], ts, level, trend, sse, n, False))
        state.update((level, trend, sse, n, y0, y1, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["metric_id", "recorded_at", "level", "trend", "sse", "n", "late"])

    return stream.groupBy("metric_id").applyInPandasWithState(fn, HOLT_OUT, HOLT_STATE, "append",
                                                              _timeout(idle_ms))
