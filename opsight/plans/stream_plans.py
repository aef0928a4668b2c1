"""Registered streaming queries (STR-*): each runs its stream to completion (availableNow) into the
shared checkpoint folder, reads the result back, and is checked against the batch definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import HOUR, r4, ts_text
from ..operators import health as H
from ..sources.adapters import Model, app_of
from ..streaming import streams as S
from .health_plans import HLT16_SQL, HYST_WINDOW
from .oracle_base import ASOF, r4 as sr4, tstext, with_
from .registry import query

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events_stream(spark, sf_dir):
    return S.read_events(spark, sf_dir.rstrip("/"), EVENTS_SCHEMA, glob="events.parquet").withColumn("app", app_of())


def _on_time(spark, stream, name, hours):
    """The stream without its late rows, which go to a table of their own (STR-9)."""
    d = S.scratch(spark, f"{name}-split")
    split = S.LateSplit(spark, f"{d}/rows", delay_s=hours * HOUR)
    split.run(stream, f"{d}/ckpt")
    return split.on_time(stream.schema)


def _run(spark, stream, name, keys):
    d = S.scratch(spark, name)
    S.upsert_sink(stream, f"{d}/out", f"{d}/ckpt")
    return S.read_upserted(spark, f"{d}/out", keys)


@query("str1_ingest_bronze", """SELECT event_type, count(*) AS events, round(sum(value), 4) + 0.0 AS value_sum,
  min(event_id) AS first_event_id FROM events GROUP BY event_type""")
def str1(spark, sf_dir):
    d = S.scratch(spark, "bronze")
    q = S.ingest_bronze(_events_stream(spark, sf_dir), f"{d}/bronze", f"{d}/ckpt", partition_by=["event_type"])
    q.awaitTermination()
    b = spark.read.parquet(f"{d}/bronze")
    return b.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), r4(F.sum("value")).alias("value_sum"),
                                       F.min("event_id").alias("first_event_id"))


@query("str3_tumbling_errors_stream", with_("ev") + f"""SELECT app, {tstext("date_trunc('hour', ts)")} AS window_start,
  count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY app, date_trunc('hour', ts)""")
def str3(spark, sf_dir):
    s = _on_time(spark, _events_stream(spark, sf_dir).filter(F.col("event_type") == "error"), "tumbling", 2)
    out = _run(spark, S.tumbling_counts(s, "app", "1 hour", watermark="2 hours"), "tumbling", ["app", "w"])
    return out.select("app", ts_text("w.start").alias("window_start"), "n")


@query("str2_sliding_signal_stream", with_("ev") + f"""SELECT event_type, {tstext('ws')} AS window_start,
  {sr4('avg(value)')} AS value, count(*) AS n FROM (
  SELECT event_type, value, date_trunc('hour', ts) - to_hours(o) AS ws FROM ev, range(0, 5) t(o)) GROUP BY event_type, ws""")
def str2(spark, sf_dir):
    s = _on_time(spark, _events_stream(spark, sf_dir), "sliding", 2)
    out = _run(spark, S.sliding_signal(s, "event_type", "value", "5 hours", "1 hour", watermark="2 hours"),
               "sliding", ["event_type", "w"])
    return out.select("event_type", ts_text("w.start").alias("window_start"), r4("value").alias("value"), "n")


SESSION_GAP_H = 3


SESSION_WM_H = 4


@query("str10_error_sessions_stream", with_("ev", extra=[("e", "SELECT app, ts FROM ev WHERE event_type = 'error'"), (
    "g", f"""SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY app ORDER BY ts) IS NULL
  OR ts >= lag(ts) OVER (PARTITION BY app ORDER BY ts) + INTERVAL {SESSION_GAP_H} HOUR THEN 1 ELSE 0 END AS nw FROM e"""), (
    "s", "SELECT *, sum(nw) OVER (PARTITION BY app ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g"),
    ("ss", f"SELECT app, min(ts) AS st, max(ts) + INTERVAL {SESSION_GAP_H} HOUR AS en, count(*) AS errors FROM s GROUP BY app, sid")])
       + f"""SELECT app, strftime(st, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(en, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
  errors FROM ss WHERE en < (SELECT max(ts) FROM e) - INTERVAL {SESSION_WM_H} HOUR""")
def str10(spark, sf_dir):
    """Append mode: a session is emitted once the watermark (max event time - 4 h) passes its end."""
    s = _on_time(spark, _events_stream(spark, sf_dir).filter(F.col("event_type") == "error"), "sessions", SESSION_WM_H)
    sess = S.error_sessions(s, "app", f"{SESSION_GAP_H} hours", watermark=f"{SESSION_WM_H} hours")
    d = S.scratch(spark, "sessions")
    S.upsert_sink(sess, f"{d}/out", f"{d}/ckpt", mode="append")
    out = S.read_upserted(spark, f"{d}/out", ["app", "s"])
    return out.select("app", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                      F.date_format("s.end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "errors")


def _two_runs(spark, rows, time_col, schema, operator, name, last=None):
    """The older and the newer half of the rows (and then `last`), each written and streamed to its end: the second run restarts
    from the checkpoint of the first, so the state of every key is carried over a restart."""
    d = S.scratch(spark, name)
    ends = rows.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
    middle = ends["lo"] + (ends["hi"] - ends["lo"]) / 2 if ends["lo"] is not None else None
    parts = [rows.where(F.col(time_col) <= F.lit(middle)), rows.where(F.col(time_col) > F.lit(middle)), *([last] if last is not None else [])]
    for part in parts:
        part.write.mode("append").parquet(f"{d}/in")
        src = spark.readStream.schema(schema).parquet(f"{d}/in")
        q = S.start_stateful(operator(src).writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ckpt")
                             .outputMode("append").trigger(availableNow=True))
        q.awaitTermination()
    return spark.read.parquet(f"{d}/out")


@query("str5_recovery_status_stream", HLT16_SQL)
def str5(spark, sf_dir):
    """The hysteresis stream fed with the dense per-period error counts (written once as files)."""
    m = Model(spark, sf_dir)
    pe = H.dense_period_errors(m.error_logs(), m.applications(), m.as_of(), window_s=HYST_WINDOW * HOUR, unit_s=HOUR)
    rows = pe.select("application_id", "period", F.col("errors").cast("long").alias("errors"))
    out = _two_runs(spark, rows, "period", "application_id int, period long, errors long", S.hysteresis_stream, "hysteresis")
    return out.where("not late").drop("late")


@query("str7_holt_stream", with_("ev", extra=[
    ("g", "SELECT user_id % 5 AS k, date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(value) AS s FROM ev GROUP BY ALL"),
    ("raw", "SELECT event_type || '_' || k AS metric_id, day AS recorded_at, s / n AS value FROM g"),
    ("h", "SELECT metric_id, list(value ORDER BY recorded_at) AS h, count(*) AS n FROM raw GROUP BY 1")]) + f"""
SELECT metric_id, {sr4('hw[1]')} AS level, {sr4('hw[2]')} AS trend, {sr4('hw[3]')} AS sse, CAST(n AS BIGINT) AS n FROM (
  SELECT metric_id, n, list_reduce(list_transform(list_slice(h, 2, n), lambda y: [y, 0.0::DOUBLE, 0.0::DOUBLE]),
    lambda s, e: [0.3 * e[1] + 0.7 * (s[1] + s[2]), 0.1 * ((0.3 * e[1] + 0.7 * (s[1] + s[2])) - s[1]) + 0.9 * s[2],
                  s[3] + (e[1] - (s[1] + s[2])) * (e[1] - (s[1] + s[2]))], [h[1], (h[3] - h[1]) / 2.0, 0.0::DOUBLE]) AS hw FROM h)""")
def str7(spark, sf_dir):
    m = Model(spark, sf_dir)
    raw = m.metrics_raw().filter(~F.col("metric_id").rlike("^(error_share|success_share|daily_events)_"))
    out = _two_runs(spark, raw, "recorded_at", "metric_id string, recorded_at timestamp, value double", S.holt_stream, "holt").where("not late")
    last = out.groupBy("metric_id").agg(F.max_by(F.struct("level", "trend", "sse", "n"), "n").alias("x"))
    return last.select("metric_id", r4("x.level").alias("level"), r4("x.trend").alias("trend"), r4("x.sse").alias("sse"),
                       F.col("x.n").alias("n"))


STR4_S = 10 * HOUR  # the ten minutes of the alert rule, in the test unit

# Greedy by event time: after a kept alert the next one is the first that lies more than the window behind it.
STR4_SQL = "WITH RECURSIVE " + with_("ev", extra=[
    ("a", "SELECT app, event_type AS severity, ts, event_id FROM ev WHERE event_type IN ('error', 'purchase') AND value > 60"),
    ("kept(app, severity, ts)", f"""SELECT app, severity, min(ts) FROM a GROUP BY app, severity
UNION ALL SELECT k.app, k.severity, (SELECT min(a.ts) FROM a WHERE a.app = k.app AND a.severity = k.severity
  AND a.ts > k.ts + to_seconds({STR4_S})) FROM kept k WHERE k.ts IS NOT NULL"""),
])[len("WITH "):] + f"""SELECT k.app, k.severity, {tstext('k.ts')} AS created_at, min(a.event_id) AS event_id FROM kept k JOIN a ON a.app = k.app AND a.severity = k.severity AND a.ts = k.ts WHERE k.ts IS NOT NULL GROUP BY k.app, k.severity, k.ts"""


@query("str4_alert_dedup_stream", STR4_SQL)
def str4(spark, sf_dir):
    """Alerts (errors and purchases above 60) per application and severity: one in ten hours, the first by event time.

    The alerts are streamed in two runs, the older half first, and a restart lies between them.
    """
    ev = Model(spark, sf_dir).events().filter(F.col("event_type").isin("error", "purchase") & (F.col("value") > 60))
    rows = ev.select("app", F.col("event_type").alias("severity"), "ts", "event_id")
    # A last row beyond every window moves the watermark on, as the next alerts would, so that all are decided.
    beat = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("int").alias("app"), F.lit("heartbeat").alias("severity"),
                                                    (F.col("ts") + F.make_dt_interval(secs=F.lit(float(2 * STR4_S)))).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    kept = _two_runs(spark, rows, "ts", "app int, severity string, ts timestamp, event_id long",
                     lambda s: S.dedup_alerts(s, ["app", "severity"], window_s=STR4_S, delay_s=2 * HOUR), "dedup", last=beat)
    return kept.where("severity <> 'heartbeat'").select("app", "severity", ts_text("created_at").alias("created_at"), "event_id")
@query("str6_correlate_streams", with_("ev") + """SELECT a.app, count(*) AS pairs FROM
  (SELECT app, ts FROM ev WHERE event_type = 'error') a JOIN (SELECT app, ts FROM ev WHERE event_type = 'purchase') b
  ON a.app = b.app AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE GROUP BY a.app""")
def str6(spark, sf_dir):
    """Errors and purchases of the same application within 30 minutes: a watermarked
    stream-stream interval join (state bounded by the watermark and the interval)."""
    ev = _on_time(spark, _events_stream(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase")), "correlate", 1)
    a = ev.filter(F.col("event_type") == "error").select(F.col("app").alias("a_app"), F.col("ts").alias("a_ts"))
    b = ev.filter(F.col("event_type") == "purchase").select(F.col("app").alias("b_app"), F.col("ts").alias("b_ts"))
    j = S.correlate(a, b, "a_app", "b_app", "a_ts", "b_ts", "30 minutes", watermark="1 hour")
    d = S.scratch(spark, "correlate")
    q = (j.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{d}/out").groupBy(F.col("a_app").alias("app")).agg(F.count(F.lit(1)).alias("pairs"))


@query("str8_freshness_stream", with_("ev") + f"""SELECT event_type AS source, {tstext('max(ts)')} AS last_seen,
  (epoch_us({ASOF}) - epoch_us(max(ts))) // 1000000 AS freshness_s FROM ev GROUP BY event_type""")
def str8(spark, sf_dir):
    """Latest event time per source kept by a streaming aggregate (update mode, upsert sink);
    freshness = as_of - last seen."""
    ev = _events_stream(spark, sf_dir)
    out = _run(spark, S.freshness(ev.withColumnRenamed("event_type", "source"), "source"), "fresh", ["source"])
    a = Model(spark, sf_dir).as_of()
    return out.select("source", ts_text("last_seen").alias("last_seen"),
                      F.floor((F.unix_micros(a) - F.unix_micros("last_seen")) / 1_000_000).cast("long").alias("freshness_s"))


# ------------------------------------------------------------------ STR-9
@query("str9_late_rows", with_("ev", extra=[
    ("mid", "SELECT min(ts) + (max(ts) - min(ts)) / 2 AS m FROM ev"),
    ("b", "SELECT ev.*, CASE WHEN ts <= (SELECT m FROM mid) AND event_id % 7 <> 0 THEN 0 ELSE 1 END AS batch FROM ev"),
    ("x", "SELECT *, batch = 1 AND ts < (SELECT max(ts) FROM b WHERE batch = 0) - INTERVAL 2 HOUR AS late FROM b")]) + """
SELECT event_type, CAST(count(*) FILTER (WHERE NOT late) AS BIGINT) AS on_time, CAST(count(*) FILTER (WHERE late) AS BIGINT) AS late FROM x GROUP BY 1""")
def str9(spark, sf_dir):
    """Events in two deliveries; every seventh of the first half comes with the second and is late if two hours behind the first's newest."""
    rows = Model(spark, sf_dir).events().select("event_id", "ts", "event_type", "value", "app")
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    d = S.scratch(spark, "late")
    split = S.LateSplit(spark, f"{d}/rows", delay_s=2 * HOUR)
    first = (F.col("ts") <= F.lit(ends["lo"] + (ends["hi"] - ends["lo"]) / 2 if ends["lo"] else None)) & (F.col("event_id") % 7 != 0)
    for part in (first, ~first):
        rows.where(part).write.mode("append").parquet(f"{d}/in")
        split.run(spark.readStream.schema(rows.schema).parquet(f"{d}/in"), f"{d}/ckpt")
    on_time = spark.read.parquet(f"{d}/rows/on_time").groupBy("event_type").agg(F.count(F.lit(1)).alias("on_time"))
    late = split.late().groupBy("event_type").agg(F.count(F.lit(1)).alias("late"))
    return on_time.join(late, "event_type", "full").fillna(0, ["on_time", "late"]).select("event_type", "on_time", "late")
