"""Registered source / sink queries (SRC-*): each writes through the sink to the shared
checkpoint folder, reads the written table back and is checked against its definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import DAY, r4, rnd, ts_text
from ..operators import anomaly as A
from ..operators import gitstats as G
from ..operators import health as H
from ..operators import leading as L
from ..sources import sinks as K
from ..sources.adapters import Model
from ..streaming.streams import scratch
from .anomaly_plans import ANO18_SQL
from .enterprise_plans import SINCE, UNTIL
from .health_plans import HLT3_SQL
from .leading_plans import _Ctx, _ctes, _series_subs, cycle_insights
from .oracle_base import ASOF, r4 as sr4, rnd as srnd, tstext, with_
from .registry import ORACLES, query
from .signal_plans import sig2


@query("src7_save_partitioned", HLT3_SQL)
def src7(spark, sf_dir):
    """HLT-3 baseline written partitioned by day type and hour, read back with partition discovery."""
    m = Model(spark, sf_dir)
    b = H.entity_baseline(m.metrics_long(), m.as_of(), days=30).withColumn("sample_count", F.col("sample_count").cast("long"))
    p = K.save(b, f"{scratch(spark, 'baseline')}/t", partition_by=["day_type", "hour_of_day"])
    back = spark.read.parquet(p)
    return back.select(*b.columns).withColumn("hour_of_day", F.col("hour_of_day").cast("int"))


@query("src8_upsert_latest", with_("ev") + f"""SELECT signal_name, {tstext('snapshot_time')} AS snapshot_time,
  {sr4('numeric_value')} AS numeric_value FROM (
  SELECT *, row_number() OVER (PARTITION BY signal_name ORDER BY snapshot_time DESC) AS rn FROM (
    SELECT event_type || '_' || CAST(user_id % 3 AS VARCHAR) AS signal_name, date_trunc('hour', ts) AS snapshot_time,
      avg(value) AS numeric_value FROM ev GROUP BY ALL)) WHERE rn = 1""")
def src8(spark, sf_dir):
    """Upsert day by day: first the rows before the last day, then the last day's rows; newest per signal wins."""
    m = Model(spark, sf_dir)
    e = m.events()
    snap = (e.groupBy(F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 3).cast("string")).alias("signal_name"),
                      F.date_trunc("hour", "ts").alias("snapshot_time")).agg(F.avg("value").alias("numeric_value")))
    cut = F.date_trunc("day", m.as_of())
    base = scratch(spark, "upsert")
    v1 = K.upsert_latest(spark, base, snap.filter(F.col("snapshot_time") < cut), ["signal_name"], "snapshot_time")
    v2 = K.upsert_latest(spark, base, snap.filter(F.col("snapshot_time") >= cut), ["signal_name"], "snapshot_time", current=v1)
    out = spark.read.parquet(v2)
    return out.select("signal_name", ts_text("snapshot_time").alias("snapshot_time"), r4("numeric_value").alias("numeric_value"))


@query("src9_upsert_single_row", with_("ev") + "SELECT count(*) AS events, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM ev")
def src9(spark, sf_dir):
    """MERGE ON 1=1: a one-row table replaced by the newer summary (keys = [])."""
    e = Model(spark, sf_dir).events()
    base = scratch(spark, "single")
    first = e.filter(F.col("ts") < F.date_trunc("day", e.select(F.max("ts")).scalar())) \
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    second = e.agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    v1 = K.upsert_latest(spark, base, first, [], "last_ts")
    v2 = K.upsert_latest(spark, base, second, [], "last_ts", current=v1)
    return spark.read.parquet(v2).select("events", ts_text("last_ts").alias("last_ts"))


@query("src13_to_csv", with_("numstat") + f"""SELECT repo, branch, author, CAST(sum(CAST(added AS BIGINT)) AS BIGINT) AS lines_added,
  CAST(sum(CAST(deleted AS BIGINT)) AS BIGINT) AS lines_deleted,
  CAST(sum(CAST(added AS BIGINT)) - sum(CAST(deleted AS BIGINT)) AS BIGINT) AS net_lines, count(DISTINCT commit) AS commits
FROM numstat WHERE committed_at >= TIMESTAMP '{SINCE}' AND committed_at <= TIMESTAMP '{UNTIL}'
  AND regexp_full_match(added, '\\d+') AND regexp_full_match(deleted, '\\d+') GROUP BY ALL""")
def src13(spark, sf_dir):
    df = G.contributions(Model(spark, sf_dir).numstat(), SINCE, UNTIL)
    p = K.to_csv(df, f"{scratch(spark, 'csv')}/contributions")
    return spark.read.option("header", True).schema(
        "repo string, branch string, author string, lines_added long, lines_deleted long, net_lines long, commits long").csv(p)


@query("src14_roll_up_and_expire", with_("metrics_long") + f"""
SELECT entity_id, metric_name, {tstext('recorded_at')} AS recorded_at, CAST(1 AS BIGINT) AS n, {sr4('metric_value')} AS metric_value_avg,
  {sr4('metric_value')} AS metric_value_min, {sr4('metric_value')} AS metric_value_max, 'raw' AS tier
FROM metrics_long WHERE recorded_at >= {ASOF} - INTERVAL 7 DAY
UNION ALL
SELECT entity_id, metric_name, {tstext("date_trunc('hour', recorded_at)")}, count(*), {sr4('avg(metric_value)')},
  {sr4('min(metric_value)')}, {sr4('max(metric_value)')}, 'aggregated'
FROM metrics_long WHERE recorded_at < {ASOF} - INTERVAL 7 DAY AND recorded_at >= {ASOF} - INTERVAL 90 DAY
GROUP BY entity_id, metric_name, date_trunc('hour', recorded_at)""")
def src14(spark, sf_dir):
    m = Model(spark, sf_dir)
    t = K.roll_up_and_expire(m.metrics_long(), "recorded_at", ["metric_value"], ["entity_id", "metric_name"], m.as_of())
    return t.select("entity_id", "metric_name", ts_text("recorded_at").alias("recorded_at"), "n",
                    *[r4(c).alias(c) for c in ("metric_value_avg", "metric_value_min", "metric_value_max")], "tier")


@query("src14_tiered_retention", with_("ev") + f"""
SELECT app, event_type, {tstext('ts')} AS ts, CAST(1 AS BIGINT) AS n, {sr4('value')} AS value_sum, {sr4('value')} AS value_min, {sr4('value')} AS value_max, 'raw' AS tier
FROM ev WHERE CAST(ts AS DATE) >= CAST({ASOF} AS DATE) - 7
UNION ALL
SELECT app, event_type, {tstext("date_trunc('hour', ts)")}, count(*), {sr4('sum(value)')}, {sr4('min(value)')}, {sr4('max(value)')}, 'aggregated'
FROM ev WHERE CAST(ts AS DATE) < CAST({ASOF} AS DATE) - 7 AND CAST(ts AS DATE) >= CAST({ASOF} AS DATE) - 90 GROUP BY app, event_type, date_trunc('hour', ts)""")
def src14_tiered(spark, sf_dir):
    """Retention job of metrics run twice, a week apart, each time on what has arrived by then."""
    m = Model(spark, sf_dir)
    e = m.events().select("app", "event_type", "ts", "value")
    newest = spark.range(1).select(F.date_format(m.as_of(), "yyyy-MM-dd"), F.date_format(m.as_of() - F.make_dt_interval(days=F.lit(7)), "yyyy-MM-dd")).first()
    t = K.TieredTable(spark, f"{scratch(spark, 'retention')}/t", "metrics", "ts", ["value"], ["app", "event_type"])
    seen = F.date_format("ts", "yyyy-MM-dd") < newest[1]
    for rows, day in ((e.filter(seen), newest[1]), (e.filter(~seen), newest[0])):
        t.append(rows)
        t.roll_up(day)
    return t.read().select("app", "event_type", ts_text("ts").alias("ts"), "n", *[r4(c).alias(c) for c in ("value_sum", "value_min", "value_max")], "tier")


@query("src2_shape_synthetic", with_("ev") + f"""SELECT event_type AS app_name, count(*) AS executions,
  CAST(sum(CASE WHEN event_type <> 'error' AND value * 50 < 3000 THEN 1 ELSE 0 END) AS BIGINT) AS healthy,
  {sr4(srnd("avg(CASE WHEN event_type <> 'error' AND value * 50 < 3000 THEN 100.0 ELSE 0.0 END)", 1))} AS health_pct
FROM ev GROUP BY event_type""")
def src2(spark, sf_dir):
    """Monitor executions arrive as JSON text (built here from events: code 500 for errors,
    duration = 50 x value ms); the shaper parses and flags them; App Health per monitor."""
    e = Model(spark, sf_dir).events()
    raw = e.select(F.to_json(F.struct(
        F.col("event_type").alias("monitorName"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("responseCode"),
        (F.col("value") * 50).alias("duration"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("executionTimestamp"))).alias("payload"))
    s = K.shape_synthetic(raw)
    return s.groupBy("app_name").agg(F.count(F.lit(1)).alias("executions"), F.sum("is_healthy").cast("long").alias("healthy"),
                                     r4(rnd(F.avg(F.col("is_healthy") * 100.0), 1)).alias("health_pct"))


SRC12_SQL = f"""SELECT 'enterprise_score' AS section, '' AS name, {sr4("round(avg(score) FILTER (WHERE domain_key <> 'unmapped'), 1)")} AS value, NULL AS text FROM ({ORACLES['lip3_domain_scores']})
UNION ALL SELECT 'outage_probability', '', {sr4('probability')}, NULL FROM ({ORACLES['lip15_outage_probability']})
UNION ALL SELECT 'signal', signal_name, {sr4('numeric_value')}, status FROM ({_ctes()} SELECT * FROM latest)
UNION ALL SELECT 'domain', domain_key, {sr4('score')}, NULL FROM ({ORACLES['lip3_domain_scores']})
UNION ALL SELECT 'insight', related_signals, NULL, insight_text FROM (SELECT * FROM ({ORACLES['lip11_insights']})
  ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, insight_text LIMIT 10)"""


@query("src12_serving_document", SRC12_SQL)
def src12(spark, sf_dir):
    """Serving document of the newest cycle, parsed back into rows."""
    c = _Ctx(spark, sf_dir)
    lt = c.latest.select("signal_name", r4("numeric_value").alias("numeric_value"), "status", "trend", "direction")
    dom = L.domain_scores(c.latest, c.dmap)
    prob = L.outage_probability(c.latest, c.active())
    ins = K.newest_insights(cycle_insights(c, sig2(c.m), _series_subs(c)).withColumn("created_at", c.as_of))
    doc = K.serving_document(lt, dom, prob, ins, c.as_of)
    return K.document_rows(doc).withColumn("value", r4("value"))


@query("src11_latest_anomaly_view", ANO18_SQL.replace("SELECT * FROM res", """SELECT res.*, CAST(0.7 AS DOUBLE) AS config_window_pct, 20 AS config_min_points, c.unit AS config_unit
  FROM res JOIN cfg c USING (metric_id)"""))
def src11(spark, sf_dir):
    """Gold view: of two saved runs, a day apart, the rows of the newest one with their metric config."""
    m = Model(spark, sf_dir)
    base, cfg, raw = f"{scratch(spark, 'anomaly-runs')}/t", m.metric_config(), m.metrics_raw()
    day = F.make_dt_interval(days=F.lit(1))
    for n, (rows, at) in enumerate(((raw.filter(F.col("recorded_at") <= m.as_of() - day), m.as_of() - day), (raw, m.as_of()))):
        K.save(A.run_anomaly(A.metric_histories(rows, cfg, n=20).checkpoint(), at), f"{base}/run={n}")
    runs = spark.read.parquet(base).drop("run")
    newest = runs.filter(F.col("run_timestamp") == runs.select(F.max("run_timestamp")).scalar())
    config = cfg.select("metric_id", F.col("baseline_window_pct").alias("config_window_pct"), F.col("history_min_points").alias("config_min_points"), F.col("unit").alias("config_unit"))
    return newest.join(config, "metric_id", "left")
