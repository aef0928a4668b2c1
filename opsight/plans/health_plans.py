"""Registered health queries (HLT-*) over the test tables, with their DuckDB oracles.

Unit: `events` holds ~14 rows an hour at sf0.01, so the reference's minutes are
hours here (FIXTURES.md C). Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import DAY, HOUR
from ..operators import health as H
from ..sources.adapters import Model
from .oracle_base import ASOF, bucket, r4, rnd, since, tstext, with_
from .registry import query

U = HOUR

# ------------------------------------------------------------------ HLT-1
HLT1_SQL = with_("metrics_long", "threshold_config", "error_logs", extra=[
    ("cur", "SELECT m.*, t.threshold_value, CASE WHEN m.metric_value > t.threshold_value THEN 1 ELSE 0 END "
            "AS is_breaching FROM metrics_long m JOIN threshold_config t USING (entity_id, metric_name) "
            f"WHERE {since('m.recorded_at', 24 * U)}"),
    ("he", f"SELECT entity_id, count(*) AS error_count, count(DISTINCT {bucket('recorded_at', U)}) AS error_periods "
           f"FROM error_logs WHERE {since('recorded_at', 22 * U)} GROUP BY entity_id"),
]) + f"""
SELECT c.entity_id, c.entity_name, c.entity_type, c.metric_name, {r4('c.metric_value')} AS metric_value,
  {r4('c.threshold_value')} AS threshold_value, {tstext('c.recorded_at')} AS recorded_at,
  CAST(COALESCE(he.error_count, 0) AS BIGINT) AS errors_in_lookback,
  CAST(COALESCE(he.error_periods, 0) AS BIGINT) AS error_periods,
  CASE WHEN c.is_breaching = 1 AND he.error_count >= 5 THEN 'CRITICAL'
       WHEN c.is_breaching = 1 AND he.error_periods >= 15 THEN 'DEGRADED'
       WHEN c.is_breaching = 1 AND COALESCE(he.error_count, 0) = 0 THEN 'WARNING'
       WHEN c.is_breaching = 0 AND he.error_periods >= 10 THEN 'DEGRADED'
       ELSE 'HEALTHY' END AS health_status,
  CASE WHEN c.is_breaching = 1 AND COALESCE(he.error_count, 0) = 0 THEN 'Possible transient spike - monitoring'
       WHEN c.is_breaching = 1 AND he.error_count >= 5 THEN 'Confirmed issue - errors persisting' END AS status_note
FROM cur c LEFT JOIN he USING (entity_id)"""


def hlt1(spark, sf_dir):
    m = Model(spark, sf_dir)
    metrics = m.metrics_long()
    return H.threshold_breach(metrics, m.thresholds(metrics), m.error_logs(), m.as_of(),
                              current_s=24 * U, lookback_s=22 * U, period_s=U)


query("hlt1_threshold_breach", HLT1_SQL, headline=True)(hlt1)

# ------------------------------------------------------------------ HLT-2
HLT2_SQL = with_("metrics_long") + f"""
SELECT entity_id, entity_name, metric_name, CAST(hour({ASOF}) AS INTEGER) AS current_hour,
  {r4('avg(metric_value)')} AS baseline_avg, {r4('stddev_samp(metric_value)')} AS baseline_stddev,
  CAST(count(*) AS BIGINT) AS sample_count, {r4('min(metric_value)')} AS baseline_min,
  {r4('max(metric_value)')} AS baseline_max,
  {r4('quantile_cont(metric_value, 0.5)')} AS baseline_p50, {r4('quantile_cont(metric_value, 0.95)')} AS baseline_p95,
  {r4('quantile_cont(metric_value, 0.99)')} AS baseline_p99
FROM metrics_long WHERE {since('recorded_at', 7 * DAY)} AND hour(recorded_at) = hour({ASOF})
GROUP BY entity_id, entity_name, metric_name"""


@query("hlt2_same_hour_baseline", HLT2_SQL)
def hlt2(spark, sf_dir):
    m = Model(spark, sf_dir)
    return H.same_hour_baseline(m.metrics_long(), m.as_of(), days=7)


# ------------------------------------------------------------------ HLT-3
BASELINE_CTE = (f"SELECT entity_id, entity_name, metric_name, hour(recorded_at) AS hour_of_day, "
                "CASE WHEN dayofweek(recorded_at) IN (0, 6) THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type, "
                f"{r4('avg(metric_value)')} AS baseline_avg, {r4('stddev_samp(metric_value)')} AS baseline_stddev, "
                f"{r4('quantile_cont(metric_value, 0.5)')} AS baseline_p50, "
                f"{r4('quantile_cont(metric_value, 0.95)')} AS baseline_p95, "
                f"{r4('quantile_cont(metric_value, 0.99)')} AS baseline_p99, count(*) AS sample_count, "
                f"{tstext(ASOF)} AS calculated_at "
                f"FROM metrics_long WHERE {since('recorded_at', 30 * DAY)} GROUP BY ALL")
HLT3_SQL = with_("metrics_long", extra=[("b", BASELINE_CTE)]) + "SELECT * REPLACE (CAST(sample_count AS BIGINT) AS sample_count) FROM b"


@query("hlt3_entity_baseline", HLT3_SQL)
def hlt3(spark, sf_dir):
    m = Model(spark, sf_dir)
    return H.entity_baseline(m.metrics_long(), m.as_of(), days=30) \
        .withColumn("sample_count", F.col("sample_count").cast("long"))


# ------------------------------------------------------------------ HLT-4
HLT4_CTES = [
    ("b", BASELINE_CTE),
    ("cm", f"SELECT entity_id, entity_name, metric_name, avg(metric_value) AS current_value, "
           f"max(metric_value) AS current_max FROM metrics_long WHERE {since('recorded_at', 5 * U)} GROUP BY ALL"),
    ("bb", f"SELECT * FROM b WHERE hour_of_day = hour({ASOF}) AND day_type = "
           f"CASE WHEN dayofweek({ASOF}) IN (0, 6) THEN 'WEEKEND' ELSE 'WEEKDAY' END"),
    ("anom", f"""SELECT cm.entity_id, cm.entity_name, cm.metric_name, {r4('cm.current_value')} AS current_value,
  {r4('bb.baseline_avg')} AS baseline_avg, {r4('bb.baseline_stddev')} AS baseline_stddev,
  CAST(bb.sample_count AS BIGINT) AS sample_count,
  {r4("CASE WHEN bb.baseline_stddev > 0 THEN (cm.current_value - bb.baseline_avg) / bb.baseline_stddev ELSE 0 END")} AS z_score,
  {r4('bb.baseline_avg + 2 * COALESCE(bb.baseline_stddev, 0)')} AS threshold_2sigma,
  {r4('bb.baseline_avg + 3 * COALESCE(bb.baseline_stddev, 0)')} AS threshold_3sigma,
  CASE WHEN bb.baseline_stddev > 0 AND (cm.current_value - bb.baseline_avg) / bb.baseline_stddev > 3 THEN 'CRITICAL_ANOMALY'
       WHEN bb.baseline_stddev > 0 AND (cm.current_value - bb.baseline_avg) / bb.baseline_stddev > 2 THEN 'WARNING_ANOMALY'
       WHEN cm.current_value > bb.baseline_p95 THEN 'ELEVATED' ELSE 'NORMAL' END AS anomaly_status,
  {r4("CASE WHEN bb.baseline_avg > 0 THEN " + rnd('(cm.current_value - bb.baseline_avg) / bb.baseline_avg * 100', 2) + " ELSE 0 END")} AS pct_above_baseline
FROM cm LEFT JOIN bb USING (entity_id, metric_name)"""),
]
HLT4_SQL = with_("metrics_long", extra=HLT4_CTES) + "SELECT * FROM anom"


def _anomaly(spark, sf_dir):
    m = Model(spark, sf_dir)
    metrics = m.metrics_long()
    a = m.as_of()
    base = H.entity_baseline(metrics, a, days=30)
    return H.baseline_anomaly(metrics, base, a, current_s=5 * U)


query("hlt4_baseline_anomaly", HLT4_SQL)(_anomaly)

# ------------------------------------------------------------------ HLT-5
HLT5_SQL = with_("metrics_wide", extra=[
    ("d", f"SELECT application_id, application_name, CAST(recorded_at AS DATE) AS metric_date, "
          "hour(recorded_at) AS hour_of_day, dayofweek(recorded_at) AS dow, sum(error_count) AS total_errors, "
          "sum(request_count) AS total_requests, CASE WHEN sum(request_count) > 0 THEN "
          f"{rnd('sum(error_count) * 100.0 / sum(request_count)', 4)} ELSE 0 END AS error_rate_pct "
          f"FROM metrics_wide WHERE {since('recorded_at', 14 * DAY)} GROUP BY ALL")]) + f"""
SELECT application_id, application_name, hour_of_day,
  CASE WHEN dow IN (0, 6) THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type,
  {r4('avg(error_rate_pct)')} AS baseline_error_rate_avg, {r4('stddev_samp(error_rate_pct)')} AS baseline_error_rate_stddev,
  {r4('avg(error_rate_pct) + 2 * COALESCE(stddev_samp(error_rate_pct), 0)')} AS warning_threshold,
  {r4('avg(error_rate_pct) + 3 * COALESCE(stddev_samp(error_rate_pct), 0)')} AS critical_threshold,
  CAST(count(*) AS BIGINT) AS days_of_data, {r4('min(error_rate_pct)')} AS min_error_rate,
  {r4('max(error_rate_pct)')} AS max_error_rate
FROM d GROUP BY application_id, application_name, hour_of_day, CASE WHEN dow IN (0, 6) THEN 'WEEKEND' ELSE 'WEEKDAY' END"""


@query("hlt5_error_rate_baseline", HLT5_SQL)
def hlt5(spark, sf_dir):
    m = Model(spark, sf_dir)
    return H.error_rate_baseline(m.metrics_wide(), m.as_of(), days=14)


# ------------------------------------------------------------------ HLT-6
HLT6_SQL = with_("metrics_long", extra=HLT4_CTES) + f"""
SELECT entity_id, entity_name, metric_name, current_value, baseline_avg, baseline_stddev, sample_count, z_score,
  CASE WHEN baseline_avg IS NULL THEN 'NO_BASELINE' WHEN sample_count < 7 THEN 'WIDE_SIGMA'
       WHEN COALESCE(baseline_stddev, 0) <= abs(baseline_avg) * 0.01 THEN 'PCT_DEVIATION' ELSE 'SIGMA' END AS method,
  {r4("(current_value - baseline_avg) * 100.0 / NULLIF(baseline_avg, 0)")} AS deviation_pct,
  CASE WHEN baseline_avg IS NULL THEN 'NO_BASELINE'
       WHEN sample_count < 7 THEN CASE WHEN z_score > 4.0 THEN 'CRITICAL_ANOMALY' ELSE 'NORMAL' END
       WHEN COALESCE(baseline_stddev, 0) <= abs(baseline_avg) * 0.01 THEN
            CASE WHEN (current_value - baseline_avg) * 100.0 / NULLIF(baseline_avg, 0) > 50 THEN 'CRITICAL_ANOMALY' ELSE 'NORMAL' END
       WHEN z_score > 3 THEN 'CRITICAL_ANOMALY' WHEN z_score > 2 THEN 'WARNING_ANOMALY' ELSE 'NORMAL' END AS anomaly_status
FROM anom"""


@query("hlt6_anomaly_with_fallback", HLT6_SQL)
def hlt6(spark, sf_dir):
    return H.anomaly_with_fallback(_anomaly(spark, sf_dir))


# ------------------------------------------------------------------ HLT-20
HLT20_SQL = with_("metrics_long", extra=HLT4_CTES) + """
SELECT *, CASE WHEN z_score > 3 THEN 'CRITICAL_HIGH' WHEN z_score > 2 THEN 'WARNING_HIGH'
  WHEN z_score > 1 THEN 'SLIGHTLY_ELEVATED' WHEN z_score < -2 THEN 'UNUSUALLY_LOW'
  WHEN z_score < -1 THEN 'SLIGHTLY_LOW' ELSE 'NORMAL' END AS z_band FROM anom"""


@query("hlt20_z_band", HLT20_SQL)
def hlt20(spark, sf_dir):
    return H.z_band(_anomaly(spark, sf_dir))


# ------------------------------------------------------------------ HLT-7
HU = 6 * HOUR  # host windows: 5/15/30/60 units of 6 hours (per-host errors are sparse)
HLT7_SQL = with_("host_error_logs", extra=[
    ("hep", f"""SELECT host_id, host_name, application_id,
  count(*) FILTER (WHERE {since('recorded_at', 5 * HU)}) AS errors_5,
  count(*) FILTER (WHERE {since('recorded_at', 15 * HU)}) AS errors_15,
  count(*) FILTER (WHERE {since('recorded_at', 30 * HU)}) AS errors_30,
  count(*) FILTER (WHERE {since('recorded_at', 60 * HU)}) AS errors_60,
  count(DISTINCT CASE WHEN {since('recorded_at', 30 * HU)} THEN {bucket('recorded_at', HU)} END) AS d30
FROM host_error_logs WHERE {since('recorded_at', 60 * HU)} GROUP BY ALL"""),
    ("hb", f"""SELECT host_id, avg(n) AS avg_hourly_errors, stddev_samp(n) AS sd FROM (
  SELECT host_id, CAST(recorded_at AS DATE) AS d, count(*) AS n FROM host_error_logs
  WHERE {since('recorded_at', 7 * DAY)} AND hour(recorded_at) = hour({ASOF}) GROUP BY ALL) GROUP BY host_id""")]) + f"""
SELECT hep.host_id, host_name, application_id, CAST(errors_5 AS BIGINT) AS errors_5, CAST(errors_15 AS BIGINT) AS errors_15,
  CAST(errors_30 AS BIGINT) AS errors_30, CAST(errors_60 AS BIGINT) AS errors_60,
  CAST(d30 AS BIGINT) AS distinct_error_periods_30, {r4('avg_hourly_errors')} AS avg_hourly_errors,
  CASE WHEN d30 >= 15 AND errors_30 >= 20 THEN 'CRITICAL'
       WHEN errors_60 > avg_hourly_errors + 3 * COALESCE(sd, 0) AND errors_60 >= 10 THEN 'CRITICAL'
       WHEN d30 >= 10 THEN 'DEGRADED'
       WHEN errors_60 > avg_hourly_errors + 2 * COALESCE(sd, 0) AND errors_60 >= 5 THEN 'DEGRADED'
       WHEN errors_5 >= 5 AND d30 < 10 THEN 'WARNING' ELSE 'HEALTHY' END AS host_health_status,
  CASE WHEN d30 >= 15 THEN 'Persistent errors - immediate attention required'
       WHEN errors_5 >= 5 AND d30 < 5 THEN 'Recent spike - monitoring for persistence' END AS recommendation
FROM hep LEFT JOIN hb USING (host_id)"""


@query("hlt7_repeated_host_errors", HLT7_SQL)
def hlt7(spark, sf_dir):
    m = Model(spark, sf_dir)
    return H.repeated_host_errors(m.host_error_logs(), m.as_of(), unit_s=HU)


# ------------------------------------------------------------------ HLT-8
HLT8_SQL = with_("metrics_long", "threshold_config", extra=[
    ("mm", f"""SELECT m.*, t.threshold_value,
  avg(metric_value) OVER w10 AS rolling_avg, stddev_samp(metric_value) OVER w10 AS rolling_stddev,
  sum(CASE WHEN metric_value > threshold_value THEN 1 ELSE 0 END) OVER w5 AS c
FROM metrics_long m JOIN threshold_config t USING (entity_id, metric_name)
WHERE {since('m.recorded_at', 30 * U)}
WINDOW w10 AS (PARTITION BY entity_id, metric_name ORDER BY recorded_at, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
       w5 AS (PARTITION BY entity_id, metric_name ORDER BY recorded_at, row_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")]) + f"""
SELECT entity_id, entity_name, metric_name, {r4('metric_value')} AS metric_value, {tstext('recorded_at')} AS recorded_at,
  {r4('rolling_avg')} AS rolling_avg, {r4('rolling_stddev')} AS rolling_stddev, CAST(c AS BIGINT) AS breaches_in_window,
  CASE WHEN c >= 4 THEN 'GENUINE_ISSUE'
       WHEN metric_value > rolling_avg + 3 * rolling_stddev AND c <= 1 THEN 'TRANSIENT_SPIKE'
       WHEN metric_value > rolling_avg * 1.5 AND c BETWEEN 2 AND 3 THEN 'TRENDING_UP' ELSE 'NORMAL' END AS spike_classification,
  CASE WHEN c >= 4 THEN 1 ELSE 0 END AS should_alert
FROM mm WHERE {since('recorded_at', 1 * U)}"""


@query("hlt8_spike_classification", HLT8_SQL)
def hlt8(spark, sf_dir):
    m = Model(spark, sf_dir)
    metrics = m.metrics_long()
    return H.spike_classification(metrics, m.thresholds(metrics), m.as_of(), unit_s=U)


# ------------------------------------------------------------------ HLT-10
WSCORE_CTE = (f"SELECT application_id, count(*) FILTER (WHERE {since('recorded_at', 5 * U)}) AS b1, "
              f"count(*) FILTER (WHERE {since('recorded_at', 15 * U)} AND NOT {since('recorded_at', 5 * U)}) AS b2, "
              f"count(*) FILTER (WHERE NOT {since('recorded_at', 15 * U)}) AS b3 "
              f"FROM error_logs WHERE {since('recorded_at', 30 * U)} GROUP BY application_id")
HLT10_SQL = with_("error_logs", extra=[("ws", WSCORE_CTE)]) + """
SELECT application_id, CAST(b1 AS BIGINT) AS errors_band1, CAST(b2 AS BIGINT) AS errors_band2,
  CAST(b3 AS BIGINT) AS errors_band3, CAST(3 * b1 + 2 * b2 + b3 AS BIGINT) AS weighted_error_score,
  CASE WHEN 3 * b1 + 2 * b2 + b3 <= 5 THEN 'HEALTHY' WHEN 3 * b1 + 2 * b2 + b3 <= 15 THEN 'WARNING'
       WHEN 3 * b1 + 2 * b2 + b3 <= 30 THEN 'DEGRADED' ELSE 'CRITICAL' END AS score_status FROM ws"""


@query("hlt10_weighted_error_score", HLT10_SQL)
def hlt10(spark, sf_dir):
    m = Model(spark, sf_dir)
    return H.weighted_error_score(m.error_logs(), m.as_of(), unit_s=U)


# ------------------------------------------------------------------ HLT-9
HLT9_CTES = [
    ("ws", WSCORE_CTE),
    ("syn", f"SELECT application_id, avg(success_rate) AS s FROM synthetic_metrics WHERE {since('recorded_at', 5 * U)} GROUP BY 1"),
    ("hm", f"SELECT application_id, count(DISTINCT CASE WHEN health_status = 'HEALTHY' THEN host_id END) AS hh, "
           f"count(DISTINCT host_id) AS th FROM host_metrics WHERE {since('recorded_at', 5 * U)} GROUP BY 1"),
    ("al", f"SELECT application_id, count(DISTINCT alert_id) AS ac FROM alerts WHERE status = 'ACTIVE' "
           f"AND {since('created_at', 60 * U)} GROUP BY 1"),
    ("ch", f"SELECT application_id, count(*) AS ch FROM metrics_wide WHERE {since('recorded_at', 10 * U)} "
           "AND error_rate < 1 GROUP BY 1"),
    ("j", """SELECT a.application_id, a.application_name, syn.s, COALESCE(hm.hh, 0) AS hh, COALESCE(hm.th, 0) AS th,
  COALESCE(3 * ws.b1 + 2 * ws.b2 + ws.b3, 0) AS w, COALESCE(al.ac, 0) AS ac, COALESCE(ch.ch, 0) AS ch
FROM applications a LEFT JOIN syn USING (application_id) LEFT JOIN hm USING (application_id)
LEFT JOIN ws USING (application_id) LEFT JOIN al USING (application_id) LEFT JOIN ch USING (application_id)"""),
    ("health", f"""SELECT application_id, application_name, {r4(rnd('s', 2))} AS synthetic_health_pct,
  CAST(hh AS VARCHAR) || '/' || CAST(th AS VARCHAR) AS host_health, CAST(w AS BIGINT) AS weighted_error_score,
  CAST(ac AS BIGINT) AS active_alerts, CAST(ch AS BIGINT) AS consecutive_healthy_periods,
  CASE WHEN s < 95 AND hh * 1.0 / NULLIF(th, 0) < 0.5 AND w >= 20 THEN 'CRITICAL'
       WHEN s < 90 AND ch <= 2 THEN 'CRITICAL'
       WHEN s < 98 AND w >= 10 THEN 'DEGRADED'
       WHEN hh * 1.0 / NULLIF(th, 0) < 0.8 AND w >= 5 THEN 'DEGRADED'
       WHEN s < 99 OR w BETWEEN 3 AND 9 OR ac > 0 THEN 'WARNING'
       WHEN ch >= 5 AND w > 0 THEN 'RECOVERING' ELSE 'HEALTHY' END AS overall_status,
  CASE WHEN ch >= 8 THEN 'HIGH' WHEN ch >= 5 THEN 'MEDIUM' WHEN ch >= 2 THEN 'LOW' ELSE 'VERY_LOW' END AS status_confidence
FROM j"""),
]
HLT9_SQL = with_("applications", "error_logs", "synthetic_metrics", "host_metrics", "alerts", "metrics_wide",
                 extra=HLT9_CTES) + "SELECT * FROM health"


def _health(m):
    return H.application_health(m.applications(), m.synthetic_metrics(5 * U), m.host_metrics(5 * U), m.error_logs(),
                                m.alerts(), m.metrics_wide(10 * U), m.as_of(), unit_s=U)


query("hlt9_application_health", HLT9_SQL)(lambda spark, sf_dir: _health(Model(spark, sf_dir).sliced(60 * U)))

# ------------------------------------------------------------------ HLT-11 / 12
CORR_CTES = [
    ("ec", f"SELECT application_id, count(*) AS n FROM error_logs WHERE {since('recorded_at', 10 * U)} GROUP BY 1"),
    ("ci", "SELECT a.application_id, a.application_name, a.datacenter_id, a.infrastructure_group, "
           "COALESCE(ec.n, 0) AS error_count, CASE WHEN COALESCE(ec.n, 0) >= 5 THEN 1 ELSE 0 END AS has_issue "
           "FROM applications a LEFT JOIN ec USING (application_id)"),
    ("ii", "SELECT datacenter_id, infrastructure_group, count(*) AS total_apps, sum(has_issue) AS affected_apps, "
           f"{rnd('sum(has_issue) * 100.0 / count(*)', 2)} AS pct_affected FROM ci GROUP BY 1, 2"),
    ("corr", f"""SELECT ci.application_id, ci.application_name, CAST(ci.error_count AS BIGINT) AS error_count,
  CAST(ii.affected_apps AS BIGINT) AS apps_in_group_affected, CAST(ii.total_apps AS BIGINT) AS total_apps_in_group,
  {r4('ii.pct_affected')} AS pct_affected,
  CASE WHEN ii.pct_affected >= 50 THEN 'SUPPRESS_ALERT' WHEN ii.affected_apps = 1 THEN 'RAISE_ALERT'
       ELSE 'RAISE_WITH_CORRELATION' END AS alert_action,
  CASE WHEN ii.pct_affected >= 50 THEN 'Infrastructure issue suspected - ' || CAST(ii.affected_apps AS VARCHAR)
         || ' apps affected in ' || ci.infrastructure_group
       WHEN ii.affected_apps = 1 THEN 'Isolated application issue'
       ELSE 'Correlated with ' || CAST(ii.affected_apps - 1 AS VARCHAR) || ' other app(s)' END AS alert_context
FROM ci JOIN ii USING (datacenter_id, infrastructure_group) WHERE ci.has_issue = 1"""),
]
HLT11_SQL = with_("applications", "error_logs", extra=CORR_CTES) + "SELECT * FROM corr"


def _corr(m):
    return H.correlation_suppression(m.applications(), m.error_logs(), m.as_of(), window_s=10 * U)


query("hlt11_correlation_suppression", HLT11_SQL)(lambda spark, sf_dir: _corr(Model(spark, sf_dir)))

HLT12_SQL = with_("applications", "error_logs", extra=CORR_CTES[:2]) + f"""
SELECT datacenter_id, infrastructure_group, CAST(count(*) AS BIGINT) AS total_apps,
  CAST(sum(has_issue) AS BIGINT) AS affected_apps, {r4('sum(has_issue) * 100.0 / count(*)')} AS pct_affected,
  CASE WHEN sum(has_issue) * 100.0 / count(*) <= 20 THEN 'RAISE_INDIVIDUAL'
       WHEN sum(has_issue) * 100.0 / count(*) <= 50 THEN 'RAISE_WITH_CORRELATION'
       WHEN sum(has_issue) * 100.0 / count(*) <= 80 THEN 'SUPPRESS_APPS_RAISE_INFRA'
       ELSE 'SUPPRESS_ALL_RAISE_CRITICAL_INFRA' END AS group_action
FROM ci GROUP BY 1, 2"""


@query("hlt12_group_decision", HLT12_SQL)
def hlt12(spark, sf_dir):
    m = Model(spark, sf_dir)
    return H.group_decision(m.applications(), m.error_logs(), m.as_of(), window_s=10 * U)


# ------------------------------------------------------------------ HLT-17
ERRSTATUS_CTE = (f"SELECT application_id, count(*) AS total_errors, count(DISTINCT {bucket('recorded_at', U)}) AS d "
                 f"FROM error_logs WHERE {since('recorded_at', 30 * U)} GROUP BY 1")
ERR_LADDER = ("CASE WHEN d >= 16 THEN 'CRITICAL' WHEN d >= 6 THEN 'DEGRADED' WHEN d >= 3 AND total_errors >= 20 "
              "THEN 'DEGRADED' WHEN d >= 1 THEN 'WARNING' ELSE 'HEALTHY' END")
HLT17_SQL = with_("error_logs", extra=[("es", ERRSTATUS_CTE)]) + f"""
SELECT application_id, CAST(total_errors AS BIGINT) AS total_errors, CAST(d AS BIGINT) AS distinct_error_periods,
  {ERR_LADDER} AS error_status,
  CASE WHEN d >= 16 THEN 'persistent' WHEN d >= 11 THEN 'high confidence' WHEN d >= 6 THEN 'sustained'
       WHEN d >= 3 AND total_errors >= 20 THEN 'dense' WHEN d >= 1 THEN 'monitor' ELSE 'none' END AS error_note
FROM es"""


@query("hlt17_error_minute_status", HLT17_SQL)
def hlt17(spark, sf_dir):
    m = Model(spark, sf_dir)
    return H.error_minute_status(m.error_logs(), m.as_of(), window_s=30 * U, unit_s=U)


# ------------------------------------------------------------------ HLT-13
MAINT_CTES = [
    ("es", ERRSTATUS_CTE),
    ("st", f"SELECT a.application_id, a.application_name, a.infrastructure_group, "
           f"COALESCE(CASE WHEN es.application_id IS NULL THEN NULL ELSE {ERR_LADDER} END, 'HEALTHY') AS current_status, "
           "COALESCE(es.total_errors, 0) AS error_count FROM applications a LEFT JOIN es USING (application_id)"),
    ("maint", f"""SELECT st.application_id, st.application_name, st.current_status, CAST(st.error_count AS BIGINT) AS error_count,
  mw.maintenance_id, mw.maintenance_type, {tstext('mw.start_time')} AS start_time, {tstext('mw.end_time')} AS end_time,
  CASE WHEN mw.maintenance_id IS NOT NULL AND {ASOF} BETWEEN mw.start_time AND mw.end_time THEN 'SUPPRESS_DURING_MAINTENANCE'
       WHEN mw.maintenance_id IS NOT NULL AND {ASOF} BETWEEN mw.start_time - INTERVAL 15 HOUR AND mw.start_time THEN 'PRE_MAINTENANCE_WINDOW'
       WHEN mw.maintenance_id IS NOT NULL AND {ASOF} BETWEEN mw.end_time AND mw.end_time + INTERVAL 30 HOUR THEN 'POST_MAINTENANCE_STABILIZATION'
       ELSE 'NORMAL_MONITORING' END AS monitoring_mode,
  CASE WHEN {ASOF} BETWEEN mw.start_time AND mw.end_time THEN 0
       WHEN {ASOF} BETWEEN mw.end_time AND mw.end_time + INTERVAL 30 HOUR AND st.error_count < 10 THEN 0 ELSE 1 END AS should_alert
FROM st LEFT JOIN maintenance_windows mw
  ON (st.application_id = mw.application_id OR mw.scope = 'ALL' OR st.infrastructure_group = mw.infrastructure_group)
 AND {ASOF} BETWEEN mw.start_time - INTERVAL 15 HOUR AND mw.end_time + INTERVAL 30 HOUR
WHERE st.current_status IN ('WARNING', 'DEGRADED', 'CRITICAL')"""),
]
HLT13_SQL = with_("applications", "error_logs", "maintenance_windows", extra=MAINT_CTES) + "SELECT * FROM maint"


def _maint(m):
    a = m.as_of()
    st = H.application_status(m.applications(), m.error_logs(), a, window_s=30 * U, unit_s=U)
    return H.maintenance_mode(st, m.maintenance_windows(), a, pre_s=15 * U, post_s=30 * U)


query("hlt13_maintenance_mode", HLT13_SQL)(lambda spark, sf_dir: _maint(Model(spark, sf_dir)))

# ------------------------------------------------------------------ HLT-14
DASH_CTES = [
    ("m5", f"SELECT application_id, avg(success_rate) AS s, avg(response_time_ms) AS rt, max(error_rate) AS mer, "
           f"count(CASE WHEN success_rate < 99 THEN 1 END) AS dp FROM metrics_wide WHERE {since('recorded_at', 5 * U)} GROUP BY 1"),
    ("h5", f"SELECT application_id, count(*) AS th, sum(CASE WHEN health_status = 'HEALTHY' THEN 1 ELSE 0 END) AS hh "
           f"FROM host_metrics WHERE {since('recorded_at', 5 * U)} GROUP BY 1"),
    ("e30", f"SELECT application_id, count(*) AS ec, count(DISTINCT {bucket('recorded_at', U)}) AS dem "
            f"FROM error_logs WHERE {since('recorded_at', 30 * U)} GROUP BY 1"),
    ("a1", "SELECT application_id, count(*) AS ac FROM alerts WHERE status = 'ACTIVE' GROUP BY 1"),
    ("dash", f"""SELECT a.application_id, a.application_name, {r4(rnd('COALESCE(m5.s, 100)', 2))} AS synthetic_health_pct,
  CAST(COALESCE(h5.hh, 0) AS VARCHAR) || '/' || CAST(COALESCE(h5.th, 0) AS VARCHAR) AS host_health,
  {r4(rnd('COALESCE(m5.mer, 0)', 3))} AS service_failure_rate, CAST(COALESCE(a1.ac, 0) AS BIGINT) AS alert_count,
  CAST(COALESCE(e30.ec, 0) AS BIGINT) AS error_count_30, CAST(COALESCE(e30.dem, 0) AS BIGINT) AS distinct_error_periods,
  CASE WHEN m5.s < 90 AND e30.dem >= 10 THEN 'Critical' WHEN h5.hh * 1.0 / NULLIF(h5.th, 0) < 0.5 THEN 'Critical'
       WHEN m5.s < 98 AND e30.dem >= 5 THEN 'Degraded' WHEN m5.dp >= 3 THEN 'Degraded'
       WHEN h5.hh * 1.0 / NULLIF(h5.th, 0) < 0.8 THEN 'Degraded'
       WHEN m5.s < 99 AND e30.ec > 0 THEN 'Warning' WHEN a1.ac > 0 THEN 'Warning' ELSE 'Healthy' END AS overall_status,
  CASE WHEN e30.dem >= 5 THEN 'Confirmed' WHEN e30.ec > 0 AND e30.dem < 3 THEN 'Possible Transient' ELSE 'Stable' END AS confidence_level
FROM applications a LEFT JOIN m5 USING (application_id) LEFT JOIN h5 USING (application_id)
LEFT JOIN e30 USING (application_id) LEFT JOIN a1 USING (application_id) WHERE a.is_active = 1"""),
]
HLT14_SQL = with_("applications", "metrics_wide", "host_metrics", "error_logs", "alerts", extra=DASH_CTES) + \
    "SELECT * FROM dash"


def _dash(m):
    return H.application_dashboard(m.applications(), m.metrics_wide(5 * U), m.host_metrics(5 * U), m.error_logs(),
                                   m.alerts(), m.as_of(), unit_s=U)


query("hlt14_application_dashboard", HLT14_SQL, headline=True)(lambda spark, sf_dir: _dash(Model(spark, sf_dir).sliced(30 * U)))

# ------------------------------------------------------------------ HLT-15 (WIN-8)
STREAK_CTES = [
    ("s0", f"""SELECT m.*, CASE WHEN metric_value > threshold_value THEN 1 ELSE 0 END AS breach
FROM metrics_long m JOIN threshold_config t USING (entity_id, metric_name) WHERE {since('m.recorded_at', 30 * U)}"""),
    ("s1", "SELECT *, sum(1 - breach) OVER (PARTITION BY entity_id, metric_name ORDER BY recorded_at, row_id "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island, "
           "sum(breach) OVER (PARTITION BY entity_id, metric_name ORDER BY recorded_at, row_id "
           "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS biw FROM s0"),
    ("streaks", f"""SELECT entity_id, entity_name, metric_name, {tstext('recorded_at')} AS recorded_at,
  {r4('metric_value')} AS metric_value, breach,
  CAST(sum(breach) OVER (PARTITION BY entity_id, metric_name, island ORDER BY recorded_at, row_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS breach_streak,
  CAST(biw AS BIGINT) AS breaches_in_window FROM s1"""),
]
HLT15_SQL = with_("metrics_long", "threshold_config", extra=STREAK_CTES) + """
SELECT entity_id, entity_name, metric_name, max(breach_streak) AS max_streak,
  arg_max(breach_streak, (recorded_at, breach_streak)) AS current_streak,
  CAST(sum(CASE WHEN breach_streak >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS alert_rows,
  CASE WHEN max(breach_streak) >= 4 THEN 1 ELSE 0 END AS persistent
FROM streaks GROUP BY 1, 2, 3"""


@query("hlt15_persistent_breach", HLT15_SQL)
def hlt15(spark, sf_dir):
    m = Model(spark, sf_dir)
    metrics = m.metrics_long()
    return H.persistent_breach(metrics, m.thresholds(metrics), m.as_of(), window_s=30 * U)


HLT15S_SQL = with_("metrics_long", "threshold_config", extra=STREAK_CTES) + \
    "SELECT *, CASE WHEN breach_streak >= 4 THEN 1 ELSE 0 END AS should_alert FROM streaks"


@query("win8_breach_streaks", HLT15S_SQL)
def win8(spark, sf_dir):
    m = Model(spark, sf_dir)
    metrics = m.metrics_long()
    return H.breach_streaks(metrics, m.thresholds(metrics), m.as_of(), window_s=30 * U)


# ------------------------------------------------------------------ HLT-18 / HLT-19
TIERS_CTE = """
SELECT d.application_id, d.application_name, d.synthetic_health_pct, d.distinct_error_periods,
  CAST(COALESCE(3 * ws.b1 + 2 * ws.b2 + ws.b3, 0) AS BIGINT) AS weighted_error_score, d.alert_count, d.confidence_level,
  CASE WHEN d.synthetic_health_pct < 90 OR d.distinct_error_periods >= 15
            OR (CAST(split_part(host_health, '/', 2) AS INTEGER) - CAST(split_part(host_health, '/', 1) AS INTEGER)) * 1.0
               / NULLIF(CAST(split_part(host_health, '/', 2) AS INTEGER), 0) > 0.5 THEN 'P1-CRITICAL'
       WHEN (d.synthetic_health_pct >= 90 AND d.synthetic_health_pct < 98) OR d.distinct_error_periods BETWEEN 10 AND 14
            OR COALESCE(3 * ws.b1 + 2 * ws.b2 + ws.b3, 0) BETWEEN 16 AND 30 THEN 'P2-DEGRADED'
       WHEN (d.synthetic_health_pct >= 98 AND d.synthetic_health_pct < 99) OR d.distinct_error_periods BETWEEN 5 AND 9
            OR d.alert_count = 1 THEN 'P3-WARNING'
       WHEN d.distinct_error_periods BETWEEN 1 AND 4 OR d.confidence_level = 'Possible Transient' THEN 'P4-INFO'
       ELSE 'NONE' END AS alert_tier
FROM dash d LEFT JOIN ws USING (application_id)"""
HLT18_SQL = with_("applications", "metrics_wide", "host_metrics", "error_logs", "alerts",
                  extra=DASH_CTES + [("ws", WSCORE_CTE), ("tiers", TIERS_CTE)]) + "SELECT * FROM tiers"


def _tiers(m):
    a = m.as_of()
    return H.alert_tier(_dash(m), H.weighted_error_score(m.error_logs(), a, unit_s=U))


query("hlt18_alert_tier", HLT18_SQL)(lambda spark, sf_dir: _tiers(Model(spark, sf_dir)))

HLT19_SQL = with_("applications", "metrics_wide", "host_metrics", "error_logs", "alerts", "synthetic_metrics",
                  "metrics_long", "threshold_config", "maintenance_windows",
                  extra=DASH_CTES + HLT9_CTES + CORR_CTES + MAINT_CTES + STREAK_CTES + [("tiers", TIERS_CTE)]) + """
, st2 AS (SELECT entity_id AS application_id, max(breach_streak) AS max_streak FROM streaks GROUP BY 1),
gp AS (SELECT application_id, max(pct_affected) AS g FROM corr GROUP BY 1),
mt AS (SELECT application_id, max(CASE WHEN monitoring_mode = 'SUPPRESS_DURING_MAINTENANCE' THEN 1 ELSE 0 END) AS inm,
         max(CASE WHEN monitoring_mode = 'POST_MAINTENANCE_STABILIZATION' AND error_count < 10 THEN 1 ELSE 0 END) AS pq
       FROM maint GROUP BY 1),
x AS (SELECT t.*, st2.max_streak, gp.g, mt.inm, mt.pq, h.overall_status,
  CASE WHEN COALESCE(st2.max_streak, 0) < 4 THEN 'TRANSIENT' WHEN gp.g > 50 THEN 'INFRA_GROUP'
       WHEN mt.inm = 1 THEN 'MAINTENANCE' WHEN mt.pq = 1 THEN 'POST_MAINTENANCE'
       WHEN t.confidence_level = 'Possible Transient' AND t.alert_tier IN ('P1-CRITICAL', 'P2-DEGRADED') THEN 'POSSIBLE_TRANSIENT'
       WHEN h.overall_status = 'RECOVERING' THEN 'RECOVERING' END AS reason
  FROM tiers t LEFT JOIN st2 USING (application_id) LEFT JOIN gp USING (application_id)
  LEFT JOIN mt USING (application_id) LEFT JOIN health h USING (application_id))
SELECT application_id, application_name, alert_tier, CAST(COALESCE(max_streak, 0) AS BIGINT) AS max_streak,
  round(CAST(g AS DOUBLE), 4) AS group_pct_affected, COALESCE(overall_status, 'HEALTHY') AS overall_status,
  COALESCE(reason, 'NONE') AS suppress_reason, CASE WHEN reason IS NULL AND alert_tier <> 'NONE' THEN 1 ELSE 0 END AS send_alert
FROM x"""


@query("hlt19_suppress", HLT19_SQL)
def hlt19(spark, sf_dir):
    m = Model(spark, sf_dir).sliced(60 * U)
    metrics = m.metrics_long()
    streaks = H.persistent_breach(metrics, m.thresholds(metrics), m.as_of(), window_s=30 * U)
    return H.suppress(_tiers(m), streaks, _corr(m), _maint(m), _health(m))


# ------------------------------------------------------------------ HLT-16
HYST_WINDOW = 72  # periods (hours)


def _hyst_case(st: str, bad: str, ok: str) -> str:
    up = f"{st} IN ('HEALTHY', 'RECOVERING')"
    return (f"CASE WHEN {up} AND {bad} >= 8 THEN 'CRITICAL' WHEN {up} AND {bad} >= 4 THEN 'DEGRADED' "
            f"WHEN {st} = 'DEGRADED' AND {bad} >= 8 THEN 'CRITICAL' "
            f"WHEN {st} IN ('DEGRADED', 'CRITICAL') AND {ok} >= 5 THEN 'RECOVERING' "
            f"WHEN {st} = 'RECOVERING' AND {ok} >= 8 THEN 'HEALTHY' ELSE {st} END")


_LAST = f"CAST(floor(epoch_us({ASOF}) / {U * 1_000_000}) AS BIGINT)"
HLT16_SQL = "WITH RECURSIVE " + with_("applications", "error_logs", extra=[
    ("cnt", f"SELECT application_id, {bucket('recorded_at', U)} AS period, count(*) AS errors FROM error_logs "
            f"WHERE {since('recorded_at', HYST_WINDOW * U)} GROUP BY ALL"),
    ("dense", f"""SELECT a.application_id, g.period, COALESCE(c.errors, 0) AS errors,
  row_number() OVER (PARTITION BY a.application_id ORDER BY g.period) AS idx
FROM applications a CROSS JOIN (SELECT unnest(range({_LAST} - {HYST_WINDOW - 1}, {_LAST} + 1)) AS period) g
LEFT JOIN cnt c ON c.application_id = a.application_id AND c.period = g.period"""),
    ("r", f"""SELECT application_id, idx, period, errors, CASE WHEN errors >= 1 THEN 1 ELSE 0 END AS bad,
  CASE WHEN errors >= 1 THEN 0 ELSE 1 END AS ok,
  {_hyst_case("'HEALTHY'", "CASE WHEN errors >= 1 THEN 1 ELSE 0 END", "CASE WHEN errors >= 1 THEN 0 ELSE 1 END")} AS status
FROM dense WHERE idx = 1
UNION ALL
SELECT d.application_id, d.idx, d.period, d.errors, CASE WHEN d.errors >= 1 THEN r.bad + 1 ELSE 0 END,
  CASE WHEN d.errors >= 1 THEN 0 ELSE r.ok + 1 END,
  {_hyst_case("r.status", "CASE WHEN d.errors >= 1 THEN r.bad + 1 ELSE 0 END", "CASE WHEN d.errors >= 1 THEN 0 ELSE r.ok + 1 END")}
FROM r JOIN dense d ON d.application_id = r.application_id AND d.idx = r.idx + 1""")])[len("WITH "):] + """
SELECT application_id, CAST(period AS BIGINT) AS period, CAST(errors AS BIGINT) AS errors, CAST(bad AS INTEGER) AS bad,
  CAST(ok AS INTEGER) AS ok, status FROM r"""


@query("hlt16_recovery_status", HLT16_SQL)
def hlt16(spark, sf_dir):
    m = Model(spark, sf_dir)
    pe = H.dense_period_errors(m.error_logs(), m.applications(), m.as_of(), window_s=HYST_WINDOW * U, unit_s=U)
    return H.recovery_status(pe)
