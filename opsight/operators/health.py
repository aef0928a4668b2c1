"""Application and host health with false-alarm reduction (HLT-1..20).

Every operator takes DataFrames of the model (see `sources.adapters`) and an
`as_of` Column (default: newest event time), and returns a DataFrame. Window
lengths are seconds; defaults are the reference's minutes. Aggregates are
computed per side *before* joining (no fan-out), joins to small per-key
aggregates are left to AQE, which broadcasts a side only once its measured
size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import (MIN, DAY, bucket, count_if, day_type, ladder, r4, rank_of, resolve_as_of, rnd,
                              since, ts_text)
from ..functions.segments import (SEG, carried_states, machine_table, segmented, streak_summary, with_carried_rows,
                                  with_streak)
from ..functions.selection import with_percentiles

BASELINE_PROBS = {"baseline_p50": 0.50, "baseline_p95": 0.95, "baseline_p99": 0.99}
HEALTH_ORDER = ["CRITICAL", "DEGRADED", "WARNING", "RECOVERING", "HEALTHY"]


# --------------------------------------------------------------------------- HLT-1
def threshold_breach(metrics: DataFrame, thresholds: DataFrame, errors: DataFrame, as_of=None,
                     current_s: int = MIN, lookback_s: int = 30 * MIN, period_s: int = MIN,
                     critical_errors: int = 5, degraded_periods: int = 15,
                     quiet_degraded_periods: int = 10) -> DataFrame:
    """Threshold breach with error context.

    CRITICAL: breaching and >= 5 errors in the lookback; DEGRADED: breaching and
    >= 15 error periods (dead branch as coded, F28); WARNING: breaching with no
    errors; DEGRADED: not breaching and >= 10 error periods; else HEALTHY (this
    includes breaching with 1-4 errors, F5).
    """
    a = resolve_as_of(as_of, metrics, "recorded_at")
    cur = (metrics.filter(since("recorded_at", a, current_s))
           .join(thresholds, ["entity_id", "metric_name"])
           .withColumn("is_breaching", (F.col("metric_value") > F.col("threshold_value")).cast("int")))
    he = (errors.filter(since("recorded_at", a, lookback_s))
          .groupBy("entity_id")
          .agg(F.count(F.lit(1)).alias("error_count"),
               F.countDistinct(bucket("recorded_at", period_s)).alias("error_periods")))
    j = cur.join(he, "entity_id", "left")
    b = F.col("is_breaching") == 1
    n = F.col("error_count")
    status = ladder([
        (b & (n >= critical_errors), "CRITICAL"),
        (b & (F.col("error_periods") >= degraded_periods), "DEGRADED"),
        (b & (F.coalesce(n, F.lit(0)) == 0), "WARNING"),
        (~b & (F.col("error_periods") >= quiet_degraded_periods), "DEGRADED"),
    ], "HEALTHY")
    note = ladder([
        (b & (F.coalesce(n, F.lit(0)) == 0), "Possible transient spike - monitoring"),
        (b & (n >= critical_errors), "Confirmed issue - errors persisting"),
    ])
    return j.select(
        "entity_id", "entity_name", "entity_type", "metric_name",
        r4("metric_value").alias("metric_value"), r4("threshold_value").alias("threshold_value"),
        ts_text("recorded_at").alias("recorded_at"),
        F.coalesce(n, F.lit(0)).cast("long").alias("errors_in_lookback"),
        F.coalesce(F.col("error_periods"), F.lit(0)).cast("long").alias("error_periods"),
        status.alias("health_status"), note.alias("status_note"))


# --------------------------------------------------------------------------- HLT-2
def same_hour_baseline(metrics: DataFrame, as_of=None, days: int = 7, weekdays_only: bool = False) -> DataFrame:
    """Method 1: last `days` days at the hour of as_of: mean, sample SD, n, min, max, exact p50/95/99."""
    a = resolve_as_of(as_of, metrics, "recorded_at")
    m = metrics.filter(since("recorded_at", a, days * DAY) & (F.hour("recorded_at") == F.hour(a)))
    if weekdays_only:
        m = m.filter(F.dayofweek("recorded_at").between(2, 6))
    keys = ["entity_id", "entity_name", "metric_name"]
    moments = (m.groupBy(*keys)
               .agg(F.avg("metric_value").alias("baseline_avg"),
                    F.stddev_samp("metric_value").alias("baseline_stddev"),
                    F.count(F.lit(1)).alias("sample_count"),
                    F.min("metric_value").alias("baseline_min"),
                    F.max("metric_value").alias("baseline_max")))
    return (with_percentiles(moments, m, keys, "metric_value", BASELINE_PROBS)
            .select("entity_id", "entity_name", "metric_name", F.hour(a).alias("current_hour"),
                    *[r4(c).alias(c) for c in ("baseline_avg", "baseline_stddev")],
                    F.col("sample_count").cast("long").alias("sample_count"),
                    *[r4(c).alias(c) for c in ("baseline_min", "baseline_max", "baseline_p50",
                                               "baseline_p95", "baseline_p99")]))


# --------------------------------------------------------------------------- HLT-3 / SRC-4
def entity_baseline(metrics: DataFrame, as_of=None, days: int = 30, rounded: bool = True) -> DataFrame:
    """Method 2: baseline per entity, metric, hour of day and WEEKDAY/WEEKEND (exact percentiles, F1)."""
    a = resolve_as_of(as_of, metrics, "recorded_at")
    m = (metrics.filter(since("recorded_at", a, days * DAY))
         .withColumn("hour_of_day", F.hour("recorded_at"))
         .withColumn("day_type", day_type("recorded_at")))
    keys = ["entity_id", "entity_name", "metric_name", "hour_of_day", "day_type"]
    moments = m.groupBy(*keys).agg(F.avg("metric_value").alias("baseline_avg"),
                                   F.stddev_samp("metric_value").alias("baseline_stddev"),
                                   F.count(F.lit(1)).alias("sample_count"))
    out = with_percentiles(moments, m, keys, "metric_value", BASELINE_PROBS).withColumn("calculated_at", ts_text(a))
    if rounded:
        for c in ("baseline_avg", "baseline_stddev", "baseline_p50", "baseline_p95", "baseline_p99"):
            out = out.withColumn(c, r4(c))
    return out


# --------------------------------------------------------------------------- HLT-4
def baseline_anomaly(metrics: DataFrame, baseline: DataFrame, as_of=None, current_s: int = 5 * MIN) -> DataFrame:
    """Method 3: mean of the current window against the baseline of as_of's hour and day type."""
    a = resolve_as_of(as_of, metrics, "recorded_at")
    cm = (metrics.filter(since("recorded_at", a, current_s))
          .groupBy("entity_id", "entity_name", "metric_name")
          .agg(F.avg("metric_value").alias("current_value"), F.max("metric_value").alias("current_max")))
    b = (baseline.filter((F.col("hour_of_day") == F.hour(a)) & (F.col("day_type") == day_type(a)))
         .select("entity_id", "metric_name", "baseline_avg", "baseline_stddev", "baseline_p95",
                 "baseline_p99", "sample_count"))
    j = cm.join(b, ["entity_id", "metric_name"], "left")
    sd, avg, cv = F.col("baseline_stddev"), F.col("baseline_avg"), F.col("current_value")
    z = (cv - avg) / sd
    return j.select(
        "entity_id", "entity_name", "metric_name",
        r4(cv).alias("current_value"), r4(avg).alias("baseline_avg"), r4(sd).alias("baseline_stddev"),
        F.col("sample_count").cast("long").alias("sample_count"),
        r4(F.when(sd > 0, z).otherwise(F.lit(0.0))).alias("z_score"),
        r4(avg + 2 * F.coalesce(sd, F.lit(0.0))).alias("threshold_2sigma"),
        r4(avg + 3 * F.coalesce(sd, F.lit(0.0))).alias("threshold_3sigma"),
        ladder([((sd > 0) & (z > 3), "CRITICAL_ANOMALY"),
                ((sd > 0) & (z > 2), "WARNING_ANOMALY"),
                (cv > F.col("baseline_p95"), "ELEVATED")], "NORMAL").alias("anomaly_status"),
        r4(F.when(avg > 0, rnd((cv - avg) / avg * 100, 2)).otherwise(F.lit(0.0))).alias("pct_above_baseline"))


# --------------------------------------------------------------------------- HLT-5
def error_rate_baseline(wide: DataFrame, as_of=None, days: int = 14) -> DataFrame:
    """Method 4: hourly error-rate baseline per application, hour and day type; 2σ / 3σ thresholds."""
    a = resolve_as_of(as_of, wide, "recorded_at")
    daily = (wide.filter(since("recorded_at", a, days * DAY))
             .groupBy("application_id", "application_name", F.to_date("recorded_at").alias("metric_date"),
                      F.hour("recorded_at").alias("hour_of_day"), F.dayofweek("recorded_at").alias("day_of_week"))
             .agg(F.sum("error_count").alias("total_errors"), F.sum("request_count").alias("total_requests"))
             .withColumn("error_rate_pct",
                         F.when(F.col("total_requests") > 0,
                                rnd(F.col("total_errors") * 100.0 / F.col("total_requests"), 4))
                         .otherwise(F.lit(0.0))))
    sd = F.stddev_samp("error_rate_pct")
    mean = F.avg("error_rate_pct")
    return (daily.groupBy("application_id", "application_name", "hour_of_day",
                          F.when(F.col("day_of_week").isin(1, 7), "WEEKEND").otherwise("WEEKDAY").alias("day_type"))
            .agg(r4(mean).alias("baseline_error_rate_avg"),
                 r4(sd).alias("baseline_error_rate_stddev"),
                 r4(mean + 2 * F.coalesce(sd, F.lit(0.0))).alias("warning_threshold"),
                 r4(mean + 3 * F.coalesce(sd, F.lit(0.0))).alias("critical_threshold"),
                 F.count(F.lit(1)).alias("days_of_data"),
                 r4(F.min("error_rate_pct")).alias("min_error_rate"),
                 r4(F.max("error_rate_pct")).alias("max_error_rate")))


# --------------------------------------------------------------------------- HLT-6
def anomaly_with_fallback(anomaly: DataFrame, min_samples: int = 7, wide_sigma: float = 4.0,
                          low_sd_ratio: float = 0.01, pct_limit: float = 50.0) -> DataFrame:
    """Small-sample and low-variance fallback over `baseline_anomaly` output.

    No baseline -> NO_BASELINE; n < min_samples -> z against a wider band
    (`wide_sigma`); SD <= low_sd_ratio * mean -> percentage deviation > 50 %
    is an anomaly; else the sigma rule as in method 3.
    """
    n, sd, avg = F.col("sample_count"), F.col("baseline_stddev"), F.col("baseline_avg")
    z, cv = F.col("z_score"), F.col("current_value")
    dev_pct = F.try_divide((cv - avg) * 100.0, avg)
    method = ladder([(avg.isNull(), "NO_BASELINE"),
                     (n < min_samples, "WIDE_SIGMA"),
                     (F.coalesce(sd, F.lit(0.0)) <= F.abs(avg) * low_sd_ratio, "PCT_DEVIATION")], "SIGMA")
    status = ladder([
        (method == "NO_BASELINE", "NO_BASELINE"),
        ((method == "WIDE_SIGMA") & (z > wide_sigma), "CRITICAL_ANOMALY"),
        ((method == "WIDE_SIGMA"), "NORMAL"),
        ((method == "PCT_DEVIATION") & (dev_pct > pct_limit), "CRITICAL_ANOMALY"),
        ((method == "PCT_DEVIATION"), "NORMAL"),
        (z > 3, "CRITICAL_ANOMALY"), (z > 2, "WARNING_ANOMALY")], "NORMAL")
    return anomaly.select("entity_id", "entity_name", "metric_name", "current_value", "baseline_avg",
                          "baseline_stddev", "sample_count", "z_score",
                          method.alias("method"), r4(dev_pct).alias("deviation_pct"),
                          status.alias("anomaly_status"))


# --------------------------------------------------------------------------- HLT-7
def repeated_host_errors(host_errors: DataFrame, as_of=None, unit_s: int = MIN,
                         windows=(5, 15, 30, 60), baseline_days: int = 7) -> DataFrame:
    """Repeated host errors: counts in 5/15/30/60 units, distinct error periods in 30,
    against the same-hour daily baseline over `baseline_days`."""
    a = resolve_as_of(as_of, host_errors, "recorded_at")
    w5, w15, w30, w60 = windows
    t = F.col("recorded_at")
    in30 = since(t, a, w30 * unit_s)
    hep = (host_errors.filter(since(t, a, w60 * unit_s))
           .groupBy("host_id", "host_name", "application_id")
           .agg(count_if(since(t, a, w5 * unit_s)).alias("errors_5"),
                count_if(since(t, a, w15 * unit_s)).alias("errors_15"),
                count_if(in30).alias("errors_30"),
                count_if(since(t, a, w60 * unit_s)).alias("errors_60"),
                F.countDistinct(F.when(in30, bucket(t, unit_s))).alias("distinct_error_periods_30"),
                F.max(t).alias("last_error_time")))
    hourly = (host_errors.filter(since(t, a, baseline_days * DAY) & (F.hour(t) == F.hour(a)))
              .groupBy("host_id", F.to_date(t).alias("d")).agg(F.count(F.lit(1)).alias("error_count")))
    hb = hourly.groupBy("host_id").agg(F.avg("error_count").alias("avg_hourly_errors"),
                                       F.stddev_samp("error_count").alias("stddev_hourly_errors"))
    j = hep.join(hb, "host_id", "left")
    d30, e30, e60, e5 = (F.col("distinct_error_periods_30"), F.col("errors_30"), F.col("errors_60"),
                         F.col("errors_5"))
    avg, sd = F.col("avg_hourly_errors"), F.coalesce(F.col("stddev_hourly_errors"), F.lit(0.0))
    status = ladder([
        ((d30 >= 15) & (e30 >= 20), "CRITICAL"),
        ((e60 > avg + 3 * sd) & (e60 >= 10), "CRITICAL"),
        (d30 >= 10, "DEGRADED"),
        ((e60 > avg + 2 * sd) & (e60 >= 5), "DEGRADED"),
        ((e5 >= 5) & (d30 < 10), "WARNING")], "HEALTHY")
    rec = ladder([(d30 >= 15, "Persistent errors - immediate attention required"),
                  ((e5 >= 5) & (d30 < 5), "Recent spike - monitoring for persistence")])
    return j.select("host_id", "host_name", "application_id", "errors_5", "errors_15", "errors_30",
                    "errors_60", F.col("distinct_error_periods_30").cast("long").alias("distinct_error_periods_30"),
                    r4(avg).alias("avg_hourly_errors"), status.alias("host_health_status"),
                    rec.alias("recommendation"))


# --------------------------------------------------------------------------- HLT-8 (WIN-1..3)
def _breaches(metrics: DataFrame, thresholds: DataFrame, as_of: Column, window_s: float, segment_s: float | None) -> DataFrame:
    """Rows of the window with `breach`, cut into segments of `segment_s` (default: a sixth of the window)."""
    m = (metrics.filter(since("recorded_at", as_of, window_s)).join(thresholds, ["entity_id", "metric_name"])
         .withColumn("breach", (F.col("metric_value") > F.col("threshold_value")).cast("int")))
    return segmented(m, "recorded_at", segment_s or window_s / 6)


SERIES, IN_ORDER = ["entity_id", "metric_name"], ["recorded_at", "row_id"]


def spike_classification(metrics: DataFrame, thresholds: DataFrame, as_of=None, unit_s: int = MIN,
                         window_units: int = 30, current_units: int = 1, segment_s: float | None = None) -> DataFrame:
    """Transient spike vs genuine issue, from rolling mean/SD over the 10 previous rows
    and the breach count over rows 5 preceding..current (as coded, F2).

    The series is cut into segments that carry in the ten rows before them, so a long one is the work of many tasks.
    """
    a = resolve_as_of(as_of, metrics, "recorded_at")
    rows = with_carried_rows(_breaches(metrics, thresholds, a, window_units * unit_s, segment_s), SERIES, IN_ORDER, 10,
                             ["metric_value", "breach"])
    w = Window.partitionBy(*SERIES, SEG).orderBy(*IN_ORDER)
    m = (rows.withColumn("rolling_avg", F.avg("metric_value").over(w.rowsBetween(-10, -1)))
         .withColumn("rolling_stddev", F.stddev_samp("metric_value").over(w.rowsBetween(-10, -1)))
         .withColumn("breaches_in_window", F.sum("breach").over(w.rowsBetween(-5, 0))).filter(~F.col("_halo")))
    v, ra, rs, c = F.col("metric_value"), F.col("rolling_avg"), F.col("rolling_stddev"), F.col("breaches_in_window")
    cls = ladder([(c >= 4, "GENUINE_ISSUE"),
                  ((v > ra + 3 * rs) & (c <= 1), "TRANSIENT_SPIKE"),
                  ((v > ra * 1.5) & c.between(2, 3), "TRENDING_UP")], "NORMAL")
    return (m.filter(since("recorded_at", a, current_units * unit_s))
            .select("entity_id", "entity_name", "metric_name", r4(v).alias("metric_value"),
                    ts_text("recorded_at").alias("recorded_at"),
                    r4(ra).alias("rolling_avg"), r4(rs).alias("rolling_stddev"),
                    c.cast("long").alias("breaches_in_window"), cls.alias("spike_classification"),
                    F.when(c >= 4, 1).otherwise(0).alias("should_alert")))


# --------------------------------------------------------------------------- HLT-10
def weighted_error_score(errors: DataFrame, as_of=None, unit_s: int = MIN, bands=(5, 15, 30)) -> DataFrame:
    """Time-decay error score per application: 3 / 2 / 1 per error in the last 5 / 15 / 30 units,
    with the note's status bands (0-5 HEALTHY, 6-15 WARNING, 16-30 DEGRADED, 31+ CRITICAL; F23)."""
    a = resolve_as_of(as_of, errors, "recorded_at")
    b1, b2, b3 = bands
    t = F.col("recorded_at")
    g = (errors.filter(since(t, a, b3 * unit_s))
         .groupBy("application_id")
         .agg(count_if(since(t, a, b1 * unit_s)).alias("errors_band1"),
              count_if(since(t, a, b2 * unit_s) & ~since(t, a, b1 * unit_s)).alias("errors_band2"),
              count_if(~since(t, a, b2 * unit_s)).alias("errors_band3")))
    score = F.col("errors_band1") * 3 + F.col("errors_band2") * 2 + F.col("errors_band3")
    return g.select("application_id", "errors_band1", "errors_band2", "errors_band3",
                    score.cast("long").alias("weighted_error_score"),
                    ladder([(score <= 5, "HEALTHY"), (score <= 15, "WARNING"), (score <= 30, "DEGRADED")],
                           "CRITICAL").alias("score_status"))


# --------------------------------------------------------------------------- HLT-9
def application_health(apps: DataFrame, synthetic: DataFrame, hosts: DataFrame, errors: DataFrame,
                       alerts: DataFrame, wide: DataFrame, as_of=None, unit_s: int = MIN) -> DataFrame:
    """Aggregated application health with recovery and confidence.

    The reference joins four detail tables before grouping, multiplying the
    weighted score (F3). Here each side is aggregated per application first and
    the aggregates are left-joined to the applications.
    """
    a = resolve_as_of(as_of, errors, "recorded_at")
    syn = (synthetic.filter(since("recorded_at", a, 5 * unit_s)).groupBy("application_id")
           .agg(F.avg("success_rate").alias("synthetic_health_5")))
    hm = (hosts.filter(since("recorded_at", a, 5 * unit_s)).groupBy("application_id")
          .agg(F.countDistinct(F.when(F.col("health_status") == "HEALTHY", F.col("host_id"))).alias("healthy_hosts"),
               F.countDistinct("host_id").alias("total_hosts")))
    ws = weighted_error_score(errors, a, unit_s).select("application_id", "weighted_error_score")
    al = (alerts.filter((F.col("status") == "ACTIVE") & since("created_at", a, 60 * unit_s))
          .groupBy("application_id").agg(F.countDistinct("alert_id").alias("active_alerts")))
    ch = (wide.filter(since("recorded_at", a, 10 * unit_s) & (F.col("error_rate") < 1))
          .groupBy("application_id").agg(F.count(F.lit(1)).alias("consecutive_healthy_periods")))
    j = (apps.select("application_id", "application_name")
         .join(syn, "application_id", "left").join(hm, "application_id", "left")
         .join(ws, "application_id", "left").join(al, "application_id", "left")
         .join(ch, "application_id", "left")
         .fillna(0, ["healthy_hosts", "total_hosts", "weighted_error_score", "active_alerts",
                     "consecutive_healthy_periods"]))
    s, hh, th = F.col("synthetic_health_5"), F.col("healthy_hosts"), F.col("total_hosts")
    w, al_, ch_ = F.col("weighted_error_score"), F.col("active_alerts"), F.col("consecutive_healthy_periods")
    hr = F.try_divide(hh * 1.0, th.cast("double"))
    status = ladder([
        ((s < 95) & (hr < 0.5) & (w >= 20), "CRITICAL"),
        ((s < 90) & (ch_ <= 2), "CRITICAL"),
        ((s < 98) & (w >= 10), "DEGRADED"),
        ((hr < 0.8) & (w >= 5), "DEGRADED"),
        ((s < 99) | w.between(3, 9) | (al_ > 0), "WARNING"),
        ((ch_ >= 5) & (w > 0), "RECOVERING")], "HEALTHY")
    conf = ladder([(ch_ >= 8, "HIGH"), (ch_ >= 5, "MEDIUM"), (ch_ >= 2, "LOW")], "VERY_LOW")
    return j.select("application_id", "application_name",
                    r4(rnd(s, 2)).alias("synthetic_health_pct"),
                    F.concat(hh.cast("string"), F.lit("/"), th.cast("string")).alias("host_health"),
                    w.cast("long").alias("weighted_error_score"), al_.cast("long").alias("active_alerts"),
                    ch_.cast("long").alias("consecutive_healthy_periods"),
                    status.alias("overall_status"), conf.alias("status_confidence"))


# --------------------------------------------------------------------------- HLT-11 / HLT-12
def correlation_suppression(apps: DataFrame, errors: DataFrame, as_of=None, window_s: int = 10 * MIN,
                            issue_errors: int = 5, policy: str = "query", min_group_size: int = 1) -> DataFrame:
    """Correlation by datacentre x infrastructure group.

    policy 'query': SUPPRESS_ALERT at >= 50 % affected (SQL); 'note': at > 50 % (F22).
    `min_group_size`: groups smaller than this never suppress (F29 option; 1 = as coded).
    """
    a = resolve_as_of(as_of, errors, "recorded_at")
    ec = (errors.filter(since("recorded_at", a, window_s)).groupBy("application_id")
          .agg(F.count(F.lit(1)).alias("error_count")))
    ci = (apps.select("application_id", "application_name", "datacenter_id", "infrastructure_group")
          .join(ec, "application_id", "left").fillna(0, ["error_count"])
          .withColumn("has_issue", (F.col("error_count") >= issue_errors).cast("int")))
    ii = (ci.groupBy("datacenter_id", "infrastructure_group")
          .agg(F.count(F.lit(1)).alias("total_apps"), F.sum("has_issue").alias("affected_apps"))
          .withColumn("pct_affected", rnd(F.col("affected_apps") * 100.0 / F.col("total_apps"), 2)))
    j = ci.filter(F.col("has_issue") == 1).join(ii, ["datacenter_id", "infrastructure_group"])
    p, n, tot = F.col("pct_affected"), F.col("affected_apps"), F.col("total_apps")
    hit = (p >= 50) if policy == "query" else (p > 50)
    hit = hit & (tot >= min_group_size)
    action = ladder([(hit, "SUPPRESS_ALERT"), (n == 1, "RAISE_ALERT")], "RAISE_WITH_CORRELATION")
    ctx = ladder([
        (hit, F.concat(F.lit("Infrastructure issue suspected - "), n.cast("string"),
                       F.lit(" apps affected in "), F.col("infrastructure_group"))),
        (n == 1, F.lit("Isolated application issue"))],
        F.concat(F.lit("Correlated with "), (n - 1).cast("string"), F.lit(" other app(s)")))
    return j.select("application_id", "application_name", F.col("error_count").cast("long").alias("error_count"),
                    n.cast("long").alias("apps_in_group_affected"), tot.cast("long").alias("total_apps_in_group"),
                    r4(p).alias("pct_affected"), action.alias("alert_action"), ctx.alias("alert_context"))


def group_decision(apps: DataFrame, errors: DataFrame, as_of=None, window_s: int = 10 * MIN,
                   issue_errors: int = 5) -> DataFrame:
    """Four-band decision per group from the note: 0-20 / 21-50 / 51-80 / 81-100 % affected."""
    a = resolve_as_of(as_of, errors, "recorded_at")
    ec = (errors.filter(since("recorded_at", a, window_s)).groupBy("application_id")
          .agg(F.count(F.lit(1)).alias("error_count")))
    g = (apps.join(ec, "application_id", "left").fillna(0, ["error_count"])
         .groupBy("datacenter_id", "infrastructure_group")
         .agg(F.count(F.lit(1)).alias("total_apps"),
              count_if(F.col("error_count") >= issue_errors).alias("affected_apps")))
    p = F.col("affected_apps") * 100.0 / F.col("total_apps")
    return g.select("datacenter_id", "infrastructure_group", F.col("total_apps").cast("long").alias("total_apps"),
                    "affected_apps", r4(p).alias("pct_affected"),
                    ladder([(p <= 20, "RAISE_INDIVIDUAL"), (p <= 50, "RAISE_WITH_CORRELATION"),
                            (p <= 80, "SUPPRESS_APPS_RAISE_INFRA")], "SUPPRESS_ALL_RAISE_CRITICAL_INFRA")
                    .alias("group_action"))


# --------------------------------------------------------------------------- HLT-13 (JOIN-5)
def maintenance_mode(status: DataFrame, windows: DataFrame, as_of, pre_s: int = 15 * MIN,
                     post_s: int = 30 * MIN, post_error_limit: int = 10, combine: bool = False) -> DataFrame:
    """Maintenance awareness for applications in WARNING/DEGRADED/CRITICAL.

    The OR-join (application, scope ALL, or group) is written as a union of three
    equi-joins plus a scope-ALL broadcast of its (few) rows, each with the time
    range as a residual condition; no nested loop over the status table.
    One row per matching window as coded (F30); `combine=True` keeps the quietest.
    """
    a = as_of
    st = status.filter(F.col("current_status").isin("WARNING", "DEGRADED", "CRITICAL"))
    wn = windows.filter(a.between(F.col("start_time") - F.make_dt_interval(secs=F.lit(pre_s)),
                                  F.col("end_time") + F.make_dt_interval(secs=F.lit(post_s))))
    wcols = ["maintenance_id", "maintenance_type", "start_time", "end_time"]
    by_app = st.join(wn.filter(F.col("application_id").isNotNull()).select("application_id", *wcols),
                     "application_id")
    by_grp = st.join(wn.filter(F.col("infrastructure_group").isNotNull())
                     .select(F.col("infrastructure_group").alias("_g"), *wcols),
                     st.infrastructure_group == F.col("_g")).drop("_g")
    # Scope-ALL windows apply to every application: their (small, config) list is one scalar
    # subquery value exploded per status row, so no join and no pairing of two tables.
    all_list = wn.filter(F.col("scope") == "ALL").agg(
        F.collect_list(F.struct(*wcols)).alias("l")).scalar()
    by_all = st.withColumn("_w", F.explode(F.coalesce(all_list, F.array()))).select(
        *st.columns, *[F.col(f"_w.{c}").alias(c) for c in wcols])
    # A window can match one application in more than one way (e.g. its group and ALL): keep one row per pair.
    matched = by_app.unionByName(by_grp).unionByName(by_all).dropDuplicates(["application_id", "maintenance_id"])
    unmatched = st.join(matched.select("application_id").distinct(), "application_id", "left_anti")
    for c, t in (("maintenance_id", "long"), ("maintenance_type", "string"),
                 ("start_time", "timestamp"), ("end_time", "timestamp")):
        unmatched = unmatched.withColumn(c, F.lit(None).cast(t))
    j = matched.unionByName(unmatched)
    has = F.col("maintenance_id").isNotNull()
    s, e = F.col("start_time"), F.col("end_time")
    mode = ladder([
        (has & a.between(s, e), "SUPPRESS_DURING_MAINTENANCE"),
        (has & a.between(s - F.make_dt_interval(secs=F.lit(pre_s)), s), "PRE_MAINTENANCE_WINDOW"),
        (has & a.between(e, e + F.make_dt_interval(secs=F.lit(post_s))), "POST_MAINTENANCE_STABILIZATION")],
        "NORMAL_MONITORING")
    alert = ladder([(a.between(s, e), 0),
                    (a.between(e, e + F.make_dt_interval(secs=F.lit(post_s)))
                     & (F.col("error_count") < post_error_limit), 0)], 1)
    out = j.select("application_id", "application_name", "current_status",
                   F.col("error_count").cast("long").alias("error_count"), "maintenance_id",
                   "maintenance_type", ts_text("start_time").alias("start_time"),
                   ts_text("end_time").alias("end_time"), mode.alias("monitoring_mode"),
                   alert.alias("should_alert"))
    if combine:
        w = Window.partitionBy("application_id").orderBy(F.col("should_alert"), F.col("maintenance_id"))
        out = out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return out


def application_status(apps: DataFrame, errors: DataFrame, as_of=None, window_s: int = 30 * MIN,
                       unit_s: int = MIN) -> DataFrame:
    """Current status per application from distinct error periods (HLT-17 ladder), as the
    `application_status` input of the maintenance check."""
    st = error_minute_status(errors, as_of, window_s, unit_s)
    return (apps.select("application_id", "application_name", "infrastructure_group")
            .join(st.select("application_id", "total_errors", "error_status"), "application_id", "left")
            .select("application_id", "application_name", "infrastructure_group",
                    F.coalesce(F.col("error_status"), F.lit("HEALTHY")).alias("current_status"),
                    F.coalesce(F.col("total_errors"), F.lit(0)).alias("error_count")))


# --------------------------------------------------------------------------- HLT-14 / SRC-5
def application_dashboard(apps: DataFrame, wide: DataFrame, hosts: DataFrame, errors: DataFrame,
                          alerts: DataFrame, as_of=None, unit_s: int = MIN) -> DataFrame:
    """Dashboard view: four per-application aggregates left-joined to active applications."""
    a = resolve_as_of(as_of, errors, "recorded_at")
    m = (wide.filter(since("recorded_at", a, 5 * unit_s)).groupBy("application_id")
         .agg(F.avg("success_rate").alias("avg_synthetic_health"),
              F.avg("response_time_ms").alias("avg_response_time"),
              F.max("error_rate").alias("max_error_rate"),
              count_if(F.col("success_rate") < 99).alias("degraded_periods")))
    h = (hosts.filter(since("recorded_at", a, 5 * unit_s)).groupBy("application_id")
         .agg(F.count(F.lit(1)).alias("total_hosts"),
              count_if(F.col("health_status") == "HEALTHY").alias("healthy_hosts")))
    e = (errors.filter(since("recorded_at", a, 30 * unit_s)).groupBy("application_id")
         .agg(F.count(F.lit(1)).alias("error_count_30"),
              F.countDistinct(bucket("recorded_at", unit_s)).alias("distinct_error_periods")))
    al = (alerts.filter(F.col("status") == "ACTIVE").groupBy("application_id")
          .agg(F.count(F.lit(1)).alias("active_alert_count")))
    j = (apps.filter(F.col("is_active") == 1).select("application_id", "application_name")
         .join(m, "application_id", "left").join(h, "application_id", "left")
         .join(e, "application_id", "left").join(al, "application_id", "left"))
    s, dp = F.col("avg_synthetic_health"), F.col("degraded_periods")
    hh, th = F.col("healthy_hosts"), F.col("total_hosts")
    dem, ec, ac = F.col("distinct_error_periods"), F.col("error_count_30"), F.col("active_alert_count")
    hr = F.try_divide(hh * 1.0, th.cast("double"))
    status = ladder([((s < 90) & (dem >= 10), "Critical"), (hr < 0.5, "Critical"),
                     ((s < 98) & (dem >= 5), "Degraded"), (dp >= 3, "Degraded"), (hr < 0.8, "Degraded"),
                     ((s < 99) & (ec > 0), "Warning"), (ac > 0, "Warning")], "Healthy")
    conf = ladder([(dem >= 5, "Confirmed"), ((ec > 0) & (dem < 3), "Possible Transient")], "Stable")
    return j.select(
        "application_id", "application_name",
        r4(rnd(F.coalesce(s, F.lit(100.0)), 2)).alias("synthetic_health_pct"),
        F.concat(F.coalesce(hh, F.lit(0)).cast("string"), F.lit("/"),
                 F.coalesce(th, F.lit(0)).cast("string")).alias("host_health"),
        r4(rnd(F.coalesce(F.col("max_error_rate"), F.lit(0.0)), 3)).alias("service_failure_rate"),
        F.coalesce(ac, F.lit(0)).cast("long").alias("alert_count"),
        F.coalesce(ec, F.lit(0)).cast("long").alias("error_count_30"),
        F.coalesce(dem, F.lit(0)).cast("long").alias("distinct_error_periods"),
        status.alias("overall_status"), conf.alias("confidence_level"))


# --------------------------------------------------------------------------- WIN-8 / HLT-15
def breach_streaks(metrics: DataFrame, thresholds: DataFrame, as_of=None, window_s: int = 30 * MIN,
                   n: int = 4, segment_s: float | None = None) -> DataFrame:
    """Consecutive-breach streak per row (gaps and islands), plus the coded 6-row count (F2).

    Segmented scan: a streak continues over the segments it fills, whose summaries give what each carries in.
    """
    a = resolve_as_of(as_of, metrics, "recorded_at")
    rows = with_streak(_breaches(metrics, thresholds, a, window_s, segment_s), SERIES, IN_ORDER, "breach", "breach_streak")
    w = Window.partitionBy(*SERIES, SEG).orderBy(*IN_ORDER)
    m = (with_carried_rows(rows, SERIES, IN_ORDER, 5, ["breach"])
         .withColumn("breaches_in_window", F.sum("breach").over(w.rowsBetween(-5, 0))).filter(~F.col("_halo")))
    return m.select("entity_id", "entity_name", "metric_name", ts_text("recorded_at").alias("recorded_at"),
                    r4("metric_value").alias("metric_value"), "breach",
                    F.col("breach_streak").cast("long").alias("breach_streak"),
                    F.col("breaches_in_window").cast("long").alias("breaches_in_window"),
                    (F.col("breach_streak") >= n).cast("int").alias("should_alert"))


def persistent_breach(metrics: DataFrame, thresholds: DataFrame, as_of=None, window_s: int = 30 * MIN,
                      n: int = 4, segment_s: float | None = None) -> DataFrame:
    """Alert gate: per entity-metric the longest and the final streak in the window, from segment summaries alone."""
    a = resolve_as_of(as_of, metrics, "recorded_at")
    s = streak_summary(_breaches(metrics, thresholds, a, window_s, segment_s), ["entity_id", "entity_name", "metric_name"],
                       IN_ORDER, "breach", n)
    return s.select("entity_id", "entity_name", "metric_name", F.col("max_streak").cast("long").alias("max_streak"),
                    F.col("current_streak").cast("long").alias("current_streak"), F.col("long_rows").cast("long").alias("alert_rows"),
                    (F.col("max_streak") >= n).cast("int").alias("persistent"))


# --------------------------------------------------------------------------- HLT-17
def error_minute_status(errors: DataFrame, as_of=None, window_s: int = 30 * MIN, unit_s: int = MIN) -> DataFrame:
    """Distinct error periods x total errors grid (quality over quantity)."""
    a = resolve_as_of(as_of, errors, "recorded_at")
    g = (errors.filter(since("recorded_at", a, window_s)).groupBy("application_id")
         .agg(F.count(F.lit(1)).alias("total_errors"),
              F.countDistinct(bucket("recorded_at", unit_s)).alias("distinct_error_periods")))
    d, n = F.col("distinct_error_periods"), F.col("total_errors")
    st = ladder([(d >= 16, "CRITICAL"), (d >= 6, "DEGRADED"), ((d >= 3) & (n >= 20), "DEGRADED"),
                 (d >= 1, "WARNING")], "HEALTHY")
    note = ladder([(d >= 16, "persistent"), (d >= 11, "high confidence"), (d >= 6, "sustained"),
                   ((d >= 3) & (n >= 20), "dense"), (d >= 1, "monitor")], "none")
    return g.select("application_id", n.cast("long").alias("total_errors"), d.cast("long").alias("distinct_error_periods"),
                    st.alias("error_status"), note.alias("error_note"))


# --------------------------------------------------------------------------- HLT-18
def alert_tier(dashboard: DataFrame, weighted: DataFrame) -> DataFrame:
    """P1-P4 tier from a dashboard row and the weighted error score."""
    j = dashboard.join(weighted.select("application_id", "weighted_error_score"), "application_id", "left")
    s = F.col("synthetic_health_pct")
    d = F.col("distinct_error_periods")
    w = F.coalesce(F.col("weighted_error_score"), F.lit(0))
    hh = F.split("host_health", "/")
    healthy, total = hh.getItem(0).cast("int"), hh.getItem(1).cast("int")
    unhealthy_share = F.try_divide((total - healthy).cast("double"), total.cast("double"))
    tier = ladder([
        ((s < 90) | (d >= 15) | (unhealthy_share > 0.5), "P1-CRITICAL"),
        (((s >= 90) & (s < 98)) | d.between(10, 14) | w.between(16, 30), "P2-DEGRADED"),
        (((s >= 98) & (s < 99)) | d.between(5, 9) | (F.col("alert_count") == 1), "P3-WARNING"),
        (d.between(1, 4) | (F.col("confidence_level") == "Possible Transient"), "P4-INFO")], "NONE")
    return j.select("application_id", "application_name", "synthetic_health_pct", "distinct_error_periods",
                    w.cast("long").alias("weighted_error_score"), "alert_count", "confidence_level",
                    tier.alias("alert_tier"))


# --------------------------------------------------------------------------- HLT-19
def suppress(tiers: DataFrame, streaks: DataFrame, groups: DataFrame, maintenance: DataFrame,
             health: DataFrame) -> DataFrame:
    """Six suppression rules applied in order; first match names the reason.

    Inputs are per-application results (tier, longest breach streaks as of `persistent_breach`, group % affected,
    maintenance mode, overall status); each is reduced to one row per application
    before the left joins.
    """
    st = streaks.groupBy(F.col("entity_id").alias("application_id")).agg(F.max("max_streak").alias("max_streak"))
    gp = groups.groupBy("application_id").agg(F.max("pct_affected").alias("group_pct_affected"))
    mt = maintenance.groupBy("application_id").agg(
        F.max((F.col("monitoring_mode") == "SUPPRESS_DURING_MAINTENANCE").cast("int")).alias("in_maintenance"),
        F.max(((F.col("monitoring_mode") == "POST_MAINTENANCE_STABILIZATION")
               & (F.col("error_count") < 10)).cast("int")).alias("post_quiet"))
    hl = health.select("application_id", "overall_status")
    j = (tiers.join(st, "application_id", "left").join(gp, "application_id", "left")
         .join(mt, "application_id", "left").join(hl, "application_id", "left"))
    reason = ladder([
        (F.coalesce(F.col("max_streak"), F.lit(0)) < 4, "TRANSIENT"),
        (F.col("group_pct_affected") > 50, "INFRA_GROUP"),
        (F.col("in_maintenance") == 1, "MAINTENANCE"),
        (F.col("post_quiet") == 1, "POST_MAINTENANCE"),
        ((F.col("confidence_level") == "Possible Transient") & F.col("alert_tier").isin("P1-CRITICAL", "P2-DEGRADED"),
         "POSSIBLE_TRANSIENT"),
        (F.col("overall_status") == "RECOVERING", "RECOVERING")])
    return j.select("application_id", "application_name", "alert_tier",
                    F.coalesce(F.col("max_streak"), F.lit(0)).cast("long").alias("max_streak"),
                    r4("group_pct_affected").alias("group_pct_affected"),
                    F.coalesce(F.col("overall_status"), F.lit("HEALTHY")).alias("overall_status"),
                    F.coalesce(reason, F.lit("NONE")).alias("suppress_reason"),
                    F.when(reason.isNull() & (F.col("alert_tier") != "NONE"), 1).otherwise(0).alias("send_alert"))


# --------------------------------------------------------------------------- HLT-20
def z_band(scores: DataFrame, z: str = "z_score") -> DataFrame:
    """Symmetric flag including unusually LOW values (z < -2)."""
    zc = F.col(z)
    band = ladder([(zc > 3, "CRITICAL_HIGH"), (zc > 2, "WARNING_HIGH"), (zc > 1, "SLIGHTLY_ELEVATED"),
                   (zc < -2, "UNUSUALLY_LOW"), (zc < -1, "SLIGHTLY_LOW")], "NORMAL")
    return scores.withColumn("z_band", band)


def sort_by_health(df: DataFrame, status: str, *then: Column) -> DataFrame:
    """Severity-ranked order (SRT-1)."""
    return df.orderBy(rank_of(status, HEALTH_ORDER), *then)


__all__ = [n for n in dir() if not n.startswith("_")]


# --------------------------------------------------------------------------- HLT-16 (batch twin of STR-5)
def dense_period_errors(errors: DataFrame, entities: DataFrame, as_of, window_s: int, unit_s: int = MIN,
                        key: str = "application_id") -> DataFrame:
    """Error count per entity and period over the window, including periods without errors.

    Each entity explodes its own period sequence (window / unit rows, a parameter bound,
    not a data-volume bound); counts are pre-aggregated per period before the join.
    """
    a = resolve_as_of(as_of, errors, "recorded_at")
    last = bucket(a, unit_s)
    n_periods = int(window_s // unit_s)
    cnt = (errors.filter(since("recorded_at", a, window_s))
           .groupBy(key, bucket("recorded_at", unit_s).alias("period")).agg(F.count(F.lit(1)).alias("errors")))
    grid = entities.select(key, F.explode(F.sequence(last - (n_periods - 1), last)).alias("period"))
    return (grid.join(cnt, [key, "period"], "left").fillna(0, ["errors"])
            .withColumn("period_start", F.timestamp_seconds(F.col("period") * unit_s)))


HYST_STATES = ["HEALTHY", "DEGRADED", "CRITICAL", "RECOVERING"]


def hysteresis_step(status: str, bad: int, ok: int, degrade: int, critical: int, recover: int, healthy: int) -> str:
    """The next status from the lengths of the run of breaches and of the run of OK periods."""
    if status in ("HEALTHY", "RECOVERING") and bad >= min(degrade, critical):
        return "CRITICAL" if bad >= critical else "DEGRADED"
    if status == "DEGRADED" and bad >= critical:
        return "CRITICAL"
    if status in ("DEGRADED", "CRITICAL") and ok >= recover:
        return "RECOVERING"
    return "HEALTHY" if status == "RECOVERING" and ok >= healthy else status


def recovery_status(period_errors: DataFrame, key: str = "application_id", start: str = "HEALTHY",
                    min_errors: int = 1, degrade: int = 4, critical: int = 8, recover: int = 5,
                    healthy: int = 8, segment: int = 256) -> DataFrame:
    """Hysteresis state machine per entity over ordered periods.

    A period with >= min_errors errors is a breach. HEALTHY/RECOVERING -> DEGRADED after
    4 consecutive breaches, -> CRITICAL after 8; DEGRADED/CRITICAL -> RECOVERING after 5
    consecutive OK periods; RECOVERING -> HEALTHY after 8.

    Series are cut into segments of `segment` periods. The run lengths come from segmented scans; given them, a
    segment maps the status before it to the status after it, and these maps are composed along the series. Each segment is then
    followed from its own first status. No task holds more of a series than its segments' summaries.
    """
    top = max(degrade, critical)
    symbols = [(b, 0) for b in range(top + 1)] + [(0, o) for o in range(1, max(recover, healthy) + 1)]
    table = machine_table(HYST_STATES, symbols, lambda s, x: hysteresis_step(s, x[0], x[1], degrade, critical, recover, healthy))
    rows = (period_errors.select(key, F.col("period").cast("long").alias("period"), F.col("errors").cast("long").alias("errors"))
            .withColumn(SEG, F.floor(F.col("period") / F.lit(segment)).cast("long"))
            .withColumn("_br", (F.col("errors") >= min_errors).cast("int")).withColumn("_ok", 1 - F.col("_br")))
    rows = with_streak(with_streak(rows, [key], ["period"], "_br", "bad"), [key], ["period"], "_ok", "ok")
    symbol = F.when(F.col("_br") == 1, F.least("bad", F.lit(top))).otherwise(top + F.least("ok", F.lit(max(recover, healthy))))
    rows = rows.withColumn("_x", symbol.cast("int"))
    carried = carried_states(rows, [key], "period", "_x", table, len(HYST_STATES), HYST_STATES.index(start))
    names = F.array(*[F.lit(s) for s in HYST_STATES])
    points = rows.groupBy(key, SEG).agg(F.sort_array(F.collect_list(F.struct("period", "errors", "bad", "ok", "_x"))).alias("_pts"))
    first = F.struct(F.col("_state").alias("s"), F.array().cast("array<int>").alias("out"))

    def step(acc, p):
        nxt = F.get(F.get(table, p["_x"]), acc["s"])
        return F.struct(nxt.alias("s"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    met = points.join(carried.withColumnsRenamed({key: "_k", SEG: "_g"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col(SEG) == F.col("_g")))
    folded = met.select(key, F.explode(F.arrays_zip("_pts", F.aggregate("_pts", first, step)["out"].alias("st"))).alias("z"))
    return folded.select(key, "z._pts.period", "z._pts.errors", F.col("z._pts.bad").cast("int").alias("bad"),
                         F.col("z._pts.ok").cast("int").alias("ok"), F.get(names, F.col("z.st")).alias("status"))
