"""Leading-indicator pipeline (LIP-1..26, SIG-15..19): scoring, domains, correlation,
alerts, insights, projections and outage probability over signal snapshots.

Snapshots are `(signal_name, numeric_value, snapshot_time)`, one row per signal
per cycle. Their size is bounded by signals x cycles, not by raw event volume,
so windows partitioned by signal hold one signal's bounded series. Rule, map and
template tables are small fixed tables and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import count_if, fixed, ladder, r4, rnd, since, ts_text
from ..functions.selection import exact_percentiles, with_percentiles

# The fourteen signals, their default thresholds and orientation
# (signal_config insert of the implementation guide): name, healthy, warning, critical, inverted.
SIGNAL_CONFIG = [
    ("Agent Online", 95.0, 90.0, 90.0, False), ("Incidents", 3.0, 6.0, 6.0, True),
    ("App Health", 97.0, 93.0, 93.0, False), ("Core Systems", 99.0, 97.0, 97.0, False),
    ("Call LOB SLA", 85.0, 80.0, 80.0, False), ("Queue Sufficiency", 90.0, 80.0, 80.0, False),
    ("Presence—Vendor", 94.0, 90.0, 90.0, False), ("Presence—Location", 93.0, 88.0, 88.0, False),
    ("Connectivity", 96.0, 92.0, 92.0, False), ("Genesys Platform", 99.5, 98.0, 98.0, False),
    ("IVR / Self-Service", 97.0, 93.0, 93.0, False), ("Call Quality", 4.0, 3.5, 3.5, False),
    ("Network Latency", 30.0, 80.0, 80.0, True), ("Desktop / Endpoint", 97.0, 93.0, 93.0, False),
]
SIGNAL_NAMES = [s[0] for s in SIGNAL_CONFIG]
INVERTED = [s[0] for s in SIGNAL_CONFIG if s[4]]

# Signal -> domain map (22 pairs: agent 7, app 6, genesys 9).
DOMAIN_MAP = [
    ("Agent Online", "agent"), ("Agent Online", "genesys"), ("Incidents", "app"), ("Incidents", "genesys"),
    ("App Health", "app"), ("Core Systems", "app"), ("Core Systems", "genesys"),
    ("Call LOB SLA", "agent"), ("Call LOB SLA", "genesys"), ("Queue Sufficiency", "agent"),
    ("Presence—Vendor", "agent"), ("Presence—Location", "agent"), ("Connectivity", "agent"),
    ("Connectivity", "genesys"), ("Genesys Platform", "genesys"), ("IVR / Self-Service", "app"),
    ("IVR / Self-Service", "genesys"), ("Call Quality", "genesys"), ("Network Latency", "app"),
    ("Network Latency", "genesys"), ("Desktop / Endpoint", "agent"), ("Desktop / Endpoint", "app"),
]

# Correlation rules (rule_id, signal_a, signal_b, direction, window_min, confidence,
# insight_template_id, recommended_action).
CORRELATION_RULES = [
    (1, "Connectivity", "Call Quality", "a_causes_b", 5, 0.90, 4, "Check ThousandEyes for degraded network paths"),
    (2, "Network Latency", "Call Quality", "a_causes_b", 5, 0.85, 4, "Investigate ISP peering and BGP route changes"),
    (3, "Incidents", "Call LOB SLA", "a_causes_b", 10, 0.80, 5, "Check incident CIs — if call-path, SLA impact certain"),
    (4, "Incidents", "App Health", "bidirectional", 5, 0.85, 4, "Shared root cause — check both signals for common CI"),
    (5, "Connectivity", "Presence—Location", "a_causes_b", 3, 0.92, 4, "Regional ISP issue — activate DR routing for that site"),
    (6, "Agent Online", "Queue Sufficiency", "a_causes_b", 2, 0.95, 4, "Staffing shortfall — check root cause of agent drop"),
    (7, "Agent Online", "Call LOB SLA", "a_causes_b", 5, 0.88, 4, "SLA will breach — contact WFM for emergency staffing"),
    (8, "Desktop / Endpoint", "Agent Online", "a_causes_b", 3, 0.85, 4, "Desktop failure causing logoffs — check Citrix/browser"),
    (9, "Core Systems", "App Health", "a_causes_b", 2, 0.95, 4, "ROOT CAUSE — fix infrastructure first, apps will follow"),
    (10, "Genesys Platform", "Call Quality", "a_causes_b", 1, 0.95, 4, "Genesys outage — open bridge with Genesys TAM"),
    (11, "Genesys Platform", "IVR / Self-Service", "a_causes_b", 1, 0.90, 4, "Platform hosts IVR — expect queue overflow in 10 min"),
    (12, "IVR / Self-Service", "Queue Sufficiency", "a_causes_b", 10, 0.75, 4, "IVR overflow building — pre-emptively activate overflow plans"),
    (13, "Network Latency", "Desktop / Endpoint", "a_causes_b", 5, 0.80, 4, "High latency killing Citrix sessions — check ISP"),
    (14, "Connectivity", "Genesys Platform", "a_causes_b", 3, 0.70, 4, "VERIFY: could be our network, not Genesys. Check status page."),
]

# Insight templates (template_id, trigger_type, severity, template_text).
INSIGHT_TEMPLATES = [
    (1, "threshold_breach", "critical",
     "{signal_name} has breached critical threshold at {current_value} (threshold: {threshold}). Immediate investigation required."),
    (2, "threshold_breach", "warning",
     "{signal_name} approaching critical levels at {current_value}. Trending {direction} over last {window}."),
    (3, "rate_decline", "critical",
     "{signal_name} declining rapidly ({previous_value}→{current_value} in {duration}). Breach of {threshold} threshold projected in ~{eta_minutes} minutes."),
    (4, "correlation", "warning",
     "{signal_a} degradation correlated with {signal_b} ({confidence}% confidence). {recommended_action}"),
    (5, "correlation", "warning",
     "{incident_count} Active Incidents — {p1_count} P1 critical. Incident rate exceeds {window} rolling average by {multiplier}x."),
    (6, "pattern_match", "warning",
     "Pattern match: Signal trajectory {similarity}% similar to {past_event_date} pre-outage. Probability escalating {current_prob}%→{projected_prob}% within {eta}m."),
    (7, "multi_correlation", "warning",
     "{signal_a} below {threshold} in {sub_signals}. Correlated with {correlated_signal}. {recommended_action}"),
    (8, "recovery", "info",
     "{signal_name} stable post-{event_description}. All {scope} recovered to {current_value}+."),
    (9, "stable", "info", "{signal_list} — stable for {duration}+ hrs. No forecast deviation detected."),
]

STATUS_SCORE = {"critical": 0, "warning": 70, "healthy": 100}
DOMAIN_WEIGHTS = {"genesys": 0.40, "agent": 0.35, "app": 0.25}


def _const(spark: SparkSession, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def domain_map(spark: SparkSession) -> DataFrame:
    return _const(spark, DOMAIN_MAP, "signal_name string, domain_key string")


def correlation_rules(spark: SparkSession) -> DataFrame:
    return _const(spark, [r + (True,) for r in CORRELATION_RULES],
                  "rule_id int, signal_a string, signal_b string, direction string, time_window_min int, "
                  "confidence double, insight_template_id int, recommended_action string, is_active boolean")


def insight_templates(spark: SparkSession) -> DataFrame:
    return _const(spark, INSIGHT_TEMPLATES, "template_id int, trigger_type string, severity string, template_text string")


# --------------------------------------------------------------------------- LIP-26
def calibrate_thresholds(snapshots: DataFrame, until: Column, inverted=INVERTED,
                         q_healthy: float = 0.30, q_warning: float = 0.10) -> DataFrame:
    """Per-signal thresholds from history before `until`: exact quantiles of the signal's values.

    Normal signals: healthy at or above the q_healthy quantile, warning at or above the
    q_warning quantile; inverted signals mirror (1 - q)."""
    inv = F.col("signal_name").isin(list(inverted))
    hist = snapshots.filter(F.col("snapshot_time") < until)
    g = exact_percentiles(hist, ["signal_name"], "numeric_value", [q_healthy, q_warning, 1 - q_healthy, 1 - q_warning],
                          ["_lh", "_lw", "_hh", "_hw"])
    return g.select("signal_name",
                    r4(F.when(inv, F.col("_hh")).otherwise(F.col("_lh"))).alias("healthy_threshold"),
                    r4(F.when(inv, F.col("_hw")).otherwise(F.col("_lw"))).alias("warning_threshold"),
                    r4(F.when(inv, F.col("_hw")).otherwise(F.col("_lw"))).alias("critical_threshold"),
                    inv.alias("is_inverted"))


# --------------------------------------------------------------------------- LIP-1
def status_of(value: Column, cfg_h: Column, cfg_w: Column, inverted: Column) -> Column:
    normal = ladder([(value >= cfg_h, "healthy"), (value >= cfg_w, "warning")], "critical")
    inv = ladder([(value <= cfg_h, "healthy"), (value <= cfg_w, "warning")], "critical")
    return F.when(inverted, inv).otherwise(normal)


def score_signals(values: DataFrame, signal_config: DataFrame) -> DataFrame:
    """Threshold scoring, normal and inverted; a signal without thresholds is kept as 'unconfigured', one without a value as 'no data'."""
    j = values.join(signal_config, "signal_name", "left")
    scored = status_of(F.col("numeric_value"), F.col("healthy_threshold"), F.col("warning_threshold"), F.col("is_inverted"))
    known = F.col("healthy_threshold").isNotNull() & F.col("warning_threshold").isNotNull()
    return j.withColumn("status", F.when(~known, "unconfigured").when(F.col("numeric_value").isNull(), "no data").otherwise(scored))


# --------------------------------------------------------------------------- LIP-2
def snapshot_trend(scored: DataFrame) -> DataFrame:
    """Change against the previous snapshot of the same signal; up / down / flat."""
    w = Window.partitionBy("signal_name").orderBy("snapshot_time")
    d = F.col("numeric_value") - F.lag("numeric_value").over(w)
    out = scored.withColumn("_d", d)
    return (out.withColumn("trend", F.when(F.col("_d").isNull(), F.lit(None))
                           .when(F.col("_d") >= 0, F.concat(F.lit("+"), fixed("_d", 1))).otherwise(fixed("_d", 1)))
            .withColumn("direction", ladder([(F.col("_d") > 0, "up"), (F.col("_d") < 0, "down")], "flat"))
            .drop("_d"))


def latest_snapshot(df: DataFrame) -> DataFrame:
    return df.filter(F.col("snapshot_time") == df.select(F.max("snapshot_time")).scalar())


# --------------------------------------------------------------------------- LIP-3 / LIP-4
def domain_scores(latest: DataFrame, dmap: DataFrame) -> DataFrame:
    """Domain score = mean of 0 / 70 / 100 by status, with counts, at one snapshot.

    A status that is none of the three (unconfigured, no data) has no score: it is left out of the mean and counted.
    A signal that no domain claims belongs to the domain `unmapped`, so that it isn't lost.
    """
    s = latest.join(dmap, "signal_name", "left").withColumn("domain_key", F.coalesce("domain_key", F.lit("unmapped"))).withColumn(
        "score", ladder([(F.col("status") == "critical", 0), (F.col("status") == "warning", 70), (F.col("status") == "healthy", 100)]))
    return s.groupBy("domain_key").agg(
        rnd(F.avg("score"), 1).alias("score"), F.count(F.lit(1)).alias("signal_count"),
        count_if(F.col("status") == "critical").alias("critical_count"),
        count_if(F.col("status") == "warning").alias("warning_count"),
        count_if(F.col("score").isNull()).alias("unscored_count"))


def enterprise_score(domains: DataFrame, weights: dict | None = None) -> DataFrame:
    """Mean of the three domain scores (or weighted), as one row via pivot (no cross join)."""
    p = domains.groupBy().pivot("domain_key", ["agent", "app", "genesys"]).agg(F.first("score"))
    if weights:
        ent = sum(F.col(k) * w for k, w in weights.items())
    else:
        ent = (F.col("agent") + F.col("app") + F.col("genesys")) / 3
    return p.select(rnd(ent, 1).alias("enterprise_score"), F.col("agent").alias("agent_health_score"),
                    F.col("app").alias("app_health_score"), F.col("genesys").alias("genesys_health_score"))


# --------------------------------------------------------------------------- LIP-5
def correlations(scored: DataFrame, rules: DataFrame, as_of: Column, recent_s: int = 300,
                 minute_s: int = 60) -> DataFrame:
    """Rule pairs whose two signals are both degraded within the rule's time window.

    Equi-join on the rule's signal names (rules broadcast) with the time gap as a
    residual; candidates are the degraded snapshots of the recent window only.
    """
    deg = (scored.filter(F.col("status").isin("warning", "critical") & since("snapshot_time", as_of, recent_s))
           .select("signal_name", "status", "numeric_value", "snapshot_time"))
    a = deg.select(*[F.col(c).alias(f"a_{c}") for c in deg.columns])
    b = deg.select(*[F.col(c).alias(f"b_{c}") for c in deg.columns])
    r = rules.filter("is_active")
    lag_units = F.abs(F.unix_timestamp("a_snapshot_time") - F.unix_timestamp("b_snapshot_time")) / F.lit(minute_s)
    m = (r.join(a, r.signal_a == a.a_signal_name).join(b, r.signal_b == b.b_signal_name)
         .withColumn("lag_minutes", lag_units).filter(F.col("lag_minutes") <= F.col("time_window_min")))
    w = Window.partitionBy("signal_a", "signal_b").orderBy(F.col("confidence").desc(), F.col("rule_id"),
                                                          F.col("a_snapshot_time").desc(), F.col("b_snapshot_time").desc())
    d = m.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return d.select("rule_id", "signal_a", "signal_b", "confidence", "direction",
                    r4("a_numeric_value").alias("signal_a_value"), r4("b_numeric_value").alias("signal_b_value"),
                    F.col("a_status").alias("signal_a_status"), F.col("b_status").alias("signal_b_status"),
                    r4("lag_minutes").alias("lag_minutes"), "recommended_action", "insight_template_id",
                    ts_text(as_of).alias("detected_at"))


# --------------------------------------------------------------------------- LIP-6
def cascade(active: DataFrame) -> DataFrame:
    """Root causes of each affected signal over active cause -> effect edges, with the least number of hops.

    The walk goes on until it finds no new (signal, cause) pair, so chains have any length and cycles end. A root
    is a cause that nothing outside its own cycle causes; of a cycle the first signal by name stands
    for all. The edges come from the rule table (one row per rule), so each hop is a join of small tables.
    """
    e = active.select(F.col("signal_a").alias("cause"), F.col("signal_b").alias("effect")).distinct().checkpoint()
    found = e.select(F.col("effect").alias("signal"), F.col("cause").alias("root"), F.lit(1).alias("hops"))
    frontier = found
    while not frontier.isEmpty():
        step = (frontier.join(e.withColumnRenamed("effect", "root"), "root")
                .select("signal", F.col("cause").alias("root"), (F.col("hops") + 1).alias("hops")).distinct())
        frontier = step.join(found, ["signal", "root"], "left_anti").checkpoint()
        found = found.unionByName(frontier)
    back = found.select(F.col("root").alias("signal"), F.col("signal").alias("root"), F.lit(True).alias("mutual"))
    pairs = found.join(back, ["signal", "root"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))
    # A cause is no root if something causes it from outside its cycle, or if its cycle has a signal with a smaller name.
    caused = pairs.filter(~F.col("mutual") | (F.col("root") < F.col("signal"))).select(F.col("signal").alias("root")).distinct()
    return found.join(caused, "root", "left_anti").select("signal", "root", "hops")


# --------------------------------------------------------------------------- LIP-7
def rate_of_change(snapshots: DataFrame, as_of: Column, window_s: int = 300, per_s: int = 60) -> DataFrame:
    """Slope per unit between the first and last value of the window (ordered by time, F11)."""
    h = snapshots.filter(since("snapshot_time", as_of, window_s))
    g = h.groupBy("signal_name").agg(
        F.min_by("numeric_value", "snapshot_time").alias("first_value"),
        F.max_by("numeric_value", "snapshot_time").alias("last_value"),
        F.count(F.lit(1)).alias("data_points"),
        F.min("snapshot_time").alias("first_time"), F.max("snapshot_time").alias("last_time"))
    el = (F.unix_timestamp("last_time") - F.unix_timestamp("first_time")) / F.lit(per_s)
    slope = F.when(el > 0, (F.col("last_value") - F.col("first_value")) / el).otherwise(F.lit(0.0))
    g = g.withColumn("slope", slope)
    trend = ladder([(F.col("slope") < -2.0, "rapid_decline"), (F.col("slope") < -0.5, "declining"),
                    (F.col("slope") > 0.5, "improving")], "stable")
    return g.select("signal_name", r4("slope").alias("slope"), trend.alias("trend"),
                    r4("first_value").alias("first_value"), r4("last_value").alias("last_value"),
                    F.col("data_points").cast("long").alias("data_points"))


# --------------------------------------------------------------------------- LIP-8 / LIP-10
def alert_candidates(latest: DataFrame, roc: DataFrame, as_of: Column) -> DataFrame:
    cur = (latest.filter(F.col("status").isin("warning", "critical"))
           .select("signal_name", F.col("status").alias("severity"),
                   F.concat(F.col("signal_name"), F.lit(" is "), F.col("status"), F.lit(" at "),
                            fixed("numeric_value", 2)).alias("message")))
    rd = (roc.filter(F.col("trend") == "rapid_decline")
          .select("signal_name", F.lit("critical").alias("severity"),
                  F.concat(F.col("signal_name"), F.lit(" declining rapidly: "), fixed("slope", 1),
                           F.lit(" units/min")).alias("message")))
    return cur.unionByName(rd).withColumn("alert_time", as_of)


def new_alerts(candidates: DataFrame, past_alerts: DataFrame, as_of: Column, dedup_s: int = 600) -> DataFrame:
    """Candidates not alerted for the same signal and severity within the dedup window (anti join)."""
    recent = past_alerts.filter(since("created_at", as_of, dedup_s)).select("signal_name", "severity")
    return (candidates.join(recent, ["signal_name", "severity"], "left_anti")
            .select("signal_name", "severity", "message", ts_text("alert_time").alias("created_at"),
                    F.lit(False).alias("is_acknowledged")))


def pending_notifications(alerts: DataFrame, as_of: Column, window_s: int = 60) -> DataFrame:
    return alerts.filter((F.col("severity") == "critical") & ~F.col("is_acknowledged")
                         & since("created_at", as_of, window_s))


# --------------------------------------------------------------------------- LIP-9
def alert_level(latest: DataFrame, enterprise: DataFrame, roc_window: DataFrame, active: DataFrame,
                previous: DataFrame) -> DataFrame:
    """One overall alert level for the cycle (CRITICAL / WARNING / INFO / NONE) with its reasons."""
    s = latest.agg(count_if(F.col("status") == "critical").alias("n_critical"),
                   count_if(F.col("status") == "warning").alias("n_warning"))
    # Every other input is one value per cycle: attached as scalar subqueries (no joins).
    j = s.select("n_critical", "n_warning").withColumns({
        "enterprise_score": enterprise.select("enterprise_score").scalar(),
        "n_sustained_decline": roc_window.agg(count_if(F.col("sustained_decline"))).scalar(),
        "n_strong_correlations": active.agg(count_if(F.col("confidence") > 0.8)).scalar(),
        "n_recovered": previous.agg(count_if(F.col("recovered"))).scalar(),
        "n_improving": previous.agg(count_if(F.col("direction") == "up")).scalar()})
    lvl = ladder([
        ((F.col("n_critical") > 0) | (F.col("n_warning") >= 2) | (F.col("enterprise_score") < 90), "CRITICAL"),
        ((F.col("n_warning") > 0) | (F.col("n_sustained_decline") > 0) | (F.col("n_strong_correlations") > 0), "WARNING"),
        ((F.col("n_recovered") > 0) | (F.col("n_improving") > 0), "INFO")], "NONE")
    return j.withColumn("alert_level", lvl)


def sustained_decline(snapshots: DataFrame, as_of: Column, unit_s: int = 60, periods: int = 5,
                      pct_per_unit: float = 2.0) -> DataFrame:
    """Signals whose value fell by more than `pct_per_unit` % per unit in each of the last `periods` steps (WIN-11)."""
    w = Window.partitionBy("signal_name").orderBy("snapshot_time")
    s = (snapshots.filter(since("snapshot_time", as_of, (periods + 1) * unit_s))
         .withColumn("_prev", F.lag("numeric_value").over(w))
         .withColumn("_drop", F.try_divide((F.col("_prev") - F.col("numeric_value")) * 100.0, F.abs(F.col("_prev")))))
    return s.groupBy("signal_name").agg(
        (count_if(F.col("_drop") > pct_per_unit) >= periods).alias("sustained_decline"),
        count_if(F.col("_drop") > pct_per_unit).alias("declining_steps"))


# --------------------------------------------------------------------------- LIP-11
def fill_template(template: Column, fields: Column) -> Column:
    """Replace every {key} of the template by the value of `fields` (a map<string,string>)."""
    return F.aggregate(F.map_entries(fields), template,
                       lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def insights(triggers: DataFrame, templates: DataFrame, dmap: DataFrame) -> DataFrame:
    """Insight text per trigger, with the domains of the signal.

    `triggers`: (trigger_type, severity, signal_name, related_signal, fields map<string,string>) and optionally
    template_id, e.g. a rule's own; without one the first template of (trigger_type, severity) is taken.
    """
    if "template_id" not in triggers.columns:
        triggers = triggers.withColumn("template_id", F.lit(None).cast("int"))
    first = templates.groupBy("trigger_type", "severity").agg(F.min("template_id").alias("_first"))
    d = dmap.groupBy("signal_name").agg(F.array_sort(F.collect_set("domain_key")).alias("domains"))
    j = (triggers.join(first, ["trigger_type", "severity"], "left")
         .withColumn("template_id", F.coalesce("template_id", "_first"))
         .join(templates.select("template_id", "template_text"), "template_id", "left").join(d, "signal_name", "left"))
    plain = F.concat_ws(": ", F.col("trigger_type"), F.col("signal_name"))  # of a trigger without a template
    return j.select("trigger_type", "severity", "signal_name",
                    F.coalesce(fill_template(F.col("template_text"), F.col("fields")), plain).alias("insight_text"),
                    F.array_join(F.coalesce(F.col("domains"), F.array().cast("array<string>")), ",").alias("domains"),
                    F.concat_ws(",", F.col("signal_name"), F.col("related_signal")).alias("related_signals"))


TRIGGER = "trigger_type string, severity string, signal_name string, related_signal string, template_id int, fields map<string,string>"


def _trigger(df: DataFrame, kind: str, severity: str, fields: dict[str, Column], signal: str | None = "signal_name", related: str | None = None,
             template: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    pairs = [x for k, v in fields.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("n/a")))]
    return df.select(F.lit(kind).alias("trigger_type"), F.lit(severity).alias("severity"), (F.col(signal) if signal else none).alias("signal_name"),
                     (F.col(related) if related else none).alias("related_signal"),
                     (template if template is not None else F.lit(None)).cast("int").alias("template_id"), F.create_map(*pairs).alias("fields"))


def status_triggers(latest: DataFrame, window: str) -> DataFrame:
    """Breaches (templates 1, 2) and recoveries (8) of the newest snapshot; latest has prev_status."""
    value = fixed("numeric_value", 2)
    crit = _trigger(latest.filter(F.col("status") == "critical"), "threshold_breach", "critical",
                    {"signal_name": F.col("signal_name"), "current_value": value, "threshold": fixed("critical_threshold", 2)})
    warn = _trigger(latest.filter(F.col("status") == "warning"), "threshold_breach", "warning",
                    {"signal_name": F.col("signal_name"), "current_value": value, "direction": F.col("direction"), "window": F.lit(window)})
    back = latest.filter((F.col("status") == "healthy") & F.col("prev_status").isin("warning", "critical"))
    rec = _trigger(back, "recovery", "info", {"signal_name": F.col("signal_name"), "event_description": F.lit("degradation"),
                                              "scope": F.lit("checks"), "current_value": value})
    return crit.unionByName(warn).unionByName(rec)


def decline_triggers(roc: DataFrame, projected: DataFrame, latest: DataFrame, duration: str) -> DataFrame:
    """Rapid declines (template 3) with the threshold ahead and the minutes until it (n/a without a projection)."""
    j = (roc.filter(F.col("trend") == "rapid_decline").join(projected.select("signal_name", "eta_minutes"), "signal_name", "left")
         .join(latest.select("signal_name", F.col("critical_threshold").alias("_t")), "signal_name", "left"))
    return _trigger(j, "rate_decline", "critical", {
        "signal_name": F.col("signal_name"), "previous_value": fixed("first_value", 1), "current_value": fixed("last_value", 1),
        "duration": F.lit(duration), "threshold": fixed("_t", 1), "eta_minutes": F.col("eta_minutes")})


def correlation_triggers(active: DataFrame, incidents: DataFrame, surge: DataFrame, window: str) -> DataFrame:
    """Active rules, each with its own template: 4, or 5 with the incident counts (numeric_value, p1_count) and the newest surge."""
    multiplier = surge.agg(F.max_by("multiplier", "snapshot_time")).scalar()
    return _trigger(active, "correlation", "warning", {
        "signal_a": F.col("signal_a"), "signal_b": F.col("signal_b"), "confidence": F.bround(F.col("confidence") * 100, 0).cast("long"),
        "recommended_action": F.col("recommended_action"), "incident_count": incidents.select(F.col("numeric_value").cast("long")).scalar(),
        "p1_count": incidents.select(F.col("p1_count").cast("long")).scalar(), "window": F.lit(window), "multiplier": fixed(multiplier, 1)},
        "signal_a", "signal_b", F.col("insight_template_id"))


def pattern_triggers(matches: DataFrame, probability: DataFrame, with_pattern: DataFrame, projected: DataFrame, least: float = 0.8) -> DataFrame:
    """The best match of the pre-outage library (template 6), if its similarity is `least` at least."""
    best = matches.filter((F.col("rank") == 1) & (F.col("similarity") >= least))
    return _trigger(best, "pattern_match", "warning", {
        "similarity": fixed(F.col("similarity") * 100, 0), "past_event_date": F.date_format("episode_start", "yyyy-MM-dd HH:mm"),
        "current_prob": probability.select("probability").scalar(), "projected_prob": with_pattern.select("probability").scalar(),
        "eta": projected.agg(F.min("eta_minutes")).scalar()}, None)


def low_sub_signals(sub_signals: DataFrame) -> DataFrame:
    """(parent_signal, subs, thr): the sub-signals of each parent that aren't healthy, and the lowest of their thresholds."""
    return sub_signals.filter(F.col("status").isin("warning", "critical")).groupBy("parent_signal").agg(
        F.array_join(F.array_sort(F.collect_list("sub_name")), ", ").alias("subs"), F.min("threshold").alias("thr"))


def sub_signal_triggers(sub_signals: DataFrame, active: DataFrame) -> DataFrame:
    """Parents that are low in named sub-signals and the effect of an active rule (template 7)."""
    j = low_sub_signals(sub_signals).join(active.select(F.col("signal_b").alias("parent_signal"), "signal_a", "recommended_action"), "parent_signal")
    return _trigger(j, "multi_correlation", "warning", {
        "signal_a": F.col("parent_signal"), "threshold": F.concat(fixed("thr", 0), F.lit("%")), "sub_signals": F.col("subs"),
        "correlated_signal": F.col("signal_a"), "recommended_action": F.col("recommended_action")}, "parent_signal", "signal_a")


def stable_triggers(stable: DataFrame, duration: str) -> DataFrame:
    """One trigger (template 9) for all stable signals, if there are any."""
    g = stable.groupBy().agg(F.array_join(F.array_sort(F.collect_list("signal_name")), ", ").alias("l"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
    return _trigger(g, "stable", "info", {"signal_list": F.col("l"), "duration": F.lit(duration)}, None)


# --------------------------------------------------------------------------- LIP-12
def recovery_events(trended: DataFrame) -> DataFrame:
    """Snapshots where a signal returns to healthy from warning/critical."""
    w = Window.partitionBy("signal_name").orderBy("snapshot_time")
    p = trended.withColumn("prev_status", F.lag("status").over(w))
    return p.filter((F.col("status") == "healthy") & F.col("prev_status").isin("warning", "critical"))


def healthy_streaks(scored: DataFrame) -> DataFrame:
    """Length of the current healthy run per snapshot (gaps and islands); a snapshot without a score (unconfigured,
    no data) neither ends a run nor adds to it."""
    w = Window.partitionBy("signal_name").orderBy("snapshot_time")
    s = scored.filter(F.col("status").isin("healthy", "warning", "critical")).withColumn("_bad", (F.col("status") != "healthy").cast("int")).withColumn(
        "_island", F.sum("_bad").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wi = Window.partitionBy("signal_name", "_island").orderBy("snapshot_time")
    return s.withColumn("healthy_run", F.sum(1 - F.col("_bad")).over(wi.rowsBetween(Window.unboundedPreceding, 0))) \
        .drop("_bad", "_island")


def stable_signals(scored: DataFrame, as_of: Column, min_units: int = 4) -> DataFrame:
    """Signals healthy for more than `min_units` consecutive snapshots up to as_of."""
    s = healthy_streaks(scored)
    return s.filter((F.col("snapshot_time") == as_of) & (F.col("healthy_run") > min_units)) \
        .select("signal_name", F.col("healthy_run").cast("long").alias("healthy_run"))


# --------------------------------------------------------------------------- LIP-13
def incident_surge(snapshots: DataFrame, signal: str = "Incidents", window_s: int = 3600) -> DataFrame:
    """Value against its trailing average over `window_s` (range frame, current row excluded)."""
    w = (Window.partitionBy("signal_name").orderBy(F.col("snapshot_time").cast("long"))
         .rangeBetween(-window_s, -1))
    s = snapshots.filter(F.col("signal_name") == signal).withColumn("rolling_avg", F.avg("numeric_value").over(w))
    return s.select("signal_name", ts_text("snapshot_time").alias("snapshot_time"),
                    r4("numeric_value").alias("numeric_value"), r4("rolling_avg").alias("rolling_avg"),
                    r4(F.try_divide(F.col("numeric_value"), F.col("rolling_avg"))).alias("multiplier"))


# --------------------------------------------------------------------------- LIP-14
def eta(snapshots: DataFrame, signal_config: DataFrame, as_of: Column, window_s: int = 900, per_s: int = 60,
        max_eta: int = 60, min_points: int = 3) -> DataFrame:
    """Minutes (units of `per_s`) until the critical threshold by OLS over the window.

    Falling signals only for normal orientation; rising ones for inverted signals
    (extension). Already beyond the threshold -> eta 0. Rounded half-even. A signal without a critical
    threshold stays, with a null ETA, if it moves at all.
    """
    h = snapshots.filter(since("snapshot_time", as_of, window_s)).join(signal_config, "signal_name", "left")
    t0 = F.unix_timestamp("snapshot_time")
    g = h.groupBy("signal_name", "critical_threshold", "is_inverted").agg(
        F.regr_slope("numeric_value", t0 / F.lit(per_s)).alias("slope"),
        F.count(F.lit(1)).alias("n"), F.max_by("numeric_value", "snapshot_time").alias("current_value"))
    inv = F.col("is_inverted")
    slope, cur, crit = F.col("slope"), F.col("current_value"), F.col("critical_threshold")
    moving = F.when(inv.isNull() | crit.isNull(), slope != 0).when(inv, slope > 0).otherwise(slope < 0)
    beyond = F.when(inv, cur >= crit).otherwise(cur <= crit)
    e = F.when(beyond, F.lit(0.0)).otherwise(F.abs((cur - crit) / slope))
    out = g.filter((F.col("n") >= min_points) & slope.isNotNull() & moving)
    return (out.withColumn("eta_minutes", F.when(crit.isNotNull(), F.bround(e, 0).cast("long")))
            .filter(F.col("eta_minutes").isNull() | (F.col("eta_minutes") < max_eta))
            .select("signal_name", "eta_minutes", r4(F.bround(slope, 2)).alias("slope_per_min"),
                    r4(cur).alias("current_value"), r4(crit).alias("critical_threshold"),
                    ts_text(as_of).alias("projected_at")))


# --------------------------------------------------------------------------- LIP-15
def best_pattern(matches: DataFrame) -> Column:
    """The best similarity of `pre_outage_match` as 0 to 100 (0 without a match): the pattern part of the probability."""
    return matches.agg(F.greatest(F.coalesce(F.max("similarity"), F.lit(0.0)), F.lit(0.0)) * 100).scalar()


def outage_probability(latest: DataFrame, active: DataFrame, pattern: Column | float = 0.0) -> DataFrame:
    """0.40·min(25c+8w,100) + 0.25·min(12d,100) + 0.20·min(20h,100) + 0.15·pattern, rounded half-even.

    `d` counts signals whose `direction` is 'down' (F12); no decay is applied (F13).
    """
    s = latest.agg(count_if(F.col("status") == "critical").alias("critical_count"),
                   count_if(F.col("status") == "warning").alias("warning_count"),
                   count_if(F.col("direction") == "down").alias("declining_count"))
    # The correlation count is one value: a scalar subquery, not a join of two one-row tables.
    j = s.withColumn("correlation_count", active.agg(count_if(F.col("confidence") > 0.8)).scalar())
    f1 = F.least(F.col("critical_count") * 25 + F.col("warning_count") * 8, F.lit(100)) * 0.40
    f2 = F.least(F.col("declining_count") * 12, F.lit(100)) * 0.25
    f3 = F.least(F.col("correlation_count") * 20, F.lit(100)) * 0.20
    total = F.least(f1 + f2 + f3 + (pattern if isinstance(pattern, Column) else F.lit(pattern)) * 0.15, F.lit(100.0))
    return j.select(F.bround(rnd(total, 6), 0).cast("long").alias("probability"), "critical_count", "warning_count",
                    "declining_count", "correlation_count")


# --------------------------------------------------------------------------- LIP-16
def pattern_match(current: DataFrame, library: DataFrame, vec: str = "embedding", top: int = 5) -> DataFrame:
    """Cosine similarity of the current signal vector to each past pattern; the `top` most
    similar, ranked (a top-k report).

    The current vector is one scalar array, so each pattern is compared in its own row: no join and no shuffle of
    the library; the top-k is taken per partition first.
    """
    lib = library.select("vec_id", "label", F.col(vec).cast("array<double>").alias("x"),
                         current.select(F.col(vec).cast("array<double>")).scalar().alias("y"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    sims = lib.withColumn("similarity", F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))))
    w = Window.orderBy(F.col("similarity").desc(), F.col("vec_id"))
    return (sims.orderBy(F.col("similarity").desc(), F.col("vec_id")).limit(top)
            .withColumn("rank", F.row_number().over(w))
            .select("rank", "vec_id", "label", r4("similarity").alias("similarity")))


def outage_episodes(scored: DataFrame, signals, step_s: int, min_critical: int) -> DataFrame:
    """(episode_start): snapshots with `min_critical` critical signals and more whose predecessor, a step before, had fewer."""
    n = scored.filter(F.col("signal_name").isin(list(signals))).groupBy("snapshot_time").agg(count_if(F.col("status") == "critical").alias("n"))
    bad = n.filter(F.col("n") >= min_critical).select("snapshot_time")
    before = bad.select((F.col("snapshot_time") + F.make_dt_interval(secs=F.lit(float(step_s)))).alias("snapshot_time"))
    return bad.join(before, "snapshot_time", "left_anti").withColumnRenamed("snapshot_time", "episode_start")


def trajectory_vectors(snapshots: DataFrame, ends: DataFrame, signals, step_s: int, steps: int) -> DataFrame:
    """(end_time, embedding): the course of all signals over the `steps` snapshots up to each time of `ends` (end_time).

    A value is its distance from the signal's mean in SDs, 0 where a snapshot is missing or the signal never changes. Each snapshot is
    dealt to the `steps` windows that hold it, so a window is a group of at most signals x steps rows.
    """
    names = list(signals)
    snap = snapshots.filter(F.col("signal_name").isin(names))
    st = snap.groupBy("signal_name").agg(F.avg("numeric_value").alias("_m"), F.stddev_samp("numeric_value").alias("_sd"))
    z = F.when(F.col("_sd") > 0, (F.col("numeric_value") - F.col("_m")) / F.col("_sd")).otherwise(F.lit(0.0))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("signal_name")) - 1
    dealt = (snap.join(st, "signal_name").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
             .select((F.col("snapshot_time") + F.make_dt_interval(secs=(F.col("_k") * step_s).cast("decimal(18,6)"))).alias("end_time"),
                     ((steps - 1 - F.col("_k")) * len(names) + place).cast("int").alias("at"), F.coalesce(z, F.lit(0.0)).alias("z")))
    g = dealt.join(ends, "end_time", "left_semi").groupBy("end_time").agg(F.map_from_entries(F.collect_list(F.struct("at", "z"))).alias("zs"))
    return g.select("end_time", F.transform(F.sequence(F.lit(0), F.lit(steps * len(names) - 1)), lambda i: F.coalesce(F.try_element_at("zs", i), F.lit(0.0))).alias("embedding"))


def pre_outage_match(snapshots: DataFrame, scored: DataFrame, as_of: Column, signals=SIGNAL_NAMES, step_s: int = 60, steps: int = 15,
                     min_critical: int = 3, top: int = 5) -> DataFrame:
    """The past outages whose run-up is most like the course of the signals up to now: rank, episode_start, similarity (-1 to 1).

    The library is made from the snapshots: one vector for each episode, of the `steps` snapshots before it began.
    """
    gap = F.make_dt_interval(secs=F.lit(float(step_s)))
    starts = outage_episodes(scored, signals, step_s, min_critical).filter(F.col("episode_start") < as_of)
    ends = starts.select((F.col("episode_start") - gap).alias("end_time"))
    now = snapshots.filter(F.col("snapshot_time") == as_of).select(F.col("snapshot_time").alias("end_time")).distinct()
    vectors = trajectory_vectors(snapshots, ends.unionByName(now).distinct(), signals, step_s, steps)
    current = vectors.filter(F.col("end_time") == as_of).select("embedding")
    library = vectors.join(ends, "end_time", "left_semi").filter(F.col("end_time") < as_of).select(
        F.unix_micros("end_time").alias("vec_id"), (F.col("end_time") + gap).alias("label"), "embedding")
    m = pattern_match(current, library, top=top)
    return m.select("rank", F.col("label").alias("episode_start"), "similarity")


# --------------------------------------------------------------------------- LIP-26 (calibration)
def threshold_curve(snapshots: DataFrame, breaches: DataFrame, candidates: DataFrame, horizon_s: int = 900, inverted=INVERTED) -> DataFrame:
    """Per signal and candidate threshold: how many snapshots are beyond it, the share of them that a breach follows within
    `horizon_s`, and the share of normal snapshots (no breach within the horizon) on its good side.

    breaches: breach_time; candidates: signal_name, candidates (array). Snapshots are counted once by the interval between
    two candidates that holds them, and cumulative counts over these few intervals answer all candidates at once.
    """
    width = int(horizon_s * 1_000_000)
    bk = lambda c: F.floor(F.unix_micros(c) / F.lit(width)).cast("long")
    b = breaches.select("breach_time", F.explode(F.array(bk("breach_time"), bk("breach_time") - 1)).alias("_b"))
    s = snapshots.filter(F.col("numeric_value").isNotNull()).withColumn("_b", bk("snapshot_time"))
    horizon = F.make_dt_interval(secs=F.lit(float(horizon_s)))
    hit = s.join(b, (s["_b"] == b["_b"]) & (b["breach_time"] > s["snapshot_time"]) & (b["breach_time"] <= s["snapshot_time"] + horizon), "left_semi")
    marked = hit.withColumn("_f", F.lit(1)).unionByName(
        s.join(b, (s["_b"] == b["_b"]) & (b["breach_time"] > s["snapshot_time"]) & (b["breach_time"] <= s["snapshot_time"] + horizon), "left_anti").withColumn("_f", F.lit(0)))
    cands = candidates.select("signal_name", F.array_sort(F.array_distinct("candidates")).alias("_c"))
    inv = F.col("signal_name").isin(list(inverted))
    # Place among the candidates: beyond candidate i (from 0) are, normally, values below it, so places up to i; inverted, values above it, places over i.
    place = F.size(F.filter("_c", lambda c: F.when(inv, c < F.col("numeric_value")).otherwise(c <= F.col("numeric_value"))))
    counted = marked.join(cands, "signal_name").groupBy("signal_name", place.alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("f"))
    by_place = F.map_from_entries(F.collect_list(F.struct("_p", F.struct("n", "f").alias("v"))))
    per = counted.groupBy("signal_name").agg(by_place.alias("m"), F.sum("n").alias("total"), F.sum("f").alias("followed")).join(cands, "signal_name")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("f"))

    def upto(i):  # counts of places 0..i
        return F.aggregate(F.sequence(F.lit(0), i), zero, lambda a, j: F.struct(
            (a["n"] + F.coalesce(F.try_element_at("m", j)["n"], F.lit(0))).alias("n"), (a["f"] + F.coalesce(F.try_element_at("m", j)["f"], F.lit(0))).alias("f")))

    low = per.select("signal_name", "total", "followed", F.posexplode("_c").alias("_i", "threshold"), "m").withColumn("_u", upto(F.col("_i")))
    n = F.when(inv, F.col("total") - F.col("_u.n")).otherwise(F.col("_u.n"))
    f = F.when(inv, F.col("followed") - F.col("_u.f")).otherwise(F.col("_u.f"))
    normal = F.col("total") - F.col("followed")
    return low.select("signal_name", r4("threshold").alias("threshold"), n.alias("beyond"), f.alias("followed"),
                      r4(F.try_divide(f.cast("double"), n.cast("double"))).alias("breach_share"),
                      r4(F.try_divide((normal - (n - f)).cast("double"), normal.cast("double"))).alias("normal_share"))


# --------------------------------------------------------------------------- LIP-18
def signal_matrix(latest: DataFrame, dmap: DataFrame) -> DataFrame:
    """Signal x domain matrix of statuses (pivot), with the number of domains a signal is shared by."""
    j = latest.join(dmap, "signal_name")
    p = j.groupBy("signal_name").pivot("domain_key", ["agent", "app", "genesys"]).agg(F.first("status"))
    n = j.groupBy("signal_name").agg(F.count(F.lit(1)).alias("domain_count"))
    return p.join(n, "signal_name").withColumn("shared", F.col("domain_count") > 1)


def domain_lanes(latest: DataFrame, dmap: DataFrame) -> DataFrame:
    j = latest.join(dmap, "signal_name")
    return j.groupBy("domain_key").agg(
        count_if(F.col("status") == "healthy").alias("healthy"), count_if(F.col("status") == "warning").alias("warning"),
        count_if(F.col("status") == "critical").alias("critical"),
        F.array_join(F.array_sort(F.collect_list("signal_name")), ", ").alias("signals"))


# --------------------------------------------------------------------------- LIP-21
def signal_outliers(snapshots: DataFrame, as_of: Column, method: str = "zscore", k: float = 3.0) -> DataFrame:
    """Latest value of each signal against its own history: z-score (|z| > k) or IQR (1.5 x IQR fences)."""
    hist = snapshots.filter(F.col("snapshot_time") < as_of)
    cur = snapshots.filter(F.col("snapshot_time") == as_of).select("signal_name", F.col("numeric_value").alias("v"))
    st = hist.groupBy("signal_name").agg(F.avg("numeric_value").alias("mean"), F.stddev_samp("numeric_value").alias("sd"))
    if method != "zscore":
        st = with_percentiles(st, hist, ["signal_name"], "numeric_value", {"q1": 0.25, "q3": 0.75})
    j = cur.join(st, "signal_name")
    if method == "zscore":
        z = F.when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
        return j.select("signal_name", r4("v").alias("value"), r4(z).alias("score"), (F.abs(z) > k).alias("is_outlier"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.select("signal_name", r4("v").alias("value"), r4(lo).alias("lower_fence"), r4(hi).alias("upper_fence"),
                    ((F.col("v") < lo) | (F.col("v") > hi)).alias("is_outlier"))


# --------------------------------------------------------------------------- LIP-25
def rule_confidence(scored: DataFrame, rules: DataFrame, minute_s: int = 60) -> DataFrame:
    """Measured confidence and lag of each rule: share of A's degradation starts followed by a
    B degradation start within the rule window, and the median lag of those that were.

    Episode starts come from `lag(status)`; the A-to-B match is an equi-join on the rule's
    signal and a time bucket, with the exact time range as a residual (interval join).
    """
    w = Window.partitionBy("signal_name").orderBy("snapshot_time")
    bad = F.col("status").isin("warning", "critical")
    starts = (scored.withColumn("_prev_bad", F.lag(bad.cast("int"), 1, 0).over(w))
              .filter(bad & (F.col("_prev_bad") == 0)).select("signal_name", "snapshot_time"))
    a = starts.select(F.col("signal_name").alias("signal_a"), F.col("snapshot_time").alias("ta"))
    b = starts.select(F.col("signal_name").alias("signal_b"), F.col("snapshot_time").alias("tb"))
    ra = rules.join(a, "signal_a")
    # Interval join without pairing whole histories: bucket width = the largest rule window, so the
    # B-starts within [ta, ta + window] are in ta's bucket or the next; A-starts are exploded into
    # those two buckets and joined on (signal, bucket), the exact range is the residual.
    width_us = rules.agg(F.max("time_window_min")).scalar() * F.lit(minute_s * 1_000_000)
    bk = lambda c: F.floor(F.unix_micros(c) / width_us).cast("long")
    ra_b = ra.withColumn("bucket", F.explode(F.array(bk(F.col("ta")), bk(F.col("ta")) + 1)))
    b_b = b.withColumn("bucket", bk(F.col("tb")))
    gap = (F.unix_timestamp("tb") - F.unix_timestamp("ta")) / F.lit(minute_s)
    m = (ra_b.join(b_b, ["signal_b", "bucket"])
         .filter((F.col("tb") >= F.col("ta"))
                 & (F.col("tb") <= F.col("ta") + F.make_dt_interval(
                     secs=(F.col("time_window_min") * minute_s).cast("decimal(18,6)"))))
         .select("rule_id", "ta", gap.alias("gap")))
    first = m.groupBy("rule_id", "ta").agg(F.min("gap").alias("lag"))
    tot = ra.groupBy("rule_id", "signal_a", "signal_b", "confidence").agg(F.count(F.lit(1)).alias("a_starts"))
    hit = first.groupBy("rule_id").agg(F.count(F.lit(1)).alias("followed"), F.percentile("lag", 0.5).alias("median_lag"))
    return (tot.join(hit, "rule_id", "left").fillna(0, ["followed"])
            .select("rule_id", "signal_a", "signal_b", r4("confidence").alias("stated_confidence"),
                    F.col("a_starts").cast("long").alias("a_starts"), F.col("followed").cast("long").alias("followed"),
                    r4(F.col("followed") / F.col("a_starts")).alias("measured_confidence"),
                    r4("median_lag").alias("median_lag_minutes")))


# --------------------------------------------------------------------------- LIP-19
def regional_signals(region_values: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Per-signal values per region over the cycle window, with the global roll-up (rollup)."""
    v = region_values.filter(since("ts", as_of, window_s))
    g = v.rollup("signal_name", "region").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("samples"))
    return (g.filter(F.col("signal_name").isNotNull())
            .select("signal_name", F.coalesce("region", F.lit("GLOBAL")).alias("region"), r4("v").alias("numeric_value"),
                    "samples"))


# --------------------------------------------------------------------------- LIP-22
def incident_scope(incidents: DataFrame, ci_map: DataFrame, open_states=("Open", "In Progress")) -> DataFrame:
    """Open incidents per configuration item: count, groups involved, whether the CI is on the
    call path (accept rule R3) or not (weaken it), and whether incidents share the item.
    Incidents without an item are one row with a null item; they don't share it and neither accept nor weaken the rule."""
    o = incidents.filter(F.col("state").isin(*open_states)).join(ci_map, "incident_id", "left")
    g = o.groupBy("ci", "call_path").agg(F.count(F.lit(1)).alias("incidents"),
                                         F.array_join(F.array_sort(F.collect_set("assignment_group")), ",").alias("groups"))
    return g.select("ci", "call_path", "incidents", "groups", (F.col("ci").isNotNull() & (F.col("incidents") > 1)).alias("shared"),
                    F.when(F.col("call_path"), "accept_R3").when(F.col("ci").isNotNull(), "weaken_R3").otherwise("unmapped").alias("rule_r3"))


# --------------------------------------------------------------------------- LIP-24
def ivr_overflow(containment: DataFrame, volume_per_hour: Column, baseline_pct: Column) -> DataFrame:
    """Extra live calls per hour from a self-service drop: volume x (baseline - current containment)."""
    return containment.select("period", r4("containment_pct").alias("containment_pct"),
                              r4(F.greatest(F.lit(0.0), (baseline_pct - F.col("containment_pct")) / 100.0)
                                 * volume_per_hour).alias("extra_calls_per_hour"))


# --------------------------------------------------------------------------- LIP-17
def multi_correlation(sub_signals: DataFrame, active: DataFrame, templates: DataFrame) -> DataFrame:
    """Template #7: a parent signal below threshold in named sub-signals, correlated (active rule)
    with another signal. sub_signals: (parent_signal, sub_name, status, threshold)."""
    low = low_sub_signals(sub_signals)
    cor = active.select(F.col("signal_b").alias("parent_signal"), F.col("signal_a").alias("correlated_signal"),
                        "recommended_action")
    t = templates.filter(F.col("template_id") == 7).select("template_text")
    j = low.join(cor, "parent_signal").withColumn("template_text", t.scalar())
    fields = F.create_map(F.lit("signal_a"), F.col("parent_signal"), F.lit("threshold"), F.concat(fixed("thr", 0), F.lit("%")),
                          F.lit("sub_signals"), F.col("subs"), F.lit("correlated_signal"), F.col("correlated_signal"),
                          F.lit("recommended_action"), F.col("recommended_action"))
    return j.select("parent_signal", "correlated_signal", fill_template(F.col("template_text"), fields).alias("insight_text"))
