"""Four-tier statistical anomaly pipeline (ANO-1..24).

Descriptive + diagnostic (method-specific z, directionality, Bonferroni risk,
OLS trend), predictive (Holt level/trend, forecasts, intervals, time to breach)
and prescriptive (ordered rule rows, first match wins). Everything is one
projection over a per-metric row holding a bounded history array; nothing is
collected to the driver (the reference collects all metrics to one thread).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import fixed, ladder, r4, rank_of, ts_text
from ..functions.stats import (HOLT_ALPHA, HOLT_BETA, Z80, Z95, arr_mad, arr_mean, arr_median, arr_sd,
                               bonferroni, holt, logit, ols, residual_se)

DEFAULT_HISTORY = 20
BASELINE_PCT = 0.70
MAX_LOOKAHEAD = 50
IMMINENT = 5

# Breach thresholds by metric type (requirements §10.3).
RATIO_LOW_THRESHOLD = 0.70
RATIO_HIGH_THRESHOLD = 0.95
CAPACITY_BREACH_SHARE = 0.95
UNBOUNDED_BREACH_FACTOR = 2.0

# Ordered action rules per rule set (requirements §11.2), first match wins.
# (rule_set, condition, parameter, urgency, action, impact)
ACTION_RULES = [
    ("port_usage", "breached", None, "urgent",
     "IMMEDIATE: Request emergency port capacity expansion. Engage vendor support hotline.",
     "Prevents call routing failures and customer abandonment."),
    ("port_usage", "breach_within", 3, "urgent",
     "ESCALATE: Port saturation projected imminently. Initiate capacity expansion. Reroute overflow to backup carrier.",
     "Avoids saturation-induced call drops."),
    ("port_usage", "breach_within", 10, "moderate",
     "PLAN: Schedule port capacity review with Nuance. Analyze peak-hour patterns. Consider dynamic port allocation.",
     "Proactive capacity management reduces incident risk by ~60%."),
    ("port_usage", "risk_not_nominal", None, "moderate",
     "MONITOR: Set up automated alerts at 85% and 90% utilization thresholds.",
     "Early warning enables proactive intervention."),
    ("port_usage", "always", None, "monitor",
     "MAINTAIN: Port usage within normal range. Continue monitoring cadence.", "No action required."),
    ("dotnet_apdex", "critical_breached", None, "urgent",
     "Trigger APM deep-dive. Check memory leaks, thread pool exhaustion. Engage .NET platform team.",
     "Prevents user-facing SLA breach."),
    ("dotnet_apdex", "critical", None, "urgent",
     "Run Dynatrace root-cause analysis. Isolate top 3 slowest transactions. Consider service restart.",
     "Direct correlation with customer satisfaction."),
    ("dotnet_apdex", "elevated", None, "moderate",
     "Review recent deployments. Check infrastructure metrics. Correlate with release calendar.",
     "Catch regression before customer impact."),
    ("dotnet_apdex", "negative_trend", None, "moderate",
     "Schedule performance profiling. Review code-level hotspots in Dynatrace.",
     "Trend reversal at this stage is 3× cheaper than post-incident."),
    ("dotnet_apdex", "always", None, "monitor", "Continue standard APM monitoring.", "No action required."),
    ("ugw_apdex", "critical", None, "urgent",
     "Check gateway pod health, connection pool limits, SSL certificate status.",
     "Gateway is single point of failure for all API traffic."),
    ("ugw_apdex", "elevated", None, "moderate",
     "Review request queue depth, backend timeouts, TLS handshake latency.",
     "Gateway issues cascade to all downstream services."),
    ("ugw_apdex", "negative_trend", None, "moderate",
     "Evaluate gateway scaling policy. Review connection pool recycling.",
     "Proactive scaling prevents cascading failures."),
    ("ugw_apdex", "always", None, "monitor", "Continue monitoring.", "No action required."),
    ("self_serve", "critical_breached", None, "urgent",
     "Check IVR menu, speech recognition, knowledge base freshness. Alert workforce management.",
     "Every 1% drop ≈ 200+ additional live agent calls/day."),
    ("self_serve", "critical", None, "urgent",
     "Audit top 10 IVR exit points. Review NLU confidence scores.",
     "Agent queue times increase exponentially below 65%."),
    ("self_serve", "elevated", None, "moderate",
     "Analyze intent-level containment rates. A/B test IVR prompt changes.",
     "Targeted fixes can recover 5-10% containment in a week."),
    ("self_serve", "negative_trend", None, "moderate",
     "Schedule CX team review. Update knowledge base for top 20 call drivers.",
     "Improving self-serve is the highest-ROI capacity lever."),
    ("self_serve", "always", None, "monitor", "Continue monitoring containment by intent.", "No action required."),
    ("rpm", "critical_up", None, "urgent",
     "Rule out DDoS/bot traffic. Check rate limiters. Prepare auto-scaling. Alert NOC.",
     "Uncontrolled growth causes cascading failures."),
    ("rpm", "critical_down", None, "urgent",
     "RPM critically low — verify LB health, DNS, client connectivity. Check for incident.",
     "RPM drop may indicate customer-impacting outage."),
    ("rpm", "elevated", None, "moderate",
     "Correlate with marketing campaigns, seasonal patterns. Update baseline if organic.",
     "Distinguishing growth from anomaly prevents false alerts."),
    ("rpm", "always", None, "monitor", "Continue baseline calibration.", "No action required."),
    ("monthly_azure_spend", "critical_breached", None, "urgent",
     "Budget exceeded. Identify top 3 cost drivers via Azure Cost Analysis. "
     "Engage resource owners for immediate right-sizing or shutdown.",
     "Every day over budget costs ~$1,600. FinOps SLA breach triggers executive review."),
    ("monthly_azure_spend", "breach_within", 5, "moderate",
     "Budget breach projected. Review auto-scaling policies, orphaned resources, and dev/test environment schedules.",
     "Proactive cost control avoids budget overrun and executive escalation."),
    ("monthly_azure_spend", "always", None, "monitor", "Spend within budget. Continue weekly cost review cadence.",
     "No action required."),
    ("reserved_instance_utilization", "risk_not_nominal", None, "moderate",
     "RI utilization dropping. Review instance families with <50% usage. "
     "Consider exchanging or selling unused reservations on Azure marketplace.",
     "Each unused RI wastes $200-2,000/month depending on SKU."),
    ("reserved_instance_utilization", "always", None, "monitor", "RI utilization healthy. Continue tracking.",
     "No action required."),
    ("storage_growth_rate", "critical", None, "urgent",
     "Abnormal storage growth detected. Check for log floods, backup duplication, "
     "or data pipeline errors. Review lifecycle policies.",
     "Unchecked growth at this rate adds ~$15K/month to storage costs."),
    ("storage_growth_rate", "always", None, "monitor",
     "Growth within expected range. Continue lifecycle policy enforcement.", "No action required."),
]

# Urgency classes (requirements §11.3).
URGENCY_RESPONSE = [("urgent", "Immediate (< 15 min)"), ("moderate", "Within 1 hour"),
                    ("monitor", "Next scheduled review")]

DEFAULT_RULE_SET = [("bounded_capacity", "port_usage"), ("bounded_ratio", "self_serve"),
                    ("unbounded_count", "rpm")]


# --------------------------------------------------------------------------- ANO-1
def metric_histories(raw: DataFrame, config: DataFrame, n: int = DEFAULT_HISTORY, salts: int = 16) -> DataFrame:
    """Last `n` values per active metric, oldest first, with the newest as current value.

    Top-n in two steps so one very long metric does not sit in one task: first
    per (metric, salt) and then per metric over at most n * salts rows; the
    result is exactly the overall top n.
    """
    salt = F.pmod(F.xxhash64("recorded_at"), F.lit(salts))
    w1 = Window.partitionBy("metric_id", "_salt").orderBy(F.col("recorded_at").desc())
    w2 = Window.partitionBy("metric_id").orderBy(F.col("recorded_at").desc())
    top = (raw.select("metric_id", "recorded_at", "value").withColumn("_salt", salt)
           .withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n)
           .withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n))
    hist = (top.groupBy("metric_id")
            .agg(F.sort_array(F.collect_list(F.struct("recorded_at", "value"))).alias("_pts"),
                 F.max("recorded_at").alias("last_recorded_at"))
            .select("metric_id", "last_recorded_at",
                    F.transform("_pts", lambda p: p["value"].cast("double")).alias("history")))
    cfg = config.filter(F.coalesce(F.col("is_active"), F.lit(True)))
    return (hist.join(cfg, "metric_id")
            .withColumn("current_value", F.element_at("history", -1)))


# --------------------------------------------------------------------------- ANO-6 / ANO-3..5
def z_parts(hist: Column, current: Column, metric_type: Column, capacity: Column, pct=BASELINE_PCT):
    """Baseline slice and method-specific (mu, sigma, transformed current, method)."""
    n = F.size(hist)
    m = F.floor(n * (pct if isinstance(pct, Column) else F.lit(float(pct)))).cast("int")
    base = F.slice(hist, 1, F.greatest(m, F.lit(1)))
    cap_ok = capacity.isNotNull() & (capacity > 0)
    lb = F.transform(base, lambda x: logit(x))
    cb = F.transform(base, lambda x: logit(x / capacity))
    is_ratio = metric_type == "bounded_ratio"
    is_cap = metric_type == "bounded_capacity"
    mu = ladder([(is_ratio, arr_mean(lb)), (is_cap & cap_ok, arr_mean(cb))], arr_median(base))
    sigma = ladder([(is_ratio, arr_sd(lb)), (is_cap & cap_ok, arr_sd(cb))], arr_mad(base))
    cur_t = ladder([(is_ratio, logit(current)), (is_cap & cap_ok, logit(current / capacity))], current)
    method = ladder([(is_ratio, "Logit-Z"), (is_cap, "Capacity-Logit-Z")], "Median-MAD")
    return base, m, mu, sigma, cur_t, method


def mu_of(base: Column, metric_type: Column, capacity: Column) -> Column:
    cap_ok = capacity.isNotNull() & (capacity > 0)
    return ladder([(metric_type == "bounded_ratio", arr_mean(F.transform(base, lambda x: logit(x)))),
                   ((metric_type == "bounded_capacity") & cap_ok, arr_mean(F.transform(base, lambda x: logit(x / capacity))))],
                  arr_median(base))


def sigma_of(base: Column, metric_type: Column, capacity: Column) -> Column:
    cap_ok = capacity.isNotNull() & (capacity > 0)
    return ladder([(metric_type == "bounded_ratio", arr_sd(F.transform(base, lambda x: logit(x)))),
                   ((metric_type == "bounded_capacity") & cap_ok, arr_sd(F.transform(base, lambda x: logit(x / capacity))))],
                  arr_mad(base))


def directional(z: Column, direction: Column) -> Column:
    """lower_is_bad flips, higher_is_bad keeps, both takes |z| (ANO-7)."""
    return ladder([(direction == "lower_is_bad", -z), (direction == "higher_is_bad", z)], F.abs(z))


def format_value(value: Column, metric_type: Column, unit: Column, capacity: Column) -> Column:
    """'58.0%', '0.780', '472 / 500', '1,850' (ANO-17)."""
    return ladder([
        ((metric_type == "bounded_ratio") & (unit == "%"), F.concat(fixed(value * 100, 1), F.lit("%"))),
        (metric_type == "bounded_ratio", fixed(value, 3)),
        ((metric_type == "bounded_capacity") & capacity.isNotNull() & (capacity != 0),
         F.concat(value.cast("long").cast("string"), F.lit(" / "), capacity.cast("long").cast("string")))],
        F.format_number(value, 0))


def _rule_condition(kind: str, param, c: dict) -> Column:
    score, crit, elev = c["score"], c["crit"], c["elev"]
    if kind == "breached":
        return c["breached"]
    if kind == "breach_within":
        return c["periods"].isNotNull() & (c["periods"] <= param)
    if kind == "risk_not_nominal":
        return c["risk"] != "Nominal"
    if kind == "critical_breached":
        return (score > crit) & c["breached"]
    if kind == "critical":
        return score > crit
    if kind == "elevated":
        return score > elev
    if kind == "negative_trend":
        return (c["slope"] < 0) & (c["r2"] > 0.5)
    if kind == "critical_up":
        return (score > crit) & (c["slope"] > 0)
    if kind == "critical_down":
        return (score > crit) & (c["slope"] < 0)
    if kind == "always":
        return F.lit(True)
    raise ValueError(kind)


def prescribe(rule_set: Column, ctx: dict, rules=ACTION_RULES) -> tuple[Column, Column, Column]:
    """Rule rows -> one chained CASE per output; first matching rule of the metric's set (ANO-15)."""
    conds = [((rule_set == rs) & F.coalesce(_rule_condition(k, p, ctx), F.lit(False)), (u, a, i))
             for rs, k, p, u, a, i in rules]
    urg = ladder([(c, v[0]) for c, v in conds], "monitor")
    act = ladder([(c, v[1]) for c, v in conds], "No rules configured.")
    imp = ladder([(c, v[2]) for c, v in conds], "N/A")
    return urg, act, imp


def _fmt4_list(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.4f", r4(x))), ", "),
                    F.lit("]"))


# --------------------------------------------------------------------------- ANO-18
def run_anomaly(hist: DataFrame, as_of: Column, run_id: Column | None = None, n_tests: Column | None = None,
                thresholds: tuple[float, float] | None = None, min_points: int = DEFAULT_HISTORY,
                pct: float = BASELINE_PCT, suppress_nominal_breach: bool = False) -> DataFrame:
    """Full four-tier result, one row per metric (anomaly_results schema, 49 columns + breach_state).

    `n_tests` defaults to the number of metrics in `hist` (a scalar subquery);
    thresholds are the one-sided normal quantiles at 0.05/N and 0.005/N unless a
    fixed (elevated, critical) pair is given. Config columns that override the defaults where they are present and
    not null: baseline_window_pct, history_min_points, breach_threshold, breach_direction ('above' / 'below'),
    breach_label, rule_set.
    """
    if n_tests is None:
        n_tests = hist.select(F.count(F.lit(1))).scalar()
    # N, the thresholds and the run identity are computed once into columns: every later
    # reference is a column, not another copy of the scalar subqueries behind them.
    hist = hist.withColumns({"_nt": n_tests.cast("long"), "_as_of": as_of})
    hist = hist.withColumn("_bf", bonferroni(F.col("_nt")))
    n_tests, as_of = F.col("_nt"), F.col("_as_of")
    bf = F.col("_bf")
    elev = F.lit(thresholds[0]) if thresholds else bf["elevated"]
    crit = F.lit(thresholds[1]) if thresholds else bf["critical"]
    alpha = bf["alpha"]
    run = run_id if run_id is not None else F.concat(F.lit("run-"), F.date_format(as_of, "yyyyMMddHHmmss"))

    h, cur, mt, cap = F.col("history"), F.col("current_value"), F.col("metric_type"), F.col("capacity")
    direction = F.col("direction")
    min_pts = F.coalesce(F.col("history_min_points"), F.lit(min_points)) if "history_min_points" in hist.columns \
        else F.lit(min_points)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in hist.columns else default

    pct = given("baseline_window_pct", F.lit(float(pct)))
    set_threshold = given("breach_threshold", F.lit(None).cast("double"))
    set_direction = given("breach_direction", F.lit(None).cast("string"))
    set_label = given("breach_label", F.lit(None).cast("string"))
    # Stage 1: baseline statistics (each fold computed once; later stages refer to columns).
    base, m, mu, sigma, cur_t, method = z_parts(h, cur, mt, cap, pct)
    st1 = hist.withColumns({"_base": base, "_m": m, "_n": F.size(h), "_min_pts": min_pts})
    st1 = st1.withColumns({"_mu": mu_of(F.col("_base"), mt, cap), "_sigma": sigma_of(F.col("_base"), mt, cap),
                           "_cur_t": cur_t, "_method": method, "_bmean": arr_mean(F.col("_base")),
                           "_bmed": arr_median(F.col("_base")), "_ols": ols(h), "_hw": holt(h)})
    base, m, n, mu, sigma, cur_t = (F.col(c) for c in ("_base", "_m", "_n", "_mu", "_sigma", "_cur_t"))
    method, tr, hw, min_pts = F.col("_method"), F.col("_ols"), F.col("_hw"), F.col("_min_pts")
    cap_bad = (mt == "bounded_capacity") & (cap.isNull() | (cap <= 0))
    insufficient = (n < min_pts) | cap_bad
    z = F.when(sigma > 0, (cur_t - mu) / sigma).otherwise(F.lit(0.0))
    st1 = st1.withColumns({"_z": z, "_se": residual_se(hw)})
    z = F.col("_z")
    st1 = st1.withColumn("_score", directional(z, direction))
    score = F.col("_score")
    risk = ladder([(score > crit, "Critical"), (score > elev, "Elevated")], "Nominal")
    risk_desc0 = ladder([(risk == "Critical", F.concat(F.lit("Extreme anomaly (Bonferroni-adjusted p < "), fixed(alpha, 3), F.lit(")"))),
                         (risk == "Elevated", F.lit("Significant deviation beyond adjusted threshold"))],
                        "Within expected statistical range")
    base_mean = F.col("_bmean")
    risk_desc = F.concat(risk_desc0, ladder([
        ((direction == "lower_is_bad") & (cur < base_mean), " ▼ Value is below baseline (degradation)."),
        ((direction == "higher_is_bad") & (cur > base_mean), " ▲ Value exceeds baseline (approaching capacity).")], ""))
    sdir = F.when(tr["slope"] > 0, "increasing").otherwise("decreasing")
    r2txt = fixed(tr["r_squared"], 2)
    tclass = ladder([(tr["r_squared"] > 0.85, F.concat(F.lit("Strong "), sdir, F.lit(" trend"))),
                     (tr["r_squared"] > 0.50, F.concat(F.lit("Moderate "), sdir, F.lit(" trend")))],
                    "No significant trend")
    tdesc = ladder([(tr["r_squared"] > 0.85, F.concat(F.lit("Strong linear trend "), sdir, F.lit(" (R²="), r2txt, F.lit(")"))),
                    (tr["r_squared"] > 0.50, F.concat(F.lit("Moderate "), sdir, F.lit(" trend (R²="), r2txt, F.lit(")")))],
                   F.concat(F.lit("No significant trend pattern (R²="), r2txt, F.lit(")")))
    se = F.col("_se")
    lvl, trd = hw["level"], hw["trend"]
    is_ratio = mt == "bounded_ratio"
    is_cap = mt == "bounded_capacity"

    def clamp(x: Column, lower_only=False) -> Column:
        c = F.when(is_ratio, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(x)
        return F.when(is_cap, F.greatest(F.lit(0.0), x)).otherwise(c) if lower_only else c

    fc = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: lvl + k * trd)
    f5 = lvl + 5 * trd
    w95 = F.lit(Z95) * se * F.sqrt(F.lit(5.0))
    w80 = F.lit(Z80) * se * F.sqrt(F.lit(5.0))
    thr = ladder([(is_ratio & (direction == "lower_is_bad"), F.lit(RATIO_LOW_THRESHOLD)),
                  (is_ratio, F.lit(RATIO_HIGH_THRESHOLD)),
                  (is_cap & (cap > 0), cap * CAPACITY_BREACH_SHARE)],
                 F.col("_bmed") * UNBOUNDED_BREACH_FACTOR)
    st1 = st1.withColumn("_thr", F.coalesce(set_threshold, thr))
    thr = F.col("_thr")
    label = ladder([
        (set_label.isNotNull(), set_label),
        (is_ratio & (direction == "lower_is_bad"), F.lit("Drops below 0.70 (Poor)")),
        (is_ratio, F.lit("Exceeds 95%")),
        (is_cap & (cap > 0), F.format_string("Utilization exceeds 95%% (%d/%d)",
                                             (cap * CAPACITY_BREACH_SHARE).cast("long"), cap.cast("long")))],
        F.format_string("RPM exceeds 2× baseline (%d)", thr.cast("long")))
    below = F.coalesce(set_direction == "below", direction == "lower_is_bad")
    hits = F.filter(F.sequence(F.lit(1), F.lit(MAX_LOOKAHEAD)),
                    lambda k: F.when(below, (lvl + k * trd) < thr).otherwise((lvl + k * trd) > thr))
    st1 = st1.withColumn("_periods", F.try_element_at(hits, F.lit(1)))
    st1 = st1.withColumn("_risk", risk)
    periods = F.col("_periods")
    risk = F.col("_risk")
    breached = F.when(below, cur < thr).otherwise(cur > thr)
    if suppress_nominal_breach:
        periods = F.when(risk != "Nominal", periods)
    state = ladder([(breached, "Already Breached"), (periods <= IMMINENT, "Breach Imminent"),
                    (periods.isNotNull(), "Breach Projected")], "No Breach")
    rule_set = given("rule_set", ladder([(mt == t, s) for t, s in DEFAULT_RULE_SET], "rpm"))
    ctx = {"score": score, "crit": crit, "elev": elev, "breached": breached, "periods": periods,
           "risk": risk, "slope": tr["slope"], "r2": tr["r_squared"]}
    urg, act, imp = prescribe(rule_set, ctx)
    hist = st1

    def full(c: Column) -> Column:
        return F.when(~insufficient, c)

    out = hist.select(
        run.alias("run_id"), ts_text(as_of).alias("run_timestamp"),
        "metric_id", "metric_name", "category", r4(cur).alias("current_value"),
        F.when(insufficient, cur.cast("string")).otherwise(format_value(cur, mt, F.col("unit"), cap)).alias("formatted_value"),
        F.when(insufficient, "N/A").otherwise(method).alias("method"), "metric_type", "direction",
        r4(F.when(insufficient, 0.0).otherwise(mu)).alias("baseline_mu"),
        r4(F.when(insufficient, 0.0).otherwise(sigma)).alias("baseline_sigma"),
        F.when(insufficient, 0).otherwise(m).cast("long").alias("baseline_n"),
        r4(F.when(insufficient, 0.0).otherwise(z)).alias("z_score_raw"),
        r4(F.when(insufficient, 0.0).otherwise(score)).alias("anomaly_score"),
        F.when(insufficient, "Insufficient Data").otherwise(risk).alias("risk_level"),
        F.when(insufficient, F.format_string("Need ≥%d data points, only %d available", min_pts, n))
        .otherwise(risk_desc).alias("risk_description"),
        r4(full(tr["slope"])).alias("trend_slope"), r4(full(tr["r_squared"])).alias("trend_r_squared"),
        r4(full(tr["slope_normalized"])).alias("trend_slope_norm"),
        full(tclass).alias("trend_classification"), full(tdesc).alias("trend_description"),
        r4(crit).alias("sigma_critical"), r4(elev).alias("sigma_elevated"), r4(alpha).alias("bonferroni_alpha"),
        n_tests.cast("long").alias("num_metrics_tested"), n.cast("long").alias("history_length"),
        _fmt4_list(h).alias("history_values"),
        r4(full(lvl)).alias("hw_level"), r4(full(trd)).alias("hw_trend"),
        full(F.lit(HOLT_ALPHA)).alias("hw_alpha"), full(F.lit(HOLT_BETA)).alias("hw_beta"),
        r4(full(clamp(lvl + trd))).alias("forecast_h1"), r4(full(clamp(lvl + 3 * trd))).alias("forecast_h3"),
        r4(full(clamp(f5))).alias("forecast_h5"),
        full(_fmt4_list(F.transform(fc, lambda x: clamp(x)))).alias("forecast_values"),
        r4(full(clamp(f5 + w95))).alias("ci_95_upper_h5"), r4(full(clamp(f5 - w95, True))).alias("ci_95_lower_h5"),
        r4(full(clamp(f5 + w80))).alias("ci_80_upper_h5"), r4(full(clamp(f5 - w80, True))).alias("ci_80_lower_h5"),
        r4(full(se)).alias("residual_se"),
        r4(full(thr)).alias("breach_threshold"), full(label).alias("breach_label"),
        full(periods).cast("long").alias("periods_to_breach"), full(breached).alias("currently_breached"),
        r4(full(lvl + periods * trd)).alias("forecast_at_breach"), full(state).alias("breach_state"),
        full(urg).alias("rx_urgency"), full(act).alias("rx_action"), full(imp).alias("rx_impact"))
    return out


# --------------------------------------------------------------------------- ANO-16 / 20 / 21 / 22 / 23
def urgency(results: DataFrame) -> DataFrame:
    return results.withColumn("response_time", ladder([(F.col("rx_urgency") == u, r) for u, r in URGENCY_RESPONSE]))


RISK_ORDER = ["Critical", "Elevated", "Nominal", "Insufficient Data"]


def executive_summary(results: DataFrame) -> DataFrame:
    """Worst status, counts per risk level, top and next risk by anomaly score (one row per run)."""
    ranked = results.withColumn("_sev", rank_of("risk_level", RISK_ORDER))
    w = Window.partitionBy("run_id").orderBy(F.col("_sev"), F.col("anomaly_score").desc(), F.col("metric_id"))
    r = ranked.withColumn("_rk", F.row_number().over(w))
    return (r.groupBy("run_id")
            .agg(F.min("_sev").alias("_worst"),
                 F.count(F.lit(1)).alias("metrics"),
                 *[F.sum((F.col("risk_level") == lv).cast("long")).alias(f"n_{lv.lower().replace(' ', '_')}")
                   for lv in RISK_ORDER],
                 F.max(F.when(F.col("_rk") == 1, F.col("metric_id"))).alias("top_risk_metric"),
                 F.max(F.when(F.col("_rk") == 1, F.col("anomaly_score"))).alias("top_risk_score"),
                 F.max(F.when(F.col("_rk") == 2, F.col("metric_id"))).alias("next_risk_metric"),
                 F.max(F.when(F.col("_rk") == 2, F.col("anomaly_score"))).alias("next_risk_score"))
            .withColumn("overall_status", ladder([(F.col("_worst") == i + 1, v) for i, v in enumerate(RISK_ORDER)]))
            .drop("_worst"))


def narratives(results: DataFrame) -> DataFrame:
    """One narrative sentence set per metric from the computed fields (ANO-21)."""
    txt = F.concat_ws(" ",
                      F.concat(F.col("metric_name"), F.lit(" is at "), F.col("formatted_value"), F.lit(".")),
                      F.when(F.col("risk_level") == "Insufficient Data", F.col("risk_description"))
                      .otherwise(F.concat(F.lit("Risk "), F.col("risk_level"), F.lit(" at "), fixed("anomaly_score", 2),
                                                F.lit("σ ("), F.col("method"), F.lit(")."))),
                      F.when(F.col("trend_description").isNotNull(), F.concat(F.col("trend_description"), F.lit("."))),
                      F.when(F.col("breach_state") == "Already Breached",
                             F.concat(F.lit("Already breached: "), F.col("breach_label"), F.lit(".")))
                      .when(F.col("periods_to_breach").isNotNull(),
                            F.format_string("Breach in ~%d periods: %s.", F.col("periods_to_breach"), F.col("breach_label"))),
                      F.when(F.col("rx_action").isNotNull(),
                             F.concat(F.lit("Action ("), F.col("rx_urgency"), F.lit("): "), F.col("rx_action"))))
    return results.select("run_id", "metric_id", "risk_level", txt.alias("narrative"))


def action_list(results: DataFrame, top: int | None = None) -> DataFrame:
    """Prioritised actions of the newest run: urgency, then anomaly score (ANO-22), in the order of `priority`.

    One row a metric, so the ranking's single task holds the configured metrics that need an action."""
    newest = results.filter(F.col("run_timestamp") == results.select(F.max("run_timestamp")).scalar())
    acts = newest.filter(F.col("rx_urgency").isin("urgent", "moderate"))
    w = Window.orderBy(rank_of("rx_urgency", ["urgent", "moderate", "monitor"]), F.col("anomaly_score").desc(),
                       F.col("metric_id"))
    out = acts.select("run_id", "metric_id", "metric_name", "risk_level", "anomaly_score", "rx_urgency",
                      "rx_action", "rx_impact")
    out = out.withColumn("priority", F.row_number().over(w).cast("long"))
    return out if top is None else out.filter(F.col("priority") <= top)


def critical_alerts(results: DataFrame) -> DataFrame:
    """Critical rows of the newest run (ANO-23). Newest = max run_timestamp, not max(run_id)."""
    newest = results.filter(F.col("run_timestamp") == results.select(F.max("run_timestamp")).scalar())
    return newest.filter(F.col("risk_level") == "Critical").select(
        "run_id", "metric_id", "metric_name", "current_value", "anomaly_score", "risk_description",
        "breach_state", "rx_urgency", "rx_action")


def two_tier(hist: DataFrame, n_tests: Column | None = None) -> DataFrame:
    """Tiers 1-2 only (the SQL form): inline of one struct per metric (ANO-19 / JOIN-12)."""
    if n_tests is None:
        n_tests = hist.select(F.count(F.lit(1))).scalar()
    hist = hist.withColumn("_nt", n_tests.cast("long"))
    hist = hist.withColumn("_bf", bonferroni(F.col("_nt")))
    bf = F.col("_bf")
    h, cur, mt, cap = F.col("history"), F.col("current_value"), F.col("metric_type"), F.col("capacity")
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in hist.columns else F.lit(default)
    least = given("history_min_points", DEFAULT_HISTORY)
    base, m, mu, sigma, cur_t, method = z_parts(h, cur, mt, cap, given("baseline_window_pct", BASELINE_PCT))
    hist = hist.withColumn("_base", base)
    hist = hist.withColumns({"_mu": mu_of(F.col("_base"), mt, cap), "_sigma": sigma_of(F.col("_base"), mt, cap),
                             "_cur_t": cur_t})
    mu, sigma, cur_t = F.col("_mu"), F.col("_sigma"), F.col("_cur_t")
    hist = hist.withColumn("_z", F.when(sigma > 0, (cur_t - mu) / sigma).otherwise(F.lit(0.0)))
    z = F.col("_z")
    score = directional(z, F.col("direction"))
    short = F.size(h) < least
    st = F.struct(
        F.when(short, "N/A").otherwise(method).alias("method"),
        r4(F.when(short, 0.0).otherwise(mu)).alias("baseline_mu"),
        r4(F.when(short, 0.0).otherwise(sigma)).alias("baseline_sigma"),
        r4(F.when(short, 0.0).otherwise(z)).alias("z_score_raw"),
        r4(F.when(short, 0.0).otherwise(score)).alias("anomaly_score"),
        F.when(short, "Insufficient Data").otherwise(
            ladder([(score > bf["critical"], "Critical"), (score > bf["elevated"], "Elevated")], "Nominal"))
        .alias("risk_level"))
    # The SQL form inlines array(struct); expanding the struct's fields is the same row shape.
    return hist.select("metric_id", "metric_name", "metric_type", "direction", r4(cur).alias("current_value"),
                       st.alias("_t")).select("metric_id", "metric_name", "metric_type", "direction",
                                              "current_value", "_t.*")
