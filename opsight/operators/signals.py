"""The leading-indicator signal formulas (SIG-1..19) over their raw tables.

Each returns `signal_name, numeric_value, status` (plus sub-signal columns) for the
window ending at `as_of`. Thresholds are the stated defaults (parameters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import count_if, ladder, pct, r4, rnd, since

DEFAULT_SLA = 30  # seconds, for calls of a queue without a line of business

OPEN_STATES = ("Open", "In Progress", "New", "On Hold")

# LOB sub-signal thresholds (healthy, warning) of the Call LOB SLA signal.
LOB_THRESHOLDS = [("Sales", 85.0, 80.0), ("Billing", 85.0, 80.0), ("Service", 82.0, 78.0), ("Retention", 92.0, 88.0)]


def _status(v: Column, healthy: float, warning: float) -> Column:
    """Nothing measured is `no data`, which has no score, instead of critical."""
    return ladder([(v.isNull(), "no data"), (v >= healthy, "healthy"), (v >= warning, "warning")], "critical")


# --------------------------------------------------------------------------- SIG-2
def incidents_signal(incidents: DataFrame, as_of: Column, window_s: int, change_s: int, groups=None) -> DataFrame:
    """Open incidents opened in the window, P1/P2/P3 counts, change against the same count
    `change_s` earlier; critical when > 6, >= 2 P1 or a rise of >= 4; warning at 4-6 or 1 P1."""
    inc = incidents.filter(F.col("state").isin(*OPEN_STATES))
    if groups:
        inc = inc.filter(F.col("assignment_group").isin(*groups))
    earlier = as_of - F.make_dt_interval(secs=F.lit(float(change_s)))
    now_w = since("opened_at", as_of, window_s) & (F.col("opened_at") <= as_of)
    then_w = since("opened_at", earlier, window_s) & (F.col("opened_at") <= earlier)
    g = inc.agg(count_if(now_w).alias("numeric_value"), count_if(now_w & (F.col("priority") == 1)).alias("p1_count"),
                count_if(now_w & (F.col("priority") == 2)).alias("p2_count"),
                count_if(now_w & (F.col("priority") == 3)).alias("p3_count"), count_if(then_w).alias("_then"))
    n, p1 = F.col("numeric_value"), F.col("p1_count")
    ch = n - F.col("_then")
    st = ladder([((n > 6) | (p1 >= 2) | (ch >= 4), "critical"), ((n >= 4) | (p1 == 1), "warning")], "healthy")
    return g.select(F.lit("Incidents").alias("signal_name"), "numeric_value", "p1_count", "p2_count", "p3_count",
                    ch.alias("change"), st.alias("status"))


# --------------------------------------------------------------------------- SIG-3 / SIG-10
def app_health_signal(checks: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Mean check pass (0/100) over the window, overall (app_name ALL) and per monitored application."""
    c = checks.filter(since("check_time", as_of, window_s))
    g = c.rollup("app_name").agg(F.avg(F.col("is_healthy") * 100.0).alias("v"), F.count(F.lit(1)).alias("checks"))
    v = rnd(F.col("v"), 1)
    return g.select(F.coalesce("app_name", F.lit("ALL")).alias("app_name"), r4(v).alias("numeric_value"), "checks",
                    _status(v, 97.0, 93.0).alias("status"))


def platform_signal(provider_status: DataFrame, checks: DataFrame, unit: str = "day") -> DataFrame:
    """Platform health per period from the provider indicator and the synthetic success rate,
    severest condition first (F14): major/critical or rate < 90 -> 50; minor or rate < 99 -> 95; else 100."""
    rate = (checks.groupBy(F.date_trunc(unit, "check_time").alias("period"))
            .agg(F.avg(F.col("is_healthy") * 100.0).alias("synthetic_rate")))
    j = rate.join(provider_status, "period", "left").withColumn("indicator", F.coalesce("indicator", F.lit("none")))
    r, ind = F.col("synthetic_rate"), F.col("indicator")
    v = ladder([(ind.isin("major", "critical") | (r < 90), 50.0), ((ind == "minor") | (r < 99), 95.0)], 100.0)
    return j.select(F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), "indicator",
                    r4("synthetic_rate").alias("synthetic_rate"), v.alias("numeric_value"),
                    _status(v, 99.5, 98.0).alias("status"))


# --------------------------------------------------------------------------- SIG-5 / SIG-16
def _with_lob(calls: DataFrame, lob_config: DataFrame, default_sla: int = DEFAULT_SLA) -> DataFrame:
    """Calls with their line of business; calls of a queue that has none stay, as 'Unlisted' with the default target."""
    return (calls.join(lob_config, "queue", "left").withColumn("lob_name", F.coalesce("lob_name", F.lit("Unlisted")))
            .withColumn("sla_target_sec", F.coalesce("sla_target_sec", F.lit(default_sla))))


def lob_sla_signal(calls: DataFrame, lob_config: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Share of calls answered within the LOB's target, total and per LOB (sorted breakdown)."""
    c = _with_lob(calls.filter(since("call_time", as_of, window_s)), lob_config)
    per = c.groupBy("lob_name").agg(count_if(F.col("wait_sec") <= F.col("sla_target_sec")).alias("sla_met"),
                                    F.count(F.lit(1)).alias("call_count"))
    g = per.agg(F.sum("sla_met").alias("met"), F.sum("call_count").alias("n"),
                F.sort_array(F.collect_list(F.struct("lob_name", rnd(pct(F.col("sla_met"), F.col("call_count")), 1)
                                                     .alias("pct")))).alias("lob_breakdown"))
    v = rnd(pct(F.col("met"), F.col("n")), 1)
    return g.select(F.lit("Call LOB SLA").alias("signal_name"), r4(v).alias("numeric_value"),
                    F.array_join(F.transform("lob_breakdown", lambda x: F.concat(x["lob_name"], F.lit(":"),
                                                                                  F.format_string("%.1f", x["pct"]))), ";")
                    .alias("lob_breakdown"), _status(v, 85.0, 80.0).alias("status"))


def lob_sub_signals(calls: DataFrame, lob_config: DataFrame, thresholds: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Per-LOB sub-signal snapshots scored with their own thresholds (unpivoted rows + threshold join)."""
    c = _with_lob(calls.filter(since("call_time", as_of, window_s)), lob_config)
    per = c.groupBy("lob_name").agg(rnd(pct(count_if(F.col("wait_sec") <= F.col("sla_target_sec")),
                                             F.count(F.lit(1))), 1).alias("v"))
    j = per.join(thresholds, "lob_name", "left")
    return j.select(F.lit("Call LOB SLA").alias("parent_signal"), F.col("lob_name").alias("sub_name"),
                    r4("v").alias("numeric_value"),
                    _status_cols(F.col("v"), F.col("healthy"), F.col("warning")).alias("status"))


# Thresholds of sub-signals (parent, sub-signal, healthy, warning, lower is better).
SUB_THRESHOLDS = [
    ("Agent Online", "voice", 95.0, 90.0, False), ("Agent Online", "chat", 93.0, 88.0, False), ("Agent Online", "email", 90.0, 85.0, False),
    ("App Health", "CRM", 98.0, 95.0, False), ("App Health", "WFM", 95.0, 90.0, False), ("App Health", "Reporting", 90.0, 80.0, False),
    ("Call LOB SLA", "Sales", 85.0, 80.0, False), ("Call LOB SLA", "Billing", 85.0, 80.0, False), ("Call LOB SLA", "Service", 82.0, 78.0, False),
    ("Call LOB SLA", "Retention", 92.0, 88.0, False), ("Call Quality", "Jitter", 10.0, 20.0, True), ("Call Quality", "Packet Loss", 0.5, 1.5, True),
]
# An open incident of a priority gives its sub-signal this status.
INCIDENT_SUBS = {"p1_count": ("P1 Critical", "critical"), "p2_count": ("P2 High", "warning"), "p3_count": ("P3 Medium", "healthy")}


def sub_signal_snapshots(spark: SparkSession, families: dict[str, DataFrame], incidents: DataFrame) -> DataFrame:
    """SIG-16: (parent_signal, sub_name, numeric_value, status, threshold) of all families.

    families: parent -> rows (sub_name, numeric_value), scored with their own thresholds; sub-signals without any are unconfigured.
    incidents: one row with p1_count, p2_count, p3_count, unpivoted; their status follows from the priority.
    """
    rows = None
    for parent, df in families.items():
        part = df.select(F.lit(parent).alias("parent_signal"), "sub_name", F.col("numeric_value").cast("double").alias("numeric_value"))
        rows = part if rows is None else rows.unionByName(part)
    th = F.broadcast(spark.createDataFrame(SUB_THRESHOLDS, "parent_signal string, sub_name string, healthy double, warning double, low boolean"))
    v, h, w = F.col("numeric_value"), F.col("healthy"), F.col("warning")
    low = ladder([(v.isNull(), "no data"), (v < h, "healthy"), (v <= w, "warning")], "critical")
    scored = rows.join(th, ["parent_signal", "sub_name"], "left").select(
        "parent_signal", "sub_name", r4("numeric_value").alias("numeric_value"),
        F.when(F.col("low"), low).otherwise(_status_cols(v, h, w)).alias("status"), h.alias("threshold"))
    cells = F.array(*[F.struct(F.lit(name).alias("sub_name"), F.col(c).cast("double").alias("numeric_value"),
                               F.when(F.col(c) > 0, st).otherwise("healthy").alias("status")) for c, (name, st) in INCIDENT_SUBS.items()])
    inc = incidents.select(F.explode(cells).alias("x")).select(F.lit("Incidents").alias("parent_signal"), "x.*", F.lit(1.0).alias("threshold"))
    return scored.unionByName(inc)


def _status_cols(v: Column, h: Column, w: Column) -> Column:
    return F.when(h.isNull() | w.isNull(), "unconfigured").when(v.isNull(), "no data").when(v >= h, "healthy").when(v >= w, "warning").otherwise("critical")


# --------------------------------------------------------------------------- SIG-7 / SIG-8 / SIG-18
def presence_signal(roster: DataFrame, calls: DataFrame, as_of: Column, window_s: int, by: str,
                    healthy: float, warning: float) -> DataFrame:
    """Agents present (at least one call in the window) / scheduled agents of the roster, per `by`."""
    present = calls.filter(since("call_time", as_of, window_s)).select("agent_id").distinct() \
        .withColumn("present", F.lit(1))
    j = roster.join(present, "agent_id", "left")
    g = j.groupBy(by).agg(F.count(F.lit(1)).alias("scheduled"), F.count("present").alias("present"))
    v = rnd(pct(F.col("present"), F.col("scheduled")), 1)
    return g.select(by, "scheduled", "present", r4(v).alias("numeric_value"), _status(v, healthy, warning).alias("status"))


def localised_drop(presence: DataFrame, warning: float = 93.0) -> DataFrame:
    """One location below the line while the others hold -> localised; two or more -> widespread."""
    g = presence.agg(count_if(F.col("numeric_value") < warning).alias("locations_low"),
                     F.count(F.lit(1)).alias("locations"))
    lab = ladder([(F.col("locations_low") == 0, "none"), (F.col("locations_low") == 1, "localised")], "widespread")
    return g.select("locations_low", "locations", lab.alias("drop_pattern"))


# --------------------------------------------------------------------------- SIG-12 / SIG-13 / SIG-14
def call_quality_signal(calls: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Mean MOS, jitter and packet loss per region and overall; the status is that of the MOS."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.rollup("region").agg(F.avg("mos").alias("v"), F.count(F.lit(1)).alias("calls"), F.avg("jitter_ms").alias("j"), F.avg("packet_loss_pct").alias("l"))
    v = rnd(F.col("v"), 1)
    return g.select(F.coalesce("region", F.lit("ALL")).alias("region"), r4(v).alias("numeric_value"), "calls", r4(rnd("j", 1)).alias("avg_jitter_ms"),
                    r4(rnd("l", 2)).alias("avg_packet_loss_pct"), _status(v, 4.0, 3.5).alias("status"))


def latency_signal(rtt: DataFrame, as_of: Column, window_s: int, ts: str = "ts", value: str = "rtt_ms") -> DataFrame:
    """Mean round-trip time over the window; inverted thresholds (< 30 healthy, <= 80 warning)."""
    g = rtt.filter(since(ts, as_of, window_s)).agg(F.avg(value).alias("v"), F.count(F.lit(1)).alias("samples"))
    v = rnd(F.col("v"), 1)
    st = ladder([(v.isNull(), "no data"), (v < 30, "healthy"), (v <= 80, "warning")], "critical")
    return g.select(F.lit("Network Latency").alias("signal_name"), r4(v).alias("numeric_value"), "samples",
                    st.alias("status"))


def desktop_signal(endpoints: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Mean of three endpoint checks (Citrix active and RTT < 100 ms, browser, softphone), stacked
    into one column in a single scan; also each check's pass rate as sub-signals."""
    e = endpoints.filter(since("ts", as_of, window_s))
    st = e.select(F.expr("stack(3, 'Citrix', CASE WHEN citrix_active AND ica_rtt_ms < 100 THEN 100.0 ELSE 0.0 END, "
                         "'Browser', CASE WHEN browser_responsive THEN 100.0 ELSE 0.0 END, "
                         "'Softphone', CASE WHEN softphone_registered THEN 100.0 ELSE 0.0 END) AS (check_name, health)"))
    g = st.rollup("check_name").agg(F.avg("health").alias("v"))
    v = rnd(F.col("v"), 1)
    return g.select(F.coalesce("check_name", F.lit("ALL")).alias("check_name"), r4(v).alias("numeric_value"),
                    _status(v, 97.0, 93.0).alias("status"))


def lob_config(spark: SparkSession, rows) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, "queue string, lob_name string, sla_target_sec int"))


def lob_thresholds(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(LOB_THRESHOLDS, "lob_name string, healthy double, warning double"))


# --------------------------------------------------------------------------- SIG-1
def agent_online_signal(status_rows: DataFrame, schedule: DataFrame, as_of: Column, window_s: int,
                        excluded=("Training", "Meeting", "Break")) -> DataFrame:
    """Routable agents / scheduled agents, total and per media; excluded states do not count as routable.
    The schedule is aggregated per media before the join (no fan-out, F15)."""
    s = status_rows.filter(since("ts", as_of, window_s) & ~F.col("agent_status").isin(*excluded))
    routable = s.groupBy("media").agg(F.countDistinct("agent_id").alias("routable"))
    sched = schedule.groupBy("media").agg(F.sum("scheduled").alias("scheduled"))
    j = sched.join(routable, "media", "left").fillna(0, ["routable"])
    tot = j.agg(pct(F.sum("routable"), F.sum("scheduled"))).scalar()
    v = rnd(pct(F.col("routable"), F.col("scheduled")), 1)
    return j.select("media", "routable", "scheduled", r4(v).alias("media_pct"), r4(rnd(tot, 1)).alias("numeric_value"),
                    _status(rnd(tot, 1), 95.0, 90.0).alias("status"))


# --------------------------------------------------------------------------- SIG-4 / SIG-9 / SIG-11
def core_systems_signal(components: DataFrame) -> DataFrame:
    """UP components / all components for each component type and overall (rollup)."""
    g = components.rollup("component_type").agg(count_if(F.col("up")).alias("up"), F.count(F.lit(1)).alias("components"))
    v = rnd(pct(F.col("up"), F.col("components")), 1)
    return g.select(F.coalesce("component_type", F.lit("ALL")).alias("component_type"), "up", "components",
                    r4(v).alias("numeric_value"), _status(v, 99.0, 97.0).alias("status"))


def connectivity_signal(paths: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Share of network paths with loss < 1 % and latency < 150 ms over the window."""
    p = paths.filter(since("ts", as_of, window_s)).groupBy("path").agg(
        pct(count_if(F.col("lost")), F.count(F.lit(1))).alias("loss"), F.avg("latency_ms").alias("lat"))
    g = p.agg(count_if((F.col("loss") < 1) & (F.col("lat") < 150)).alias("good"), F.count(F.lit(1)).alias("paths"))
    v = rnd(pct(F.col("good"), F.col("paths")), 1)
    return g.select(F.lit("Connectivity").alias("signal_name"), "good", "paths", r4(v).alias("numeric_value"),
                    _status(v, 96.0, 92.0).alias("status"))


def ivr_signal(sessions: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """IVR / self-service completed / attempted over the window."""
    s = sessions.filter(since("ts", as_of, window_s))
    g = s.agg(count_if(F.col("completed")).alias("completed"), F.count(F.lit(1)).alias("attempts"))
    v = rnd(pct(F.col("completed"), F.col("attempts")), 1)
    return g.select(F.lit("IVR / Self-Service").alias("signal_name"), "completed", "attempts", r4(v).alias("numeric_value"),
                    _status(v, 97.0, 93.0).alias("status"))


# --------------------------------------------------------------------------- SIG-6 / SIG-19
def queue_sufficiency(queues: DataFrame, shortage_pct: float = 85.0, systemic_queues: int = 3) -> DataFrame:
    """Mean of available / required over queues, and the systemic-shortage flag (> 3 queues below 85 %)."""
    q = queues.withColumn("ratio", F.try_divide(F.col("available") * 100.0, F.col("required")))
    g = q.agg(F.avg("ratio").alias("v"), count_if(F.col("ratio") < shortage_pct).alias("queues_short"),
              F.count(F.lit(1)).alias("queues"))
    v = rnd(F.col("v"), 1)
    return g.select(F.lit("Queue Sufficiency").alias("signal_name"), r4(v).alias("numeric_value"), "queues_short", "queues",
                    (F.col("queues_short") > systemic_queues).alias("systemic_shortage"), _status(v, 90.0, 80.0).alias("status"))


# --------------------------------------------------------------------------- SIG-17 / LIP-23
def voice_cause(quality: DataFrame, jitter_high: float = 20.0, loss_high: float = 1.5) -> DataFrame:
    """Jitter high with loss fine -> congestion; both high -> link or routing; loss only -> packet loss."""
    j, l = F.col("jitter_ms") > jitter_high, F.col("packet_loss_pct") > loss_high
    lab = ladder([(j & ~l, "congestion"), (j & l, "link_or_routing"), (~j & l, "packet_loss")], "none")
    return quality.withColumn("voice_cause", lab)


def disambiguate(connectivity: DataFrame, provider_indicator: Column, low_pct: float = 92.0) -> DataFrame:
    """Platform or own network (rule R14): regional vs global connectivity drop x provider status."""
    g = connectivity.agg(count_if(F.col("numeric_value") < low_pct).alias("regions_low"), F.count(F.lit(1)).alias("regions"))
    scope = ladder([(F.col("regions_low") == 0, "none"), (F.col("regions_low") < F.col("regions"), "regional")], "global")
    major = provider_indicator.isin("major", "critical")
    verdict = ladder([(scope == "none", "no_drop"), (major & (scope == "global"), "platform_outage"),
                      (major, "platform_partial"), (scope == "regional", "own_network_regional")], "own_network_global")
    return g.select("regions_low", "regions", scope.alias("drop_scope"), provider_indicator.alias("provider_indicator"),
                    verdict.alias("verdict"))
