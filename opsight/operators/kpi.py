"""KPI and scorecard roll-ups shown on the dashboards (KPI-1..21).

Inputs are the calls and incidents model tables; periods are relative to an
`as_of` Column. Period comparisons use conditional aggregation in one pass
(one flag per period) instead of joining calls to a period table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import DAY, count_if, elapsed_text, ladder, mmss, pct, r4, rnd, since, ts_text

POOR_MOS = 3.5
AHT_TARGET_MIN = 5.0
SERVICE_LEVEL_SEC = 30


def vendor_scorecard(calls: DataFrame, unit: str = "month") -> DataFrame:
    """KPI-1: per vendor and period: agents, share of agents impacted (any poor call), calls,
    disconnected (queue R), degraded (MOS < 3.5), and the change of the impacted share vs the previous period."""
    c = calls.withColumn("period", F.date_trunc(unit, "call_time"))
    per_agent = c.groupBy("vendor_id", "period", "agent_id").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("queue") == "R").alias("disc"),
        count_if(F.col("mos") < POOR_MOS).alias("deg"))
    g = per_agent.groupBy("vendor_id", "period").agg(
        F.count(F.lit(1)).alias("agents"), count_if(F.col("deg") > 0).alias("agents_impacted"),
        F.sum("n").alias("calls"), F.sum("disc").alias("disconnected"), F.sum("deg").alias("degraded"))
    g = g.withColumn("impacted_pct", pct(F.col("agents_impacted"), F.col("agents")))
    w = Window.partitionBy("vendor_id").orderBy("period")
    return g.select("vendor_id", ts_text("period").alias("period"), "agents", "agents_impacted",
                    F.col("calls").cast("long").alias("calls"), F.col("disconnected").cast("long").alias("disconnected"),
                    F.col("degraded").cast("long").alias("degraded"), r4("impacted_pct").alias("impacted_pct"),
                    r4(F.col("impacted_pct") - F.lag("impacted_pct").over(w)).alias("impacted_pct_change"))


PERIODS = ["today", "yesterday", "last_7_days", "last_30_days", "month_to_date", "quarter_to_date", "year_to_date"]


def _bounds(as_of: Column, name: str):
    d0 = F.date_trunc("day", as_of)
    one = F.make_dt_interval(days=F.lit(1))
    if name == "today":
        return d0, d0 + one
    if name == "yesterday":
        return d0 - one, d0
    if name == "last_7_days":
        return d0 - F.make_dt_interval(days=F.lit(6)), d0 + one
    if name == "last_30_days":
        return d0 - F.make_dt_interval(days=F.lit(29)), d0 + one
    unit = {"month_to_date": "month", "quarter_to_date": "quarter", "year_to_date": "year"}[name]
    return F.date_trunc(unit, as_of), d0 + one


def period_compare(calls: DataFrame, as_of: Column, periods=PERIODS) -> DataFrame:
    """KPI-2 / KPI-3: calls in each named period and in the previous period of equal length,
    with % change and arrow class. One scan: a conditional count per period and side."""
    aggs = []
    for p in periods:
        s, e = _bounds(as_of, p)
        ln = e - s
        t = F.col("call_time")
        aggs += [count_if((t >= s) & (t < e)).alias(f"{p}__cur"), count_if((t >= s - ln) & (t < s)).alias(f"{p}__prev")]
    one = calls.agg(*aggs)
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), F.col(f"{p}__cur").alias("calls"), F.col(f"{p}__prev").alias("previous_calls"))
        for p in periods])).alias("x")).select("x.*")
    chg = pct(F.col("calls") - F.col("previous_calls"), F.col("previous_calls"))
    return stacked.select("period", "calls", "previous_calls", r4(chg).alias("pct_change"),
                          ladder([(chg > 0, "up"), (chg < 0, "down")], "flat").alias("arrow"))


def daily_change(calls: DataFrame) -> DataFrame:
    """KPI-3: daily calls with day-over-day, week-over-week and month-over-month % change."""
    d = calls.groupBy(F.to_date("call_time").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    prev = d.select(F.col("day").alias("pday"), F.col("calls").alias("pc"))

    def chg(lag_days: int, name: str, df):
        j = df.join(prev, F.date_add(F.col("pday"), lag_days) == F.col("day"), "left")
        return j.withColumn(name, r4(pct(F.col("calls") - F.col("pc"), F.col("pc")))).drop("pday", "pc")

    out = chg(1, "dod_pct", d)
    out = chg(7, "wow_pct", out)
    out = chg(28, "mom_pct", out)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", "dod_pct", "wow_pct", "mom_pct",
                      ladder([(F.col("dod_pct") > 0, "up"), (F.col("dod_pct") < 0, "down")], "flat").alias("arrow"))


def impacted_series(calls: DataFrame) -> DataFrame:
    """KPI-4: per day, agents impacted % and call issues by type (pivot)."""
    c = calls.withColumn("day", F.to_date("call_time")).withColumn(
        "issue", ladder([(F.col("queue") == "R", "disconnected"), (F.col("mos") < POOR_MOS, "degraded")], "ok"))
    issues = c.groupBy("day").pivot("issue", ["disconnected", "degraded", "ok"]).agg(F.count(F.lit(1))).fillna(0)
    ag = (c.groupBy("day", "agent_id").agg(count_if(F.col("issue") != "ok").alias("bad"))
          .groupBy("day").agg(F.count(F.lit(1)).alias("agents"), count_if(F.col("bad") > 0).alias("impacted")))
    return ag.join(issues, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "agents", "impacted",
                                         r4(pct(F.col("impacted"), F.col("agents"))).alias("impacted_pct"),
                                         F.col("disconnected").cast("long").alias("disconnected"),
                                         F.col("degraded").cast("long").alias("degraded"))


def impacted_alert(calls: DataFrame, as_of: Column, window_s: int = DAY) -> DataFrame:
    """KPI-5: 'n of N agents impacted (x %)' over the last window (F24: computed, not quoted)."""
    c = calls.filter(since("call_time", as_of, window_s))
    a = c.groupBy("agent_id").agg(count_if((F.col("queue") == "R") | (F.col("mos") < POOR_MOS)).alias("bad"))
    g = a.agg(count_if(F.col("bad") > 0).alias("impacted"), F.count(F.lit(1)).alias("agents"))
    p = pct(F.col("impacted"), F.col("agents"))
    return g.select("impacted", "agents", r4(p).alias("impacted_pct"),
                    F.concat(F.col("impacted").cast("string"), F.lit(" of "), F.col("agents").cast("string"),
                             F.lit(" agents impacted ("), F.format_string("%.1f", rnd(p, 1)), F.lit("%)")).alias("message"))


def vendor_table(calls: DataFrame, as_of: Column, window_s: int = 30 * DAY,
                 active_mos: float = 4.0, warning_mos: float = 3.6) -> DataFrame:
    """KPI-7 / KPI-10: per vendor agents, calls, mean quality, score, status (cut-offs are parameters)."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.groupBy("vendor_id").agg(F.countDistinct("agent_id").alias("agents"), F.count(F.lit(1)).alias("calls"),
                                   F.avg("mos").alias("quality"))
    return g.select("vendor_id", "agents", "calls", r4("quality").alias("quality"),
                    r4(F.col("quality") / 5.0 * 100).alias("score"),
                    ladder([(r4("quality") >= active_mos, "Active"), (r4("quality") >= warning_mos, "Warning")],
                           "Critical").alias("vendor_status"))


def call_metrics(calls: DataFrame, as_of: Column, window_s: int = 30 * DAY) -> DataFrame:
    """KPI-8: total, errored (disconnected), degraded calls and AHT against the 5:00 target."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.agg(F.count(F.lit(1)).alias("total_calls"), count_if(F.col("queue") == "R").alias("errored_calls"),
              count_if(F.col("mos") < POOR_MOS).alias("degraded_calls"), F.avg("duration_min").alias("aht_min"))
    return g.select("total_calls", "errored_calls", "degraded_calls", r4("aht_min").alias("aht_min"),
                    mmss(F.col("aht_min") * 60).alias("aht_text"),
                    F.when(F.col("aht_min") <= AHT_TARGET_MIN, "on_target").otherwise("above_target").alias("aht_status"))


def top_agents(calls: DataFrame, as_of: Column, window_s: int = 30 * DAY, top: int = 5) -> DataFrame:
    """KPI-11: the top agents by mean quality, then calls (a top-k report)."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.groupBy("agent_id").agg(F.avg("mos").alias("quality"), F.count(F.lit(1)).alias("calls"))
    w = Window.orderBy(F.col("quality").desc(), F.col("calls").desc(), F.col("agent_id"))
    return (g.orderBy(F.col("quality").desc(), F.col("calls").desc(), F.col("agent_id")).limit(top)
            .withColumn("rank", F.row_number().over(w))
            .select("rank", "agent_id", r4("quality").alias("quality"), "calls"))


def incident_resolution(incidents: DataFrame) -> DataFrame:
    """KPI-9: per priority: count, open, resolved, resolved share."""
    g = incidents.groupBy("priority").agg(F.count(F.lit(1)).alias("incidents"),
                                          count_if(F.col("state") != "Resolved").alias("open_incidents"),
                                          count_if(F.col("state") == "Resolved").alias("resolved"))
    return g.withColumn("resolved_pct", r4(pct(F.col("resolved"), F.col("incidents"))))


def issue_list(incidents: DataFrame, as_of: Column, top: int = 6) -> DataFrame:
    """KPI-16: open P1/P2 counts and the top open issues by severity, then newest, with elapsed time."""
    o = incidents.filter((F.col("state") != "Resolved") & (F.col("opened_at") <= as_of))
    w = Window.orderBy(F.col("priority"), F.col("opened_at").desc(), F.col("incident_id"))
    mins = (F.unix_timestamp(as_of) - F.unix_timestamp("opened_at")) / 60
    return (o.orderBy(F.col("priority"), F.col("opened_at").desc(), F.col("incident_id")).limit(top)
            .withColumn("rank", F.row_number().over(w))
            .select("rank", "incident_id", F.concat(F.lit("P"), F.col("priority").cast("string")).alias("severity"),
                    "state", ts_text("opened_at").alias("opened_at"), elapsed_text(mins).alias("elapsed")))


def call_centre(calls: DataFrame, as_of: Column, window_s: int = DAY, green: float = 90.0, amber: float = 80.0) -> DataFrame:
    """KPI-17: calls per hour, AHT, service level (wait <= 30 s), abandon %, mean wait, bands 90/80."""
    c = calls.filter(since("call_time", as_of, window_s))
    g = c.agg(F.count(F.lit(1)).alias("calls"), F.avg("duration_min").alias("aht_min"),
              count_if(F.col("wait_sec") <= SERVICE_LEVEL_SEC).alias("in_sl"),
              count_if(F.col("line_status") == "O").alias("abandoned"), F.avg("wait_sec").alias("avg_wait"))
    sl = pct(F.col("in_sl"), F.col("calls"))
    return g.select("calls", r4(F.col("calls") / (window_s / 3600.0)).alias("calls_per_hour"),
                    r4("aht_min").alias("aht_min"), r4(sl).alias("service_level_pct"),
                    r4(pct(F.col("abandoned"), F.col("calls"))).alias("abandon_pct"), r4("avg_wait").alias("avg_wait_sec"),
                    ladder([(sl >= green, "green"), (sl >= amber, "amber")], "red").alias("service_level_band"))


def overall_status(component_scores: DataFrame, score: str = "score", status: str = "status") -> DataFrame:
    """KPI-14: overall = floor(mean score); status escalates to the worst component status."""
    order = ladder([(F.col(status) == "critical", 3), (F.col(status) == "warning", 2)], 1)
    g = component_scores.agg(F.floor(F.avg(score)).cast("long").alias("overall_score"), F.max(order).alias("_w"))
    return g.select("overall_score", ladder([(F.col("_w") == 3, "critical"), (F.col("_w") == 2, "warning")],
                                            "healthy").alias("overall_status"))


# --------------------------------------------------------------------------- KPI-13 / KPI-14
def core_system_health(systems: DataFrame) -> DataFrame:
    """Rules per system type (IVR, Genesys, DB, API, generic) -> computed health, severity, note.

    systems: (name, type, apps_count, error_rate, services_down, replication_lag, health)."""
    t, apps, er = F.col("type"), F.col("apps_count"), F.col("error_rate")
    down, lag, h = F.col("services_down"), F.col("replication_lag"), F.col("health")
    tol = F.when(apps > 4, 2.5).when(apps > 2, 4.0).otherwise(6.0)
    health = ladder([
        (t == "IVR", F.greatest(F.lit(20.0), rnd(100 - er * 6, 0))),
        (t == "Genesys", F.when(down > 0, 60.0).otherwise(98.0)),
        (t == "DB", F.greatest(F.lit(30.0), rnd(100 - lag / 300.0 * 40, 0))),
        (t == "API", F.greatest(F.lit(25.0), rnd(100 - er * 7 - (apps - 1) * 2, 0)))], h.cast("double"))
    sev = ladder([
        (t == "IVR", ladder([(er > tol * 2, "critical"), (er > tol, "warning")], "good")),
        (t == "Genesys", F.when(down > 0, "critical").otherwise("good")),
        (t == "DB", ladder([(lag > 180, "critical"), (lag > 60, "warning")], "good")),
        (t == "API", ladder([(er > 5, "critical"), (er > 3, "warning")], "good"))],
        ladder([(h >= 95, "good"), (h >= 88, "warning")], "critical"))
    note = ladder([
        (t == "IVR", F.concat(F.lit("errors "), er.cast("string"), F.lit("% (tolerated "),
                              F.when(apps > 4, "2.5").when(apps > 2, "4").otherwise("6"), F.lit("%)"))),
        (t == "Genesys", F.when(down > 0, F.concat(down.cast("string"), F.lit(" services down"))).otherwise("all services up")),
        (t == "DB", F.concat(F.lit("lag "), lag.cast("string"), F.lit("s"))),
        (t == "API", F.concat(apps.cast("string"), F.lit(" apps · errors "), er.cast("string"), F.lit("%")))],
        F.concat(F.lit("health "), h.cast("string"), F.lit("%")))
    return systems.select("name", "type", health.cast("long").alias("computed_health"), sev.alias("severity"), note.alias("note"))


def core_overall(evaluated: DataFrame) -> DataFrame:
    """KPI-14: floor of the mean computed health; escalate to critical / warning if any system is."""
    w = ladder([(F.col("severity") == "critical", 3), (F.col("severity") == "warning", 2)], 1)
    g = evaluated.agg(F.floor(F.avg("computed_health")).cast("long").alias("overall_health"), F.max(w).alias("_w"),
                      F.count(F.lit(1)).alias("systems"))
    return g.select("overall_health", "systems",
                    ladder([(F.col("_w") == 3, "critical"), (F.col("_w") == 2, "warning")], "good").alias("overall_status"))


# --------------------------------------------------------------------------- KPI-6 / KPI-12 / KPI-15
QUALITY_BUCKETS = [(3.5, "below_3.5"), (4.0, "3.5_to_4.0"), (4.5, "4.0_to_4.5")]


def _bucket(q: Column) -> Column:
    return ladder([(q < lim, name) for lim, name in QUALITY_BUCKETS], "4.5_and_above")


def agent_distribution(calls: DataFrame, as_of: Column) -> DataFrame:
    """Agents per mean-quality bucket: today, yesterday, and the daily average over the last 7 days."""
    d0 = F.date_trunc("day", as_of)
    c = calls.filter((F.col("call_time") >= d0 - F.make_dt_interval(days=F.lit(6))) & (F.col("call_time") <= as_of))
    per = c.groupBy(F.date_trunc("day", "call_time").alias("day"), "agent_id").agg(F.avg("mos").alias("q"))
    per = per.withColumn("bucket", _bucket(F.col("q")))
    g = per.groupBy("bucket").agg(count_if(F.col("day") == d0).alias("today"),
                                  count_if(F.col("day") == d0 - F.make_dt_interval(days=F.lit(1))).alias("yesterday"),
                                  (F.count(F.lit(1)) / 7.0).alias("week_avg"))
    return g.select("bucket", "today", "yesterday", r4("week_avg").alias("week_avg"))


def network_tiles(samples: DataFrame, as_of: Column, capacity_per_hour: float, window_s: int = DAY,
                  baseline_s: int = 30 * DAY) -> DataFrame:
    """Utilisation (peak hourly volume / capacity), mean latency vs its 30-day average, the peak hour."""
    h = (samples.filter(since("ts", as_of, baseline_s))
         .groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("lat")))
    cur = h.filter(F.col("hour") >= F.date_trunc("hour", as_of - F.make_dt_interval(secs=F.lit(float(window_s)))))
    base = h.agg(F.avg("lat")).scalar()
    g = cur.agg(F.avg("lat").alias("mean_latency"), F.max("n").alias("peak_volume"),
                F.max_by("hour", F.struct("n", "hour")).alias("peak_hour"))
    return g.select(r4("mean_latency").alias("mean_latency_ms"), r4(base).alias("avg_latency_30d_ms"),
                    r4(pct(F.col("mean_latency") - base, base)).alias("latency_vs_avg_pct"), "peak_volume",
                    r4(F.col("peak_volume") * 100.0 / capacity_per_hour).alias("peak_utilisation_pct"),
                    ts_text("peak_hour").alias("peak_hour"))


def workforce_readiness(calls: DataFrame, lob_of: Column, as_of: Column, active_s: int = 7 * DAY,
                        pool_s: int = 30 * DAY) -> DataFrame:
    """Per LOB: agents active in the last week / agents of the LOB's 30-day pool, bands 90 / 80."""
    c = calls.filter(since("call_time", as_of, pool_s)).withColumn("lob", lob_of)
    a = c.groupBy("lob", "agent_id").agg(F.max("call_time").alias("last"))
    act = since("last", as_of, active_s)
    g = a.rollup("lob").agg(count_if(act).alias("ready"), F.count(F.lit(1)).alias("pool"))
    r = pct(F.col("ready"), F.col("pool"))
    return g.select(F.coalesce("lob", F.lit("ALL")).alias("lob"), "ready", "pool", r4(r).alias("readiness_pct"),
                    ladder([(r >= 90, "good"), (r >= 80, "warning")], "critical").alias("status"))


# --------------------------------------------------------------------------- KPI-18 / KPI-19 / KPI-21
def silo_impact(events: DataFrame, as_of: Column, window_s: int = DAY) -> DataFrame:
    """Events and servers affected by silo x category in the window, with a severity."""
    e = events.filter(since("ts", as_of, window_s))
    g = e.groupBy("silo", "category").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("server").alias("servers"))
    return g.withColumn("severity", ladder([(F.col("servers") >= 10, "critical"), (F.col("servers") >= 3, "warning")], "info"))


def events_vs_average(events: DataFrame, as_of: Column) -> DataFrame:
    """Events per class today against the class's daily average of the earlier days ('up 85 % from avg')."""
    d0 = F.date_trunc("day", as_of)
    per = events.groupBy("category", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"),
                                                                               F.countDistinct("server").alias("servers"))
    g = per.groupBy("category").agg(F.sum(F.when(F.col("day") == d0, F.col("n"))).alias("today"),
                                    F.avg(F.when(F.col("day") < d0, F.col("n"))).alias("daily_avg"),
                                    F.sum(F.when(F.col("day") == d0, F.col("servers"))).alias("servers_today"))
    chg = pct(F.col("today") - F.col("daily_avg"), F.col("daily_avg"))
    return g.select("category", F.coalesce("today", F.lit(0)).cast("long").alias("today"), r4("daily_avg").alias("daily_avg"),
                    F.coalesce("servers_today", F.lit(0)).cast("long").alias("servers_today"), r4(chg).alias("change_pct"),
                    F.concat(F.when(chg >= 0, "↑ ").otherwise("↓ "), F.abs(rnd(chg, 0)).cast("long").cast("string"),
                             F.lit(" % from avg")).alias("label"))


def platform_tiles(events: DataFrame, as_of: Column, window_s: int = DAY) -> DataFrame:
    """Sessions, success %, error rate %, failed logins and active users over the window."""
    e = events.filter(since("ts", as_of, window_s))
    g = e.agg(F.count(F.lit(1)).alias("sessions"), count_if(F.col("event_type") != "error").alias("ok"),
              count_if(F.col("event_type") == "error").alias("errors"),
              count_if((F.col("event_type") == "error") & (F.col("value") > 300)).alias("failed_logins"),
              F.countDistinct("user_id").alias("active_users"))
    return g.select("sessions", r4(pct(F.col("ok"), F.col("sessions"))).alias("success_pct"),
                    r4(pct(F.col("errors"), F.col("sessions"))).alias("error_rate_pct"), "failed_logins", "active_users")


# --------------------------------------------------------------------------- KPI-20
def root_cause(events: DataFrame, as_of: Column, window_s: int = DAY) -> DataFrame:
    """Per event id: events, servers hit, priority by servers, and the silo holding the largest share."""
    e = events.filter(since("ts", as_of, window_s))
    per = e.groupBy("event_code", "silo").agg(F.count(F.lit(1)).alias("n"))
    tot = e.groupBy("event_code").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("server").alias("servers"))
    top = per.groupBy("event_code").agg(F.max_by(F.struct("n", "silo"), F.struct("n", "silo")).alias("t"))
    j = tot.join(top, "event_code")
    return j.select("event_code", "events", "servers",
                    ladder([(F.col("servers") >= 10, "P1"), (F.col("servers") >= 5, "P2")], "P3").alias("priority"),
                    F.col("t.silo").alias("top_silo"), r4(F.col("t.n") * 100.0 / F.col("events")).alias("top_silo_share_pct"))
