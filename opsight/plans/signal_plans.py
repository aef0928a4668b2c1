"""Registered signal-formula queries (SIG-*) with DuckDB oracles.

Adapter choices (test data): synthetic checks and endpoint checks are event rows
(monitor = event type; healthy when not an error and 50 x value < 3000 ms; Citrix
active when not an error, ICA RTT = value, browser responsive when value < 300,
softphone registered when user_id % 7 <> 0); the provider indicator per day is the
count of error events above 300 (0 none, 1 minor, 2 major, more critical); the agent
roster is `supplier` (vendor = nation % 5, location = region); LOB per call queue.
Incident windows use days (orders are daily), event windows hours, call windows days.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import DAY, HOUR
from ..operators import signals as S
from ..sources.adapters import Model
from .enterprise_plans import CALLS_ASOF, INC_ASOF, _calls_asof, _inc_asof
from .oracle_base import ASOF, r4, rnd, with_
from .registry import model_query, query

# Fixed adapter values: call queue -> line of business and its answer target (seconds).
LOB_CONFIG = [("A", "Sales", 20), ("N", "Billing", 30), ("R", "Service", 45)]


def _since(col, asof, s):
    return f"{col} >= {asof} - to_seconds({s})"


def _st(v, h, w):
    return f"CASE WHEN {v} IS NULL THEN 'no data' WHEN {v} >= {h} THEN 'healthy' WHEN {v} >= {w} THEN 'warning' ELSE 'critical' END"


def _checks(m: Model):
    e = m.events()
    return e.select(F.col("event_type").alias("app_name"), F.col("ts").alias("check_time"),
                    ((F.col("event_type") != "error") & (F.col("value") * 50 < 3000)).cast("int").alias("is_healthy"))


CHECKS_CTE = ("checks", "SELECT event_type AS app_name, ts AS check_time, "
                        "CASE WHEN event_type <> 'error' AND value * 50 < 3000 THEN 1 ELSE 0 END AS is_healthy FROM ev")


def _roster(m: Model):
    s = m.raw("supplier")
    geo = (m.raw("nation").join(F.broadcast(m.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", F.col("r_name").alias("region")))
    return s.join(F.broadcast(geo), s.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey").alias("agent_id"), (F.col("s_nationkey") % 5).cast("int").alias("vendor_id"), "region")


ROSTER_CTE = ("roster", "SELECT s.s_suppkey AS agent_id, CAST(s.s_nationkey % 5 AS INTEGER) AS vendor_id, r.r_name AS region "
                        "FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")


# ------------------------------------------------------------------ SIG-2
INC_W, INC_CH = 4 * DAY, 10 * DAY
SIG2_SQL = with_("incidents", extra=[("o", "SELECT * FROM incidents WHERE state IN ('Open', 'In Progress', 'New', 'On Hold')"), (
    "g", f"""SELECT count(*) FILTER (WHERE {_since('opened_at', INC_ASOF, INC_W)} AND opened_at <= {INC_ASOF}) AS n,
  count(*) FILTER (WHERE {_since('opened_at', INC_ASOF, INC_W)} AND opened_at <= {INC_ASOF} AND priority = 1) AS p1,
  count(*) FILTER (WHERE {_since('opened_at', INC_ASOF, INC_W)} AND opened_at <= {INC_ASOF} AND priority = 2) AS p2,
  count(*) FILTER (WHERE {_since('opened_at', INC_ASOF, INC_W)} AND opened_at <= {INC_ASOF} AND priority = 3) AS p3,
  count(*) FILTER (WHERE {_since('opened_at', f"({INC_ASOF} - to_seconds({INC_CH}))", INC_W)}
                   AND opened_at <= {INC_ASOF} - to_seconds({INC_CH})) AS t FROM o""")]) + """
SELECT 'Incidents' AS signal_name, n AS numeric_value, p1 AS p1_count, p2 AS p2_count, p3 AS p3_count, n - t AS change,
  CASE WHEN n > 6 OR p1 >= 2 OR n - t >= 4 THEN 'critical' WHEN n >= 4 OR p1 = 1 THEN 'warning' ELSE 'healthy' END AS status FROM g"""


@model_query("sig2_incidents", SIG2_SQL)
def sig2(m):
    return S.incidents_signal(m.incidents(), _inc_asof(m), INC_W, INC_CH)


# ------------------------------------------------------------------ SIG-3
@model_query("sig3_app_health", with_("ev", extra=[CHECKS_CTE]) + f"""SELECT COALESCE(app_name, 'ALL') AS app_name,
  {r4(rnd('avg(is_healthy * 100.0)', 1))} AS numeric_value, count(*) AS checks,
  {_st(rnd('avg(is_healthy * 100.0)', 1), 97.0, 93.0)} AS status
FROM checks WHERE {_since('check_time', ASOF, 5 * HOUR)} GROUP BY ROLLUP (app_name)""")
def sig3(m):
    return S.app_health_signal(_checks(m), m.as_of(), 5 * HOUR)


# ------------------------------------------------------------------ SIG-10
PROVIDER_CTE = ("prov", """SELECT date_trunc('day', ts) AS period, CASE WHEN count(*) = 1 THEN 'minor' WHEN count(*) = 2 THEN 'major'
  ELSE 'critical' END AS indicator FROM ev WHERE event_type = 'error' AND value > 300 GROUP BY 1""")


@model_query("sig10_platform", with_("ev", extra=[CHECKS_CTE, PROVIDER_CTE]) + f"""SELECT strftime(r.period, '%Y-%m-%d %H:%M:%S') AS period,
  COALESCE(p.indicator, 'none') AS indicator, {r4('r.rate')} AS synthetic_rate,
  CAST(CASE WHEN COALESCE(p.indicator, 'none') IN ('major', 'critical') OR r.rate < 90 THEN 50.0
       WHEN COALESCE(p.indicator, 'none') = 'minor' OR r.rate < 99 THEN 95.0 ELSE 100.0 END AS DOUBLE) AS numeric_value,
  {_st("CASE WHEN COALESCE(p.indicator, 'none') IN ('major', 'critical') OR r.rate < 90 THEN 50.0 WHEN COALESCE(p.indicator, 'none') = 'minor' OR r.rate < 99 THEN 95.0 ELSE 100.0 END", 99.5, 98.0)} AS status
FROM (SELECT date_trunc('day', check_time) AS period, avg(is_healthy * 100.0) AS rate FROM checks GROUP BY 1) r
LEFT JOIN prov p USING (period)""")
def sig10(m):
    e = m.events()
    prov = (e.filter((F.col("event_type") == "error") & (F.col("value") > 300))
            .groupBy(F.date_trunc("day", "ts").alias("period")).agg(F.count(F.lit(1)).alias("n"))
            .select("period", F.when(F.col("n") == 1, "minor").when(F.col("n") == 2, "major").otherwise("critical")
                    .alias("indicator")))
    return S.platform_signal(prov, _checks(m))


# ------------------------------------------------------------------ SIG-5 / SIG-16
LOB_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{n}', {t})" for q, n, t in LOB_CONFIG) + ") t(queue, lob_name, sla_target_sec)"
LOBT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {h}, {w})" for n, h, w in S.LOB_THRESHOLDS) + ") t(lob_name, healthy, warning)"
SLA_W = 30 * DAY
PER_LOB = ("per", f"""SELECT lob_name, count(*) FILTER (WHERE wait_sec <= sla_target_sec) AS met, count(*) AS n
FROM calls JOIN lob USING (queue) WHERE {_since('call_time', CALLS_ASOF, SLA_W)} GROUP BY lob_name""")


@model_query("sig5_call_lob_sla", with_("calls", extra=[("lob", LOB_SQL), PER_LOB]) + f"""
SELECT 'Call LOB SLA' AS signal_name, {r4(rnd('sum(met) * 100.0 / NULLIF(sum(n), 0)', 1))} AS numeric_value,
  string_agg(lob_name || ':' || printf('%.1f', {rnd('met * 100.0 / NULLIF(n, 0)', 1)}), ';' ORDER BY lob_name) AS lob_breakdown,
  {_st(rnd('sum(met) * 100.0 / NULLIF(sum(n), 0)', 1), 85.0, 80.0)} AS status FROM per""")
def sig5(m):
    return S.lob_sla_signal(m.calls(), S.lob_config(m.spark, LOB_CONFIG), _calls_asof(m), SLA_W)


@query("sig16_lob_sub_signals", with_("calls", extra=[("lob", LOB_SQL), ("lt", LOBT_SQL), PER_LOB]) + f"""
SELECT 'Call LOB SLA' AS parent_signal, lob_name AS sub_name, {r4(rnd('met * 100.0 / NULLIF(n, 0)', 1))} AS numeric_value,
  CASE WHEN {rnd('met * 100.0 / NULLIF(n, 0)', 1)} >= healthy THEN 'healthy'
       WHEN {rnd('met * 100.0 / NULLIF(n, 0)', 1)} >= warning THEN 'warning' ELSE 'critical' END AS status
FROM per JOIN lt USING (lob_name)""")
def sig16(spark, sf_dir):
    m = Model(spark, sf_dir)
    return S.lob_sub_signals(m.calls(), S.lob_config(spark, LOB_CONFIG), S.lob_thresholds(spark), _calls_asof(m), SLA_W)


# ------------------------------------------------------------------ SIG-7 / SIG-8 / SIG-18
PRES_W = 7 * DAY


def _presence_sql(by, h, w):
    return with_("calls", extra=[ROSTER_CTE, ("pr", f"SELECT DISTINCT agent_id, 1 AS present FROM calls WHERE {_since('call_time', CALLS_ASOF, PRES_W)}")]) + f"""
SELECT {by}, count(*) AS scheduled, count(present) AS present, {r4(rnd('count(present) * 100.0 / count(*)', 1))} AS numeric_value,
  {_st(rnd('count(present) * 100.0 / count(*)', 1), h, w)} AS status FROM roster LEFT JOIN pr USING (agent_id) GROUP BY {by}"""


@model_query("sig7_presence_vendor", _presence_sql("vendor_id", 94.0, 90.0))
def sig7(m):
    return S.presence_signal(_roster(m), m.calls(), _calls_asof(m), PRES_W, "vendor_id", 94.0, 90.0)


@model_query("sig8_presence_location", _presence_sql("region", 93.0, 88.0))
def sig8(m):
    return S.presence_signal(_roster(m), m.calls(), _calls_asof(m), PRES_W, "region", 93.0, 88.0)


@query("sig18_localised_drop", "WITH x AS (" + _presence_sql("region", 93.0, 88.0) + """)
SELECT count(*) FILTER (WHERE numeric_value < 93.0) AS locations_low, count(*) AS locations,
  CASE WHEN count(*) FILTER (WHERE numeric_value < 93.0) = 0 THEN 'none'
       WHEN count(*) FILTER (WHERE numeric_value < 93.0) = 1 THEN 'localised' ELSE 'widespread' END AS drop_pattern FROM x""")
def sig18(spark, sf_dir):
    m = Model(spark, sf_dir)
    return S.localised_drop(S.presence_signal(_roster(m), m.calls(), _calls_asof(m), PRES_W, "region", 93.0, 88.0))


# ------------------------------------------------------------------ SIG-12 / SIG-13 / SIG-14
@model_query("sig12_call_quality", with_("calls") + f"""SELECT COALESCE(region, 'ALL') AS region, {r4(rnd('avg(mos)', 1))} AS numeric_value,
  count(*) AS calls, {r4(rnd('avg(wait_sec / 2.0)', 1))} AS avg_jitter_ms, {r4(rnd('avg(5.0 - mos)', 2))} AS avg_packet_loss_pct,
  {_st(rnd('avg(mos)', 1), 4.0, 3.5)} AS status
FROM calls WHERE {_since('call_time', CALLS_ASOF, 5 * DAY)} GROUP BY ROLLUP (region)""")
def sig12(m):
    calls = m.calls_geo().withColumn("jitter_ms", F.col("wait_sec") / 2.0).withColumn("packet_loss_pct", F.lit(5.0) - F.col("mos"))
    return S.call_quality_signal(calls, _calls_asof(m), 5 * DAY)


@model_query("sig13_network_latency", with_("ev") + f"""SELECT 'Network Latency' AS signal_name, {r4(rnd('avg(value)', 1))} AS numeric_value,
  count(*) AS samples, CASE WHEN count(value) = 0 THEN 'no data' WHEN {rnd('avg(value)', 1)} < 30 THEN 'healthy' WHEN {rnd('avg(value)', 1)} <= 80 THEN 'warning'
  ELSE 'critical' END AS status FROM ev WHERE {_since('ts', ASOF, HOUR)}""")
def sig13(m):
    return S.latency_signal(m.events().withColumnRenamed("value", "rtt_ms"), m.as_of(), HOUR)


@model_query("sig14_desktop", with_("ev", extra=[("st", f"""SELECT 'Citrix' AS check_name, CASE WHEN event_type <> 'error' AND value < 100 THEN 100.0 ELSE 0.0 END AS health
  FROM ev WHERE {_since('ts', ASOF, 2 * HOUR)}
UNION ALL SELECT 'Browser', CASE WHEN value < 300 THEN 100.0 ELSE 0.0 END FROM ev WHERE {_since('ts', ASOF, 2 * HOUR)}
UNION ALL SELECT 'Softphone', CASE WHEN user_id % 7 <> 0 THEN 100.0 ELSE 0.0 END FROM ev WHERE {_since('ts', ASOF, 2 * HOUR)}""")]) + f"""
SELECT COALESCE(check_name, 'ALL') AS check_name, {r4(rnd('avg(health)', 1))} AS numeric_value,
  {_st(rnd('avg(health)', 1), 97.0, 93.0)} AS status FROM st GROUP BY ROLLUP (check_name)""")
def sig14(m):
    e = m.events().select("ts", (F.col("event_type") != "error").alias("citrix_active"), F.col("value").alias("ica_rtt_ms"),
                          (F.col("value") < 300).alias("browser_responsive"),
                          (F.col("user_id") % 7 != 0).alias("softphone_registered"))
    return S.desktop_signal(e, m.as_of(), 2 * HOUR)


# ------------------------------------------------------------------ SIG-1 / 4 / 6 / 9 / 11 / 17 / 19, LIP-23
# Adapters: agent states from events (click/view Available, purchase/signup Interacting, error Break),
# media by user_id % 3 (voice/chat/email), scheduled per media = users seen in the last 7 days;
# components = the core systems of KPI-13 (UP unless critical); paths = region x event type;
# IVR attempts = view contacts, completed unless the customer comes back within 1 hour;
# queues = vendor x call queue (available agents / required = handle minutes / (30 x 480));
# jitter = wait / 2 ms, packet loss = 5 - MOS (= 20 x discount) %.
from ..operators import kpi as KP
from .enterprise_plans import CORE_EVAL, SYS_SQL, _ev_region, _systems

MEDIA = "CASE user_id % 3 WHEN 0 THEN 'voice' WHEN 1 THEN 'chat' ELSE 'email' END"
AGENT_STATUS = "CASE WHEN event_type IN ('click', 'view') THEN 'Available' WHEN event_type = 'error' THEN 'Break' ELSE 'Interacting' END"


@model_query("sig1_agent_online", with_("ev", extra=[
    ("r", f"""SELECT {MEDIA} AS media, count(DISTINCT user_id) AS routable FROM ev
  WHERE {_since('ts', ASOF, 2 * HOUR)} AND {AGENT_STATUS} NOT IN ('Training', 'Meeting', 'Break') GROUP BY 1"""),
    ("s", f"SELECT {MEDIA} AS media, count(DISTINCT user_id) AS scheduled FROM ev WHERE {_since('ts', ASOF, 7 * DAY)} GROUP BY 1"),
    ("j", "SELECT s.media, COALESCE(r.routable, 0) AS routable, s.scheduled FROM s LEFT JOIN r USING (media)")]) + f"""
SELECT media, routable, scheduled, {r4(rnd('routable * 100.0 / scheduled', 1))} AS media_pct,
  {r4(rnd('(SELECT sum(routable) * 100.0 / sum(scheduled) FROM j)', 1))} AS numeric_value,
  {_st(rnd('(SELECT sum(routable) * 100.0 / sum(scheduled) FROM j)', 1), 95.0, 90.0)} AS status FROM j""")
def sig1(m):
    e = m.events()
    media = F.when(F.col("user_id") % 3 == 0, "voice").when(F.col("user_id") % 3 == 1, "chat").otherwise("email")
    st = F.when(F.col("event_type").isin("click", "view"), "Available").when(F.col("event_type") == "error", "Break") \
        .otherwise("Interacting")
    rows = e.select("ts", F.col("user_id").alias("agent_id"), media.alias("media"), st.alias("agent_status"))
    a = m.as_of()
    sched = (rows.filter(F.col("ts") >= a - F.make_dt_interval(days=F.lit(7))).groupBy("media")
             .agg(F.countDistinct("agent_id").alias("scheduled")))
    return S.agent_online_signal(rows, sched, a, 2 * HOUR)


@model_query("sig4_core_systems", with_("ev", extra=[SYS_SQL, CORE_EVAL]) + f"""SELECT COALESCE(type, 'ALL') AS component_type,
  count(*) FILTER (WHERE severity <> 'critical') AS up, count(*) AS components,
  {r4(rnd("count(*) FILTER (WHERE severity <> 'critical') * 100.0 / count(*)", 1))} AS numeric_value,
  {_st(rnd("count(*) FILTER (WHERE severity <> 'critical') * 100.0 / count(*)", 1), 99.0, 97.0)} AS status
FROM core GROUP BY ROLLUP (type)""")
def sig4(m):
    ev = KP.core_system_health(_systems(m))
    return S.core_systems_signal(ev.select(F.col("type").alias("component_type"), (F.col("severity") != "critical").alias("up")))


PATHS_SQL = ("p", f"""SELECT region || '/' || event_type AS path, count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*) AS loss,
  avg(value) AS lat FROM (SELECT e.*, a.infrastructure_group AS region FROM ev e JOIN applications a ON a.application_id = e.app)
  WHERE {_since('ts', ASOF, DAY)} GROUP BY 1""")


@model_query("sig9_connectivity", with_("ev", "applications", extra=[PATHS_SQL]) + f"""SELECT 'Connectivity' AS signal_name,
  count(*) FILTER (WHERE loss < 1 AND lat < 150) AS good, count(*) AS paths,
  {r4(rnd('count(*) FILTER (WHERE loss < 1 AND lat < 150) * 100.0 / count(*)', 1))} AS numeric_value,
  {_st(rnd('count(*) FILTER (WHERE loss < 1 AND lat < 150) * 100.0 / count(*)', 1), 96.0, 92.0)} AS status FROM p""")
def sig9(m):
    p = _ev_region(m).select("ts", F.concat(F.col("region"), F.lit("/"), F.col("event_type")).alias("path"),
                             (F.col("event_type") == "error").alias("lost"), F.col("value").alias("latency_ms"))
    return S.connectivity_signal(p, m.as_of(), DAY)


@model_query("sig11_ivr", with_("contacts", extra=[("c", """SELECT *, NOT COALESCE(lead(contact_time) OVER (PARTITION BY customer_id
  ORDER BY contact_time, contact_id) <= contact_time + INTERVAL 1 HOUR, FALSE) AS completed FROM contacts""")]) + f"""
SELECT 'IVR / Self-Service' AS signal_name, count(*) FILTER (WHERE completed) AS completed, count(*) AS attempts,
  {r4(rnd('count(*) FILTER (WHERE completed) * 100.0 / count(*)', 1))} AS numeric_value,
  {_st(rnd('count(*) FILTER (WHERE completed) * 100.0 / count(*)', 1), 97.0, 93.0)} AS status
FROM c WHERE channel = 'view' AND {_since('contact_time', ASOF, 15 * HOUR)}""")
def sig11(m):
    from ..functions.core import neighbour_within
    c = neighbour_within(m.contacts(), ["customer_id"], ["contact_time", "contact_id"], HOUR, [], "next", "n_") \
        .withColumn("completed", F.col("n_contact_time").isNull())
    s = c.filter(F.col("channel") == "view").select(F.col("contact_time").alias("ts"), "completed")
    return S.ivr_signal(s, m.as_of(), 15 * HOUR)


QUEUES_SQL = ("q", f"""SELECT vendor_id, queue, count(DISTINCT agent_id) AS available, sum(duration_min) / (30 * 480.0) AS required
  FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY ALL""")


@model_query("sig6_19_queue_sufficiency", with_("calls", extra=[QUEUES_SQL]) + f"""SELECT 'Queue Sufficiency' AS signal_name,
  {r4(rnd('avg(available * 100.0 / required)', 1))} AS numeric_value,
  count(*) FILTER (WHERE available * 100.0 / required < 85.0) AS queues_short, count(*) AS queues,
  count(*) FILTER (WHERE available * 100.0 / required < 85.0) > 3 AS systemic_shortage,
  {_st(rnd('avg(available * 100.0 / required)', 1), 90.0, 80.0)} AS status FROM q""")
def sig6(m):
    c = m.calls_geo().filter(F.col("call_time") >= _calls_asof(m) - F.make_dt_interval(days=F.lit(30)))
    q = c.groupBy("vendor_id", "queue").agg(F.countDistinct("agent_id").alias("available"),
                                            (F.sum("duration_min") / (30 * 480.0)).alias("required"))
    return S.queue_sufficiency(q)


@query("sig17_voice_cause", with_("calls") + f"""SELECT CASE WHEN wait_sec / 2.0 > 20 AND NOT (l_disc > 1.5) THEN 'congestion'
  WHEN wait_sec / 2.0 > 20 AND l_disc > 1.5 THEN 'link_or_routing' WHEN l_disc > 1.5 THEN 'packet_loss' ELSE 'none' END AS voice_cause,
  count(*) AS calls FROM (SELECT *, (5.0 - mos) AS l_disc FROM calls) WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY 1""")
def sig17(spark, sf_dir):
    m = Model(spark, sf_dir)
    q = m.calls().filter(F.col("call_time") >= _calls_asof(m) - F.make_dt_interval(days=F.lit(30))).select(
        (F.col("wait_sec") / 2.0).alias("jitter_ms"), (F.lit(5.0) - F.col("mos")).alias("packet_loss_pct"))
    return S.voice_cause(q).groupBy("voice_cause").agg(F.count(F.lit(1)).alias("calls"))


PROV_LAST = ("SELECT COALESCE((SELECT CASE WHEN count(*) = 1 THEN 'minor' WHEN count(*) = 2 THEN 'major' ELSE 'critical' END "
             "FROM ev WHERE event_type = 'error' AND value > 300 AND date_trunc('day', ts) = date_trunc('day', " + ASOF + ") "
             "HAVING count(*) > 0), 'none')")


@query("lip23_disambiguate", with_("ev", "applications", extra=[("rc", f"""SELECT region, count(*) FILTER (WHERE loss < 1 AND lat < 150) * 100.0 / count(*) AS v
  FROM (SELECT region, event_type, count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*) AS loss, avg(value) AS lat
        FROM (SELECT e.*, a.infrastructure_group AS region FROM ev e JOIN applications a ON a.application_id = e.app)
        WHERE {_since('ts', ASOF, DAY)} GROUP BY ALL) GROUP BY region""")]) + f"""
SELECT count(*) FILTER (WHERE v < 92.0) AS regions_low, count(*) AS regions,
  CASE WHEN count(*) FILTER (WHERE v < 92.0) = 0 THEN 'none' WHEN count(*) FILTER (WHERE v < 92.0) < count(*) THEN 'regional'
       ELSE 'global' END AS drop_scope, ({PROV_LAST}) AS provider_indicator,
  CASE WHEN count(*) FILTER (WHERE v < 92.0) = 0 THEN 'no_drop'
       WHEN ({PROV_LAST}) IN ('major', 'critical') AND count(*) FILTER (WHERE v < 92.0) = count(*) THEN 'platform_outage'
       WHEN ({PROV_LAST}) IN ('major', 'critical') THEN 'platform_partial'
       WHEN count(*) FILTER (WHERE v < 92.0) < count(*) THEN 'own_network_regional' ELSE 'own_network_global' END AS verdict FROM rc""")
def lip23(spark, sf_dir):
    """Connectivity per region (share of good paths), provider indicator of the newest day (rule R14)."""
    m = Model(spark, sf_dir)
    a = m.as_of()
    p = _ev_region(m).filter(F.col("ts") >= a - F.make_dt_interval(days=F.lit(1)))
    per_path = p.groupBy("region", "event_type").agg(
        (F.sum((F.col("event_type") == "error").cast("long")) * 100.0 / F.count(F.lit(1))).alias("loss"),
        F.avg("value").alias("lat"))
    rc = per_path.groupBy("region").agg(
        (F.sum(((F.col("loss") < 1) & (F.col("lat") < 150)).cast("long")) * 100.0 / F.count(F.lit(1))).alias("numeric_value"))
    e = m.events()
    n = e.filter((F.col("event_type") == "error") & (F.col("value") > 300) & (F.date_trunc("day", "ts") == F.date_trunc("day", a))) \
        .agg(F.count(F.lit(1))).scalar()
    ind = F.when(n == 0, "none").when(n == 1, "minor").when(n == 2, "major").otherwise("critical")
    return S.disambiguate(rc, ind)


# ------------------------------------------------------------------ SIG-16, all families
# Monitored applications (adapter): CRM = click checks, WFM = view, Reporting = purchase; the other monitors have no thresholds.
APP_NAMES = {"click": "CRM", "view": "WFM", "purchase": "Reporting"}


def _subs_sql() -> str:
    from .registry import ORACLES as O

    def st(v, h, w, low=False):
        rule = f"WHEN {v} < {h} THEN 'healthy' WHEN {v} <= {w} THEN 'warning'" if low else f"WHEN {v} >= {h} THEN 'healthy' WHEN {v} >= {w} THEN 'warning'"
        return f"CASE WHEN {h} IS NULL THEN 'unconfigured' WHEN {v} IS NULL THEN 'no data' {rule} ELSE 'critical' END"

    app = "CASE app_name WHEN 'click' THEN 'CRM' WHEN 'view' THEN 'WFM' WHEN 'purchase' THEN 'Reporting' ELSE app_name END"
    app_h = "CASE app_name WHEN 'click' THEN 98.0 WHEN 'view' THEN 95.0 WHEN 'purchase' THEN 90.0 END"
    app_w = "CASE app_name WHEN 'click' THEN 95.0 WHEN 'view' THEN 90.0 WHEN 'purchase' THEN 80.0 END"
    med_h = "CASE media WHEN 'voice' THEN 95.0 WHEN 'chat' THEN 93.0 ELSE 90.0 END"
    med_w = "CASE media WHEN 'voice' THEN 90.0 WHEN 'chat' THEN 88.0 ELSE 85.0 END"
    lob_h = "CASE sub_name WHEN 'Service' THEN 82.0 WHEN 'Retention' THEN 92.0 ELSE 85.0 END"
    parts = [
        f"SELECT 'Agent Online' AS parent_signal, media AS sub_name, media_pct AS numeric_value, {st('media_pct', med_h, med_w)} AS status, {med_h} AS threshold FROM ({O['sig1_agent_online']})",
        f"SELECT 'App Health', {app}, numeric_value, {st('numeric_value', app_h, app_w)}, {app_h} FROM ({O['sig3_app_health']}) WHERE app_name <> 'ALL'",
        f"SELECT parent_signal, sub_name, numeric_value, status, {lob_h} FROM ({O['sig16_lob_sub_signals']})",
        f"SELECT 'Call Quality', 'Jitter', avg_jitter_ms, {st('avg_jitter_ms', 10.0, 20.0, True)}, 10.0 FROM ({O['sig12_call_quality']}) WHERE region = 'ALL'",
        f"SELECT 'Call Quality', 'Packet Loss', avg_packet_loss_pct, {st('avg_packet_loss_pct', 0.5, 1.5, True)}, 0.5 FROM ({O['sig12_call_quality']}) WHERE region = 'ALL'",
        *[f"SELECT 'Incidents', '{n}', CAST({c} AS DOUBLE), CASE WHEN {c} > 0 THEN '{s}' ELSE 'healthy' END, 1.0 FROM ({O['sig2_incidents']})"
          for c, n, s in (("p1_count", "P1 Critical", "critical"), ("p2_count", "P2 High", "warning"), ("p3_count", "P3 Medium", "healthy"))]]
    return "SELECT parent_signal, sub_name, " + r4("numeric_value") + " AS numeric_value, status, CAST(threshold AS DOUBLE) AS threshold FROM (" + "\nUNION ALL ".join(parts) + ")"


@model_query("sig16_sub_signals", _subs_sql())
def sub_signals(m):
    """Sub-signals of the five families, each with its own thresholds."""
    q = sig12(m).filter(F.col("region") == "ALL")
    names = F.create_map(*[F.lit(x) for kv in APP_NAMES.items() for x in kv])
    families = {
        "Agent Online": sig1(m).select(F.col("media").alias("sub_name"), F.col("media_pct").alias("numeric_value")),
        "App Health": sig3(m).filter(F.col("app_name") != "ALL").select(F.coalesce(names[F.col("app_name")], "app_name").alias("sub_name"), "numeric_value"),
        "Call LOB SLA": S.lob_sub_signals(m.calls(), S.lob_config(m.spark, LOB_CONFIG), S.lob_thresholds(m.spark), _calls_asof(m), SLA_W).select("sub_name", "numeric_value"),
        "Call Quality": q.select(F.explode(F.array(F.struct(F.lit("Jitter").alias("sub_name"), F.col("avg_jitter_ms").alias("numeric_value")),
                                                   F.struct(F.lit("Packet Loss").alias("sub_name"), F.col("avg_packet_loss_pct").alias("numeric_value")))).alias("x")).select("x.*")}
    return S.sub_signal_snapshots(m.spark, families, sig2(m))
