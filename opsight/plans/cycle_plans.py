"""The leading-indicator cycle on the results of SIG-1..14 (not on values made from `events`)."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import HOUR, r4, rnd, ts_text
from ..operators import cycle as C
from ..operators import leading as L
from ..sources.adapters import Model
from ..streaming.streams import scratch
from . import signal_plans as P
from ..sources import sinks as K
from .leading_plans import U, _Ctx, _alert_parts, _pre_outage, _values, cycle_insights
from .oracle_base import ASOF, r4 as sr4, rnd as srnd, tstext
from .registry import ORACLES, query

CYCLES = 3


def _only(plan, column, value):
    return lambda m: plan(m).filter(F.col(column) == value)


def _mean(plan):
    """The mean over the groups (vendors, locations) as the signal's value."""
    return lambda m: plan(m).agg(rnd(F.avg("numeric_value"), 1).alias("numeric_value"))


def _newest(plan):
    def run(m):
        rows = plan(m)
        return rows.agg(F.max_by("numeric_value", "period").alias("numeric_value"))

    return run


SIGNAL_PLANS = {
    "Agent Online": P.sig1, "Incidents": P.sig2, "App Health": _only(P.sig3, "app_name", "ALL"),
    "Core Systems": _only(P.sig4, "component_type", "ALL"), "Call LOB SLA": P.sig5, "Queue Sufficiency": P.sig6,
    "Presence—Vendor": _mean(P.sig7), "Presence—Location": _mean(P.sig8), "Connectivity": P.sig9,
    "Genesys Platform": _newest(P.sig10), "IVR / Self-Service": P.sig11, "Call Quality": _only(P.sig12, "region", "ALL"),
    "Network Latency": P.sig13, "Desktop / Endpoint": _only(P.sig14, "check_name", "ALL"),
}


def signal_config(spark):
    return L._const(spark, L.SIGNAL_CONFIG, "signal_name string, healthy_threshold double, warning_threshold double, "
                                            "critical_threshold double, is_inverted boolean")


def run_signal_cycles(spark, sf_dir, cycles: int = CYCLES) -> C.SnapshotTable:
    """The last `cycles` cycles, oldest first, each appended to a new snapshot table as its job would."""
    m = Model(spark, sf_dir)
    table = C.SnapshotTable(spark, scratch(spark, "signal-snapshots"))
    config = signal_config(spark)
    for n in range(cycles):
        steps = cycles - 1 - n
        at = m.as_of() - F.make_dt_interval(secs=F.lit(float(steps * HOUR)))
        table.append(n, C.signal_rows(SIGNAL_PLANS, m.back(steps), at), config, n - 1 if n else None)
    return table


# ------------------------------------------------------------------ oracle: the signals' own statements over shortened tables
_PICK = {
    "sig1_agent_online": "max(numeric_value)", "sig2_incidents": "max(numeric_value)", "sig3_app_health": "max(numeric_value) FILTER (WHERE app_name = 'ALL')",
    "sig4_core_systems": "max(numeric_value) FILTER (WHERE component_type = 'ALL')", "sig5_call_lob_sla": "max(numeric_value)",
    "sig6_19_queue_sufficiency": "max(numeric_value)", "sig7_presence_vendor": srnd("avg(numeric_value)", 1),
    "sig8_presence_location": srnd("avg(numeric_value)", 1), "sig9_connectivity": "max(numeric_value)",
    "sig10_platform": "arg_max(numeric_value, period)", "sig11_ivr": "max(numeric_value)",
    "sig12_call_quality": "max(numeric_value) FILTER (WHERE region = 'ALL')", "sig13_network_latency": "max(numeric_value)",
    "sig14_desktop": "max(numeric_value) FILTER (WHERE check_name = 'ALL')",
}


def _back(sql: str, steps: int) -> str:
    """The statement with every read of a time-stamped table cut off `steps` cycles before its newest row."""
    for table, column, unit in (("events", "ts", "HOUR"), ("lineitem", "l_shipdate", "DAY"), ("orders", "o_orderdate", "DAY")):
        cut = (f"(SELECT * FROM @{table} WHERE CAST({column} AS TIMESTAMP) <= "
               f"(SELECT max(CAST({column} AS TIMESTAMP)) FROM @{table}) - INTERVAL {steps} {unit})")
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", lambda m: f"{m[1]} {cut}", sql).replace(f"@{table}", table)
    return sql


def cycle_ctes(cycles: int = CYCLES) -> str:
    parts = []
    for n in range(cycles):
        steps = cycles - 1 - n
        for name, key in zip(SIGNAL_PLANS, _PICK):
            parts.append(f"SELECT {n} AS cycle, '{name}' AS signal_name, CAST({_PICK[key]} AS DOUBLE) AS numeric_value, "
                         f"{ASOF} - INTERVAL {steps} HOUR AS snapshot_time FROM ({_back(ORACLES[key], steps)})")
    cfg = _values(L.SIGNAL_CONFIG, ["VARCHAR", "DOUBLE", "DOUBLE", "DOUBLE", "BOOLEAN"])
    return "WITH vals AS (" + "\nUNION ALL ".join(parts) + f"""),
cfg AS (SELECT * FROM {cfg} t(signal_name, healthy_threshold, warning_threshold, critical_threshold, is_inverted)),
scored AS (SELECT v.*, c.healthy_threshold, c.warning_threshold, c.critical_threshold, c.is_inverted, CASE WHEN numeric_value IS NULL THEN 'no data'
    WHEN is_inverted THEN CASE WHEN numeric_value <= healthy_threshold THEN 'healthy' WHEN numeric_value <= warning_threshold THEN 'warning' ELSE 'critical' END
    WHEN numeric_value >= healthy_threshold THEN 'healthy' WHEN numeric_value >= warning_threshold THEN 'warning' ELSE 'critical' END AS status
  FROM vals v JOIN cfg c USING (signal_name)),
moved AS (SELECT *, round(numeric_value - lag(numeric_value) OVER (PARTITION BY signal_name ORDER BY cycle), 9) AS d,
    lag(status) OVER (PARTITION BY signal_name ORDER BY cycle) AS prev_status FROM scored)
"""


@query("lip_cycle_signals", cycle_ctes() + f"""SELECT cycle, signal_name, {sr4('numeric_value')} AS numeric_value, status, {tstext('snapshot_time')} AS snapshot_time,
  CASE WHEN d IS NULL THEN NULL WHEN d >= 0 THEN '+' || printf('%.1f', {srnd('d', 1)}) ELSE printf('%.1f', {srnd('d', 1)}) END AS trend,
  CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END AS direction FROM moved""")
def lip_cycle_signals(spark, sf_dir):
    """Snapshots of the last three cycles, fourteen rows each, appended one cycle at a time."""
    snap = run_signal_cycles(spark, sf_dir).read()
    return snap.select("cycle", "signal_name", r4("numeric_value").alias("numeric_value"), "status",
                       ts_text("snapshot_time").alias("snapshot_time"), "trend", "direction")


class SignalContext(_Ctx):
    """The inputs of a cycle's stages from an appended snapshot table, with the stated thresholds."""

    def __init__(self, spark, model: Model, table: C.SnapshotTable):
        self.spark, self.m = spark, model
        rows = table.read().drop("cycle")
        self.cfg = signal_config(spark)
        order = Window.partitionBy("signal_name").orderBy("snapshot_time")
        self.snap = rows.select("signal_name", "numeric_value", "snapshot_time")
        self.trended = rows.withColumn("prev_status", F.lag("status").over(order)).join(self.cfg, "signal_name", "left")
        self.scored = self.trended
        self.as_of = rows.agg(F.max("snapshot_time")).scalar()
        self.latest = self.trended.filter(F.col("snapshot_time") == self.as_of)
        self.dmap, self.rules = L.domain_map(spark), L.correlation_rules(spark)


def signal_cycle(spark, sf_dir, cycles: int = CYCLES):
    """One whole leading-indicator cycle on SIG-1..14: the signals, their scores and all stages after them, by name."""
    m = Model(spark, sf_dir)
    c = SignalContext(spark, m, run_signal_cycles(spark, sf_dir, cycles))
    active, doms = c.active(), L.domain_scores(c.latest, c.dmap)
    ent = L.enterprise_score(doms)
    recovered = c.latest.withColumn("recovered", (F.col("status") == "healthy") & F.col("prev_status").isin("warning", "critical"))
    level = L.alert_level(c.latest, ent, L.sustained_decline(c.snap, c.as_of, unit_s=U, periods=5, pct_per_unit=2.0), active, recovered)
    prob = L.outage_probability(c.latest, active, L.best_pattern(_pre_outage(c, top=1)))
    found = cycle_insights(c, P.sig2(m), P.sub_signals(m)).withColumn("created_at", c.as_of)
    parts = c.latest.select("signal_name", r4("numeric_value").alias("numeric_value"), "status", "trend", "direction")
    return {"signals": c.latest, "domain_scores": doms, "enterprise_score": ent, "correlations": active, "new_alerts": _alert_parts(c)[1], "alert_level": level,
            "eta": L.eta(c.snap, c.cfg, c.as_of, window_s=15 * U, per_s=U, max_eta=60), "outage_probability": prob, "insights": found,
            "document": K.serving_document(parts, doms, prob, K.newest_insights(found), c.as_of)}


@query("lip_cycle_domains", cycle_ctes() + f""", dmap AS (SELECT * FROM {_values(L.DOMAIN_MAP, ['VARCHAR', 'VARCHAR'])} t(signal_name, domain_key))
SELECT domain_key, {srnd("avg(CASE status WHEN 'critical' THEN 0 WHEN 'warning' THEN 70 WHEN 'healthy' THEN 100 END)", 1)} AS score, count(*) AS signal_count,
  count(*) FILTER (WHERE status = 'critical') AS critical_count, count(*) FILTER (WHERE status = 'warning') AS warning_count,
  count(*) FILTER (WHERE status = 'no data') AS unscored_count FROM moved JOIN dmap USING (signal_name) WHERE cycle = {CYCLES - 1} GROUP BY 1""")
def lip_cycle_domains(spark, sf_dir):
    """Domain scores of the newest cycle of SIG-1..14."""
    c = SignalContext(spark, Model(spark, sf_dir), run_signal_cycles(spark, sf_dir))
    return L.domain_scores(c.latest, c.dmap)


@query("lip_cycle_breaches", cycle_ctes() + f"""SELECT signal_name, CASE status WHEN 'critical' THEN replace(replace(replace(
    '{{signal_name}} has breached critical threshold at {{current_value}} (threshold: {{threshold}}). Immediate investigation required.',
    '{{signal_name}}', signal_name), '{{current_value}}', printf('%.2f', {srnd('numeric_value', 2)})), '{{threshold}}', printf('%.2f', critical_threshold))
  ELSE replace(replace(replace(replace('{{signal_name}} approaching critical levels at {{current_value}}. Trending {{direction}} over last {{window}}.',
    '{{signal_name}}', signal_name), '{{current_value}}', printf('%.2f', {srnd('numeric_value', 2)})), '{{window}}', '5 h'),
    '{{direction}}', CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END) END AS insight_text
FROM moved WHERE cycle = {CYCLES - 1} AND status IN ('critical', 'warning')""")
def lip_cycle_breaches(spark, sf_dir):
    """The breach insights of the newest cycle of SIG-1..14."""
    c = SignalContext(spark, Model(spark, sf_dir), run_signal_cycles(spark, sf_dir))
    found = L.insights(L.status_triggers(c.latest, "5 h"), L.insight_templates(spark), c.dmap)
    return found.filter(F.col("trigger_type") == "threshold_breach").select("signal_name", "insight_text")
