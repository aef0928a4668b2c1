"""Registered leading-indicator queries (LIP-*, SIG-15) over hourly signal snapshots from `events`.

Cycle time = newest snapshot hour. The reference's minutes are hours here, so a
rule window of 5 "minutes" spans 5 snapshots, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.core import HOUR, fixed, r4, ts_text
from ..operators import leading as L
from ..session import checkpoint_dir
from ..sources.adapters import Model
from .oracle_base import ASOF, r4 as sr4, rnd as srnd, tstext, with_
from .registry import query
from .signal_plans import SIG2_SQL, sig2

U = HOUR


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, types) -> str:
    body = ", ".join("(" + ", ".join(
        ("NULL" if v is None else (f"CAST({v!r} AS {t})" if t in ("DOUBLE", "INTEGER") else
                                   ("TRUE" if v is True else "FALSE") if t == "BOOLEAN" else _q(v)))
        for v, t in zip(r, types)) + ")" for r in rows)
    return f"(VALUES {body})"


DMAP_SQL = f"SELECT * FROM {_values(L.DOMAIN_MAP, ['VARCHAR', 'VARCHAR'])} t(signal_name, domain_key)"
RULES_SQL = (f"SELECT * FROM {_values(L.CORRELATION_RULES, ['INTEGER', 'VARCHAR', 'VARCHAR', 'VARCHAR', 'INTEGER', 'DOUBLE', 'INTEGER', 'VARCHAR'])} "
             "t(rule_id, signal_a, signal_b, direction, time_window_min, confidence, insight_template_id, recommended_action)")
NAMES = "[" + ", ".join(_q(n) for n in L.SIGNAL_NAMES) + "]"
INV = "(" + ", ".join(_q(n) for n in L.INVERTED) + ")"
SNAP_ASOF = "(SELECT max(snapshot_time) FROM dense)"


def _since(col: str, units: int) -> str:
    return f"{col} >= {SNAP_ASOF} - to_seconds({units * U})"


SNAP_CTES = [
    ("sh", f"SELECT event_type, user_id % 3 AS k, date_trunc('hour', ts) AS h, {srnd('avg(value)', 9)} AS v FROM ev GROUP BY ALL"),
    ("sn", "SELECT *, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1) * 3 + k AS idx FROM sh"),
    ("sn2", f"SELECT *, CASE WHEN idx >= 0 AND idx < {len(L.SIGNAL_NAMES)} THEN {NAMES}[idx + 1] "
            "ELSE event_type || '_' || CAST(k AS VARCHAR) END AS signal_name FROM sn"),
    ("span", f"SELECT signal_name, unnest(generate_series(h0, date_trunc('hour', {ASOF}), INTERVAL 1 HOUR)) AS snapshot_time "
             "FROM (SELECT signal_name, min(h) AS h0 FROM sn2 GROUP BY 1)"),
    ("dense", "SELECT s.signal_name, last_value(sn2.v IGNORE NULLS) OVER (PARTITION BY s.signal_name ORDER BY s.snapshot_time "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS numeric_value, s.snapshot_time "
              "FROM span s LEFT JOIN sn2 ON sn2.signal_name = s.signal_name AND sn2.h = s.snapshot_time"),
    ("cfg", f"""SELECT signal_name,
  {sr4(f"CASE WHEN signal_name IN {INV} THEN quantile_cont(numeric_value, 0.7) ELSE quantile_cont(numeric_value, 0.3) END")} AS healthy_threshold,
  {sr4(f"CASE WHEN signal_name IN {INV} THEN quantile_cont(numeric_value, 0.9) ELSE quantile_cont(numeric_value, 0.1) END")} AS warning_threshold,
  {sr4(f"CASE WHEN signal_name IN {INV} THEN quantile_cont(numeric_value, 0.9) ELSE quantile_cont(numeric_value, 0.1) END")} AS critical_threshold,
  signal_name IN {INV} AS is_inverted
FROM dense WHERE snapshot_time < date_trunc('day', (SELECT min(ts) FROM ev)) + INTERVAL 20 DAY GROUP BY signal_name"""),
    ("scored", """SELECT d.*, c.healthy_threshold, c.warning_threshold, c.critical_threshold, c.is_inverted,
  CASE WHEN c.is_inverted THEN CASE WHEN numeric_value <= healthy_threshold THEN 'healthy'
                                    WHEN numeric_value <= warning_threshold THEN 'warning' ELSE 'critical' END
       ELSE CASE WHEN numeric_value >= healthy_threshold THEN 'healthy'
                 WHEN numeric_value >= warning_threshold THEN 'warning' ELSE 'critical' END END AS status
FROM dense d JOIN cfg c USING (signal_name)"""),
    ("tr0", "SELECT *, numeric_value - lag(numeric_value) OVER (PARTITION BY signal_name ORDER BY snapshot_time) AS dd, "
            "lag(status) OVER (PARTITION BY signal_name ORDER BY snapshot_time) AS prev_status FROM scored"),
    ("trended", f"""SELECT * EXCLUDE (dd), CASE WHEN dd IS NULL THEN NULL WHEN dd >= 0 THEN '+' || printf('%.1f', {srnd('dd', 1)})
  ELSE printf('%.1f', {srnd('dd', 1)}) END AS trend,
  CASE WHEN dd > 0 THEN 'up' WHEN dd < 0 THEN 'down' ELSE 'flat' END AS direction FROM tr0"""),
    ("latest", f"SELECT * FROM trended WHERE snapshot_time = {SNAP_ASOF}"),
    ("dmap", DMAP_SQL),
    ("rules", RULES_SQL),
]


def _ctes(*extra):
    return with_("ev", extra=SNAP_CTES + list(extra))


class _Ctx:
    """Shared Spark inputs of one query: snapshots, calibrated config, scored + trended rows."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.m = Model(spark, sf_dir)
        # The snapshot series is the silver table of one cycle: computed once and written to the
        # shared checkpoint folder (reliable checkpoint, lineage cut); every stage reads it.
        checkpoint_dir(spark)
        self.snap = self.m.signal_snapshots().checkpoint()
        self.cfg = L.calibrate_thresholds(self.snap, self.m.calibration_end())
        # Scored once, too: every stage reads these rows instead of calibrating and scoring again.
        self.trended = L.snapshot_trend(L.score_signals(self.snap, self.cfg)).withColumn(
            "prev_status", F.lag("status").over(Window.partitionBy("signal_name").orderBy("snapshot_time"))).checkpoint()
        self.scored = self.trended.drop("trend", "direction", "prev_status")
        self.as_of = F.timestamp_micros(F.lit(self.snap.agg(F.unix_micros(F.max("snapshot_time"))).first()[0]))
        self.latest = self.trended.filter(F.col("snapshot_time") == self.as_of)
        self.dmap = L.domain_map(spark)
        self.rules = L.correlation_rules(spark)

    def active(self):
        return L.correlations(self.scored, self.rules, self.as_of, recent_s=5 * U, minute_s=U)


# ------------------------------------------------------------------ LIP-26 / LIP-1 / LIP-2
@query("lip26_calibrate_thresholds", _ctes() + "SELECT * FROM cfg")
def lip26(spark, sf_dir):
    return _Ctx(spark, sf_dir).cfg


@query("lip1_score_signals", _ctes() + f"SELECT signal_name, {tstext('snapshot_time')} AS snapshot_time, "
       f"{sr4('numeric_value')} AS numeric_value, status FROM scored")
def lip1(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return c.scored.select("signal_name", ts_text("snapshot_time").alias("snapshot_time"),
                           r4("numeric_value").alias("numeric_value"), "status")


@query("lip2_snapshot_trend", _ctes() + f"SELECT signal_name, {tstext('snapshot_time')} AS snapshot_time, "
       f"{sr4('numeric_value')} AS numeric_value, status, trend, direction FROM trended")
def lip2(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return c.trended.select("signal_name", ts_text("snapshot_time").alias("snapshot_time"),
                            r4("numeric_value").alias("numeric_value"), "status", "trend", "direction")


# ------------------------------------------------------------------ LIP-3 / LIP-4
DOMAIN_CTE = ("dom", f"""SELECT COALESCE(domain_key, 'unmapped') AS domain_key,
  {srnd("avg(CASE WHEN status = 'critical' THEN 0 WHEN status = 'warning' THEN 70 WHEN status = 'healthy' THEN 100 END)", 1)} AS score,
  CAST(count(*) AS BIGINT) AS signal_count, CAST(count(*) FILTER (WHERE status = 'critical') AS BIGINT) AS critical_count,
  CAST(count(*) FILTER (WHERE status = 'warning') AS BIGINT) AS warning_count,
  CAST(count(*) FILTER (WHERE status NOT IN ('critical', 'warning', 'healthy')) AS BIGINT) AS unscored_count
FROM latest LEFT JOIN dmap USING (signal_name) GROUP BY COALESCE(domain_key, 'unmapped')""")


@query("lip3_domain_scores", _ctes(DOMAIN_CTE) + "SELECT * FROM dom")
def lip3(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.domain_scores(c.latest, c.dmap)


ENT_CTE = ("ent", f"""SELECT {srnd("(max(CASE WHEN domain_key = 'agent' THEN score END) + max(CASE WHEN domain_key = 'app' THEN score END) + max(CASE WHEN domain_key = 'genesys' THEN score END)) / 3", 1)} AS enterprise_score,
  max(CASE WHEN domain_key = 'agent' THEN score END) AS agent_health_score,
  max(CASE WHEN domain_key = 'app' THEN score END) AS app_health_score,
  max(CASE WHEN domain_key = 'genesys' THEN score END) AS genesys_health_score FROM dom""")


@query("lip4_enterprise_score", _ctes(DOMAIN_CTE, ENT_CTE) + "SELECT * FROM ent")
def lip4(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.enterprise_score(L.domain_scores(c.latest, c.dmap))


@query("lip4_enterprise_score_weighted", _ctes(DOMAIN_CTE) + f"""
SELECT {srnd("max(CASE WHEN domain_key = 'genesys' THEN score END) * 0.4 + max(CASE WHEN domain_key = 'agent' THEN score END) * 0.35 + max(CASE WHEN domain_key = 'app' THEN score END) * 0.25", 1)} AS enterprise_score,
  max(CASE WHEN domain_key = 'agent' THEN score END) AS agent_health_score,
  max(CASE WHEN domain_key = 'app' THEN score END) AS app_health_score,
  max(CASE WHEN domain_key = 'genesys' THEN score END) AS genesys_health_score FROM dom""")
def lip4w(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.enterprise_score(L.domain_scores(c.latest, c.dmap), weights=L.DOMAIN_WEIGHTS)


# ------------------------------------------------------------------ LIP-5 / LIP-6
CORR_CTES = [
    ("deg", f"SELECT signal_name, status, numeric_value, snapshot_time FROM scored "
            f"WHERE status IN ('warning', 'critical') AND {_since('snapshot_time', 5)}"),
    ("mc", """SELECT r.*, a.numeric_value AS av, b.numeric_value AS bv, a.status AS ast, b.status AS bst,
  a.snapshot_time AS a_t, b.snapshot_time AS b_t, abs(epoch(a.snapshot_time) - epoch(b.snapshot_time)) / 3600.0 AS lag_minutes
FROM rules r JOIN deg a ON a.signal_name = r.signal_a JOIN deg b ON b.signal_name = r.signal_b
WHERE abs(epoch(a.snapshot_time) - epoch(b.snapshot_time)) / 3600.0 <= r.time_window_min"""),
    ("active", f"""SELECT rule_id, signal_a, signal_b, confidence, direction, {sr4('av')} AS signal_a_value, {sr4('bv')} AS signal_b_value,
  ast AS signal_a_status, bst AS signal_b_status, {sr4('lag_minutes')} AS lag_minutes, recommended_action, insight_template_id,
  {tstext(SNAP_ASOF)} AS detected_at FROM (
  SELECT *, row_number() OVER (PARTITION BY signal_a, signal_b ORDER BY confidence DESC, rule_id, a_t DESC, b_t DESC) AS rn FROM mc)
WHERE rn = 1"""),
]


@query("lip5_correlations", _ctes(*CORR_CTES) + "SELECT * FROM active")
def lip5(spark, sf_dir):
    return _Ctx(spark, sf_dir).active()


LIP6_SQL = _ctes(*CORR_CTES, ("e", "SELECT DISTINCT signal_a AS cause, signal_b AS effect FROM active"), (
    "walk(signal, root, hops)", """SELECT effect, cause, 1 FROM e
UNION SELECT w.signal, e.cause, w.hops + 1 FROM walk w JOIN e ON e.effect = w.root WHERE w.hops < 14"""), (
    "found", "SELECT signal, root, min(hops) AS hops FROM walk GROUP BY signal, root")).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT signal, root, hops FROM found r WHERE NOT EXISTS (
  SELECT 1 FROM found f WHERE f.signal = r.root
    AND (f.root < r.root OR NOT EXISTS (SELECT 1 FROM found g WHERE g.signal = f.root AND g.root = f.signal)))"""


@query("lip6_cascade", LIP6_SQL)
def lip6(spark, sf_dir):
    return L.cascade(_Ctx(spark, sf_dir).active())


# ------------------------------------------------------------------ LIP-7 / LIP-8 / LIP-10
ROC_CTE = ("roc", f"""SELECT signal_name, {sr4('slope')} AS slope,
  CASE WHEN slope < -2.0 THEN 'rapid_decline' WHEN slope < -0.5 THEN 'declining' WHEN slope > 0.5 THEN 'improving' ELSE 'stable' END AS trend,
  {sr4('first_value')} AS first_value, {sr4('last_value')} AS last_value, CAST(n AS BIGINT) AS data_points FROM (
  SELECT signal_name, arg_min(numeric_value, snapshot_time) AS first_value, arg_max(numeric_value, snapshot_time) AS last_value,
    count(*) AS n, CASE WHEN (epoch(max(snapshot_time)) - epoch(min(snapshot_time))) / 3600.0 > 0
      THEN (arg_max(numeric_value, snapshot_time) - arg_min(numeric_value, snapshot_time))
           / ((epoch(max(snapshot_time)) - epoch(min(snapshot_time))) / 3600.0) ELSE 0.0 END AS slope
  FROM dense WHERE {_since('snapshot_time', 5)} GROUP BY signal_name)""")


@query("lip7_rate_of_change", _ctes(ROC_CTE) + "SELECT * FROM roc")
def lip7(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.rate_of_change(c.snap, c.as_of, window_s=5 * U, per_s=U)


ALERT_CTES = [ROC_CTE, (
    "cand", f"""SELECT signal_name, status AS severity, signal_name || ' is ' || status || ' at ' || printf('%.2f', {srnd('numeric_value', 2)}) AS message
FROM latest WHERE status IN ('warning', 'critical')
UNION ALL SELECT signal_name, 'critical', signal_name || ' declining rapidly: ' || printf('%.1f', {srnd('slope', 1)}) || ' units/min'
FROM roc WHERE trend = 'rapid_decline'"""), (
    "past", f"SELECT signal_name, status AS severity, snapshot_time AS created_at FROM trended "
            f"WHERE status IN ('warning', 'critical') AND snapshot_time < {SNAP_ASOF}"), (
    "newal", f"""SELECT signal_name, severity, message, {tstext(SNAP_ASOF)} AS created_at, FALSE AS is_acknowledged FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.signal_name = c.signal_name AND p.severity = c.severity
                  AND {_since('p.created_at', 10)})""")]


def _alert_parts(c: _Ctx):
    roc = L.rate_of_change(c.snap, c.as_of, window_s=5 * U, per_s=U)
    cand = L.alert_candidates(c.latest, roc, c.as_of)
    past = (c.trended.filter(F.col("status").isin("warning", "critical") & (F.col("snapshot_time") < c.as_of))
            .select("signal_name", F.col("status").alias("severity"), F.col("snapshot_time").alias("created_at")))
    return roc, L.new_alerts(cand, past, c.as_of, dedup_s=10 * U)


@query("lip8_new_alerts", _ctes(*ALERT_CTES) + "SELECT * FROM newal")
def lip8(spark, sf_dir):
    return _alert_parts(_Ctx(spark, sf_dir))[1]


@query("lip10_pending_notifications", _ctes(*ALERT_CTES) + "SELECT * FROM newal WHERE severity = 'critical'")
def lip10(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    al = _alert_parts(c)[1].withColumn("created_at", F.col("created_at").cast("timestamp"))
    return L.pending_notifications(al, c.as_of, window_s=U).withColumn("created_at", ts_text("created_at"))


# ------------------------------------------------------------------ LIP-9
LIP9_SQL = _ctes(DOMAIN_CTE, ENT_CTE, *CORR_CTES, (
    "dec", f"""SELECT signal_name, count(*) FILTER (WHERE drop_pct > 2.0) >= 5 AS sustained_decline FROM (
  SELECT signal_name, (lag(numeric_value) OVER w - numeric_value) * 100.0 / NULLIF(abs(lag(numeric_value) OVER w), 0) AS drop_pct
  FROM dense WHERE {_since('snapshot_time', 6)} WINDOW w AS (PARTITION BY signal_name ORDER BY snapshot_time)) GROUP BY 1""")) + """
SELECT s.*, e.enterprise_score, d.n_sustained_decline, c.n_strong_correlations, r.n_recovered, r.n_improving,
  CASE WHEN s.n_critical > 0 OR s.n_warning >= 2 OR e.enterprise_score < 90 THEN 'CRITICAL'
       WHEN s.n_warning > 0 OR d.n_sustained_decline > 0 OR c.n_strong_correlations > 0 THEN 'WARNING'
       WHEN r.n_recovered > 0 OR r.n_improving > 0 THEN 'INFO' ELSE 'NONE' END AS alert_level
FROM (SELECT CAST(count(*) FILTER (WHERE status = 'critical') AS BIGINT) AS n_critical,
             CAST(count(*) FILTER (WHERE status = 'warning') AS BIGINT) AS n_warning FROM latest) s,
     ent e,
     (SELECT CAST(count(*) FILTER (WHERE sustained_decline) AS BIGINT) AS n_sustained_decline FROM dec) d,
     (SELECT CAST(count(*) FILTER (WHERE confidence > 0.8) AS BIGINT) AS n_strong_correlations FROM active) c,
     (SELECT CAST(count(*) FILTER (WHERE status = 'healthy' AND prev_status IN ('warning', 'critical')) AS BIGINT) AS n_recovered,
             CAST(count(*) FILTER (WHERE direction = 'up') AS BIGINT) AS n_improving FROM latest) r"""


@query("lip9_alert_level", LIP9_SQL)
def lip9(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    ent = L.enterprise_score(L.domain_scores(c.latest, c.dmap))
    dec = L.sustained_decline(c.snap, c.as_of, unit_s=U, periods=5, pct_per_unit=2.0)
    prev = c.latest.withColumn("recovered", (F.col("status") == "healthy")
                               & F.col("prev_status").isin("warning", "critical"))
    return L.alert_level(c.latest, ent, dec, c.active(), prev).select(
        "n_critical", "n_warning", "enterprise_score", "n_sustained_decline", "n_strong_correlations",
        "n_recovered", "n_improving", "alert_level")


# ------------------------------------------------------------------ LIP-12 / LIP-13 / LIP-14 / LIP-15
@query("lip12_recovery_events", _ctes() + f"""SELECT signal_name, {tstext('snapshot_time')} AS snapshot_time, prev_status,
  {sr4('numeric_value')} AS numeric_value FROM trended WHERE status = 'healthy' AND prev_status IN ('warning', 'critical')""")
def lip12(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.recovery_events(c.scored).select("signal_name", ts_text("snapshot_time").alias("snapshot_time"),
                                               "prev_status", r4("numeric_value").alias("numeric_value"))


STABLE_SQL = _ctes() + """
SELECT s.signal_name, CAST(max(run) AS BIGINT) AS healthy_run FROM (
  SELECT *, sum(CASE WHEN status = 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY signal_name, isl ORDER BY snapshot_time
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
    SELECT *, sum(CASE WHEN status <> 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY signal_name ORDER BY snapshot_time
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM scored)) s
WHERE snapshot_time = (SELECT max(snapshot_time) FROM dense) AND run > 4 GROUP BY s.signal_name"""


@query("lip12_stable_signals", STABLE_SQL)
def lip12s(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.stable_signals(c.scored, c.as_of, min_units=4)


@query("lip13_incident_surge", _ctes() + f"""SELECT signal_name, {tstext('snapshot_time')} AS snapshot_time,
  {sr4('numeric_value')} AS numeric_value, {sr4('ra')} AS rolling_avg, {sr4('numeric_value / NULLIF(ra, 0)')} AS multiplier FROM (
  SELECT *, avg(numeric_value) OVER (PARTITION BY signal_name ORDER BY snapshot_time
    RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS ra FROM dense WHERE signal_name = 'Incidents')""")
def lip13(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.incident_surge(c.snap, "Incidents", window_s=24 * U)


LIP14_BODY = f"""SELECT signal_name, CAST(eta AS BIGINT) AS eta_minutes, {sr4('round_even(round(slope, 9), 2)')} AS slope_per_min,
  {sr4('cur')} AS current_value, {sr4('critical_threshold')} AS critical_threshold, {tstext(SNAP_ASOF)} AS projected_at FROM (
  SELECT *, round_even(round(CASE WHEN (is_inverted AND cur >= critical_threshold) OR (NOT is_inverted AND cur <= critical_threshold)
                 THEN 0.0 ELSE abs((cur - critical_threshold) / slope) END, 9), 0) AS eta FROM (
    SELECT d.signal_name, c.critical_threshold, c.is_inverted, regr_slope(numeric_value, epoch(snapshot_time) / 3600.0) AS slope,
      count(*) AS n, arg_max(numeric_value, snapshot_time) AS cur
    FROM dense d JOIN cfg c USING (signal_name) WHERE {_since('d.snapshot_time', 15)} GROUP BY ALL)
  WHERE n >= 3 AND slope IS NOT NULL AND CASE WHEN is_inverted THEN slope > 0 ELSE slope < 0 END)
WHERE eta < 60"""


@query("lip14_eta", _ctes() + LIP14_BODY)
def lip14(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.eta(c.snap, c.cfg, c.as_of, window_s=15 * U, per_s=U, max_eta=60)


LIP15_SQL = _ctes(*CORR_CTES) + """
SELECT CAST(round_even(round(least(least(critical_count * 25 + warning_count * 8, 100) * 0.40
    + least(declining_count * 12, 100) * 0.25 + least(correlation_count * 20, 100) * 0.20 + 0.0 * 0.15, 100.0), 6), 0) AS BIGINT) AS probability,
  critical_count, warning_count, declining_count, correlation_count FROM
  (SELECT CAST(count(*) FILTER (WHERE status = 'critical') AS BIGINT) AS critical_count,
          CAST(count(*) FILTER (WHERE status = 'warning') AS BIGINT) AS warning_count,
          CAST(count(*) FILTER (WHERE direction = 'down') AS BIGINT) AS declining_count FROM latest) s,
  (SELECT CAST(count(*) FILTER (WHERE confidence > 0.8) AS BIGINT) AS correlation_count FROM active) c"""


@query("lip15_outage_probability", LIP15_SQL, headline=True)
def lip15(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.outage_probability(c.latest, c.active())


# ------------------------------------------------------------------ LIP-16
LIP16_SQL = """WITH cur AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)),
lib AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE label = 1 AND vec_id <> (SELECT max(vec_id) FROM embeddings)),
s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(lib.v, cur.v), lambda p: p[1] * p[2]))
        / (sqrt(list_sum(list_transform(cur.v, lambda x: x * x))) * sqrt(list_sum(list_transform(lib.v, lambda x: x * x)))) AS sim
      FROM lib, cur)
SELECT CAST(row_number() OVER (ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, vec_id, label,
  """ + sr4("sim") + """ AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 5"""


@query("lip16_pattern_match", LIP16_SQL)
def lip16(spark, sf_dir):
    m = Model(spark, sf_dir)
    emb = m.raw("embeddings")
    newest = emb.select(F.max("vec_id")).scalar()
    current = emb.filter(F.col("vec_id") == newest).select("embedding")
    lib = emb.filter((F.col("label") == 1) & (F.col("vec_id") != newest))
    return L.pattern_match(current, lib, top=5)


# Outage (adapter): five of the fourteen signals critical in one hour; the run-up is the twelve hours before.
OUTAGE_CRITICAL, RUN_UP = 5, 12
RUN_CTES = [
    ("z", f"""SELECT d.signal_name, d.snapshot_time, list_position({NAMES}, d.signal_name) - 1 AS place,
  CASE WHEN s.sd > 0 THEN (d.numeric_value - s.m) / s.sd ELSE 0.0 END AS z FROM dense d JOIN (
  SELECT signal_name, avg(numeric_value) AS m, stddev_samp(numeric_value) AS sd FROM dense GROUP BY 1) s USING (signal_name)
WHERE list_contains({NAMES}, d.signal_name)"""),
    ("bad", f"""SELECT snapshot_time FROM scored WHERE list_contains({NAMES}, signal_name) GROUP BY 1
HAVING count(*) FILTER (WHERE status = 'critical') >= {OUTAGE_CRITICAL}"""),
    ("starts", f"""SELECT snapshot_time AS episode_start FROM bad b WHERE snapshot_time < {SNAP_ASOF}
  AND NOT EXISTS (SELECT 1 FROM bad p WHERE p.snapshot_time = b.snapshot_time - INTERVAL 1 HOUR)"""),
    ("ends", f"""SELECT episode_start - INTERVAL 1 HOUR AS e FROM starts WHERE episode_start - INTERVAL 1 HOUR IN (SELECT snapshot_time FROM z)
UNION SELECT {SNAP_ASOF}"""),
    ("cells", f"""SELECT e, step, place FROM ends, unnest(range(0, {RUN_UP})) AS s(step), unnest(range(0, {len(L.SIGNAL_NAMES)})) AS p(place)"""),
    ("vecs", f"""SELECT c.e, list(COALESCE(z.z, 0.0) ORDER BY c.step, c.place) AS v FROM cells c
  LEFT JOIN z ON z.place = c.place AND z.snapshot_time = c.e - to_hours(CAST({RUN_UP - 1} - c.step AS BIGINT)) GROUP BY c.e"""),
    ("sims", f"""SELECT l.e + INTERVAL 1 HOUR AS episode_start, list_sum(list_transform(list_zip(l.v, n.v), lambda p: p[1] * p[2]))
  / NULLIF(sqrt(list_sum(list_transform(n.v, lambda x: x * x))) * sqrt(list_sum(list_transform(l.v, lambda x: x * x))), 0) AS sim
  FROM vecs l, (SELECT v FROM vecs WHERE e = {SNAP_ASOF}) n WHERE l.e < {SNAP_ASOF} AND l.e + INTERVAL 1 HOUR IN (SELECT episode_start FROM starts)"""),
]


def _pre_outage(c: _Ctx, top: int = 5):
    return L.pre_outage_match(c.snap, c.scored, c.as_of, step_s=U, steps=RUN_UP, min_critical=OUTAGE_CRITICAL, top=top)


@query("lip16_pre_outage_library", _ctes(*RUN_CTES) + f"""SELECT CAST(row_number() OVER (ORDER BY sim DESC NULLS LAST, episode_start) AS INTEGER) AS rank,
  {tstext('episode_start')} AS episode_start, {sr4('sim')} AS similarity FROM sims ORDER BY sim DESC NULLS LAST, episode_start LIMIT 5""")
def lip16_library(spark, sf_dir):
    """The past outages whose twelve hours before are most like the last twelve, from the snapshots' own history."""
    return _pre_outage(_Ctx(spark, sf_dir)).withColumn("episode_start", ts_text("episode_start"))


LIP15P_SQL = _ctes(*CORR_CTES, *RUN_CTES) + """
SELECT CAST(round_even(round(least(least(critical_count * 25 + warning_count * 8, 100) * 0.40
    + least(declining_count * 12, 100) * 0.25 + least(correlation_count * 20, 100) * 0.20 + pattern * 0.15, 100.0), 6), 0) AS BIGINT) AS probability,
  critical_count, warning_count, declining_count, correlation_count FROM
  (SELECT CAST(count(*) FILTER (WHERE status = 'critical') AS BIGINT) AS critical_count,
          CAST(count(*) FILTER (WHERE status = 'warning') AS BIGINT) AS warning_count,
          CAST(count(*) FILTER (WHERE direction = 'down') AS BIGINT) AS declining_count FROM latest) s,
  (SELECT CAST(count(*) FILTER (WHERE confidence > 0.8) AS BIGINT) AS correlation_count FROM active) c,
  (SELECT COALESCE(greatest(max(""" + sr4("sim") + """), 0.0), 0.0) * 100 AS pattern FROM sims) p"""


@query("lip15_outage_probability_pattern", LIP15P_SQL)
def lip15_pattern(spark, sf_dir):
    """The fourth part of the probability from the best match of the pre-outage library."""
    c = _Ctx(spark, sf_dir)
    return L.outage_probability(c.latest, c.active(), L.best_pattern(_pre_outage(c, top=1)))


# ------------------------------------------------------------------ LIP-11
def _tmpl(tid: int) -> str:
    return _q([t for t in L.INSIGHT_TEMPLATES if t[0] == tid][0][3])


def _fill(tid: int, fields: dict) -> str:
    out = _tmpl(tid)
    for k, v in fields.items():
        out = f"replace({out}, '{{{k}}}', COALESCE(CAST({v} AS VARCHAR), 'n/a'))"
    return out


def _fx(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {srnd(expr, digits)})"


STABLE_CTE = ("stable", """SELECT signal_name FROM (
  SELECT *, sum(CASE WHEN status = 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY signal_name, isl ORDER BY snapshot_time
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
    SELECT *, sum(CASE WHEN status <> 'healthy' THEN 1 ELSE 0 END) OVER (PARTITION BY signal_name ORDER BY snapshot_time
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM scored))
WHERE snapshot_time = (SELECT max(snapshot_time) FROM dense) AND run > 4""")
SUBS_CTE = ("subs", """SELECT parent_signal, string_agg(sub_name, ', ' ORDER BY sub_name) AS subs, min(threshold) AS thr FROM (
  SELECT signal_name AS parent_signal, 'series-' || signal_name AS sub_name, status, healthy_threshold AS threshold FROM latest)
WHERE status IN ('warning', 'critical') GROUP BY 1""")
LIP11_SQL = _ctes(*CORR_CTES, *RUN_CTES, ROC_CTE, STABLE_CTE, SUBS_CTE, ("eta", LIP14_BODY), (
    "best", f"SELECT * FROM sims WHERE {sr4('sim')} >= 0.8 ORDER BY sim DESC, episode_start LIMIT 1"), (
    "inc", f"SELECT numeric_value AS n, p1_count AS p1 FROM ({SIG2_SQL})"), (
    "surge", f"""SELECT {sr4('numeric_value / NULLIF(ra, 0)')} AS m FROM (SELECT *, avg(numeric_value) OVER (PARTITION BY signal_name ORDER BY snapshot_time
    RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS ra FROM dense WHERE signal_name = 'Incidents')
  WHERE snapshot_time = (SELECT max(snapshot_time) FROM dense WHERE signal_name = 'Incidents')"""), (
    "trig", f"""SELECT 'threshold_breach' AS trigger_type, 'critical' AS severity, signal_name, NULL AS related_signal,
  {_fill(1, {'signal_name': 'signal_name', 'current_value': _fx('numeric_value', 2), 'threshold': _fx('critical_threshold', 2)})} AS insight_text
FROM latest WHERE status = 'critical'
UNION ALL SELECT 'threshold_breach', 'warning', signal_name, NULL,
  {_fill(2, {'signal_name': 'signal_name', 'current_value': _fx('numeric_value', 2), 'direction': 'direction', 'window': "'5 h'"})}
FROM latest WHERE status = 'warning'
UNION ALL SELECT 'rate_decline', 'critical', signal_name, NULL,
  {_fill(3, {'signal_name': 'signal_name', 'previous_value': _fx('first_value', 1), 'current_value': _fx('last_value', 1), 'duration': "'5 h'",
             'threshold': _fx('critical_threshold', 1), 'eta_minutes': 'eta_minutes'})}
FROM roc LEFT JOIN (SELECT signal_name, eta_minutes FROM eta) USING (signal_name) LEFT JOIN (SELECT signal_name, critical_threshold FROM latest) USING (signal_name)
WHERE trend = 'rapid_decline'
UNION ALL SELECT 'correlation', 'warning', signal_a, signal_b,
  CASE WHEN signal_a = 'Incidents' AND signal_b = 'Call LOB SLA' THEN {_fill(5, {'incident_count': '(SELECT n FROM inc)', 'p1_count': '(SELECT p1 FROM inc)', 'window': "'24 h'",
             'multiplier': "printf('%.1f', " + srnd('(SELECT m FROM surge)', 1) + ")"})}
  ELSE {_fill(4, {'signal_a': 'signal_a', 'signal_b': 'signal_b', 'confidence': 'CAST(round_even(confidence * 100, 0) AS BIGINT)', 'recommended_action': 'recommended_action'})} END
FROM active
UNION ALL SELECT 'pattern_match', 'warning', NULL, NULL,
  {_fill(6, {'similarity': _fx(f"{sr4('sim')} * 100", 0), 'past_event_date': "strftime(episode_start, '%Y-%m-%d %H:%M')",
             'current_prob': f'(SELECT probability FROM ({LIP15_SQL}))', 'projected_prob': f'(SELECT probability FROM ({LIP15P_SQL}))', 'eta': '(SELECT min(eta_minutes) FROM eta)'})}
FROM best
UNION ALL SELECT 'multi_correlation', 'warning', l.parent_signal, a.signal_a,
  {_fill(7, {'signal_a': 'l.parent_signal', 'threshold': _fx('l.thr', 0) + " || '%'", 'sub_signals': 'l.subs', 'correlated_signal': 'a.signal_a', 'recommended_action': 'a.recommended_action'})}
FROM subs l JOIN active a ON a.signal_b = l.parent_signal
UNION ALL SELECT 'recovery', 'info', signal_name, NULL,
  {_fill(8, {'signal_name': 'signal_name', 'event_description': "'degradation'", 'scope': "'checks'", 'current_value': _fx('numeric_value', 2)})}
FROM latest WHERE status = 'healthy' AND prev_status IN ('warning', 'critical')
UNION ALL SELECT 'stable', 'info', NULL, NULL,
  {_fill(9, {'signal_list': "string_agg(signal_name, ', ' ORDER BY signal_name)", 'duration': "'4'"})}
FROM stable HAVING count(*) > 0""")) + """
SELECT t.trigger_type, t.severity, t.signal_name, t.insight_text,
  COALESCE((SELECT string_agg(domain_key, ',' ORDER BY domain_key) FROM dmap d WHERE d.signal_name = t.signal_name), '') AS domains,
  concat_ws(',', t.signal_name, t.related_signal) AS related_signals
FROM trig t"""


def _series_subs(c):
    """Sub-signals of a snapshot of series: each signal's own series, at its healthy threshold."""
    return c.latest.select(F.col("signal_name").alias("parent_signal"), F.concat(F.lit("series-"), F.col("signal_name")).alias("sub_name"), "status",
                           F.col("healthy_threshold").alias("threshold"))


def cycle_insights(c, incidents, subs):
    """Insights of one cycle from all nine templates."""
    active, roc = c.active(), L.rate_of_change(c.snap, c.as_of, window_s=5 * U, per_s=U)
    projected = L.eta(c.snap, c.cfg, c.as_of, window_s=15 * U, per_s=U, max_eta=60)
    surge, matches = L.incident_surge(c.snap, "Incidents", window_s=24 * U), _pre_outage(c, top=1)
    parts = [L.status_triggers(c.latest, "5 h"), L.decline_triggers(roc, projected, c.latest, "5 h"), L.correlation_triggers(active, incidents, surge, "24 h"),
             L.pattern_triggers(matches, L.outage_probability(c.latest, active), L.outage_probability(c.latest, active, L.best_pattern(matches)), projected),
             L.sub_signal_triggers(subs, active), L.stable_triggers(L.stable_signals(c.scored, c.as_of, min_units=4), "4")]
    trig = parts[0]
    for t in parts[1:]:
        trig = trig.unionByName(t)
    return L.insights(trig, L.insight_templates(c.spark), c.dmap).select(
        "trigger_type", "severity", "signal_name", "insight_text", "domains", "related_signals")


@query("lip11_insights", LIP11_SQL)
def lip11(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return cycle_insights(c, sig2(c.m), _series_subs(c))


CURVE_SHARES = [round(0.05 * i, 2) for i in range(1, 11)]


@query("lip26_threshold_curve", _ctes(("cand", "SELECT signal_name, unnest(list_distinct([" + ", ".join(
    sr4(f"quantile_cont(numeric_value, {p})") for p in CURVE_SHARES) + "])) AS threshold FROM dense GROUP BY signal_name"), (
    "br", "SELECT snapshot_time AS b FROM scored WHERE signal_name = 'Call LOB SLA' AND status = 'critical'"), (
    "f", "SELECT d.signal_name, d.numeric_value, EXISTS (SELECT 1 FROM br WHERE b > d.snapshot_time AND b <= d.snapshot_time + INTERVAL 3 HOUR) AS followed FROM dense d"), (
    "n", f"SELECT f.*, c.threshold, CASE WHEN f.signal_name IN {INV} THEN numeric_value > threshold ELSE numeric_value < threshold END AS beyond FROM f JOIN cand c USING (signal_name)")) + f"""
SELECT signal_name, threshold, count(*) FILTER (WHERE beyond) AS beyond, count(*) FILTER (WHERE beyond AND followed) AS followed,
  {sr4('count(*) FILTER (WHERE beyond AND followed) * 1.0 / NULLIF(count(*) FILTER (WHERE beyond), 0)')} AS breach_share,
  {sr4('count(*) FILTER (WHERE NOT followed AND NOT beyond) * 1.0 / NULLIF(count(*) FILTER (WHERE NOT followed), 0)')} AS normal_share
FROM n GROUP BY signal_name, threshold""")
def lip26_curve(spark, sf_dir):
    """Candidates: ten quantiles of each signal; breach: Call LOB SLA critical within three hours."""
    from ..functions.selection import exact_percentiles

    c = _Ctx(spark, sf_dir)
    names = [f"_{i}" for i in range(len(CURVE_SHARES))]
    cand = exact_percentiles(c.snap, ["signal_name"], "numeric_value", CURVE_SHARES, names).select("signal_name", F.array(*[r4(n) for n in names]).alias("candidates"))
    breaches = c.scored.filter((F.col("signal_name") == "Call LOB SLA") & (F.col("status") == "critical")).select(F.col("snapshot_time").alias("breach_time"))
    return L.threshold_curve(c.snap, breaches, cand, horizon_s=3 * U)


# ------------------------------------------------------------------ LIP-18 / SIG-15 / LIP-21 / LIP-25
@query("lip18_signal_matrix", _ctes() + """SELECT l.signal_name,
  max(CASE WHEN domain_key = 'agent' THEN status END) AS agent, max(CASE WHEN domain_key = 'app' THEN status END) AS app,
  max(CASE WHEN domain_key = 'genesys' THEN status END) AS genesys, CAST(count(*) AS BIGINT) AS domain_count,
  count(*) > 1 AS shared FROM latest l JOIN dmap USING (signal_name) GROUP BY l.signal_name""")
def lip18(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.signal_matrix(c.latest, c.dmap)


@query("lip18_domain_lanes", _ctes() + """SELECT domain_key, CAST(count(*) FILTER (WHERE status = 'healthy') AS BIGINT) AS healthy,
  CAST(count(*) FILTER (WHERE status = 'warning') AS BIGINT) AS warning,
  CAST(count(*) FILTER (WHERE status = 'critical') AS BIGINT) AS critical,
  string_agg(signal_name, ', ' ORDER BY signal_name) AS signals FROM latest JOIN dmap USING (signal_name) GROUP BY domain_key""")
def lip18l(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.domain_lanes(c.latest, c.dmap)


@query("sig15_ghost_agents", _ctes() + f"""SELECT {tstext('snapshot_time')} AS snapshot_time FROM scored
GROUP BY snapshot_time HAVING max(CASE WHEN signal_name = 'Desktop / Endpoint' THEN status END) <> 'healthy'
  AND max(CASE WHEN signal_name = 'Agent Online' THEN status END) = 'healthy'""")
def sig15(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    p = (c.scored.filter(F.col("signal_name").isin("Desktop / Endpoint", "Agent Online"))
         .groupBy("snapshot_time").pivot("signal_name", ["Desktop / Endpoint", "Agent Online"]).agg(F.first("status")))
    return p.filter((F.col("Desktop / Endpoint") != "healthy") & (F.col("Agent Online") == "healthy")) \
        .select(ts_text("snapshot_time").alias("snapshot_time"))


LIP21_SQL = _ctes() + f"""SELECT c.signal_name, {sr4('c.numeric_value')} AS value,
  {sr4('CASE WHEN s.sd > 0 THEN (c.numeric_value - s.mean) / s.sd ELSE 0.0 END')} AS score,
  abs(CASE WHEN s.sd > 0 THEN (c.numeric_value - s.mean) / s.sd ELSE 0.0 END) > 3.0 AS is_outlier
FROM (SELECT * FROM dense WHERE snapshot_time = {SNAP_ASOF}) c JOIN (
  SELECT signal_name, avg(numeric_value) AS mean, stddev_samp(numeric_value) AS sd FROM dense
  WHERE snapshot_time < {SNAP_ASOF} GROUP BY 1) s USING (signal_name)"""


@query("lip21_signal_outliers", LIP21_SQL)
def lip21(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.signal_outliers(c.snap, c.as_of, "zscore")


LIP21I_SQL = _ctes() + f"""SELECT c.signal_name, {sr4('c.numeric_value')} AS value, {sr4('q1 - 1.5 * (q3 - q1)')} AS lower_fence,
  {sr4('q3 + 1.5 * (q3 - q1)')} AS upper_fence, c.numeric_value < q1 - 1.5 * (q3 - q1) OR c.numeric_value > q3 + 1.5 * (q3 - q1) AS is_outlier
FROM (SELECT * FROM dense WHERE snapshot_time = {SNAP_ASOF}) c JOIN (
  SELECT signal_name, quantile_cont(numeric_value, 0.25) AS q1, quantile_cont(numeric_value, 0.75) AS q3 FROM dense
  WHERE snapshot_time < {SNAP_ASOF} GROUP BY 1) s USING (signal_name)"""


@query("lip21_signal_outliers_iqr", LIP21I_SQL)
def lip21i(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.signal_outliers(c.snap, c.as_of, "iqr")


LIP25_SQL = _ctes(("starts", """SELECT signal_name, snapshot_time FROM (
  SELECT *, COALESCE(lag(CASE WHEN status IN ('warning', 'critical') THEN 1 ELSE 0 END) OVER (PARTITION BY signal_name ORDER BY snapshot_time), 0) AS pb
  FROM scored) WHERE status IN ('warning', 'critical') AND pb = 0"""), (
    "ra", "SELECT r.*, a.snapshot_time AS ta FROM rules r JOIN starts a ON a.signal_name = r.signal_a"), (
    "hit", """SELECT rule_id, ta, min((epoch(b.snapshot_time) - epoch(ta)) / 3600.0) AS lag FROM ra
  JOIN starts b ON b.signal_name = ra.signal_b AND b.snapshot_time >= ta AND b.snapshot_time <= ta + to_seconds(ra.time_window_min * 3600)
  GROUP BY rule_id, ta""")) + f"""
SELECT t.rule_id, t.signal_a, t.signal_b, {sr4('t.confidence')} AS stated_confidence, CAST(t.a_starts AS BIGINT) AS a_starts,
  CAST(COALESCE(h.followed, 0) AS BIGINT) AS followed, {sr4('COALESCE(h.followed, 0) / t.a_starts')} AS measured_confidence,
  {sr4('h.median_lag')} AS median_lag_minutes
FROM (SELECT rule_id, signal_a, signal_b, confidence, count(*) AS a_starts FROM ra GROUP BY ALL) t
LEFT JOIN (SELECT rule_id, count(*) AS followed, quantile_cont(lag, 0.5) AS median_lag FROM hit GROUP BY 1) h USING (rule_id)"""


@query("lip25_rule_confidence", LIP25_SQL)
def lip25(spark, sf_dir):
    c = _Ctx(spark, sf_dir)
    return L.rule_confidence(c.scored, c.rules, minute_s=U)


# ------------------------------------------------------------------ LIP-19 / LIP-22 / LIP-24 / LIP-17
@query("lip19_regional_signals", with_("ev", "applications", extra=[("rv", f"""SELECT e.ts, a.infrastructure_group AS region,
  CASE WHEN (list_position(['click', 'error', 'purchase', 'signup', 'view'], e.event_type) - 1) * 3 + e.user_id % 3 BETWEEN 0 AND 13
       THEN {NAMES}[(list_position(['click', 'error', 'purchase', 'signup', 'view'], e.event_type) - 1) * 3 + e.user_id % 3 + 1]
       ELSE e.event_type || '_' || CAST(e.user_id % 3 AS VARCHAR) END AS signal_name, e.value
FROM ev e JOIN applications a ON a.application_id = e.app""")]) + f"""
SELECT signal_name, COALESCE(region, 'GLOBAL') AS region, {sr4('avg(value)')} AS numeric_value, count(*) AS samples
FROM rv WHERE ts >= {ASOF} - to_seconds({24 * U}) GROUP BY ROLLUP (signal_name, region) HAVING signal_name IS NOT NULL""")
def lip19(spark, sf_dir):
    m = Model(spark, sf_dir)
    e = m.events()
    a = m.applications().select("application_id", F.col("infrastructure_group").alias("region"))
    idx = (F.array_position(F.array(*[F.lit(t) for t in Model.EVENT_TYPES]), F.col("event_type")) - 1) * 3 + F.col("user_id") % 3
    names = F.array(*[F.lit(n) for n in L.SIGNAL_NAMES])
    name = F.when((idx >= 0) & (idx < len(L.SIGNAL_NAMES)), F.element_at(names, (idx + 1).cast("int"))) \
        .otherwise(F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 3).cast("string")))
    rv = e.join(F.broadcast(a), e.app == a.application_id).select("ts", "region", name.alias("signal_name"), "value")
    return L.regional_signals(rv, m.as_of(), 24 * U)


# Configuration items (adapter): incident -> ci-<custkey % 50>; a CI is on the call path when its number % 7 = 0.
@query("lip22_incident_scope", with_("incidents", extra=[("cim", """SELECT o_orderkey AS incident_id,
  'ci-' || CAST(o_custkey % 50 AS VARCHAR) AS ci, (o_custkey % 50) % 7 = 0 AS call_path FROM orders""")]) + """
SELECT ci, call_path, count(*) AS incidents, string_agg(DISTINCT assignment_group, ',' ORDER BY assignment_group) AS groups,
  count(*) > 1 AS shared, CASE WHEN call_path THEN 'accept_R3' ELSE 'weaken_R3' END AS rule_r3
FROM incidents JOIN cim USING (incident_id) WHERE state IN ('Open', 'In Progress') GROUP BY ci, call_path""")
def lip22(spark, sf_dir):
    m = Model(spark, sf_dir)
    o = m.raw("orders")
    ci = o.select(F.col("o_orderkey").alias("incident_id"),
                  F.concat(F.lit("ci-"), (F.col("o_custkey") % 50).cast("string")).alias("ci"),
                  ((F.col("o_custkey") % 50) % 7 == 0).alias("call_path"))
    return L.incident_scope(m.incidents(groups=True), ci)


@query("lip24_ivr_overflow", with_("ev", extra=[("c", """SELECT date_trunc('day', ts) AS period,
  count(*) FILTER (WHERE event_type IN ('view', 'click')) * 100.0 / count(*) AS containment_pct, count(*) AS n FROM ev GROUP BY 1""")]) + f"""
SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, {sr4('containment_pct')} AS containment_pct,
  {sr4('greatest(0.0, ((SELECT avg(containment_pct) FROM c) - containment_pct) / 100.0) * ((SELECT avg(n) FROM c) / 24.0)')} AS extra_calls_per_hour FROM c""")
def lip24(spark, sf_dir):
    """Containment = self-service (view/click) share per day; baseline = mean daily containment;
    volume per hour = mean daily contacts / 24."""
    m = Model(spark, sf_dir)
    e = m.events()
    c = e.groupBy(F.date_trunc("day", "ts").alias("p")).agg(
        (F.sum(F.col("event_type").isin("view", "click").cast("int")) * 100.0 / F.count(F.lit(1))).alias("containment_pct"),
        F.count(F.lit(1)).alias("n"))
    base = c.agg(F.avg("containment_pct")).scalar()
    vol = c.agg(F.avg("n") / 24.0).scalar()
    out = L.ivr_overflow(c.withColumnRenamed("p", "period"), vol, base)
    return out.withColumn("period", ts_text("period"))


@query("lip17_multi_correlation", _ctes(*CORR_CTES, ("subs", """SELECT signal_name AS parent_signal, 'series-' || signal_name AS sub_name,
  status, healthy_threshold AS threshold FROM latest""")) + f"""
SELECT l.parent_signal, a.signal_a AS correlated_signal,
  replace(replace(replace(replace(replace({_q([t for t in L.INSIGHT_TEMPLATES if t[0] == 7][0][3])},
    '{{signal_a}}', l.parent_signal), '{{threshold}}', printf('%.0f', {srnd('l.thr', 0)}) || '%'), '{{sub_signals}}', l.subs),
    '{{correlated_signal}}', a.signal_a), '{{recommended_action}}', a.recommended_action) AS insight_text
FROM (SELECT parent_signal, string_agg(sub_name, ', ' ORDER BY sub_name) AS subs, min(threshold) AS thr FROM subs
      WHERE status <> 'healthy' GROUP BY 1) l JOIN active a ON a.signal_b = l.parent_signal""")
def lip17(spark, sf_dir):
    """Sub-signals here: each degraded signal's own series; the correlated signal comes from the active rules."""
    c = _Ctx(spark, sf_dir)
    return L.multi_correlation(_series_subs(c), c.active(), L.insight_templates(spark))


def run_cycle(spark, sf_dir):
    """One leading-indicator cycle as a job: snapshots computed and checkpointed once, then the
    scoring, domain, enterprise, correlation, alert, ETA and outage stages all read them.
    Returns the stage results (DataFrames) by name."""
    c = _Ctx(spark, sf_dir)
    active = c.active()
    doms = L.domain_scores(c.latest, c.dmap)
    _, alerts = _alert_parts(c)
    return {"domain_scores": doms, "enterprise_score": L.enterprise_score(doms), "correlations": active,
            "new_alerts": alerts, "eta": L.eta(c.snap, c.cfg, c.as_of, window_s=15 * U, per_s=U, max_eta=60),
            "outage_probability": L.outage_probability(c.latest, active)}
