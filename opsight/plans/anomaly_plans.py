"""Registered anomaly queries (ANO-*) over daily points derived from `events`, with DuckDB oracles.

The oracle restates the method with DuckDB list lambdas (mean, sample SD, median,
MAD, OLS, a list_reduce fold for Holt), independently of the Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import _A, _B, _C, _D, _P_LOW
from ..operators import anomaly as A
from ..session import checkpoint_dir
from ..sources.adapters import Model
from .oracle_base import ASOF, r4, rnd, tstext, with_
from .registry import query


def _hist(spark, sf_dir):
    """Histories of one run: one row per metric (bounded), written once to the shared checkpoint
    folder so the result projection and the count of tested metrics both read them."""
    m = Model(spark, sf_dir)
    checkpoint_dir(spark)
    return m, A.metric_histories(m.metrics_raw(), m.metric_config(), n=20).checkpoint()


def _results(spark, sf_dir):
    m, h = _hist(spark, sf_dir)
    return A.run_anomaly(h, m.as_of())


# ----------------------------------------------------------------------------- SQL pieces
def _logit(x: str) -> str:
    c = f"greatest(0.001::DOUBLE, least(0.999::DOUBLE, CAST({x} AS DOUBLE)))"
    return f"ln({c} / (1.0::DOUBLE - {c}))"


def _poly(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"(({acc}) * {x} + {c!r})"
    return acc


def _inv_norm(p: str) -> str:
    qlo = f"sqrt(-2.0 * ln({p}))"
    qhi = f"sqrt(-2.0 * ln(1.0 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    return (f"CASE WHEN {p} < {_P_LOW} THEN {_poly(_C, qlo)} / ({_poly(_D, qlo)} * {qlo} + 1.0) "
            f"WHEN {p} <= {1 - _P_LOW} THEN {_poly(_A, r)} * {q} / ({_poly(_B, r)} * {r} + 1.0) "
            f"ELSE -({_poly(_C, qhi)} / ({_poly(_D, qhi)} * {qhi} + 1.0)) END")


def _fixed(x: str, d: int) -> str:
    return f"printf('%.{d}f', {rnd(x, d)})"


def _fmt4_list(lst: str) -> str:
    return f"'[' || array_to_string(list_transform({lst}, lambda v: printf('%.4f', {r4('v')})), ', ') || ']'"


ANO_ADAPTER = [
    ("g", "SELECT user_id % 5 AS k, date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(value) AS s "
          "FROM ev GROUP BY ALL"),
    ("pk", "SELECT k, day, sum(n) AS n, sum(CASE WHEN event_type = 'error' THEN n ELSE 0 END) AS ne FROM g GROUP BY ALL"),
    ("raw", "SELECT event_type || '_' || k AS metric_id, day AS recorded_at, s / n AS value FROM g "
            "UNION ALL SELECT 'error_share_' || k, day, ne / n FROM pk "
            "UNION ALL SELECT 'success_share_' || k, day, 1.0 - ne / n FROM pk "
            "UNION ALL SELECT 'daily_events_' || k, day, CAST(n AS DOUBLE) FROM pk"),
    ("cfg", "SELECT DISTINCT event_type || '_' || k AS metric_id, 'Traffic' AS category, 'unbounded_count' AS metric_type, "
            "'both' AS direction, CAST(NULL AS DOUBLE) AS capacity, 'value' AS unit FROM g "
            "UNION ALL SELECT 'error_share_' || k, 'Reliability', 'bounded_ratio', 'higher_is_bad', NULL, '%' FROM pk GROUP BY k "
            "UNION ALL SELECT 'success_share_' || k, 'Reliability', 'bounded_ratio', 'lower_is_bad', NULL, '%' FROM pk GROUP BY k "
            "UNION ALL SELECT 'daily_events_' || k, 'Capacity', 'bounded_capacity', 'higher_is_bad', max(n) * 1.2, 'events' "
            "FROM pk GROUP BY k"),
    ("top", "SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY recorded_at DESC) AS rn FROM raw"),
    ("hist", "SELECT h.metric_id, h.h, cfg.* EXCLUDE (metric_id), h.metric_id AS metric_name, len(h.h) AS n, "
             "h.h[-1] AS cur, CAST(floor(len(h.h) * 0.7) AS INTEGER) AS m FROM "
             "(SELECT metric_id, list(value ORDER BY recorded_at) AS h FROM top WHERE rn <= 20 GROUP BY 1) h "
             "JOIN cfg USING (metric_id)"),
]

NT = "(SELECT count(*) FROM hist)"
CRIT = _inv_norm(f"(1.0 - 0.005 / {NT})")
ELEV = _inv_norm(f"(1.0 - 0.05 / {NT})")

ANO_STAGES = ANO_ADAPTER + [
    ("s1", f"""SELECT *, list_slice(h, 1, greatest(m, 1)) AS base,
  list_transform(list_slice(h, 1, greatest(m, 1)), lambda x: {_logit('x')}) AS lb,
  list_transform(list_slice(h, 1, greatest(m, 1)), lambda x: {_logit('x / capacity')}) AS cb,
  list_median(list_slice(h, 1, greatest(m, 1))) AS bmed, list_avg(list_slice(h, 1, greatest(m, 1))) AS bmean,
  (n - 1) / 2.0 AS xm, list_avg(h) AS ym FROM hist"""),
    ("s2", f"""SELECT *,
  CASE WHEN metric_type = 'bounded_ratio' THEN list_avg(lb)
       WHEN metric_type = 'bounded_capacity' AND capacity > 0 THEN list_avg(cb) ELSE bmed END AS mu,
  CASE WHEN metric_type = 'bounded_ratio' THEN list_stddev_samp(lb)
       WHEN metric_type = 'bounded_capacity' AND capacity > 0 THEN list_stddev_samp(cb)
       ELSE 1.4826 * list_median(list_transform(base, lambda x: abs(x - bmed))) END AS sigma,
  CASE WHEN metric_type = 'bounded_ratio' THEN {_logit('cur')}
       WHEN metric_type = 'bounded_capacity' AND capacity > 0 THEN {_logit('cur / capacity')} ELSE cur END AS cur_t,
  CASE WHEN metric_type = 'bounded_ratio' THEN 'Logit-Z' WHEN metric_type = 'bounded_capacity' THEN 'Capacity-Logit-Z'
       ELSE 'Median-MAD' END AS method,
  list_sum(list_transform(h, lambda y, i: (i - 1 - xm) * (y - ym))) AS sxy,
  list_sum(list_transform(h, lambda y, i: (i - 1 - xm) * (i - 1 - xm))) AS sxx,
  list_sum(list_transform(h, lambda y: (y - ym) * (y - ym))) AS sst,
  list_stddev_samp(h) AS sdy,
  list_reduce(list_transform(list_slice(h, 2, n), lambda y: [y, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]),
    lambda s, e: [0.3 * e[1] + 0.7 * (s[1] + s[2]),
                  0.1 * ((0.3 * e[1] + 0.7 * (s[1] + s[2])) - s[1]) + 0.9 * s[2],
                  s[3] + (e[1] - (s[1] + s[2])) * (e[1] - (s[1] + s[2])), s[4] + 1.0],
    [h[1], (h[3] - h[1]) / 2.0, 0.0::DOUBLE, 0.0::DOUBLE]) AS hw
FROM s1"""),
    ("s3", f"""SELECT *, CASE WHEN sigma > 0 THEN (cur_t - mu) / sigma ELSE 0.0 END AS z,
  CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0.0 END AS slope, hw[1] AS lvl, hw[2] AS trd,
  CASE WHEN hw[4] >= 2 THEN sqrt(hw[3] / (hw[4] - 1)) ELSE 0.0 END AS se,
  CASE WHEN metric_type = 'bounded_ratio' AND direction = 'lower_is_bad' THEN 0.70
       WHEN metric_type = 'bounded_ratio' THEN 0.95
       WHEN metric_type = 'bounded_capacity' AND capacity > 0 THEN capacity * 0.95 ELSE bmed * 2.0 END AS thr,
  (n < 20) OR (metric_type = 'bounded_capacity' AND (capacity IS NULL OR capacity <= 0)) AS insufficient,
  {CRIT} AS crit, {ELEV} AS elev, 0.05 / {NT} AS alpha
FROM s2"""),
    ("s4", f"""SELECT *,
  CASE WHEN direction = 'lower_is_bad' THEN -z WHEN direction = 'higher_is_bad' THEN z ELSE abs(z) END AS score,
  CASE WHEN sst > 0 THEN 1.0 - list_sum(list_transform(h, lambda y, i: (y - (ym + slope * (i - 1 - xm))) ^ 2)) / sst
       ELSE 0.0 END AS r2,
  CASE WHEN sdy > 0 THEN slope / sdy ELSE 0.0 END AS snorm,
  list_filter(range(1, 51), lambda k: CASE WHEN direction = 'lower_is_bad' THEN lvl + k * trd < thr
                                           ELSE lvl + k * trd > thr END)[1] AS periods,
  CASE WHEN direction = 'lower_is_bad' THEN cur < thr ELSE cur > thr END AS breached
FROM s3"""),
    ("s5", """SELECT *, CASE WHEN score > crit THEN 'Critical' WHEN score > elev THEN 'Elevated' ELSE 'Nominal' END AS risk,
  CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS sdir,
  CASE WHEN metric_type = 'bounded_capacity' THEN 'port_usage' WHEN metric_type = 'bounded_ratio' THEN 'self_serve'
       ELSE 'rpm' END AS rule_set FROM s4"""),
]


def _clamp(x: str, lower_only: bool = False) -> str:
    c = f"CASE WHEN metric_type = 'bounded_ratio' THEN greatest(0.0, least(1.0, {x})) ELSE {x} END"
    if lower_only:
        return f"CASE WHEN metric_type = 'bounded_capacity' THEN greatest(0.0, {x}) ELSE {c} END"
    return c


def _rule_cond(kind, param) -> str:
    return {
        "breached": "breached",
        "breach_within": f"(periods IS NOT NULL AND periods <= {param})",
        "risk_not_nominal": "risk <> 'Nominal'",
        "critical_breached": "(score > crit AND breached)",
        "critical": "score > crit",
        "elevated": "score > elev",
        "negative_trend": "(slope < 0 AND r2 > 0.5)",
        "critical_up": "(score > crit AND slope > 0)",
        "critical_down": "(score > crit AND slope < 0)",
        "always": "TRUE",
    }[kind]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule_case(pos: int, default: str) -> str:
    arms = " ".join(f"WHEN rule_set = {_q(rs)} AND COALESCE({_rule_cond(k, p)}, FALSE) THEN {_q(row[pos])}"
                    for row in A.ACTION_RULES for rs, k, p in [row[:3]])
    return f"CASE {arms} ELSE {_q(default)} END"


def _full(x: str) -> str:
    return f"CASE WHEN NOT insufficient THEN {x} END"


R2TXT = _fixed("r2", 2)
RESULT_SELECT = f"""SELECT 'run-' || strftime({ASOF}, '%Y%m%d%H%M%S') AS run_id, {tstext(ASOF)} AS run_timestamp,
  metric_id, metric_name, category, {r4('cur')} AS current_value,
  CASE WHEN insufficient THEN CAST(cur AS VARCHAR)
       WHEN metric_type = 'bounded_ratio' AND unit = '%' THEN {_fixed('cur * 100', 1)} || '%'
       WHEN metric_type = 'bounded_ratio' THEN {_fixed('cur', 3)}
       WHEN metric_type = 'bounded_capacity' AND capacity IS NOT NULL AND capacity <> 0
            THEN CAST(CAST(trunc(cur) AS BIGINT) AS VARCHAR) || ' / ' || CAST(CAST(trunc(capacity) AS BIGINT) AS VARCHAR)
       ELSE printf('%,.0f', cur) END AS formatted_value,
  CASE WHEN insufficient THEN 'N/A' ELSE method END AS method, metric_type, direction,
  {r4('CASE WHEN insufficient THEN 0.0 ELSE mu END')} AS baseline_mu,
  {r4('CASE WHEN insufficient THEN 0.0 ELSE sigma END')} AS baseline_sigma,
  CAST(CASE WHEN insufficient THEN 0 ELSE m END AS BIGINT) AS baseline_n,
  {r4('CASE WHEN insufficient THEN 0.0 ELSE z END')} AS z_score_raw,
  {r4('CASE WHEN insufficient THEN 0.0 ELSE score END')} AS anomaly_score,
  CASE WHEN insufficient THEN 'Insufficient Data' ELSE risk END AS risk_level,
  CASE WHEN insufficient THEN printf('Need ≥%d data points, only %d available', 20, n)
       ELSE CASE WHEN risk = 'Critical' THEN 'Extreme anomaly (Bonferroni-adjusted p < ' || {_fixed('alpha', 3)} || ')'
                 WHEN risk = 'Elevated' THEN 'Significant deviation beyond adjusted threshold'
                 ELSE 'Within expected statistical range' END
         || CASE WHEN direction = 'lower_is_bad' AND cur < bmean THEN ' ▼ Value is below baseline (degradation).'
                 WHEN direction = 'higher_is_bad' AND cur > bmean THEN ' ▲ Value exceeds baseline (approaching capacity).'
                 ELSE '' END END AS risk_description,
  {r4(_full('slope'))} AS trend_slope, {r4(_full('r2'))} AS trend_r_squared, {r4(_full('snorm'))} AS trend_slope_norm,
  {_full("CASE WHEN r2 > 0.85 THEN 'Strong ' || sdir || ' trend' WHEN r2 > 0.5 THEN 'Moderate ' || sdir || ' trend' ELSE 'No significant trend' END")} AS trend_classification,
  {_full(f"CASE WHEN r2 > 0.85 THEN 'Strong linear trend ' || sdir || ' (R²=' || {R2TXT} || ')' WHEN r2 > 0.5 THEN 'Moderate ' || sdir || ' trend (R²=' || {R2TXT} || ')' ELSE 'No significant trend pattern (R²=' || {R2TXT} || ')' END")} AS trend_description,
  {r4('crit')} AS sigma_critical, {r4('elev')} AS sigma_elevated, {r4('alpha')} AS bonferroni_alpha,
  CAST({NT} AS BIGINT) AS num_metrics_tested, CAST(n AS BIGINT) AS history_length, {_fmt4_list('h')} AS history_values,
  {r4(_full('lvl'))} AS hw_level, {r4(_full('trd'))} AS hw_trend, {_full('0.3::DOUBLE')} AS hw_alpha, {_full('0.1::DOUBLE')} AS hw_beta,
  {r4(_full(_clamp('lvl + trd')))} AS forecast_h1, {r4(_full(_clamp('lvl + 3 * trd')))} AS forecast_h3,
  {r4(_full(_clamp('lvl + 5 * trd')))} AS forecast_h5,
  {_full(_fmt4_list('list_transform(range(1, 6), lambda k: ' + _clamp('lvl + k * trd') + ')'))} AS forecast_values,
  {r4(_full(_clamp('lvl + 5 * trd + 1.96 * se * sqrt(5.0)')))} AS ci_95_upper_h5,
  {r4(_full(_clamp('lvl + 5 * trd - 1.96 * se * sqrt(5.0)', True)))} AS ci_95_lower_h5,
  {r4(_full(_clamp('lvl + 5 * trd + 1.28 * se * sqrt(5.0)')))} AS ci_80_upper_h5,
  {r4(_full(_clamp('lvl + 5 * trd - 1.28 * se * sqrt(5.0)', True)))} AS ci_80_lower_h5,
  {r4(_full('se'))} AS residual_se, {r4(_full('thr'))} AS breach_threshold,
  {_full('''CASE WHEN metric_type = 'bounded_ratio' AND direction = 'lower_is_bad' THEN 'Drops below 0.70 (Poor)'
       WHEN metric_type = 'bounded_ratio' THEN 'Exceeds 95%'
       WHEN metric_type = 'bounded_capacity' AND capacity > 0 THEN printf('Utilization exceeds 95%% (%d/%d)', CAST(trunc(capacity * 0.95) AS BIGINT), CAST(trunc(capacity) AS BIGINT))
       ELSE printf('RPM exceeds 2× baseline (%d)', CAST(trunc(thr) AS BIGINT)) END''')} AS breach_label,
  CAST({_full('periods')} AS BIGINT) AS periods_to_breach, {_full('breached')} AS currently_breached,
  {r4(_full('lvl + periods * trd'))} AS forecast_at_breach,
  {_full("CASE WHEN breached THEN 'Already Breached' WHEN periods <= 5 THEN 'Breach Imminent' WHEN periods IS NOT NULL THEN 'Breach Projected' ELSE 'No Breach' END")} AS breach_state,
  {_full(_rule_case(3, 'monitor'))} AS rx_urgency, {_full(_rule_case(4, 'No rules configured.'))} AS rx_action,
  {_full(_rule_case(5, 'N/A'))} AS rx_impact
FROM s5"""

ANO18_SQL = with_("ev", extra=ANO_STAGES + [("res", RESULT_SELECT)]) + "SELECT * FROM res"

query("ano18_run_anomaly", ANO18_SQL, headline=True)(_results)

ANO1_SQL = with_("ev", extra=ANO_ADAPTER) + f"""
SELECT metric_id, metric_type, direction, CAST(n AS BIGINT) AS history_length, {r4('cur')} AS current_value,
  {_fmt4_list('h')} AS history_values FROM hist"""


@query("ano1_metric_histories", ANO1_SQL)
def ano1(spark, sf_dir):
    _, h = _hist(spark, sf_dir)
    return h.select("metric_id", "metric_type", "direction", F.size("history").cast("long").alias("history_length"),
                    A.r4("current_value").alias("current_value"), A._fmt4_list(F.col("history")).alias("history_values"))


ANO19_SQL = with_("ev", extra=ANO_STAGES) + f"""
SELECT metric_id, metric_name, metric_type, direction, {r4('cur')} AS current_value,
  CASE WHEN n < 20 THEN 'N/A' ELSE method END AS method,
  {r4('CASE WHEN n < 20 THEN 0.0 ELSE mu END')} AS baseline_mu, {r4('CASE WHEN n < 20 THEN 0.0 ELSE sigma END')} AS baseline_sigma,
  {r4('CASE WHEN n < 20 THEN 0.0 ELSE z END')} AS z_score_raw, {r4('CASE WHEN n < 20 THEN 0.0 ELSE score END')} AS anomaly_score,
  CASE WHEN n < 20 THEN 'Insufficient Data' ELSE risk END AS risk_level FROM s5"""


@query("ano19_two_tier", ANO19_SQL)
def ano19(spark, sf_dir):
    _, h = _hist(spark, sf_dir)
    return A.two_tier(h)


RISKS = ["Critical", "Elevated", "Nominal", "Insufficient Data"]
ANO20_SQL = with_("ev", extra=ANO_STAGES + [("res", RESULT_SELECT), ("rk", """SELECT *,
  CASE risk_level WHEN 'Critical' THEN 1 WHEN 'Elevated' THEN 2 WHEN 'Nominal' THEN 3 ELSE 4 END AS sev,
  row_number() OVER (PARTITION BY run_id ORDER BY CASE risk_level WHEN 'Critical' THEN 1 WHEN 'Elevated' THEN 2
    WHEN 'Nominal' THEN 3 ELSE 4 END, anomaly_score DESC, metric_id) AS rk FROM res""")]) + """
SELECT run_id, CAST(count(*) AS BIGINT) AS metrics,
  CAST(count(*) FILTER (WHERE risk_level = 'Critical') AS BIGINT) AS n_critical,
  CAST(count(*) FILTER (WHERE risk_level = 'Elevated') AS BIGINT) AS n_elevated,
  CAST(count(*) FILTER (WHERE risk_level = 'Nominal') AS BIGINT) AS n_nominal,
  CAST(count(*) FILTER (WHERE risk_level = 'Insufficient Data') AS BIGINT) AS n_insufficient_data,
  max(CASE WHEN rk = 1 THEN metric_id END) AS top_risk_metric, max(CASE WHEN rk = 1 THEN anomaly_score END) AS top_risk_score,
  max(CASE WHEN rk = 2 THEN metric_id END) AS next_risk_metric, max(CASE WHEN rk = 2 THEN anomaly_score END) AS next_risk_score,
  CASE min(sev) WHEN 1 THEN 'Critical' WHEN 2 THEN 'Elevated' WHEN 3 THEN 'Nominal' ELSE 'Insufficient Data' END AS overall_status
FROM rk GROUP BY run_id"""


@query("ano20_executive_summary", ANO20_SQL)
def ano20(spark, sf_dir):
    return A.executive_summary(_results(spark, sf_dir))


ANO21_SQL = with_("ev", extra=ANO_STAGES + [("res", RESULT_SELECT)]) + f"""
SELECT run_id, metric_id, risk_level, concat_ws(' ',
  metric_name || ' is at ' || formatted_value || '.',
  CASE WHEN risk_level = 'Insufficient Data' THEN risk_description
       ELSE 'Risk ' || risk_level || ' at ' || {_fixed('anomaly_score', 2)} || 'σ (' || method || ').' END,
  CASE WHEN trend_description IS NOT NULL THEN trend_description || '.' END,
  CASE WHEN breach_state = 'Already Breached' THEN 'Already breached: ' || breach_label || '.'
       WHEN periods_to_breach IS NOT NULL THEN printf('Breach in ~%d periods: %s.', periods_to_breach, breach_label) END,
  CASE WHEN rx_action IS NOT NULL THEN 'Action (' || rx_urgency || '): ' || rx_action END) AS narrative
FROM res"""


@query("ano21_narratives", ANO21_SQL)
def ano21(spark, sf_dir):
    return A.narratives(_results(spark, sf_dir))


# A watch list with lower limits than the adjusted ones (1 and 0.5 SDs), so that actions and alerts come up.
WATCH = (0.5, 1.0)
WATCH_STAGES = [(n, q.replace(f"{CRIT} AS crit, {ELEV} AS elev", f"{WATCH[1]} AS crit, {WATCH[0]} AS elev")) for n, q in ANO_STAGES]


def _watched(spark, sf_dir):
    """The saved result of a run on the watch list: its readers don't compute it again."""
    m, h = _hist(spark, sf_dir)
    return A.run_anomaly(h, m.as_of(), thresholds=WATCH).checkpoint()


ANO22_SQL = with_("ev", extra=WATCH_STAGES + [("res", RESULT_SELECT)]) + """
SELECT run_id, metric_id, metric_name, risk_level, anomaly_score, rx_urgency, rx_action, rx_impact,
  row_number() OVER (ORDER BY CASE rx_urgency WHEN 'urgent' THEN 1 ELSE 2 END, anomaly_score DESC, metric_id) AS priority
FROM res WHERE rx_urgency IN ('urgent', 'moderate')"""


@query("ano22_action_list", ANO22_SQL)
def ano22(spark, sf_dir):
    return A.action_list(_watched(spark, sf_dir))


ANO23_SQL = with_("ev", extra=WATCH_STAGES + [("res", RESULT_SELECT)]) + """
SELECT run_id, metric_id, metric_name, current_value, anomaly_score, risk_description, breach_state, rx_urgency, rx_action
FROM res WHERE risk_level = 'Critical'"""


@query("ano23_critical_alerts", ANO23_SQL)
def ano23(spark, sf_dir):
    return A.critical_alerts(_watched(spark, sf_dir))


ANO16_SQL = with_("ev", extra=ANO_STAGES + [("res", RESULT_SELECT)]) + """
SELECT *, CASE rx_urgency WHEN 'urgent' THEN 'Immediate (< 15 min)' WHEN 'moderate' THEN 'Within 1 hour'
  WHEN 'monitor' THEN 'Next scheduled review' END AS response_time FROM res"""


@query("ano16_urgency", ANO16_SQL)
def ano16(spark, sf_dir):
    return A.urgency(_results(spark, sf_dir))


# ------------------------------------------------------------------ ANO-2..17 as registered projections of the result
STEP_COLUMNS = {
    "ano2_baseline_split": ["history_length", "baseline_n", "risk_level"],
    "ano3_6_z_scores": ["metric_type", "method", "baseline_mu", "baseline_sigma", "z_score_raw"],
    "ano7_directional": ["direction", "z_score_raw", "anomaly_score"],
    "ano8_bonferroni": ["num_metrics_tested", "bonferroni_alpha", "sigma_elevated", "sigma_critical"],
    "ano9_risk": ["anomaly_score", "risk_level", "risk_description"],
    "ano10_ols_trend": ["trend_slope", "trend_r_squared", "trend_slope_norm", "trend_classification", "trend_description"],
    "ano11_holt": ["hw_level", "hw_trend", "hw_alpha", "hw_beta"],
    "ano12_forecast": ["forecast_h1", "forecast_h3", "forecast_h5", "forecast_values"],
    "ano13_intervals": ["residual_se", "ci_95_upper_h5", "ci_95_lower_h5", "ci_80_upper_h5", "ci_80_lower_h5"],
    "ano14_time_to_breach": ["breach_threshold", "breach_label", "periods_to_breach", "currently_breached",
                             "forecast_at_breach", "breach_state"],
    "ano15_prescription": ["risk_level", "rx_urgency", "rx_action", "rx_impact"],
    "ano17_formatted_value": ["metric_type", "current_value", "formatted_value"],
}


def _step(cols):
    def fn(spark, sf_dir):
        return _results(spark, sf_dir).select("metric_id", *cols)
    return fn


for _key, _cols in STEP_COLUMNS.items():
    query(_key, with_("ev", extra=ANO_STAGES + [("res", RESULT_SELECT)]) + "SELECT metric_id, " + ", ".join(_cols) + " FROM res")(
        _step(_cols))


# ------------------------------------------------------------------ ANO-24: the same engine on another domain
# Daily cost per line status and return flag from lineitem (Σ extended price x (1 - discount)), unbounded,
# higher is bad, with the cost rules and a label of its own. Configuration only: the operators are unchanged.
COST_LABEL = "Daily cost above twice its baseline"
COST_ADAPTER = [
    ("raw", "SELECT 'cost_' || l_returnflag || l_linestatus AS metric_id, CAST(l_shipdate AS TIMESTAMP) AS recorded_at, "
            "sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY ALL"),
    ("cfg", "SELECT DISTINCT metric_id, 'Cloud Cost' AS category, 'unbounded_count' AS metric_type, 'higher_is_bad' AS direction, "
            "CAST(NULL AS DOUBLE) AS capacity, '$' AS unit, "
            "CASE WHEN metric_id LIKE 'cost_N%' THEN 'storage_growth_rate' ELSE 'monthly_azure_spend' END AS set_rules FROM raw"),
    ("top", "SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY recorded_at DESC) AS rn FROM raw"),
    ANO_ADAPTER[-1],
]
_DEFAULT_RULES = """CASE WHEN metric_type = 'bounded_capacity' THEN 'port_usage' WHEN metric_type = 'bounded_ratio' THEN 'self_serve'
       ELSE 'rpm' END AS rule_set"""
_DEFAULT_LABEL = "ELSE printf('RPM exceeds 2× baseline (%d)', CAST(trunc(thr) AS BIGINT)) END"
COST_STAGES = [(n, q.replace(_DEFAULT_RULES, "set_rules AS rule_set")) for n, q in ANO_STAGES[len(ANO_ADAPTER):]]
assert COST_STAGES != ANO_STAGES[len(ANO_ADAPTER):] and _DEFAULT_LABEL in RESULT_SELECT
ANO24_SQL = with_("ev", extra=COST_ADAPTER + COST_STAGES + [("res", RESULT_SELECT.replace(_DEFAULT_LABEL, f"ELSE '{COST_LABEL}' END"))]) + "SELECT * FROM res"


@query("ano24_other_domain", ANO24_SQL)
def ano24(spark, sf_dir):
    m = Model(spark, sf_dir)
    li = m.raw("lineitem")
    raw = li.groupBy(F.concat(F.lit("cost_"), F.col("l_returnflag"), F.col("l_linestatus")).alias("metric_id"),
                     F.col("l_shipdate").cast("timestamp").alias("recorded_at")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    cfg = raw.select("metric_id").distinct().select(
        "metric_id", F.col("metric_id").alias("metric_name"), F.lit("Cloud Cost").alias("category"),
        F.lit("unbounded_count").alias("metric_type"), F.lit("higher_is_bad").alias("direction"),
        F.lit(None).cast("double").alias("capacity"), F.lit("$").alias("unit"), F.lit(20).alias("history_min_points"),
        F.lit(True).alias("is_active"), F.when(F.col("metric_id").startswith("cost_N"), "storage_growth_rate").otherwise("monthly_azure_spend").alias("rule_set"),
        F.lit(COST_LABEL).alias("breach_label"))
    return A.run_anomaly(A.metric_histories(raw, cfg, n=20), m.as_of())
