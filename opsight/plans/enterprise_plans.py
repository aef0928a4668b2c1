"""Registered git statistics (GIT-*), KPI roll-ups (KPI-*) and enterprise indicators (IND-*),
with DuckDB oracles. as_of: calls -> max(l_shipdate), incidents -> max(o_orderdate), contacts -> max(ts).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import DAY
from ..operators import gitstats as G
from ..operators import indicators as I
from ..operators import kpi as K
from ..sources.adapters import Model
from .oracle_base import r4, rnd, tstext, with_
from .registry import query

CALLS_ASOF = "(SELECT CAST(max(l_shipdate) AS TIMESTAMP) FROM lineitem)"
INC_ASOF = "(SELECT CAST(max(o_orderdate) AS TIMESTAMP) FROM orders)"
EV_ASOF = "(SELECT max(CAST(ts AS TIMESTAMP)) FROM events)"
SINCE, UNTIL = "1996-01-01", "2000-12-31 23:59:59"


def _calls_asof(m: Model):
    return m.newest("lineitem", "l_shipdate")


def _inc_asof(m: Model):
    return m.newest("orders", "o_orderdate")


def _since(col: str, asof: str, seconds: int) -> str:
    return f"{col} >= {asof} - to_seconds({seconds})"


def _status(v: str, target: float, crit: float, higher=True, inclusive=False) -> str:
    if higher:
        return f"CASE WHEN {v} IS NULL THEN 'No Data' WHEN {v} < {crit} THEN 'Critical' WHEN {v} >= {target} THEN 'Healthy' ELSE 'At Risk' END"
    return f"CASE WHEN {v} IS NULL THEN 'No Data' WHEN {v} > {crit} THEN 'Critical' WHEN {v} {'<=' if inclusive else '<'} {target} THEN 'Healthy' ELSE 'At Risk' END"


def _mmss(sec: str) -> str:
    return f"printf('%d:%02d', CAST(trunc(round({sec}) / 60) AS BIGINT), CAST(round({sec}) AS BIGINT) % 60)"


# ------------------------------------------------------------------ GIT-1..4
PERIOD = f"committed_at >= TIMESTAMP '{SINCE}' AND committed_at <= TIMESTAMP '{UNTIL}'"
NUM = "regexp_full_match(added, '\\d+') AND regexp_full_match(deleted, '\\d+')"


@query("git1_contributions", with_("numstat") + f"""SELECT repo, branch, author, CAST(sum(CAST(added AS BIGINT)) AS BIGINT) AS lines_added,
  CAST(sum(CAST(deleted AS BIGINT)) AS BIGINT) AS lines_deleted,
  CAST(sum(CAST(added AS BIGINT)) - sum(CAST(deleted AS BIGINT)) AS BIGINT) AS net_lines,
  count(DISTINCT commit) AS commits FROM numstat WHERE {PERIOD} AND {NUM} GROUP BY ALL""")
def git1(spark, sf_dir):
    return G.contributions(Model(spark, sf_dir).numstat(), SINCE, UNTIL)


@query("git2_active_branches", with_("numstat") + f"SELECT DISTINCT repo, branch FROM numstat WHERE {PERIOD}")
def git2(spark, sf_dir):
    return G.active_branches(Model(spark, sf_dir).numstat(authors=False), SINCE, UNTIL)


@query("git3_lines_per_branch", with_("numstat") + f"""SELECT repo, branch, CAST(sum(lines) AS BIGINT) AS total_lines, count(*) AS files
FROM (SELECT repo, branch, path, sum(CAST(added AS BIGINT)) - sum(CAST(deleted AS BIGINT)) AS lines FROM numstat
      WHERE {NUM} GROUP BY ALL) WHERE lines > 0 GROUP BY ALL""")
def git3(spark, sf_dir):
    return G.lines_per_branch(Model(spark, sf_dir).numstat(authors=False))


@query("git4_author_branches", with_("numstat") + f"""SELECT author, string_agg(DISTINCT repo || '/' || branch, ';' ORDER BY repo || '/' || branch) AS branches,
  count(DISTINCT (repo, branch)) AS branch_count FROM numstat WHERE {PERIOD} GROUP BY author""")
def git4(spark, sf_dir):
    return G.author_branches(Model(spark, sf_dir).numstat(), SINCE, UNTIL)


# ------------------------------------------------------------------ KPI
@query("kpi1_vendor_scorecard", with_("calls") + f"""SELECT vendor_id, {tstext('period')} AS period, agents, agents_impacted,
  CAST(calls AS BIGINT) AS calls, CAST(disc AS BIGINT) AS disconnected, CAST(deg AS BIGINT) AS degraded, {r4('ip')} AS impacted_pct,
  {r4('ip - lag(ip) OVER (PARTITION BY vendor_id ORDER BY period)')} AS impacted_pct_change FROM (
  SELECT vendor_id, period, count(*) AS agents, count(*) FILTER (WHERE deg > 0) AS agents_impacted, sum(n) AS calls,
    sum(disc) AS disc, sum(deg) AS deg, (count(*) FILTER (WHERE deg > 0)) * 100.0 / count(*) AS ip FROM (
    SELECT vendor_id, date_trunc('month', call_time) AS period, agent_id, count(*) AS n,
      count(*) FILTER (WHERE queue = 'R') AS disc, count(*) FILTER (WHERE mos < 3.5) AS deg FROM calls GROUP BY ALL)
  GROUP BY ALL)""")
def kpi1(spark, sf_dir):
    return K.vendor_scorecard(Model(spark, sf_dir).calls_geo())


def _period_sql():
    d0 = f"date_trunc('day', {CALLS_ASOF})"
    defs = {
        "today": (d0, f"{d0} + INTERVAL 1 DAY"),
        "yesterday": (f"{d0} - INTERVAL 1 DAY", d0),
        "last_7_days": (f"{d0} - INTERVAL 6 DAY", f"{d0} + INTERVAL 1 DAY"),
        "last_30_days": (f"{d0} - INTERVAL 29 DAY", f"{d0} + INTERVAL 1 DAY"),
        "month_to_date": (f"date_trunc('month', {CALLS_ASOF})", f"{d0} + INTERVAL 1 DAY"),
        "quarter_to_date": (f"date_trunc('quarter', {CALLS_ASOF})", f"{d0} + INTERVAL 1 DAY"),
        "year_to_date": (f"date_trunc('year', {CALLS_ASOF})", f"{d0} + INTERVAL 1 DAY"),
    }
    parts = []
    for p in K.PERIODS:
        s, e = (f"({x})" for x in defs[p])
        parts.append(f"""SELECT '{p}' AS period,
  count(*) FILTER (WHERE call_time >= {s} AND call_time < {e}) AS calls,
  count(*) FILTER (WHERE call_time >= {s} - ({e} - {s}) AND call_time < {s}) AS previous_calls FROM calls""")
    return " UNION ALL ".join(parts)


@query("kpi2_period_compare", with_("calls", extra=[("p", _period_sql())]) + f"""SELECT period, calls, previous_calls,
  {r4('(calls - previous_calls) * 100.0 / NULLIF(previous_calls, 0)')} AS pct_change,
  CASE WHEN (calls - previous_calls) * 100.0 / NULLIF(previous_calls, 0) > 0 THEN 'up'
       WHEN (calls - previous_calls) * 100.0 / NULLIF(previous_calls, 0) < 0 THEN 'down' ELSE 'flat' END AS arrow FROM p""")
def kpi2(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.period_compare(m.calls(), _calls_asof(m))


def _chg(lag):
    return f"(d.calls - p{lag}.calls) * 100.0 / NULLIF(p{lag}.calls, 0)"


@query("kpi3_daily_change", with_("calls", extra=[("d", "SELECT CAST(call_time AS DATE) AS day, count(*) AS calls FROM calls GROUP BY 1")]) + f"""
SELECT strftime(d.day, '%Y-%m-%d') AS day, d.calls, {r4(_chg(1))} AS dod_pct, {r4(_chg(7))} AS wow_pct, {r4(_chg(28))} AS mom_pct,
  CASE WHEN {_chg(1)} > 0 THEN 'up' WHEN {_chg(1)} < 0 THEN 'down' ELSE 'flat' END AS arrow
FROM d LEFT JOIN d p1 ON p1.day + 1 = d.day LEFT JOIN d p7 ON p7.day + 7 = d.day LEFT JOIN d p28 ON p28.day + 28 = d.day""")
def kpi3(spark, sf_dir):
    return K.daily_change(Model(spark, sf_dir).calls())


@query("kpi4_impacted_series", with_("calls", extra=[("c", """SELECT *, CAST(call_time AS DATE) AS day,
  CASE WHEN queue = 'R' THEN 'disconnected' WHEN mos < 3.5 THEN 'degraded' ELSE 'ok' END AS issue FROM calls""")]) + f"""
SELECT strftime(a.day, '%Y-%m-%d') AS day, a.agents, a.impacted, {r4('a.impacted * 100.0 / a.agents')} AS impacted_pct,
  CAST(i.disconnected AS BIGINT) AS disconnected, CAST(i.degraded AS BIGINT) AS degraded FROM
  (SELECT day, count(*) AS agents, count(*) FILTER (WHERE bad > 0) AS impacted FROM
     (SELECT day, agent_id, count(*) FILTER (WHERE issue <> 'ok') AS bad FROM c GROUP BY ALL) GROUP BY day) a
  JOIN (SELECT day, count(*) FILTER (WHERE issue = 'disconnected') AS disconnected,
               count(*) FILTER (WHERE issue = 'degraded') AS degraded FROM c GROUP BY day) i USING (day)""")
def kpi4(spark, sf_dir):
    return K.impacted_series(Model(spark, sf_dir).calls())


@query("kpi5_impacted_alert", with_("calls") + f"""SELECT impacted, agents, {r4('impacted * 100.0 / agents')} AS impacted_pct,
  CAST(impacted AS VARCHAR) || ' of ' || CAST(agents AS VARCHAR) || ' agents impacted (' || printf('%.1f', {rnd('impacted * 100.0 / agents', 1)}) || '%)' AS message
FROM (SELECT count(*) FILTER (WHERE bad > 0) AS impacted, count(*) AS agents FROM (
  SELECT agent_id, count(*) FILTER (WHERE queue = 'R' OR mos < 3.5) AS bad FROM calls
  WHERE {_since('call_time', CALLS_ASOF, DAY)} GROUP BY 1))""")
def kpi5(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.impacted_alert(m.calls(), _calls_asof(m))


@query("kpi10_vendor_table", with_("calls") + f"""SELECT vendor_id, count(DISTINCT agent_id) AS agents, count(*) AS calls,
  {r4('avg(mos)')} AS quality, {r4('avg(mos) / 5.0 * 100')} AS score,
  CASE WHEN {r4('avg(mos)')} >= 4.0 THEN 'Active' WHEN {r4('avg(mos)')} >= 3.6 THEN 'Warning' ELSE 'Critical' END AS vendor_status
FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY vendor_id""")
def kpi10(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.vendor_table(m.calls_geo(), _calls_asof(m))


@query("kpi8_call_metrics", with_("calls") + f"""SELECT count(*) AS total_calls, count(*) FILTER (WHERE queue = 'R') AS errored_calls,
  count(*) FILTER (WHERE mos < 3.5) AS degraded_calls, {r4('avg(duration_min)')} AS aht_min,
  {_mmss('avg(duration_min) * 60')} AS aht_text,
  CASE WHEN avg(duration_min) <= 5.0 THEN 'on_target' ELSE 'above_target' END AS aht_status
FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)}""")
def kpi8(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.call_metrics(m.calls(), _calls_asof(m))


@query("kpi11_top_agents", with_("calls") + f"""SELECT CAST(row_number() OVER (ORDER BY q DESC, n DESC, agent_id) AS INTEGER) AS rank,
  agent_id, {r4('q')} AS quality, n AS calls FROM (SELECT agent_id, avg(mos) AS q, count(*) AS n FROM calls
  WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY 1) ORDER BY q DESC, n DESC, agent_id LIMIT 5""")
def kpi11(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.top_agents(m.calls(), _calls_asof(m))


@query("kpi9_incident_resolution", with_("incidents") + f"""SELECT priority, count(*) AS incidents,
  count(*) FILTER (WHERE state <> 'Resolved') AS open_incidents, count(*) FILTER (WHERE state = 'Resolved') AS resolved,
  {r4("count(*) FILTER (WHERE state = 'Resolved') * 100.0 / count(*)")} AS resolved_pct FROM incidents GROUP BY priority""")
def kpi9(spark, sf_dir):
    return K.incident_resolution(Model(spark, sf_dir).incidents())


def _elapsed(m: str) -> str:
    return (f"CASE WHEN {m} < 60 THEN CAST({m} AS VARCHAR) || 'm' WHEN {m} < 1440 THEN CAST({m} // 60 AS VARCHAR) || 'h ' || "
            f"CAST({m} % 60 AS VARCHAR) || 'm' ELSE CAST({m} // 1440 AS VARCHAR) || 'd ' || CAST(({m} % 1440) // 60 AS VARCHAR) || 'h' END")


@query("kpi16_issue_list", with_("incidents") + f"""SELECT CAST(row_number() OVER (ORDER BY priority, opened_at DESC, incident_id) AS INTEGER) AS rank,
  incident_id, 'P' || CAST(priority AS VARCHAR) AS severity, state, {tstext('opened_at')} AS opened_at,
  {_elapsed(f"CAST(trunc((epoch({INC_ASOF}) - epoch(opened_at)) / 60) AS BIGINT)")} AS elapsed
FROM incidents WHERE state <> 'Resolved' AND opened_at <= {INC_ASOF} ORDER BY priority, opened_at DESC, incident_id LIMIT 6""")
def kpi16(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.issue_list(m.incidents(), _inc_asof(m))


@query("kpi17_call_centre", with_("calls") + f"""SELECT count(*) AS calls, {r4('count(*) / 24.0')} AS calls_per_hour,
  {r4('avg(duration_min)')} AS aht_min, {r4('count(*) FILTER (WHERE wait_sec <= 30) * 100.0 / count(*)')} AS service_level_pct,
  {r4("count(*) FILTER (WHERE line_status = 'O') * 100.0 / count(*)")} AS abandon_pct, {r4('avg(wait_sec)')} AS avg_wait_sec,
  CASE WHEN count(*) FILTER (WHERE wait_sec <= 30) * 100.0 / count(*) >= 90 THEN 'green'
       WHEN count(*) FILTER (WHERE wait_sec <= 30) * 100.0 / count(*) >= 80 THEN 'amber' ELSE 'red' END AS service_level_band
FROM calls WHERE {_since('call_time', CALLS_ASOF, DAY)}""")
def kpi17(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.call_centre(m.calls(), _calls_asof(m))


# ------------------------------------------------------------------ IND
@query("ind1_4_major_incidents", with_("incidents") + f"""SELECT count(*) FILTER (WHERE state <> 'Resolved') AS active_p1_p2,
  count(*) FILTER (WHERE state <> 'Resolved' AND priority = 1) AS active_p1,
  count(*) FILTER (WHERE {_since('opened_at', INC_ASOF, DAY)}) AS new_in_window,
  {r4("sum(CASE WHEN state <> 'Resolved' THEN impact_value END)")} AS impact_value,
  {_status("CAST(count(*) FILTER (WHERE state <> 'Resolved') AS DOUBLE)", 3.0, 5.0, higher=False, inclusive=True)} AS status
FROM incidents WHERE priority IN (1, 2) AND opened_at <= {INC_ASOF}""")
def ind1_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.active_major_incidents(m.incidents(), _inc_asof(m))


@query("ind8_4_security_incidents_24h", with_("incidents") + f"""SELECT count(*) FILTER (WHERE priority = 1) AS p1_24h,
  count(*) FILTER (WHERE priority = 2) AS p2_24h, CASE WHEN count(*) FILTER (WHERE priority = 1) > 0 THEN 'Critical'
  WHEN count(*) FILTER (WHERE priority = 2) > 0 THEN 'Warning' ELSE 'Healthy' END AS status
FROM incidents WHERE {_since('opened_at', INC_ASOF, DAY)} AND opened_at <= {INC_ASOF}""")
def ind8_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.security_incidents_24h(m.incidents(), _inc_asof(m))


@query("ind3_1_mos_weighted", with_("calls") + f"""SELECT COALESCE(region, 'ALL') AS region,
  {r4('sum(mos * duration_min) / sum(duration_min)')} AS mos_weighted, {r4('quantile_cont(mos, 0.1)')} AS mos_p10,
  count(*) AS calls, {_status(r4('sum(mos * duration_min) / sum(duration_min)'), 4.0, 3.6)} AS status
FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY ROLLUP (region)""")
def ind3_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.mos_weighted(m.calls_geo(), _calls_asof(m))


PCR = f"{rnd('count(*) FILTER (WHERE mos < 3.5) * 100.0 / count(*)', 2)}"


@query("ind3_2_poor_call_rate", with_("calls") + f"""SELECT count(*) FILTER (WHERE mos < 3.5) AS poor_calls, count(*) AS total_calls,
  {r4(PCR)} AS poor_call_rate, count(*) FILTER (WHERE mos BETWEEN 3.5 AND 4.0) AS acceptable,
  count(*) FILTER (WHERE mos >= 3.0 AND mos < 3.5) AS poor, count(*) FILTER (WHERE mos < 3.0) AS very_poor,
  {_status(PCR, 3.0, 5.0, higher=False)} AS status FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)}""")
def ind3_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.poor_call_rate(m.calls(), _calls_asof(m))


@query("ind3_2_poor_call_rate_by_vendor", with_("calls") + f"""SELECT vendor_id, count(*) FILTER (WHERE mos < 3.5) AS poor_calls, count(*) AS total_calls,
  {r4(PCR)} AS poor_call_rate, count(*) FILTER (WHERE mos BETWEEN 3.5 AND 4.0) AS acceptable,
  count(*) FILTER (WHERE mos >= 3.0 AND mos < 3.5) AS poor, count(*) FILTER (WHERE mos < 3.0) AS very_poor,
  {_status(PCR, 3.0, 5.0, higher=False)} AS status FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY vendor_id""")
def ind3_2v(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.poor_call_rate(m.calls_geo(), _calls_asof(m), keys=("vendor_id",))


SIP_CAPACITY = 500.0


@query("ind3_3_concurrent_calls", with_("calls", extra=[
    ("c", "SELECT call_time AS s, call_time + to_seconds(CAST(duration_min * 60 AS DECIMAL(18,6))) AS e FROM calls"),
    ("ev", "SELECT s AS t, 1 AS d FROM c UNION ALL SELECT e, -1 FROM c"),
    ("days", """SELECT unnest(generate_series(date_trunc('day', min(t)), date_trunc('day', max(t)), INTERVAL 1 DAY)) AS t, 0 AS d FROM ev"""),
    ("al", "SELECT t, sum(d) AS d FROM (SELECT t, d FROM ev UNION ALL SELECT t, d FROM days) GROUP BY t"),
    ("run", """SELECT t, sum(d) OVER (ORDER BY t) AS conc,
  (epoch_us(COALESCE(lead(t) OVER (ORDER BY t), date_trunc('hour', t) + INTERVAL 1 HOUR)) - epoch_us(t)) / 1e6 AS secs FROM al""")]) + f"""
SELECT {tstext("date_trunc('day', t)")} AS period, CAST(max(conc) AS BIGINT) AS peak_concurrent,
  {r4('sum(conc * secs) / sum(secs)')} AS avg_concurrent, {r4(f'max(conc) * 100.0 / {SIP_CAPACITY}')} AS peak_utilisation_pct,
  {_status(f'max(conc) * 100.0 / {SIP_CAPACITY}', 80.0, 90.0, higher=False)} AS status
FROM run GROUP BY date_trunc('day', t)""")
def ind3_3(spark, sf_dir):
    return I.concurrent_calls(Model(spark, sf_dir).calls(), capacity=SIP_CAPACITY)


@query("ind3_4_queue_wait", with_("calls") + f"""SELECT queue, {r4('sum(wait_sec) / count(*)')} AS asa_sec,
  {_mmss('sum(wait_sec) / count(*)')} AS asa_text, count(*) AS answered,
  {_status('sum(wait_sec) / count(*)', 90.0, 180.0, higher=False)} AS status
FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY queue""")
def ind3_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.queue_wait(m.calls(), _calls_asof(m))


REP = f"""SELECT *, lag(contact_time) OVER (PARTITION BY customer_id, category ORDER BY contact_time, contact_id) AS prev FROM contacts"""


@query("ind9_4_repeat_contacts", with_("contacts", extra=[("r", REP), ("x", f"""SELECT *,
  prev IS NOT NULL AND contact_time <= prev + INTERVAL 7 DAY AS is_repeat,
  {_since('contact_time', EV_ASOF, 3600)} AS in_h, {_since('contact_time', EV_ASOF, 4 * 3600)} AS in_4h,
  contact_time >= date_trunc('day', {EV_ASOF}) AS today FROM r WHERE contact_time <= {EV_ASOF}""")]) + f"""
SELECT category, count(*) FILTER (WHERE in_h) AS contacts_1h, count(*) FILTER (WHERE in_h AND is_repeat) AS repeats_1h,
  count(*) FILTER (WHERE in_4h) AS contacts_4h, count(*) FILTER (WHERE in_4h AND is_repeat) AS repeats_4h,
  count(*) FILTER (WHERE today) AS contacts_today, count(*) FILTER (WHERE today AND is_repeat) AS repeats_today,
  count(*) AS contacts_all, count(*) FILTER (WHERE is_repeat) AS repeats_all,
  {r4('(count(*) FILTER (WHERE today AND is_repeat)) * 100.0 / NULLIF(count(*) FILTER (WHERE today), 0)')} AS repeat_rate_today,
  {r4('(count(*) FILTER (WHERE is_repeat)) * 100.0 / count(*)')} AS repeat_rate_all,
  {_status('(count(*) FILTER (WHERE is_repeat)) * 100.0 / count(*)', 20.0, 30.0, higher=False)} AS status FROM x GROUP BY category""")
def ind9_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.repeat_contacts(m.contacts(), m.as_of())


@query("ind13_3_cross_channel_journeys", with_("contacts", extra=[("j0", """SELECT *, CASE WHEN lag(contact_time) OVER w IS NULL
  OR contact_time > lag(contact_time) OVER w + INTERVAL 7 DAY THEN 1 ELSE 0 END AS nw FROM contacts
  WINDOW w AS (PARTITION BY customer_id ORDER BY contact_time, contact_id)"""), ("j1", """SELECT *, sum(nw) OVER (PARTITION BY customer_id
  ORDER BY contact_time, contact_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS journey FROM j0"""), (
    "jj", """SELECT customer_id, journey, count(DISTINCT channel) AS channels, count(*) AS contacts,
  arg_max(category, (contact_time, contact_id)) AS last_category FROM j1 GROUP BY ALL""")]) + f"""
SELECT count(*) AS cross_channel_journeys, count(*) FILTER (WHERE last_category IN ('purchase', 'signup')) AS resolved,
  {r4("(count(*) FILTER (WHERE last_category IN ('purchase', 'signup'))) * 100.0 / NULLIF(count(*), 0)")} AS resolution_rate,
  {_status("(count(*) FILTER (WHERE last_category IN ('purchase', 'signup'))) * 100.0 / NULLIF(count(*), 0)", 80.0, 70.0)} AS status
FROM jj WHERE channels >= 2""")
def ind13_3(spark, sf_dir):
    return I.cross_channel_journeys(Model(spark, sf_dir).contacts())


# Phrase lists are parameters (the test transcripts are invented text; these words occur in it). Audio (adapter): silences = id % 5,
# overlaps = id % 4, words a minute = 90 + id % 100, hold procedure kept unless id % 6 = 0, none measured where id % 11 = 0.
QA_PHRASES = {"company": ["this"], "agent": ["that"], "listening": ["with", "from"], "empathy": ["then", "there"], "resolution": ["thing", "than"]}
DISCLOSURE = ["with", "from"]


def _pc(text: str, phrases) -> str:
    pat = "(?i)\\b(" + "|".join(phrases) + ")\\b"
    return f"len(regexp_extract_all({text}, '{pat}', 0))"


def _qa_sql() -> str:
    n = ", ".join(f"sum({_pc('text', ph)}) AS n_{k}" for k, ph in QA_PHRASES.items())
    return f"""WITH g AS (SELECT conv_id, {n} FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
x AS (SELECT *, CASE WHEN conv_id % 11 <> 0 THEN conv_id % 5 END AS silences, CASE WHEN conv_id % 11 <> 0 THEN conv_id % 4 END AS talked_over,
  CASE WHEN conv_id % 11 <> 0 THEN 90 + conv_id % 100 END AS wpm, CASE WHEN conv_id % 11 <> 0 THEN conv_id % 6 <> 0 END AS hold_ok FROM g),
p AS (SELECT conv_id, CASE WHEN n_company > 0 AND n_agent > 0 THEN 15.0 WHEN n_company > 0 OR n_agent > 0 THEN 7.5 ELSE 0.0 END AS p_greeting,
  CASE WHEN n_listening >= 3 THEN 15.0 WHEN n_listening >= 1 THEN 13.0 ELSE 0.0 END AS p_listening,
  CASE WHEN n_empathy >= 2 THEN 15.0 WHEN n_empathy = 1 THEN 10.0 ELSE 0.0 END AS p_empathy,
  CASE WHEN silences IS NOT NULL THEN greatest(10.0 - 1.5 * silences, 0.0) END AS p_dead_air,
  CASE WHEN talked_over IS NOT NULL THEN greatest(10.0 - 2.0 * talked_over, 0.0) END AS p_talk_over,
  CASE WHEN wpm IS NULL THEN NULL WHEN wpm BETWEEN 120 AND 150 THEN 10.0 WHEN wpm BETWEEN 100 AND 170 THEN 5.0 ELSE 0.0 END AS p_clarity,
  CASE WHEN hold_ok THEN 10.0 WHEN NOT hold_ok THEN 0.0 END AS p_hold, CASE WHEN n_resolution > 0 THEN 15.0 ELSE 0.0 END AS p_resolution FROM x),
s AS (SELECT *, p_greeting + p_listening + p_empathy + COALESCE(p_dead_air, 0) + COALESCE(p_talk_over, 0) + COALESCE(p_clarity, 0) + COALESCE(p_hold, 0) + p_resolution AS score FROM p)
SELECT conv_id, {", ".join(f"CAST(p_{k} AS DOUBLE) AS p_{k}" for k in I.QA_POINTS)}, {r4('score')} AS qa_score,
  CAST(CASE WHEN p_dead_air IS NULL THEN 4 ELSE 0 END AS INTEGER) AS unmeasured,
  CASE WHEN score >= 90 THEN 'Exceeds' WHEN score >= 80 THEN 'Meets' WHEN score >= 70 THEN 'Needs improvement' ELSE 'Intervention' END AS band,
  {_status('score', 85.0, 70.0)} AS status FROM s"""


@query("ind11_1_qa_predictor", _qa_sql())
def ind11_1(spark, sf_dir):
    c = Model(spark, sf_dir).raw("conversations")
    i = F.col("conv_id")
    audio = c.select("conv_id").distinct().filter(i % 11 != 0).select(
        "conv_id", (i % 5).alias("silences"), (i % 4).alias("overlaps"), (90 + i % 100).alias("wpm"), (i % 6 != 0).alias("hold_ok"))
    return I.qa_predictor(c, QA_PHRASES, audio)


@query("ind14_4_disclosure_compliance", f"""SELECT count(*) AS conversations, count(*) FILTER (WHERE hits > 0) AS compliant,
  {r4('(count(*) FILTER (WHERE hits > 0)) * 100.0 / count(*)')} AS compliance_pct,
  {r4('sum(CASE WHEN hits > 0 THEN turns ELSE 0 END) * 100.0 / sum(turns)')} AS weighted_compliance_pct,
  {_status('sum(CASE WHEN hits > 0 THEN turns ELSE 0 END) * 100.0 / sum(turns)', 100.0, 99.0)} AS status FROM (
  SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN {_pc('text', DISCLOSURE)} ELSE 0 END) AS hits, count(*) AS turns
  FROM conversations GROUP BY conv_id)""")
def ind14_4(spark, sf_dir):
    return I.disclosure_compliance(Model(spark, sf_dir).raw("conversations"), DISCLOSURE)


LUHN = ("list_sum(list_transform(list_reverse(list_transform(string_split(digits, ''), lambda ch: CAST(ch AS INTEGER))), "
        "lambda d, i: CASE WHEN i % 2 = 0 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END)) % 10 = 0")


# Payment interactions (adapter): documents; the notes are the text, the transcript is the benchmark passage of that number, if there is one;
# masking failed for ids that 53 divides, recording ran for 59, the screen was captured for 61.
@query("ind14_1_pci_compliance", f"""WITH cand AS (SELECT doc_id, unnest(regexp_extract_all(text, '{I.CARD_PATTERN}', 0)) AS raw FROM documents),
d AS (SELECT doc_id, regexp_replace(raw, '[ -]', '', 'g') AS digits FROM cand),
notes AS (SELECT DISTINCT doc_id FROM d WHERE length(digits) BETWEEN 13 AND 19 AND {LUHN}),
x AS (SELECT source, doc_id % 53 = 0 AS b1, doc_id % 59 = 0 AS b2, doc_id % 61 = 0 AS b3, notes.doc_id IS NOT NULL AS b4 FROM documents LEFT JOIN notes USING (doc_id))
SELECT source, count(*) AS interactions, count(*) FILTER (WHERE b1) AS dtmf_violations, count(*) FILTER (WHERE b2) AS recording_violations,
  count(*) FILTER (WHERE b3) AS screen_violations, count(*) FILTER (WHERE b4) AS notes_violations, CAST(0 AS BIGINT) AS verbal_violations,
  count(*) FILTER (WHERE NOT (b1 OR b2 OR b3 OR b4)) AS compliant,
  {r4('count(*) FILTER (WHERE NOT (b1 OR b2 OR b3 OR b4)) * 100.0 / count(*)')} AS compliance_pct,
  {_status('count(*) FILTER (WHERE NOT (b1 OR b2 OR b3 OR b4)) * 100.0 / count(*)', 100.0, 99.5)} AS status FROM x GROUP BY source""")
def ind14_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    i = F.col("doc_id")
    spoken = m.raw("benchmark").select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").alias("transcript"))
    rows = m.raw("documents").join(spoken, "doc_id", "left").select("doc_id", "source", (i % 53 != 0).alias("dtmf_masked"), (i % 59 != 0).alias("recording_paused"),
                                                                      (i % 61 != 0).alias("screen_paused"), F.col("text").alias("notes"), "transcript")
    return I.pci_compliance(rows)


@query("ind6_4_channel_share", with_("contacts") + f"""SELECT channel, count(*) AS contacts,
  {r4('count(*) * 100.0 / sum(count(*)) OVER ()')} AS share_pct, channel IN ('view', 'click') AS self_service
FROM contacts WHERE {_since('contact_time', EV_ASOF, 30 * DAY)} GROUP BY channel""")
def ind6_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.channel_share(m.contacts(), m.as_of())


ESC_SQL = with_("incidents", extra=[("d", f"""SELECT assignment_group, day, {_status('n', 2.0, 3.0, higher=False, inclusive=True)} AS status FROM (
  SELECT assignment_group, date_trunc('day', opened_at) AS day, CAST(count(*) FILTER (WHERE priority = 1) AS DOUBLE) AS n
  FROM incidents GROUP BY ALL)"""), ("s0", """SELECT *, CASE WHEN lag(status) OVER (PARTITION BY assignment_group ORDER BY day) IS NULL
  OR status <> lag(status) OVER (PARTITION BY assignment_group ORDER BY day) THEN 1 ELSE 0 END AS chg FROM d"""),
    ("s", """SELECT *, sum(chg) OVER (PARTITION BY assignment_group ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
  FROM s0"""), ("s2", """SELECT *, (epoch(day) - epoch(min(day) OVER (PARTITION BY assignment_group, isl))) / 86400.0 AS dur FROM s""")]) + f"""
SELECT assignment_group, {tstext('day')} AS day, status, {r4('dur')} AS status_duration,
  CASE WHEN status = 'Critical' AND dur > 30 THEN 'Executive notification' WHEN status = 'Critical' AND dur > 15 THEN 'Bridge call initiated'
       WHEN status = 'Critical' THEN 'Alert Operations Manager + Page On-call' WHEN status = 'At Risk' AND dur > 30 THEN 'Alert Operations Manager'
       WHEN status = 'At Risk' AND dur > 15 THEN 'Alert Team Lead' ELSE 'None' END AS escalation FROM s2"""


@query("ind00_escalation", ESC_SQL)
def ind00(spark, sf_dir):
    inc = Model(spark, sf_dir).incidents(groups=True)
    d = (inc.groupBy("assignment_group", F.date_trunc("day", "opened_at").alias("day"))
         .agg(F.sum((F.col("priority") == 1).cast("int")).cast("double").alias("n")))
    d = d.withColumn("status", I.status(F.col("n"), 2.0, 3.0, higher_is_better=False, inclusive=True))
    return I.escalation(d, "assignment_group", ts="day", st="status", unit_s=DAY)


# ------------------------------------------------------------------ IND (events / hosts / contacts)
# Adapter choices: region of an event = region of its application; lost packet / abnormal end /
# 5xx = error event; timeout = value > 300; slow = value in (200, 300]; response seconds = value / 100;
# auth attempts = signup and error events (signup with value <= 300 succeeds, error above 300 is a
# technical failure). Windows of event indicators: 7 days.
EV_W = 7 * DAY
CRM_LIMITS = [("click", 3.0), ("view", 3.0), ("purchase", 5.0), ("signup", 5.0), ("error", 3.0)]
EVR = ("evr", "SELECT e.*, a.infrastructure_group AS region FROM ev e JOIN applications a ON a.application_id = e.app")


def _ev_region(m: Model):
    e = m.events()
    a = m.applications().select("application_id", F.col("infrastructure_group").alias("region"))
    return e.join(F.broadcast(a), e.app == a.application_id)


@query("ind1_1_availability", with_("host_metrics", "applications") + f"""SELECT COALESCE(region, 'GLOBAL') AS region,
  count(*) FILTER (WHERE health_status = 'HEALTHY') AS uptime, count(*) AS scheduled,
  {r4("count(*) FILTER (WHERE health_status = 'HEALTHY') * 100.0 / count(*)")} AS availability_pct,
  {_status("count(*) FILTER (WHERE health_status = 'HEALTHY') * 100.0 / count(*)", 99.9, 99.5)} AS status
FROM (SELECT h.*, a.infrastructure_group AS region FROM host_metrics h JOIN applications a USING (application_id)
      WHERE {_since('h.recorded_at', EV_ASOF, 30 * DAY)}) GROUP BY ROLLUP (region)""")
def ind1_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    a = m.applications().select("application_id", F.col("infrastructure_group").alias("region"))
    h = m.host_metrics().join(F.broadcast(a), "application_id")
    return I.availability(h, m.as_of(), 30 * DAY)


@query("ind2_1_latency_by_agents", with_("ev", "applications", extra=[EVR, ("s", f"SELECT * FROM evr WHERE {_since('ts', EV_ASOF, EV_W)}")]) + f"""
SELECT {r4('sum(lat * agents) / sum(agents)')} AS weighted_latency_ms, {r4('(SELECT quantile_cont(value, 0.95) FROM s)')} AS p95_latency_ms,
  CAST(sum(agents) AS BIGINT) AS agents, {_status('sum(lat * agents) / sum(agents)', 120.0, 180.0, higher=False)} AS status
FROM (SELECT region, avg(value) AS lat, count(DISTINCT user_id) AS agents FROM s GROUP BY region)""")
def ind2_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    s = _ev_region(m).select("ts", "region", F.col("value").alias("latency_ms"), F.col("user_id").alias("agent_id"))
    return I.latency_by_agents(s, m.as_of(), EV_W)


@query("ind2_4_packet_loss", with_("ev", "applications", extra=[EVR]) + f"""SELECT COALESCE(region, 'GLOBAL') AS region,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS lost, CAST(count(*) AS BIGINT) AS sent,
  {r4("count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*)")} AS packet_loss_pct,
  {_status("count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*)", 0.5, 1.0, higher=False)} AS status
FROM evr WHERE {_since('ts', EV_ASOF, EV_W)} GROUP BY ROLLUP (region)""")
def ind2_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    t = _ev_region(m).select("ts", "region", F.lit(1).alias("sent"), (F.col("event_type") == "error").cast("int").alias("lost"))
    return I.packet_loss(t, m.as_of(), EV_W)


OUTCOME = "CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 300 THEN 'slow' ELSE 'success' END"


@query("ind5_1_session_success", with_("ev") + f"""SELECT count(*) AS attempts, count(*) FILTER (WHERE o = 'success') AS success,
  count(*) FILTER (WHERE o = 'slow') AS slow, {r4("count(*) FILTER (WHERE o = 'success') * 100.0 / count(*)")} AS strict_success_pct,
  {r4("count(*) FILTER (WHERE o IN ('success', 'slow')) * 100.0 / count(*)")} AS success_pct,
  {_status("count(*) FILTER (WHERE o IN ('success', 'slow')) * 100.0 / count(*)", 98.0, 95.0)} AS status
FROM (SELECT {OUTCOME} AS o FROM ev WHERE {_since('ts', EV_ASOF, EV_W)})""")
def ind5_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    e = m.events().select("ts", F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 300, "slow")
                          .otherwise("success").alias("outcome"))
    return I.session_success(e, m.as_of(), EV_W)


CRM_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST({v} AS DOUBLE))" for t, v in CRM_LIMITS) + ") t(tx_type, limit_s)"


@query("ind7_2_crm_response", with_("ev", extra=[("lim", CRM_SQL)]) + f"""SELECT tx_type, limit_s, {r4('avg(value / 100.0)')} AS avg_s,
  {r4('quantile_cont(value / 100.0, 0.95)')} AS p95_s, {r4('count(*) FILTER (WHERE value / 100.0 > limit_s) * 100.0 / count(*)')} AS over_limit_pct,
  {r4("count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*)")} AS error_rate_pct,
  {_status('avg(value / 100.0)', 3.0, 5.0, higher=False)} AS status
FROM (SELECT ev.*, ev.event_type AS tx_type, COALESCE(lim.limit_s, 5.0) AS limit_s FROM ev LEFT JOIN lim ON lim.tx_type = ev.event_type) WHERE {_since('ts', EV_ASOF, EV_W)} GROUP BY tx_type, limit_s""")
def ind7_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    tx = m.events().select("ts", F.col("event_type").alias("tx_type"), (F.col("value") / 100.0).alias("response_s"),
                           (F.col("event_type") == "error").alias("is_error"))
    lim = F.broadcast(spark.createDataFrame(CRM_LIMITS, "tx_type string, limit_s double"))
    return I.crm_response(tx, lim, m.as_of(), EV_W)


@query("ind7_4_api_error_rate", with_("ev") + f"""SELECT app AS endpoint, count(*) AS requests,
  {r4("count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*)")} AS strict_pct,
  {r4("count(*) FILTER (WHERE event_type = 'error' OR value > 300) * 100.0 / count(*)")} AS broad_pct,
  {r4("count(*) FILTER (WHERE event_type = 'error' OR value > 200) * 100.0 / count(*)")} AS very_broad_pct,
  {_status("count(*) FILTER (WHERE event_type = 'error' OR value > 300) * 100.0 / count(*)", 0.5, 1.0, higher=False)} AS status
FROM ev WHERE {_since('ts', EV_ASOF, EV_W)} GROUP BY app""")
def ind7_4(spark, sf_dir):
    """5xx = error event; timeouts and slow responses are non-error events (value > 300 / 200-300]."""
    m = Model(spark, sf_dir)
    err = F.col("event_type") == "error"
    r = m.events().select("ts", F.col("app").alias("endpoint"), F.when(err, 500).otherwise(200).alias("code"),
                          (~err & (F.col("value") > 300)).alias("timeout"),
                          (~err & (F.col("value") > 200) & (F.col("value") <= 300)).alias("slow"))
    return I.api_error_rate(r, m.as_of(), EV_W)


AUTH = ("CASE WHEN event_type = 'signup' AND value <= 300 THEN 'success' "
        "WHEN event_type = 'error' AND value > 300 THEN 'technical_failure' ELSE 'user_failure' END")


@query("ind8_1_sso_success", with_("ev") + f"""SELECT count(*) AS attempts, count(*) FILTER (WHERE r = 'success') AS success,
  count(*) FILTER (WHERE r = 'technical_failure') AS technical_failures,
  {r4("count(*) FILTER (WHERE r = 'success') * 100.0 / count(*)")} AS success_pct,
  {r4("count(*) FILTER (WHERE r = 'technical_failure') * 100.0 / count(*)")} AS technical_failure_pct,
  {_status("count(*) FILTER (WHERE r = 'success') * 100.0 / count(*)", 99.5, 98.0)} AS status
FROM (SELECT {AUTH} AS r FROM ev WHERE event_type IN ('signup', 'error') AND {_since('ts', EV_ASOF, EV_W)})""")
def ind8_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    e = m.events().filter(F.col("event_type").isin("signup", "error"))
    a = e.select("ts", F.when((F.col("event_type") == "signup") & (F.col("value") <= 300), "success")
                 .when((F.col("event_type") == "error") & (F.col("value") > 300), "technical_failure")
                 .otherwise("user_failure").alias("result"))
    return I.sso_success(a, m.as_of(), EV_W)


@query("ind8_3_abnormal_terminations", with_("ev") + f"""SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, abnormal, ends,
  {r4('rate')} AS abnormal_rate_pct, {r4('tr')} AS trailing_avg_pct, COALESCE(rate > tr * 2.0, FALSE) AS spike,
  {_status('rate', 1.0, 2.0, higher=False)} AS status FROM (
  SELECT *, avg(rate) OVER (ORDER BY period RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS tr FROM (
    SELECT date_trunc('hour', ts) AS period, count(*) FILTER (WHERE event_type = 'error') AS abnormal, count(*) AS ends,
      count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*) AS rate FROM ev GROUP BY 1))""")
def ind8_3(spark, sf_dir):
    e = Model(spark, sf_dir).events().select("ts", (F.col("event_type") == "error").alias("abnormal"))
    return I.abnormal_terminations(e)


# Handle time (adapter): talk 30 s a unit of quantity, hold 1000 s x tax, wrap-up 600 s x discount; the hour of a call = order key % 24.
# Calls of one queue and hour are few here, so a slot is 8 hours and the base 12 weeks.
AHT_WEEKS, AHT_SLOT = 12, 8


@query("ind10_2_aht_deviation", f"""WITH c AS (SELECT l_returnflag AS queue, CAST(l_shipdate AS DATE) AS day, CAST((l_orderkey % 24) // {AHT_SLOT} AS INTEGER) AS slot,
  CAST(round(l_quantity * 30) AS BIGINT) AS talk_s, CAST(round(l_tax * 1000) AS BIGINT) AS hold_s, CAST(round(l_discount * 600) AS BIGINT) AS acw_s FROM lineitem),
x AS (SELECT *, talk_s + hold_s + acw_s AS aht_s FROM c),
now AS (SELECT queue, day, slot, count(*) AS calls, avg(aht_s) AS aht, avg(talk_s) AS talk, avg(hold_s) AS hold, avg(acw_s) AS acw FROM x GROUP BY ALL),
base AS (SELECT queue, CAST(day + CAST(7 * k AS INTEGER) AS DATE) AS day, slot, aht_s, talk_s, hold_s, acw_s FROM x, unnest(range(1, {AHT_WEEKS + 1})) AS w(k)),
m AS (SELECT queue, day, slot, count(*) AS n, avg(aht_s) AS mean, stddev_samp(aht_s) AS sd FROM base GROUP BY ALL),
kept AS (SELECT queue, day, slot, count(*) AS kept, avg(aht_s) AS aht, avg(talk_s) AS talk, avg(hold_s) AS hold, avg(acw_s) AS acw
  FROM base JOIN m USING (queue, day, slot) WHERE n = 1 OR abs(aht_s - mean) <= 3.0 * sd GROUP BY ALL)
SELECT now.queue, strftime(now.day, '%Y-%m-%d') AS day, now.slot, now.calls, COALESCE(m.n, 0) AS base_calls, COALESCE(k.kept, 0) AS kept_calls,
  {r4('now.aht')} AS aht_s, {r4('k.aht')} AS baseline_aht_s, {r4('(now.aht - k.aht) * 100.0 / NULLIF(k.aht, 0)')} AS deviation_pct,
  {r4('(now.talk - k.talk) * 100.0 / NULLIF(k.talk, 0)')} AS talk_pct, {r4('(now.hold - k.hold) * 100.0 / NULLIF(k.hold, 0)')} AS hold_pct,
  {r4('(now.acw - k.acw) * 100.0 / NULLIF(k.acw, 0)')} AS acw_pct,
  CASE WHEN k.aht IS NULL OR k.aht = 0 THEN NULL WHEN abs(now.talk - k.talk) >= greatest(abs(now.hold - k.hold), abs(now.acw - k.acw)) THEN 'talk'
       WHEN abs(now.hold - k.hold) >= abs(now.acw - k.acw) THEN 'hold' ELSE 'acw' END AS driver,
  CASE WHEN k.aht IS NULL OR k.aht = 0 THEN 'No Baseline' WHEN abs((now.aht - k.aht) * 100.0 / k.aht) > 10 THEN 'Critical'
       WHEN abs((now.aht - k.aht) * 100.0 / k.aht) > 5 THEN 'At Risk' ELSE 'Healthy' END AS status
FROM now LEFT JOIN m USING (queue, day, slot) LEFT JOIN kept k USING (queue, day, slot)""")
def ind10_2(spark, sf_dir):
    li = Model(spark, sf_dir).raw("lineitem")
    calls = li.select(F.col("l_returnflag").alias("queue"),
                      (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))).alias("call_time"),
                      F.round(F.col("l_quantity") * 30).cast("long").alias("talk_s"), F.round(F.col("l_tax") * 1000).cast("long").alias("hold_s"),
                      F.round(F.col("l_discount") * 600).cast("long").alias("acw_s"))
    return I.aht_deviation(calls, weeks=AHT_WEEKS, slot_h=AHT_SLOT)


CPC = ("d", "SELECT CAST(call_time AS DATE) AS day, sum(duration_min) * 0.75 / count(*) AS cpc, count(*) AS contacts FROM calls GROUP BY 1")


def _cpc_chg(k):
    return f"(d.cpc - p{k}.cpc) * 100.0 / NULLIF(p{k}.cpc, 0)"


@query("ind12_1_cost_per_contact", with_("calls", extra=[CPC]) + f"""SELECT strftime(d.day, '%Y-%m-%d') AS day, d.contacts,
  {r4('d.cpc')} AS cost_per_contact, {r4(_cpc_chg(1))} AS vs_prior_pct, {r4(_cpc_chg(7))} AS vs_last_week_pct,
  CASE WHEN abs({r4(_cpc_chg(1))}) > 15 THEN 'Critical' WHEN abs({r4(_cpc_chg(1))}) > 5 THEN 'At Risk' ELSE 'Healthy' END AS status
FROM d LEFT JOIN d p1 ON p1.day + 1 = d.day LEFT JOIN d p7 ON p7.day + 7 = d.day""")
def ind12_1(spark, sf_dir):
    return I.cost_per_contact(Model(spark, sf_dir).calls())


@query("ind13_1_channel_containment", with_("contacts", extra=[("c", """SELECT *, lead(channel) OVER w IS NOT NULL
  AND lead(channel) OVER w <> channel AND lead(contact_time) OVER w <= contact_time + INTERVAL 1 DAY AS escalated
  FROM contacts WINDOW w AS (PARTITION BY customer_id ORDER BY contact_time, contact_id)"""),
    ("g", "SELECT channel, count(*) AS started, count(*) FILTER (WHERE NOT escalated) AS completed FROM c GROUP BY channel")]) + f"""
SELECT channel, started, completed, {r4('completed * 100.0 / started')} AS containment_pct,
  {r4('(SELECT sum(started * completed * 100.0 / started) / sum(started) FROM g)')} AS weighted_containment_pct FROM g""")
def ind13_1(spark, sf_dir):
    return I.channel_containment(Model(spark, sf_dir).contacts())


@query("ind13_2_channel_shift", with_("contacts") + f"""SELECT contacts_now, contacts_prior, {r4('dn * 100.0 / contacts_now')} AS digital_share_now_pct,
  {r4('dp * 100.0 / contacts_prior')} AS digital_share_prior_pct,
  {r4('(dn * 100.0 / contacts_now - dp * 100.0 / contacts_prior) * 100.0 / NULLIF(dp * 100.0 / contacts_prior, 0)')} AS shift_velocity_pct,
  CASE WHEN (dn * 100.0 / contacts_now - dp * 100.0 / contacts_prior) * 100.0 / NULLIF(dp * 100.0 / contacts_prior, 0) >= 1 THEN 'Healthy'
       WHEN dn * 100.0 / contacts_now < dp * 100.0 / contacts_prior THEN 'Critical' ELSE 'At Risk' END AS status FROM (
  SELECT count(*) FILTER (WHERE {_since('contact_time', EV_ASOF, 15 * DAY)} AND contact_time <= {EV_ASOF}) AS contacts_now,
    count(*) FILTER (WHERE {_since('contact_time', EV_ASOF, 15 * DAY)} AND contact_time <= {EV_ASOF} AND channel IN ('click', 'view')) AS dn,
    count(*) FILTER (WHERE {_since('contact_time', EV_ASOF, 30 * DAY)} AND NOT {_since('contact_time', EV_ASOF, 15 * DAY)}) AS contacts_prior,
    count(*) FILTER (WHERE {_since('contact_time', EV_ASOF, 30 * DAY)} AND NOT {_since('contact_time', EV_ASOF, 15 * DAY)}
                     AND channel IN ('click', 'view')) AS dp FROM contacts)""")
def ind13_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.channel_shift(m.contacts(), m.as_of(), 15 * DAY)


# ------------------------------------------------------------------ KPI-13 / 14 / 6 / 12 / 15 / 18 / 19 / 21
# Core systems (adapter): one system per application with events in the last 24 h; type rotates
# over the five rule types by application id; error rate = rounded % of error events; services
# down = error events above 300; replication lag = rounded mean value (s); apps = users % 6 + 1.
SYS_TYPES = ["API", "IVR", "DB", "Genesys", "Generic"]
SYS_SQL = ("sys", f"""SELECT 'system-' || CAST(app AS VARCHAR) AS name, {SYS_TYPES!r}[app % 5 + 1] AS type,
  CAST(count(DISTINCT user_id) % 6 + 1 AS BIGINT) AS apps_count,
  CAST({rnd("count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*)", 0)} AS BIGINT) AS error_rate,
  count(*) FILTER (WHERE event_type = 'error' AND value > 300) AS services_down,
  CAST({rnd('avg(value)', 0)} AS BIGINT) AS replication_lag,
  100 - CAST({rnd("count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*)", 0)} AS BIGINT) AS health
FROM ev WHERE {_since('ts', EV_ASOF, DAY)} GROUP BY app""")
CORE_EVAL = ("core", f"""SELECT name, type,
  CAST(CASE WHEN type = 'IVR' THEN greatest(20.0, {rnd('100 - error_rate * 6', 0)}) WHEN type = 'Genesys' THEN CASE WHEN services_down > 0 THEN 60.0 ELSE 98.0 END
       WHEN type = 'DB' THEN greatest(30.0, {rnd('100 - replication_lag / 300.0 * 40', 0)})
       WHEN type = 'API' THEN greatest(25.0, {rnd('100 - error_rate * 7 - (apps_count - 1) * 2', 0)}) ELSE health END AS BIGINT) AS computed_health,
  CASE WHEN type = 'IVR' THEN CASE WHEN error_rate > (CASE WHEN apps_count > 4 THEN 2.5 WHEN apps_count > 2 THEN 4.0 ELSE 6.0 END) * 2 THEN 'critical'
                                   WHEN error_rate > (CASE WHEN apps_count > 4 THEN 2.5 WHEN apps_count > 2 THEN 4.0 ELSE 6.0 END) THEN 'warning' ELSE 'good' END
       WHEN type = 'Genesys' THEN CASE WHEN services_down > 0 THEN 'critical' ELSE 'good' END
       WHEN type = 'DB' THEN CASE WHEN replication_lag > 180 THEN 'critical' WHEN replication_lag > 60 THEN 'warning' ELSE 'good' END
       WHEN type = 'API' THEN CASE WHEN error_rate > 5 THEN 'critical' WHEN error_rate > 3 THEN 'warning' ELSE 'good' END
       ELSE CASE WHEN health >= 95 THEN 'good' WHEN health >= 88 THEN 'warning' ELSE 'critical' END END AS severity,
  CASE WHEN type = 'IVR' THEN 'errors ' || CAST(error_rate AS VARCHAR) || '% (tolerated '
         || CASE WHEN apps_count > 4 THEN '2.5' WHEN apps_count > 2 THEN '4' ELSE '6' END || '%)'
       WHEN type = 'Genesys' THEN CASE WHEN services_down > 0 THEN CAST(services_down AS VARCHAR) || ' services down' ELSE 'all services up' END
       WHEN type = 'DB' THEN 'lag ' || CAST(replication_lag AS VARCHAR) || 's'
       WHEN type = 'API' THEN CAST(apps_count AS VARCHAR) || ' apps · errors ' || CAST(error_rate AS VARCHAR) || '%'
       ELSE 'health ' || CAST(health AS VARCHAR) || '%' END AS note FROM sys""")


def _systems(m: Model):
    e = m.events().filter(F.col("ts") >= m.as_of() - F.make_dt_interval(days=F.lit(1)))
    err = (F.col("event_type") == "error").cast("int")
    g = e.groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.sum(err).alias("ne"), F.countDistinct("user_id").alias("u"),
                             F.sum(((F.col("event_type") == "error") & (F.col("value") > 300)).cast("long")).alias("down"),
                             F.avg("value").alias("lag"))
    from ..functions.core import rnd as _rnd
    er = _rnd(F.col("ne") * 100.0 / F.col("n"), 0).cast("long")
    return g.select(F.concat(F.lit("system-"), F.col("app").cast("string")).alias("name"),
                    F.element_at(F.array(*[F.lit(t) for t in SYS_TYPES]), (F.col("app") % 5 + 1).cast("int")).alias("type"),
                    (F.col("u") % 6 + 1).cast("long").alias("apps_count"), er.alias("error_rate"),
                    F.col("down").alias("services_down"), _rnd(F.col("lag"), 0).cast("long").alias("replication_lag"),
                    (F.lit(100) - er).alias("health"))


@query("kpi13_core_systems", with_("ev", extra=[SYS_SQL, CORE_EVAL]) + "SELECT * FROM core")
def kpi13(spark, sf_dir):
    return K.core_system_health(_systems(Model(spark, sf_dir)))


@query("kpi14_overall_status", with_("ev", extra=[SYS_SQL, CORE_EVAL]) + """SELECT CAST(floor(avg(computed_health)) AS BIGINT) AS overall_health,
  count(*) AS systems, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'warning'
  ELSE 'good' END AS overall_status FROM core""")
def kpi14(spark, sf_dir):
    return K.core_overall(K.core_system_health(_systems(Model(spark, sf_dir))))


@query("kpi6_agent_distribution", with_("calls", extra=[("pa", f"""SELECT date_trunc('day', call_time) AS day, agent_id, avg(mos) AS q FROM calls
  WHERE call_time >= date_trunc('day', {CALLS_ASOF}) - INTERVAL 6 DAY AND call_time <= {CALLS_ASOF} GROUP BY ALL""")]) + f"""
SELECT CASE WHEN q < 3.5 THEN 'below_3.5' WHEN q < 4.0 THEN '3.5_to_4.0' WHEN q < 4.5 THEN '4.0_to_4.5' ELSE '4.5_and_above' END AS bucket,
  count(*) FILTER (WHERE day = date_trunc('day', {CALLS_ASOF})) AS today,
  count(*) FILTER (WHERE day = date_trunc('day', {CALLS_ASOF}) - INTERVAL 1 DAY) AS yesterday,
  {r4('count(*) / 7.0')} AS week_avg FROM pa GROUP BY 1""")
def kpi6(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.agent_distribution(m.calls(), _calls_asof(m))


NET_CAP = 50.0


@query("kpi12_network_tiles", with_("ev", extra=[("h", f"""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS lat FROM ev
  WHERE {_since('ts', EV_ASOF, 30 * DAY)} GROUP BY 1"""), ("cur", f"SELECT * FROM h WHERE hour >= date_trunc('hour', {EV_ASOF} - INTERVAL 1 DAY)")]) + f"""
SELECT {r4('avg(lat)')} AS mean_latency_ms, {r4('(SELECT avg(lat) FROM h)')} AS avg_latency_30d_ms,
  {r4('(avg(lat) - (SELECT avg(lat) FROM h)) * 100.0 / (SELECT avg(lat) FROM h)')} AS latency_vs_avg_pct, max(n) AS peak_volume,
  {r4(f'max(n) * 100.0 / {NET_CAP}')} AS peak_utilisation_pct, strftime(arg_max(hour, (n, hour)), '%Y-%m-%d %H:%M:%S') AS peak_hour FROM cur""")
def kpi12(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.network_tiles(m.events().select("ts", F.col("value").alias("latency_ms")), m.as_of(), NET_CAP)


LOB_CASE = "CASE queue WHEN 'A' THEN 'Sales' WHEN 'N' THEN 'Billing' WHEN 'R' THEN 'Service' ELSE 'Other' END"


@query("kpi15_workforce_readiness", with_("calls", extra=[("a", f"""SELECT {LOB_CASE} AS lob, agent_id, max(call_time) AS last FROM calls
  WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY ALL""")]) + f"""
SELECT COALESCE(lob, 'ALL') AS lob, count(*) FILTER (WHERE {_since('last', CALLS_ASOF, 7 * DAY)}) AS ready, count(*) AS pool,
  {r4(f"count(*) FILTER (WHERE {_since('last', CALLS_ASOF, 7 * DAY)}) * 100.0 / count(*)")} AS readiness_pct,
  CASE WHEN count(*) FILTER (WHERE {_since('last', CALLS_ASOF, 7 * DAY)}) * 100.0 / count(*) >= 90 THEN 'good'
       WHEN count(*) FILTER (WHERE {_since('last', CALLS_ASOF, 7 * DAY)}) * 100.0 / count(*) >= 80 THEN 'warning' ELSE 'critical' END AS status
FROM a GROUP BY ROLLUP (lob)""")
def kpi15(spark, sf_dir):
    m = Model(spark, sf_dir)
    q = F.col("queue")
    lob = F.when(q == "A", "Sales").when(q == "N", "Billing").when(q == "R", "Service").otherwise("Other")
    return K.workforce_readiness(m.calls(), lob, _calls_asof(m))


SILO = ("sev", "SELECT e.ts, a.infrastructure_group AS silo, e.event_type AS category, e.user_id AS server "
               "FROM ev e JOIN applications a ON a.application_id = e.app")


def _silo_events(m: Model):
    return _ev_region(m).select("ts", F.col("region").alias("silo"), F.col("event_type").alias("category"),
                                F.col("user_id").alias("server"))


@query("kpi18_silo_impact", with_("ev", "applications", extra=[SILO]) + f"""SELECT silo, category, count(*) AS events,
  count(DISTINCT server) AS servers, CASE WHEN count(DISTINCT server) >= 10 THEN 'critical'
  WHEN count(DISTINCT server) >= 3 THEN 'warning' ELSE 'info' END AS severity FROM sev WHERE {_since('ts', EV_ASOF, DAY)} GROUP BY ALL""")
def kpi18(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.silo_impact(_silo_events(m), m.as_of())


@query("kpi19_events_vs_average", with_("ev", "applications", extra=[SILO, ("pd", """SELECT category, date_trunc('day', ts) AS day,
  count(*) AS n, count(DISTINCT server) AS servers FROM sev GROUP BY ALL""")]) + f"""
SELECT category, CAST(COALESCE(sum(n) FILTER (WHERE day = date_trunc('day', {EV_ASOF})), 0) AS BIGINT) AS today,
  {r4(f"avg(n) FILTER (WHERE day < date_trunc('day', {EV_ASOF}))")} AS daily_avg,
  CAST(COALESCE(sum(servers) FILTER (WHERE day = date_trunc('day', {EV_ASOF})), 0) AS BIGINT) AS servers_today,
  {r4(f"(sum(n) FILTER (WHERE day = date_trunc('day', {EV_ASOF})) - avg(n) FILTER (WHERE day < date_trunc('day', {EV_ASOF}))) * 100.0 / NULLIF(avg(n) FILTER (WHERE day < date_trunc('day', {EV_ASOF})), 0)")} AS change_pct,
  CASE WHEN (sum(n) FILTER (WHERE day = date_trunc('day', {EV_ASOF})) - avg(n) FILTER (WHERE day < date_trunc('day', {EV_ASOF}))) >= 0 THEN '↑ ' ELSE '↓ ' END
  || CAST(CAST(abs({rnd(f"(sum(n) FILTER (WHERE day = date_trunc('day', {EV_ASOF})) - avg(n) FILTER (WHERE day < date_trunc('day', {EV_ASOF}))) * 100.0 / NULLIF(avg(n) FILTER (WHERE day < date_trunc('day', {EV_ASOF})), 0)", 0)}) AS BIGINT) AS VARCHAR) || ' % from avg' AS label
FROM pd GROUP BY category""")
def kpi19(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.events_vs_average(_silo_events(m), m.as_of())


@query("kpi21_platform_tiles", with_("ev") + f"""SELECT count(*) AS sessions, {r4("count(*) FILTER (WHERE event_type <> 'error') * 100.0 / count(*)")} AS success_pct,
  {r4("count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*)")} AS error_rate_pct,
  count(*) FILTER (WHERE event_type = 'error' AND value > 300) AS failed_logins, count(DISTINCT user_id) AS active_users
FROM ev WHERE {_since('ts', EV_ASOF, DAY)}""")
def kpi21(spark, sf_dir):
    m = Model(spark, sf_dir)
    return K.platform_tiles(m.events(), m.as_of())


# ------------------------------------------------------------------ more IND (calls / events)
# Adapter choices: site = region; a lost packet = an error event; latency (ms) = event value;
# WAN in = events per hour, out = Σvalue / 50, capacity 20 per hour; ICA latency = call wait;
# freshness limits per source below; revenue categories from calls (see revenue query).
FRESH_LIMITS = [("click", 3600), ("view", 3600), ("purchase", 7200), ("signup", 7200), ("error", 1800)]
REV_OPP_PER_CALL = 120.0


@query("ind2_2_site_connectivity", with_("ev", "applications", extra=[EVR, ("g", f"""SELECT region,
  count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*) AS loss, avg(value) AS lat FROM evr
  WHERE {_since('ts', EV_ASOF, DAY)} GROUP BY region"""), ("s", """SELECT *, CASE WHEN loss < 1 AND lat < 150 THEN 'Connected'
  WHEN loss < 5 AND lat < 300 THEN 'Degraded' ELSE 'Disconnected' END AS site_status FROM g""")]) + f"""
SELECT region, {r4('loss')} AS loss_pct, {r4('lat')} AS latency_ms, site_status,
  {r4("(SELECT count(*) FILTER (WHERE site_status = 'Connected') * 100.0 / count(*) FROM s)")} AS connected_sites_pct FROM s""")
def ind2_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    s = _ev_region(m).select("ts", "region", (F.col("event_type") == "error").alias("lost"), F.col("value").alias("latency_ms"))
    return I.site_connectivity(s, m.as_of(), DAY)


@query("ind2_3_wan_utilisation", with_("ev", "applications", extra=[EVR, ("p", """SELECT region, date_trunc('hour', ts) AS period,
  greatest(count(*), sum(value) / 50.0) * 100.0 / 20.0 AS util FROM evr GROUP BY ALL"""), ("r", """SELECT *, avg(util) OVER (PARTITION BY region
  ORDER BY period RANGE BETWEEN INTERVAL 53999 SECOND PRECEDING AND CURRENT ROW) AS rolling FROM p""")]) + f"""
SELECT region, {r4('avg(rolling)')} AS avg_utilisation_pct, {r4('max(rolling)')} AS peak_utilisation_pct,
  {_status('max(rolling)', 70.0, 85.0, higher=False)} AS status FROM r WHERE {_since('period', EV_ASOF, DAY)} GROUP BY region""")
def ind2_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    t = _ev_region(m).select("ts", "region", F.lit(1).alias("bytes_in"), (F.col("value") / 50.0).alias("bytes_out"))
    return I.wan_utilisation(t, m.as_of(), capacity=20.0, rolling_s=15 * 3600, window_s=DAY)


@query("ind5_2_ica_latency", with_("calls") + f"""SELECT vendor_id, {r4('sum(wait_sec * duration_min) / sum(duration_min)')} AS weighted_latency_ms,
  {r4('quantile_cont(wait_sec, 0.95)')} AS p95_latency_ms,
  {_status('sum(wait_sec * duration_min) / sum(duration_min)', 60.0, 100.0, higher=False)} AS status
FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY vendor_id""")
def ind5_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    s = m.calls_geo().select(F.col("call_time").alias("ts"), "vendor_id", F.col("wait_sec").alias("latency_ms"),
                         F.col("duration_min").alias("duration"))
    return I.ica_latency(s, _calls_asof(m), 30 * DAY)


REQ = "calls * aht / (1440.0 * 0.85) / (1 - 0.3)"


@query("ind4_1_staffing_gap", with_("calls") + f"""SELECT strftime(day, '%Y-%m-%d') AS day, actual, calls, {r4(REQ)} AS required,
  {r4(f'actual - {REQ}')} AS gap, CASE WHEN abs(actual - {REQ}) > 500 THEN 'Critical' WHEN abs(actual - {REQ}) > 200 THEN 'At Risk'
  ELSE 'Healthy' END AS status FROM (SELECT CAST(call_time AS DATE) AS day, count(DISTINCT agent_id) AS actual, count(*) AS calls,
  avg(duration_min) AS aht FROM calls GROUP BY 1)""")
def ind4_1(spark, sf_dir):
    return I.staffing_gap(Model(spark, sf_dir).calls())


OCC = "handle * 100.0 / (handle + greatest(0.0, 480.0 - handle))"


@query("ind4_3_occupancy", with_("calls") + f"""SELECT vendor_id, {r4(f'avg({OCC})')} AS occupancy_pct, count(*) AS agent_days,
  CASE WHEN {r4(f'avg({OCC})')} < 65 THEN 'Critical (idle)' WHEN {r4(f'avg({OCC})')} < 75 THEN 'At Risk (low)'
       WHEN {r4(f'avg({OCC})')} <= 85 THEN 'Optimal' WHEN {r4(f'avg({OCC})')} <= 90 THEN 'At Risk (high)' ELSE 'Critical (burnout)' END AS band FROM (
  SELECT vendor_id, agent_id, CAST(call_time AS DATE) AS day, sum(duration_min) AS handle FROM calls
  WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY ALL) GROUP BY vendor_id""")
def ind4_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.occupancy_bands(m.calls_geo(), _calls_asof(m), 30 * DAY)


@query("ind10_3_occupancy_login", with_("calls") + f"""SELECT queue, {r4('sum(handle) * 100.0 / (count(*) * 420.0)')} AS occupancy_pct,
  CASE WHEN sum(handle) * 100.0 / (count(*) * 420.0) > 90 THEN 'Critical' WHEN sum(handle) * 100.0 / (count(*) * 420.0) < 70 THEN 'Critical'
       WHEN sum(handle) * 100.0 / (count(*) * 420.0) BETWEEN 80 AND 85 THEN 'Healthy' ELSE 'At Risk' END AS status FROM (
  SELECT queue, agent_id, CAST(call_time AS DATE) AS day, sum(duration_min) AS handle FROM calls
  WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY ALL) GROUP BY queue""")
def ind10_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.occupancy_login(m.calls(), _calls_asof(m), 30 * DAY)


@query("ind10_1_shrinkage", with_("calls") + f"""SELECT strftime(day, '%Y-%m-%d') AS day, present,
  {r4('(1.0 - present / n) * 100.0')} AS actual_shrinkage_pct, {r4('(1.0 - present / n) * 100.0 - 30.0')} AS variance_pct,
  {r4('((1.0 - present / n) * 100.0 - 30.0) / 100.0 * n')} AS fte_impact,
  CASE WHEN abs((1.0 - present / n) * 100.0 - 30.0) > 5 THEN 'Critical' WHEN abs((1.0 - present / n) * 100.0 - 30.0) > 2 THEN 'At Risk'
       ELSE 'Healthy' END AS status FROM (SELECT CAST(call_time AS DATE) AS day, count(DISTINCT agent_id) AS present,
  (SELECT count(*) FROM supplier) AS n FROM calls GROUP BY 1)""")
def ind10_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.shrinkage(m.calls(), m.raw("supplier"))


@query("ind10_4_schedule_efficiency", with_("calls") + f"""SELECT count(*) AS intervals, {r4('sum(req)')} AS required_total,
  {r4('(1.0 - sum(abs(req - sched)) / sum(req)) * 100.0')} AS efficiency_pct,
  {_status('(1.0 - sum(abs(req - sched)) / sum(req)) * 100.0', 95.0, 90.0)} AS status FROM (
  SELECT CAST(call_time AS DATE) AS day, sum(duration_min) / 480.0 AS req, count(DISTINCT agent_id) AS sched FROM calls
  WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY 1)""")
def ind10_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.schedule_efficiency(m.calls(), _calls_asof(m), 30 * DAY)


@query("ind11_4_coaching_priority", with_("calls") + f"""SELECT vendor_id, agent_id, {r4('score')} AS score, {r4('best')} AS cohort_best,
  {r4('least(1.0, calls / 20.0)')} AS coachability, {r4('(best - score) * least(1.0, calls / 20.0)')} AS priority,
  (best - score) * least(1.0, calls / 20.0) > 30 AS coach_first FROM (
  SELECT *, max(score) OVER (PARTITION BY vendor_id) AS best FROM (
    SELECT vendor_id, agent_id, avg(mos) * 20.0 AS score, count(*) AS calls FROM calls
    WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY ALL))""")
def ind11_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.coaching_priority(m.calls_geo(), _calls_asof(m), 30 * DAY)


FRESH_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {v})" for s, v in FRESH_LIMITS) + ") t(source, limit_s)"


@query("ind7_3_data_freshness", with_("ev", extra=[("lim", FRESH_SQL)]) + f"""SELECT g.source, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen,
  (epoch_us({EV_ASOF}) - epoch_us(last_seen)) // 1000000 AS age_s, limit_s, last_seen = oldest AS is_worst,
  CASE WHEN (epoch_us({EV_ASOF}) - epoch_us(last_seen)) // 1000000 > limit_s THEN 'Critical'
       WHEN (epoch_us({EV_ASOF}) - epoch_us(last_seen)) // 1000000 > limit_s * 0.85 THEN 'At Risk' ELSE 'Healthy' END AS status
FROM (SELECT g.source, last_seen, COALESCE(lim.limit_s, 60) AS limit_s, min(last_seen) OVER () AS oldest FROM (SELECT event_type AS source, max(ts) AS last_seen FROM ev GROUP BY 1) g LEFT JOIN lim USING (source)) g""")
def ind7_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    lim = F.broadcast(spark.createDataFrame(FRESH_LIMITS, "source string, limit_s int"))
    return I.data_freshness(m.events().withColumnRenamed("event_type", "source"), lim, m.as_of())


REV_SQL = f"""SELECT category, amount, opp AS opportunity FROM (
  SELECT count(*) * {REV_OPP_PER_CALL} AS opp,
    count(*) FILTER (WHERE line_status = 'O' AND queue = 'A') * 35.0 AS abandoned_calls,
    count(*) FILTER (WHERE queue = 'R') * 0.15 * 120.0 AS failed_transfers,
    count(*) FILTER (WHERE line_status = 'O' AND queue = 'N') * 0.30 * 480.0 AS retention_abandons,
    0.0 AS system_downtime, count(*) FILTER (WHERE mos < 3.0) * 25.0 AS quality_failures
  FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)})
UNPIVOT (amount FOR category IN (abandoned_calls, failed_transfers, retention_abandons, system_downtime, quality_failures))"""


@query("ind12_2_revenue_protection", with_("calls", extra=[("c", REV_SQL)]) + f"""SELECT {r4('sum(amount)')} AS revenue_at_risk,
  {r4('opportunity')} AS opportunity, {r4('100.0 - sum(amount) * 100.0 / opportunity')} AS protection_score,
  {_status('100.0 - sum(amount) * 100.0 / opportunity', 97.0, 95.0)} AS status FROM c GROUP BY opportunity""")
def ind12_2(spark, sf_dir):
    """Categories from calls (30 days): sales-queue (A) abandons x $35, transfers (queue R) x 0.15 x $120,
    retention-queue (N) abandons x 0.30 x $480, downtime 0, very poor calls (MOS < 3) x $25; opportunity = calls x $120."""
    m = Model(spark, sf_dir)
    c = m.calls().filter(F.col("call_time") >= _calls_asof(m) - F.make_dt_interval(days=F.lit(30)))
    ab = (F.col("line_status") == "O")
    g = c.agg((F.count(F.lit(1)) * REV_OPP_PER_CALL).alias("opportunity"),
              (F.sum((ab & (F.col("queue") == "A")).cast("long")) * 35.0).alias("abandoned_calls"),
              (F.sum((F.col("queue") == "R").cast("long")) * 0.15 * 120.0).alias("failed_transfers"),
              (F.sum((ab & (F.col("queue") == "N")).cast("long")) * 0.30 * 480.0).alias("retention_abandons"),
              F.lit(0.0).alias("system_downtime"), (F.sum((F.col("mos") < 3.0).cast("long")) * 25.0).alias("quality_failures"))
    comp = g.select("opportunity", F.expr("stack(5, 'abandoned_calls', abandoned_calls, 'failed_transfers', failed_transfers, "
                                          "'retention_abandons', retention_abandons, 'system_downtime', system_downtime, "
                                          "'quality_failures', quality_failures) AS (category, amount)"))
    return I.revenue_protection(comp)


# ------------------------------------------------------------------ IND-4.2
# Agent states (adapter): each event of a user starts a state for `value` minutes, cut at the user's
# next event and at the end of the day; click/view = available, purchase/signup = busy, error = offline.
# Schedule: every user with events on a day is scheduled available 08:00-12:00 and busy 13:00-17:00.
STATE_CASE = "CASE WHEN event_type IN ('click', 'view') THEN 'available' WHEN event_type = 'error' THEN 'offline' ELSE 'busy' END"


def _agent_states(m: Model):
    from pyspark.sql import Window
    e = m.events().withColumn("day", F.date_trunc("day", "ts"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    end = F.least(F.col("ts") + F.make_dt_interval(secs=(F.col("value") * 60).cast("decimal(18,6)")),
                  F.coalesce(F.lead("ts").over(w), F.col("day") + F.make_dt_interval(days=F.lit(1))),
                  F.col("day") + F.make_dt_interval(days=F.lit(1)))
    st = F.when(F.col("event_type").isin("click", "view"), "available").when(F.col("event_type") == "error", "offline") \
        .otherwise("busy")
    states = e.select(F.col("user_id").alias("agent_id"), st.alias("state"), F.col("ts").alias("start_ts"), end.alias("end_ts"))
    days = e.select(F.col("user_id").alias("agent_id"), "day").distinct()
    h = lambda n: F.make_dt_interval(hours=F.lit(n))
    sched = (days.select("agent_id", "day", F.lit("available").alias("state"), (F.col("day") + h(8)).alias("start_ts"),
                         (F.col("day") + h(12)).alias("end_ts"))
             .unionByName(days.select("agent_id", "day", F.lit("busy").alias("state"), (F.col("day") + h(13)).alias("start_ts"),
                                      (F.col("day") + h(17)).alias("end_ts"))))
    return states, sched


@query("ind4_2_schedule_adherence", with_("ev", extra=[("st", f"""SELECT user_id AS agent_id, {STATE_CASE} AS state, ts AS s,
  least(ts + to_seconds(CAST(value * 60 AS DECIMAL(18,6))),
        COALESCE(lead(ts) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id), date_trunc('day', ts) + INTERVAL 1 DAY),
        date_trunc('day', ts) + INTERVAL 1 DAY) AS e FROM ev"""),
    ("days", "SELECT DISTINCT user_id AS agent_id, date_trunc('day', ts) AS day FROM ev"),
    ("sch", """SELECT agent_id, day, 'available' AS state, day + INTERVAL 8 HOUR AS s, day + INTERVAL 12 HOUR AS e FROM days
      UNION ALL SELECT agent_id, day, 'busy', day + INTERVAL 13 HOUR, day + INTERVAL 17 HOUR FROM days"""),
    ("adh", """SELECT sch.day, sum(greatest(0.0, (epoch_us(least(st.e, sch.e)) - epoch_us(greatest(st.s, sch.s))) / 60000000.0)) AS a
      FROM sch JOIN st ON st.agent_id = sch.agent_id AND st.state = sch.state AND st.s < sch.e AND sch.s < st.e GROUP BY sch.day"""),
    ("sm", "SELECT day, sum((epoch_us(e) - epoch_us(s)) / 60000000.0) AS m FROM sch GROUP BY day")]) + f"""
SELECT strftime(sm.day, '%Y-%m-%d') AS day, {r4('sm.m')} AS scheduled_min, {r4('COALESCE(adh.a, 0.0)')} AS adherent_min,
  {r4('COALESCE(adh.a, 0.0) * 100.0 / sm.m')} AS adherence_pct, {_status('COALESCE(adh.a, 0.0) * 100.0 / sm.m', 92.0, 85.0)} AS status
FROM sm LEFT JOIN adh USING (day)""")
def ind4_2(spark, sf_dir):
    states, sched = _agent_states(Model(spark, sf_dir))
    return I.schedule_adherence(states, sched)


# ------------------------------------------------------------------ IND-11.3 / 11.2 / 14.2
# Readiness (adapter): an agent's skills = brands of the parts it ships; queue-required skills =
# brands #11..#15; systems = line statuses seen, required = {F, O}; certifications: current = lines
# with discount < 0.08, required = all lines; tool latency = mean wait (ms).
REQ_SKILLS = ["Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15"]


@query("ind11_3_readiness", f"""WITH a AS (SELECT l.l_suppkey AS agent_id, list_distinct(list(p.p_brand)) AS skills,
  list_distinct(list(l.l_linestatus)) AS systems, count(*) FILTER (WHERE l.l_discount < 0.08) AS cc, count(*) AS cr,
  avg(l.l_tax * 1000.0) AS tool_ms FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1),
x AS (SELECT agent_id, len(list_intersect(skills, {REQ_SKILLS!r})) * 100.0 / {len(REQ_SKILLS)} AS sm,
  len(list_intersect(systems, ['F', 'O'])) * 100.0 / 2 AS sa, cc * 100.0 / cr AS tc, 100.0 - tool_ms / 50.0 AS tp FROM a)
SELECT agent_id, {r4('sm')} AS skill_match, {r4('sa')} AS system_access, {r4('tc')} AS training, {r4('tp')} AS tool_performance,
  {r4('(sm + sa + tc + tp) / 4')} AS readiness_index,
  CASE WHEN (sm + sa + tc + tp) / 4 >= 90 THEN 'Fully ready' WHEN (sm + sa + tc + tp) / 4 >= 75 THEN 'Partially ready'
       ELSE 'Not ready' END AS status FROM x""")
def ind11_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    li, p = m.raw("lineitem"), m.raw("part").select("p_partkey", "p_brand")
    a = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("agent_id")).agg(
        F.collect_set("p_brand").alias("skills"), F.collect_set("l_linestatus").alias("systems"),
        F.sum((F.col("l_discount") < 0.08).cast("long")).alias("certs_current"), F.count(F.lit(1)).alias("certs_required"),
        F.avg(F.col("l_tax") * 1000.0).alias("tool_ms"))
    return I.readiness(a, F.array(*[F.lit(s) for s in REQ_SKILLS]), F.array(F.lit("F"), F.lit("O")))


# Attrition factors (adapter, per agent over the newest 90 days of calls): tenure < 90 days = first call
# within them; declining QA = the last two monthly MOS means each lower than the month before; AHT increase
# = last 30 days > 1.15 x the earlier 60; complaints = 2+ calls with MOS < 3 in the last 30 days;
# absenteeism = fewer than 3 call days in the last 30 days.
def _attrition_factors(m: Model):
    from pyspark.sql import Window
    a = _calls_asof(m)
    c = m.calls().filter(F.col("call_time") >= a - F.make_dt_interval(days=F.lit(90)))
    recent = F.col("call_time") >= a - F.make_dt_interval(days=F.lit(30))
    first_all = m.calls().groupBy("agent_id").agg(F.min("call_time").alias("first"))
    from ..functions.core import rnd as _rnd
    mon = (c.groupBy("agent_id", F.date_trunc("month", "call_time").alias("mth")).agg(_rnd(F.avg("mos"), 6).alias("q")))
    w = Window.partitionBy("agent_id").orderBy("mth")
    mon = (mon.withColumn("drop", (F.col("q") < F.lag("q").over(w)).cast("int"))
           .withColumn("rk", F.row_number().over(w.orderBy(F.col("mth").desc()))))
    qa = mon.filter(F.col("rk") <= 2).groupBy("agent_id").agg(
        ((F.sum(F.coalesce("drop", F.lit(0))) >= 2)).alias("declining_qa"))
    g = c.groupBy("agent_id").agg(
        F.avg(F.when(recent, F.col("duration_min"))).alias("aht_recent"),
        F.avg(F.when(~recent, F.col("duration_min"))).alias("aht_base"),
        F.sum((recent & (F.col("mos") < 3.0)).cast("long")).alias("poor"),
        F.countDistinct(F.when(recent, F.to_date("call_time"))).alias("days"))
    j = g.join(first_all, "agent_id").join(qa, "agent_id", "left")
    return j.select("agent_id", (F.col("first") >= a - F.make_dt_interval(days=F.lit(90))).alias("tenure_lt_90d"),
                    F.coalesce("declining_qa", F.lit(False)).alias("declining_qa"),
                    (F.col("days") < 3).alias("absenteeism"),
                    F.coalesce(F.col("aht_recent") > F.col("aht_base") * 1.15, F.lit(False)).alias("aht_increase"),
                    (F.col("poor") >= 2).alias("complaints"))


ATTR_SQL = with_("calls", extra=[("c", f"SELECT * FROM calls WHERE call_time >= {CALLS_ASOF} - INTERVAL 90 DAY"),
    ("fa", "SELECT agent_id, min(call_time) AS first FROM calls GROUP BY 1"),
    ("mon", """SELECT agent_id, mth, CASE WHEN q < lag(q) OVER (PARTITION BY agent_id ORDER BY mth) THEN 1 ELSE 0 END AS dr,
       row_number() OVER (PARTITION BY agent_id ORDER BY mth DESC) AS rk FROM (
       SELECT agent_id, date_trunc('month', call_time) AS mth, """ + rnd("avg(mos)", 6) + """ AS q FROM c GROUP BY ALL)"""),
    ("qa", "SELECT agent_id, sum(dr) >= 2 AS declining_qa FROM mon WHERE rk <= 2 GROUP BY 1"),
    ("g", f"""SELECT agent_id, avg(duration_min) FILTER (WHERE call_time >= {CALLS_ASOF} - INTERVAL 30 DAY) AS ar,
       avg(duration_min) FILTER (WHERE call_time < {CALLS_ASOF} - INTERVAL 30 DAY) AS ab,
       count(*) FILTER (WHERE call_time >= {CALLS_ASOF} - INTERVAL 30 DAY AND mos < 3.0) AS poor,
       count(DISTINCT CASE WHEN call_time >= {CALLS_ASOF} - INTERVAL 30 DAY THEN CAST(call_time AS DATE) END) AS days FROM c GROUP BY 1"""),
    ("f", f"""SELECT g.agent_id, fa.first >= {CALLS_ASOF} - INTERVAL 90 DAY AS tenure_lt_90d, COALESCE(qa.declining_qa, FALSE) AS declining_qa,
       days < 3 AS absenteeism, COALESCE(ar > ab * 1.15, FALSE) AS aht_increase, poor >= 2 AS complaints
       FROM g JOIN fa USING (agent_id) LEFT JOIN qa USING (agent_id)""")])
_PTS = "+".join(f"CASE WHEN {k} THEN {v} ELSE 0 END" for k, v in I.ATTRITION_POINTS.items()
                if k in ("tenure_lt_90d", "declining_qa", "absenteeism", "aht_increase", "complaints"))


@query("ind11_2_attrition_risk", ATTR_SQL + f"""SELECT agent_id, tenure_lt_90d, declining_qa, absenteeism, aht_increase, complaints,
  least(100, {_PTS}) AS risk_score, CASE WHEN least(100, {_PTS}) < 25 THEN 'Low' WHEN least(100, {_PTS}) < 50 THEN 'Medium'
  WHEN least(100, {_PTS}) < 75 THEN 'High' ELSE 'Critical' END AS risk_level FROM f""")
def ind11_2(spark, sf_dir):
    return I.attrition_risk(_attrition_factors(Model(spark, sf_dir)))


# Consent (adapter): outbound calls = lines (time = ship date + order key % 24 hours, purpose by line number, UTC offset -8..-5 by customer);
# consent events = orders (type by order key % 3, every tenth order and those in progress revoke); do-not-call = odd customers with a debt, since 1995-06-17.
PURPOSES = ["marketing", "informational", "transactional", "collections"]


IND14_2_SQL = f"""WITH ob AS (
  SELECT o.o_custkey AS customer_id, {PURPOSES!r}[l.l_linenumber % 4 + 1] AS call_type, CAST(l.l_shipdate AS TIMESTAMP) + to_hours(l.l_orderkey % 24) AS call_time,
    CAST(o.o_custkey % 4 AS INTEGER) - 8 AS utc_offset_h FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
ce AS (SELECT o_custkey AS customer_id, ['written', 'verbal', 'ebr'][o_orderkey % 3 + 1] AS consent_type, o_orderkey AS event_id,
    CASE WHEN o_orderstatus = 'P' OR o_orderkey % 10 = 0 THEN 'revoke' ELSE 'grant' END AS action,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) AS happened FROM orders),
dnc AS (SELECT c_custkey AS customer_id, TIMESTAMP '1995-06-17' AS since FROM customer WHERE c_acctbal < 0 AND c_custkey % 2 = 1),
st AS (SELECT ob.*, w.action AS w, v.action AS v, e.action AS e, dnc.since FROM ob
  ASOF LEFT JOIN (SELECT customer_id, happened, arg_max(action, event_id) AS action FROM ce WHERE consent_type = 'written' GROUP BY 1, 2) w
    ON w.customer_id = ob.customer_id AND w.happened <= ob.call_time
  ASOF LEFT JOIN (SELECT customer_id, happened, arg_max(action, event_id) AS action FROM ce WHERE consent_type = 'verbal' GROUP BY 1, 2) v
    ON v.customer_id = ob.customer_id AND v.happened <= ob.call_time
  ASOF LEFT JOIN (SELECT customer_id, happened, arg_max(action, event_id) AS action FROM ce WHERE consent_type = 'ebr' GROUP BY 1, 2) e
    ON e.customer_id = ob.customer_id AND e.happened <= ob.call_time
  LEFT JOIN dnc ON dnc.customer_id = ob.customer_id),
n AS (SELECT *, CASE call_type WHEN 'marketing' THEN [w] WHEN 'informational' THEN [w, v] WHEN 'transactional' THEN [e] ELSE [w, v, e] END AS needed,
    hour(call_time + to_hours(utc_offset_h)) AS local FROM st),
r AS (SELECT call_type, CASE WHEN list_contains(needed, 'grant') THEN
      CASE WHEN since <= call_time THEN 'do_not_call' WHEN local < 8 OR local > 20 THEN 'outside_hours' ELSE 'verified' END
    WHEN list_contains(needed, 'revoke') THEN 'revoked' WHEN list_contains([w, v, e], 'grant') THEN 'wrong_type' ELSE 'no_consent' END AS reason FROM n)
SELECT COALESCE(call_type, 'ALL') AS call_type, count(*) AS outbound, count(*) FILTER (WHERE reason = 'verified') AS verified,
  {', '.join(f"count(*) FILTER (WHERE reason = '{b}') AS {b}" for b in I.BLOCKS)},
  {r4("count(*) FILTER (WHERE reason = 'verified') * 100.0 / count(*)")} AS verification_rate,
  {r4("100.0 - count(*) FILTER (WHERE reason = 'verified') * 100.0 / count(*)")} AS block_rate,
  {_status("count(*) FILTER (WHERE reason = 'verified') * 100.0 / count(*)", 100.0, 99.0)} AS status FROM r GROUP BY ROLLUP (call_type)"""


@query("ind14_2_consent_verification", IND14_2_SQL)
def ind14_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    o = m.raw("orders")
    hours = lambda day, key: F.col(day).cast("timestamp") + F.make_dt_interval(hours=(F.col(key) % 24).cast("int"))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    calls = m.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("o_custkey").alias("customer_id"),
        pick(PURPOSES, F.col("l_linenumber") % 4).alias("call_type"), hours("l_shipdate", "l_orderkey").alias("call_time"),
        (F.col("o_custkey") % 4 - 8).cast("int").alias("utc_offset_h"))
    events = o.select(F.col("o_custkey").alias("customer_id"), pick(I.CONSENT_TYPES, F.col("o_orderkey") % 3).alias("consent_type"),
                      F.when((F.col("o_orderstatus") == "P") | (F.col("o_orderkey") % 10 == 0), "revoke").otherwise("grant").alias("action"),
                      hours("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("event_id"))
    dnc = m.raw("customer").filter((F.col("c_acctbal") < 0) & (F.col("c_custkey") % 2 == 1)).select(
        F.col("c_custkey").alias("customer_id"), F.lit("1995-06-17").cast("timestamp").alias("since"))
    return I.consent_verification(calls, events, dnc)


# ------------------------------------------------------------------ IND-6.1 / 6.3 / 12.4 / 7.1 / 8.2 / 1.3
# Adapters: IVR = 'view' contacts, chatbot = 'click' contacts, intent = customer_id % 4 (billing,
# technical, account, sales); failure contacts = 'error'; screen pops = 'purchase' events with
# pop latency = value ms; MFA: users active in the last 7 days, enrolled = users with a signup event;
# headroom components per region and hour: events / 30, users / 20, Σvalue / 3000, errors / 10.
NEXT = ("nx", """SELECT *, lead(contact_time) OVER w AS next_time, lead(channel) OVER w AS next_channel FROM contacts
  WINDOW w AS (PARTITION BY customer_id ORDER BY contact_time, contact_id)""")
WITHIN_DAY = "(next_time IS NOT NULL AND next_time <= contact_time + INTERVAL 1 DAY)"
INTENT = "CASE customer_id % 4 WHEN 0 THEN 'billing' WHEN 1 THEN 'technical' WHEN 2 THEN 'account' ELSE 'sales' END"


@query("ind6_1_ivr_containment", with_("contacts", extra=[NEXT]) + f"""SELECT count(*) AS ivr_sessions,
  {r4(f'count(*) FILTER (WHERE NOT {WITHIN_DAY}) * 100.0 / count(*)')} AS strict_pct,
  {r4(f'count(*) FILTER (WHERE NOT ({WITHIN_DAY} AND next_channel <> channel)) * 100.0 / count(*)')} AS broad_pct,
  {_status(f'count(*) FILTER (WHERE NOT ({WITHIN_DAY} AND next_channel <> channel)) * 100.0 / count(*)', 68.0, 60.0)} AS status
FROM nx WHERE channel = 'view'""")
def ind6_1(spark, sf_dir):
    return I.ivr_containment(Model(spark, sf_dir).contacts(), "view")


@query("ind6_3_chatbot_by_intent", with_("contacts", extra=[NEXT]) + f"""SELECT {INTENT} AS intent, count(*) AS sessions,
  {r4(f'count(*) FILTER (WHERE NOT {WITHIN_DAY}) * 100.0 / count(*)')} AS resolution_pct,
  {r4(f'count(*) FILTER (WHERE {WITHIN_DAY} AND next_channel <> channel) * 100.0 / count(*)')} AS escalation_pct,
  {_status(f'count(*) FILTER (WHERE NOT {WITHIN_DAY}) * 100.0 / count(*)', 65.0, 55.0)} AS status
FROM nx WHERE channel = 'click' GROUP BY 1""")
def ind6_3(spark, sf_dir):
    c = F.col("customer_id") % 4
    intent = F.when(c == 0, "billing").when(c == 1, "technical").when(c == 2, "account").otherwise("sales")
    return I.chatbot_by_intent(Model(spark, sf_dir).contacts(), "click", intent)


@query("ind12_4_avoidable_contacts", with_("contacts", extra=[("r", """SELECT *, lag(contact_time) OVER (PARTITION BY customer_id, category
  ORDER BY contact_time, contact_id) AS prev FROM contacts"""), ("x", """SELECT *, (prev IS NOT NULL AND contact_time <= prev + INTERVAL 7 DAY)
  OR channel = 'error' AS av FROM r""")]) + f"""SELECT category, count(*) AS contacts, count(*) FILTER (WHERE av) AS avoidable,
  {r4('count(*) FILTER (WHERE av) * 6.0')} AS avoidable_cost, {r4('count(*) FILTER (WHERE av) * 100.0 / count(*)')} AS avoidable_rate_pct,
  {_status('count(*) FILTER (WHERE av) * 100.0 / count(*)', 15.0, 25.0, higher=False)} AS status FROM x GROUP BY category""")
def ind12_4(spark, sf_dir):
    return I.avoidable_contacts(Model(spark, sf_dir).contacts())


@query("ind7_1_screen_pop", with_("ev") + f"""SELECT count(*) AS pops, {r4('count(*) FILTER (WHERE value <= 100.0) * 100.0 / count(*)')} AS strict_pct,
  {r4('count(*) FILTER (WHERE value <= 300.0) * 100.0 / count(*)')} AS broad_pct,
  {_status('count(*) FILTER (WHERE value <= 300.0) * 100.0 / count(*)', 99.0, 95.0)} AS status
FROM ev WHERE event_type = 'purchase' AND {_since('ts', EV_ASOF, EV_W)}""")
def ind7_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    p = m.events().filter(F.col("event_type") == "purchase").select("ts", F.col("value").alias("pop_ms"))
    return I.screen_pop(p, m.as_of(), EV_W)


@query("ind8_2_mfa_compliance", with_("ev") + f"""SELECT count(*) AS active_users, count(*) - count(en.user_id) AS remediation_needed,
  {r4('count(en.user_id) * 100.0 / count(*)')} AS compliance_pct, {_status('count(en.user_id) * 100.0 / count(*)', 100.0, 99.0)} AS status
FROM (SELECT DISTINCT user_id FROM ev WHERE {_since('ts', EV_ASOF, EV_W)}) u
LEFT JOIN (SELECT DISTINCT user_id FROM ev WHERE event_type = 'signup') en USING (user_id)""")
def ind8_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    e = m.events()
    users = e.filter(F.col("ts") >= m.as_of() - F.make_dt_interval(days=F.lit(7))).select("user_id").distinct()
    enrolled = e.filter(F.col("event_type") == "signup").select("user_id").distinct()
    return I.mfa_compliance(users, enrolled)


HEADROOM_CAPS = {"cpu": 30.0, "memory": 20.0, "db": 3000.0, "network": 10.0}


@query("ind1_3_headroom", with_("ev", "applications", extra=[EVR, ("u", """SELECT region, date_trunc('hour', ts) AS h, count(*) AS cpu,
  count(DISTINCT user_id) AS memory, sum(value) AS db, count(*) FILTER (WHERE event_type = 'error') AS network FROM evr GROUP BY ALL""")]) + f"""
SELECT region, {', '.join(f"{r4(f'100.0 - max({c}) * 100.0 / {cap}')} AS {c}_headroom" for c, cap in HEADROOM_CAPS.items())},
  {r4('least(' + ', '.join(f'100.0 - max({c}) * 100.0 / {cap}' for c, cap in HEADROOM_CAPS.items()) + ')')} AS headroom_pct,
  {_status('least(' + ', '.join(f'100.0 - max({c}) * 100.0 / {cap}' for c, cap in HEADROOM_CAPS.items()) + ')', 20.0, 10.0)} AS status
FROM u GROUP BY region""")
def ind1_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    u = (_ev_region(m).groupBy("region", F.date_trunc("hour", "ts").alias("h"))
         .agg(F.count(F.lit(1)).cast("double").alias("cpu"), F.countDistinct("user_id").cast("double").alias("memory"),
              F.sum("value").alias("db"), F.sum((F.col("event_type") == "error").cast("long")).cast("double").alias("network")))
    return I.headroom(u, HEADROOM_CAPS)


# ------------------------------------------------------------------ IND-9.2 / KPI-20
@query("ind9_2_ces_predictor", with_("contacts", extra=[("c", """SELECT *,
  lag(contact_time) OVER w AS p_t, lag(channel) OVER w AS p_ch, lead(contact_time) OVER w AS n_t, lead(channel) OVER w AS n_ch,
  lag(contact_time) OVER (PARTITION BY customer_id, category ORDER BY contact_time, contact_id) AS pc_t FROM contacts
  WINDOW w AS (PARTITION BY customer_id ORDER BY contact_time, contact_id)"""),
    ("a", "SELECT category, avg(value) AS cat_avg FROM contacts GROUP BY 1"),
    ("x", """SELECT c.category, 100 - (CASE WHEN COALESCE(pc_t IS NOT NULL AND contact_time <= pc_t + INTERVAL 7 DAY, FALSE) THEN 20 ELSE 0 END
      + CASE WHEN value > 120.0 THEN 15 ELSE 0 END
      + CASE WHEN COALESCE(p_ch = 'error' AND contact_time <= p_t + INTERVAL 1 HOUR, FALSE) THEN 10 ELSE 0 END
      + CASE WHEN COALESCE(p_ch <> channel AND contact_time <= p_t + INTERVAL 1 DAY, FALSE) THEN 15 ELSE 0 END
      + CASE WHEN COALESCE(n_ch <> channel AND n_t <= contact_time + INTERVAL 1 DAY, FALSE) THEN 10 ELSE 0 END
      + CASE WHEN value > 2 * a.cat_avg THEN 10 ELSE 0 END) AS ces_p FROM c JOIN a USING (category)""")]) + f"""
SELECT category, count(*) AS contacts, {r4('avg(ces_p)')} AS ces_predictor, {r4('count(*) FILTER (WHERE ces_p < 60) * 100.0 / count(*)')} AS high_effort_pct,
  CASE WHEN {r4('avg(ces_p)')} >= 75 THEN 'Healthy' WHEN {r4('avg(ces_p)')} >= 60 THEN 'At Risk' ELSE 'Critical' END AS status
FROM x GROUP BY category""")
def ind9_2(spark, sf_dir):
    return I.ces_predictor(Model(spark, sf_dir).contacts())


# Event id (adapter) = 'E' || value class of 50 for error events; servers = users; silo = region.
@query("kpi20_root_cause", with_("ev", "applications", extra=[("e", f"""SELECT 'E' || CAST(CAST(floor(e.value / 50) AS BIGINT) AS VARCHAR) AS event_code,
  a.infrastructure_group AS silo, e.user_id AS server FROM ev e JOIN applications a ON a.application_id = e.app
  WHERE e.event_type = 'error' AND {_since('e.ts', EV_ASOF, 7 * DAY)}""")]) + f"""
SELECT t.event_code, t.events, t.servers, CASE WHEN t.servers >= 10 THEN 'P1' WHEN t.servers >= 5 THEN 'P2' ELSE 'P3' END AS priority,
  s.silo AS top_silo, {r4('s.n * 100.0 / t.events')} AS top_silo_share_pct FROM
  (SELECT event_code, count(*) AS events, count(DISTINCT server) AS servers FROM e GROUP BY 1) t JOIN
  (SELECT event_code, arg_max(silo, (n, silo)) AS silo, max(n) AS n FROM (SELECT event_code, silo, count(*) AS n FROM e GROUP BY ALL)
   GROUP BY 1) s USING (event_code)""")
def kpi20(spark, sf_dir):
    m = Model(spark, sf_dir)
    e = _ev_region(m).filter(F.col("event_type") == "error").select(
        "ts", F.concat(F.lit("E"), F.floor(F.col("value") / 50).cast("long").cast("string")).alias("event_code"),
        F.col("region").alias("silo"), F.col("user_id").alias("server"))
    return K.root_cause(e, m.as_of(), 7 * DAY)


# ------------------------------------------------------------------ IND-12.3 / 5.4 / 13.4
@query("ind12_3_labour_efficiency", with_("calls") + f"""SELECT vendor_id, count(*) AS contacts, {r4('avg(mos) * 20.0')} AS qa_score,
  {r4('0.8 + avg(mos) * 20.0 / 100.0 * 0.4')} AS quality_factor,
  {r4('count(*) * (0.8 + avg(mos) * 20.0 / 100.0 * 0.4) / (count(DISTINCT (agent_id, CAST(call_time AS DATE))) * 8.0)')} AS labour_efficiency,
  {_status('count(*) * (0.8 + avg(mos) * 20.0 / 100.0 * 0.4) / (count(DISTINCT (agent_id, CAST(call_time AS DATE))) * 8.0)', 4.0, 3.0)} AS status
FROM calls WHERE {_since('call_time', CALLS_ASOF, 30 * DAY)} GROUP BY vendor_id""")
def ind12_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    return I.labour_efficiency(m.calls_geo(), _calls_asof(m), 30 * DAY)


# VDAs (adapter): hosts seen in the newest hour; Registered unless their latest status is UNHEALTHY;
# load index = 100 x events of the host in that hour; critical alert = an error above 300 in that hour.
@query("ind5_4_vda_health", with_("ev", extra=[("v", f"""SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0
  THEN 'Unregistered' ELSE 'Registered' END AS state, count(*) * 100.0 AS load_index,
  count(*) FILTER (WHERE event_type = 'error' AND value > 300) > 0 AS critical_alert FROM ev
  WHERE ts >= date_trunc('hour', {EV_ASOF}) GROUP BY 1""")]) + f"""SELECT count(*) AS vdas,
  count(*) FILTER (WHERE state = 'Registered' AND load_index < 10000.0 AND NOT critical_alert) AS healthy,
  {r4("count(*) FILTER (WHERE state = 'Registered' AND load_index < 10000.0 AND NOT critical_alert) * 100.0 / count(*)")} AS vda_health_pct,
  count(*) FILTER (WHERE state = 'Registered' AND load_index < 10000.0 AND NOT critical_alert) * 60 AS available_sessions,
  {_status("count(*) FILTER (WHERE state = 'Registered' AND load_index < 10000.0 AND NOT critical_alert) * 100.0 / count(*)", 85.0, 75.0)} AS status FROM v""")
def ind5_4(spark, sf_dir):
    m = Model(spark, sf_dir)
    e = m.events().filter(F.col("ts") >= F.date_trunc("hour", m.as_of()))
    v = e.groupBy("user_id").agg(
        F.when(F.sum((F.col("event_type") == "error").cast("int")) > 0, "Unregistered").otherwise("Registered").alias("state"),
        (F.count(F.lit(1)) * 100.0).alias("load_index"),
        (F.sum(((F.col("event_type") == "error") & (F.col("value") > 300)).cast("int")) > 0).alias("critical_alert"))
    return I.vda_health(v)


def _ces_sql():
    return with_("contacts", extra=[("c", """SELECT *,
  lag(contact_time) OVER w AS p_t, lag(channel) OVER w AS p_ch, lead(contact_time) OVER w AS n_t, lead(channel) OVER w AS n_ch,
  lag(contact_time) OVER (PARTITION BY customer_id, category ORDER BY contact_time, contact_id) AS pc_t FROM contacts
  WINDOW w AS (PARTITION BY customer_id ORDER BY contact_time, contact_id)"""),
        ("a", "SELECT category, avg(value) AS cat_avg FROM contacts GROUP BY 1"),
        ("x", """SELECT c.*, 100 - (CASE WHEN COALESCE(pc_t IS NOT NULL AND contact_time <= pc_t + INTERVAL 7 DAY, FALSE) THEN 20 ELSE 0 END
      + CASE WHEN value > 120.0 THEN 15 ELSE 0 END
      + CASE WHEN COALESCE(p_ch = 'error' AND contact_time <= p_t + INTERVAL 1 HOUR, FALSE) THEN 10 ELSE 0 END
      + CASE WHEN COALESCE(p_ch <> channel AND contact_time <= p_t + INTERVAL 1 DAY, FALSE) THEN 15 ELSE 0 END
      + CASE WHEN COALESCE(n_ch <> channel AND n_t <= contact_time + INTERVAL 1 DAY, FALSE) THEN 10 ELSE 0 END
      + CASE WHEN value > 2 * a.cat_avg THEN 10 ELSE 0 END) AS ces_p FROM c JOIN a USING (category)"""),
        ("cat", f"SELECT category, count(*) AS n, {r4('avg(ces_p)')} AS ces FROM x GROUP BY 1"),
        ("cd", """SELECT customer_id, CAST(contact_time AS DATE) AS day, count(*) FILTER (WHERE channel IN ('click', 'view')) AS dig,
       count(*) FILTER (WHERE channel = 'error') AS fail FROM contacts GROUP BY ALL"""),
        ("parts", """SELECT (SELECT count(*) FILTER (WHERE fail = 0) * 100.0 / count(*) FROM cd WHERE dig > 0) AS task_completion,
       (SELECT avg(CASE WHEN value < 30 THEN 100.0 WHEN value <= 60 THEN 80.0 ELSE greatest(0.0, 120.0 - value) END)
          FROM contacts WHERE channel IN ('click', 'view')) AS response_time,
       (SELECT sum(ces * n) / sum(n) FROM cat) AS effort,
       100.0 - (SELECT count(*) FILTER (WHERE pc_t IS NOT NULL AND contact_time <= pc_t + INTERVAL 7 DAY) * 100.0 / count(*) FROM x) AS satisfaction,
       (SELECT count(*) FROM contacts) AS contacts""")])


DXS = "task_completion * 0.3 + response_time * 0.25 + effort * 0.25 + satisfaction * 0.2"


@query("ind13_4_digital_experience", _ces_sql() + f"""SELECT contacts, {r4('task_completion')} AS task_completion,
  {r4('response_time')} AS response_time, {r4('effort')} AS effort, {r4('satisfaction')} AS satisfaction, {r4(DXS)} AS dxs,
  {_status(r4(DXS), 80.0, 65.0)} AS status FROM parts""")
def ind13_4(spark, sf_dir):
    return I.digital_experience(Model(spark, sf_dir).contacts())


# ------------------------------------------------------------------ IND-4.4 (same agent states and schedule as IND-4.2)
@query("ind4_4_unplanned_shrinkage", with_("ev", extra=[("st", f"""SELECT user_id AS agent_id, {STATE_CASE} AS state, ts AS s,
  least(ts + to_seconds(CAST(value * 60 AS DECIMAL(18,6))),
        COALESCE(lead(ts) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id), date_trunc('day', ts) + INTERVAL 1 DAY),
        date_trunc('day', ts) + INTERVAL 1 DAY) AS e FROM ev"""),
    ("days", "SELECT DISTINCT user_id AS agent_id, date_trunc('day', ts) AS day FROM ev"),
    ("sch", """SELECT agent_id, day, day + INTERVAL 8 HOUR AS s, day + INTERVAL 12 HOUR AS e FROM days
      UNION ALL SELECT agent_id, day, day + INTERVAL 13 HOUR, day + INTERVAL 17 HOUR FROM days"""),
    ("ov", """SELECT sch.day, st.state, greatest(0.0, (epoch_us(least(st.e, sch.e)) - epoch_us(greatest(st.s, sch.s))) / 60000000.0) AS m
      FROM sch JOIN st ON st.agent_id = sch.agent_id AND st.s < sch.e AND sch.s < st.e"""),
    ("cov", "SELECT day, sum(m) AS covered, sum(CASE WHEN state = 'offline' THEN m ELSE 0.0 END) AS technical FROM ov GROUP BY day"),
    ("sm", "SELECT day, sum((epoch_us(e) - epoch_us(s)) / 60000000.0) AS scheduled FROM sch GROUP BY day"),
    ("d", """SELECT sm.day, sm.scheduled, COALESCE(cov.covered, 0.0) AS covered, COALESCE(cov.technical, 0.0) AS technical
      FROM sm LEFT JOIN cov USING (day)""")]) + f"""
SELECT strftime(day, '%Y-%m-%d') AS day, {r4('scheduled')} AS scheduled_min, {r4('technical * 100.0 / scheduled')} AS technical_pct,
  {r4('(scheduled - covered) * 100.0 / scheduled')} AS absence_pct,
  {r4('(technical + scheduled - covered) * 100.0 / scheduled')} AS unplanned_shrinkage_pct,
  {_status('(technical + scheduled - covered) * 100.0 / scheduled', 6.0, 10.0, higher=False)} AS status FROM d""")
def ind4_4(spark, sf_dir):
    states, sched = _agent_states(Model(spark, sf_dir))
    return I.unplanned_shrinkage(states, sched)
