"""Queries for IND-1.2, 5.3, 6.2, 9.1, 9.3 and 14.3.

Stand-ins (the given tables have no such columns): recognitions are events (an error is a rejection, values over 400 and
300 are wrong words); interactions are calls (knowledge hit: even agent; transfer, issue and resolution by queue and status);
index components are shares of an application's events by class of user. The oracles state the points and limits by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import DAY
from ..operators import indicators as I
from ..operators import predictors as P
from ..sources.adapters import Model
from .enterprise_plans import CALLS_ASOF, EV_ASOF, EV_W, _calls_asof, _since, _status
from .oracle_base import r4, with_
from .registry import query

W = 30 * DAY


@query("ind6_2_asr_accuracy", with_("ev", extra=[("r", f"""SELECT app AS menu, CASE WHEN event_type = 'error' THEN 'rejection' WHEN value > 400 THEN 'substitution'
  WHEN value > 300 THEN 'deletion' ELSE 'correct' END AS outcome, user_id % 7 + 1 AS words FROM ev WHERE {_since('ts', EV_ASOF, EV_W)}""")]) + f"""
SELECT menu, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'rejection') AS rejections,
  {r4("count(*) FILTER (WHERE outcome = 'correct') * 100.0 / count(*)")} AS accuracy_pct,
  {r4("100.0 - count(*) FILTER (WHERE outcome IN ('substitution', 'deletion')) * 100.0 / sum(words)")} AS word_accuracy_pct,
  {_status("count(*) FILTER (WHERE outcome = 'correct') * 100.0 / count(*)", 92.0, 88.0)} AS status FROM r GROUP BY menu""")
def ind6_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    outcome = (F.when(F.col("event_type") == "error", "rejection").when(F.col("value") > 400, "substitution")
               .when(F.col("value") > 300, "deletion").otherwise("correct"))
    r = m.events().select(F.col("app").alias("menu"), "ts", outcome.alias("outcome"), (F.col("user_id") % 7 + 1).alias("words"))
    r = r.withColumn("errors", F.col("outcome").isin("substitution", "deletion").cast("int"))
    return P.asr_accuracy(r, m.as_of(), EV_W)


def _interactions(m: Model):
    q, st = F.col("queue"), F.col("line_status")
    return m.calls().select(
        "queue", F.col("call_time").alias("ts"), (F.col("agent_id") % 2 == 0).alias("kb_hit"),
        F.when(q == "A", "none").when(q == "N", "warm").otherwise("cold").alias("transfer"), F.col("wait_sec").alias("hold_sec"),
        (F.col("duration_min") * 60).alias("talk_sec"), F.when(st == "F", "resolved").alias("wrap_code"), "mos",
        F.when(st == "F", "resolved").when(q == "R", "unresolved").otherwise("partial").alias("resolution"),
        (F.lit(100.0) - F.col("wait_sec")).alias("ces"), F.when(q == "A", "minor").when(q == "N", "billing").otherwise("outage").alias("issue"))


FCR = """((CASE WHEN agent_id % 2 = 0 THEN 20.0 ELSE 0.0 END) + (CASE queue WHEN 'A' THEN 25.0 WHEN 'N' THEN 15.0 ELSE 0.0 END)
  + (CASE WHEN wait_sec / (duration_min * 60) < 0.15 THEN 20.0 ELSE 0.0 END) + greatest(0.0, least(20.0, (mos - 1) * 5.0))
  + (CASE WHEN line_status = 'F' THEN 15.0 ELSE 0.0 END)) * 100.0 / (CASE WHEN line_status = 'F' THEN 100.0 ELSE 85.0 END)"""


@query("ind9_1_fcr_predictor", with_("calls", extra=[("s", f"SELECT queue, line_status, {FCR} AS score FROM calls WHERE {_since('call_time', CALLS_ASOF, W)}")]) + f"""
SELECT queue, count(*) AS interactions, count(*) FILTER (WHERE line_status <> 'F') AS pending, {r4('avg(score)')} AS fcr_predictor,
  {_status(r4('avg(score)'), 85.0, 70.0)} AS status FROM s GROUP BY queue""")
def ind9_1(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.fcr_predictor(_interactions(m).withColumn("sentiment", (F.col("mos") - 1) * 5.0), _calls_asof(m), W)


NPS = """greatest(0.0, least(25.0, (mos - 1) * 6.25)) + (CASE WHEN line_status = 'F' THEN 25.0 WHEN queue = 'R' THEN 5.0 ELSE 15.0 END)
  + (100.0 - wait_sec) / 4.0 - (CASE queue WHEN 'A' THEN 2.0 WHEN 'N' THEN 5.0 ELSE 15.0 END)"""


@query("ind9_3_nps_predictor", with_("calls", extra=[("s", f"SELECT queue, {NPS} AS score FROM calls WHERE {_since('call_time', CALLS_ASOF, W)}")]) + f"""
SELECT queue, count(*) AS interactions, count(*) FILTER (WHERE score >= 70) AS promoters, count(*) FILTER (WHERE score >= 50 AND score < 70) AS passives,
  count(*) FILTER (WHERE score < 50) AS detractors, {r4('avg(score)')} AS nps_predictor, {_status(r4('avg(score)'), 65.0, 50.0)} AS status FROM s GROUP BY queue""")
def ind9_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.nps_predictor(_interactions(m).withColumn("sentiment", (F.col("mos") - 1) * 6.25), _calls_asof(m), W)


def _component(i: int, k: int) -> str:
    return f"100.0 - 100.0 * count(*) FILTER (WHERE event_type = 'error' AND user_id % {k} = {i}) / count(*)"


def _components(m: Model, names, scale: float = 1.0):
    """Share of an application's events that are no errors of the i-th class of users, for each component."""
    k = len(names)
    bad = [F.sum(((F.col("event_type") == "error") & (F.col("user_id") % k == i)).cast("int")) for i in range(k)]
    return m.events().groupBy(F.col("app").alias("application_id")).agg(
        *[((F.lit(100.0) - F.lit(100.0) * b / F.count(F.lit(1))) * scale).alias(n) for n, b in zip(names, bad)])


def _index_sql(weights, target, critical, scale=1.0):
    s = " + ".join(f"({_component(i, len(weights))}) * {scale} * {w}" for i, w in enumerate(weights))
    return with_("ev") + f"SELECT app AS application_id, {r4(s)} AS score, {_status(r4(s), target, critical)} AS status FROM ev GROUP BY app"


@query("ind1_2_dr_readiness", _index_sql([0.30, 0.25, 0.25, 0.20], 95.0, 85.0))
def ind1_2(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.index_with_status(_components(m, list(I.DR_WEIGHTS)), I.DR_WEIGHTS, 95.0, 85.0, ["application_id"])


@query("ind5_3_agent_dex", _index_sql([0.20, 0.15, 0.25, 0.20, 0.20], 8.0, 7.0, 0.1))
def ind5_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.index_with_status(_components(m, list(I.DEX_WEIGHTS), 0.1), I.DEX_WEIGHTS, 8.0, 7.0, ["application_id"])


@query("ind14_3_privacy_score", _index_sql([0.15, 0.20, 0.15, 0.15, 0.15, 0.10, 0.10], 98.0, 95.0))
def ind14_3(spark, sf_dir):
    m = Model(spark, sf_dir)
    return P.index_with_status(_components(m, list(I.PRIVACY_WEIGHTS)), I.PRIVACY_WEIGHTS, 98.0, 95.0, ["application_id"])
