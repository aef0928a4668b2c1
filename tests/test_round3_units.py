"""Fixtures in which the special rules fire: handle-time cut, consent reasons, outage run-ups, threshold curve, retention, insight templates."""

import datetime as dt
import random

from pyspark.sql import functions as F

from opsight.operators import indicators as I
from opsight.operators import leading as L
from opsight.operators import signals as S
from opsight.sources import sinks as K

T0 = dt.datetime(2024, 3, 4)  # a Monday


def at(hours):
    return T0 + dt.timedelta(hours=hours)


# ------------------------------------------------------------------ IND-10.2
def test_handle_time_baseline_cuts_single_calls(spark):
    """Four Mondays at ten: 40 calls of 450 to 474 s and one of 9,000 s; the fifth Monday is 10 % longer, by its talk time."""
    rows = [("q", T0 + dt.timedelta(days=7 * w, hours=10, minutes=i), 400 + 8 * (i % 4), 40, 10) for w in range(4) for i in range(10)]
    rows += [("q", T0 + dt.timedelta(hours=10, minutes=59), 8950, 40, 10)]
    rows += [("q", T0 + dt.timedelta(days=28, hours=10), 460, 41, 10), ("q", T0 + dt.timedelta(days=28, hours=11), 500, 40, 10), ("q", T0 + dt.timedelta(days=24, hours=10), 500, 40, 10)]
    calls = spark.createDataFrame(rows, "queue string, call_time timestamp, talk_s long, hold_s long, acw_s long")
    got = {(r["day"], r["slot"]): r for r in I.aht_deviation(calls).collect()}
    r = got["2024-04-01", 10]
    base = sum(450 + 8 * (i % 4) for i in range(10)) / 10
    assert (r["base_calls"], r["kept_calls"], r["baseline_aht_s"]) == (41, 40, base)
    assert r["deviation_pct"] == round((511 - base) * 100 / base, 4) and r["driver"] == "talk" and r["status"] == "Critical" and r["hold_pct"] == 2.5
    assert got["2024-04-01", 11]["status"] == "No Baseline" and got["2024-03-28", 10]["status"] == "No Baseline"


def test_equal_base_calls_are_all_kept(spark):
    calls = spark.createDataFrame([("q", T0 + dt.timedelta(days=7 * w), 333, 0, 1) for w in range(5) for _ in range(3)], "queue string, call_time timestamp, talk_s long, hold_s long, acw_s long")
    r = I.aht_deviation(calls).filter("day = '2024-04-01'").first()
    assert (r["base_calls"], r["kept_calls"], r["deviation_pct"], r["hold_pct"], r["status"]) == (12, 12, 0.0, None, "Healthy")


# ------------------------------------------------------------------ IND-14.2
CALLS = "call_id int, customer_id int, call_type string, call_time timestamp, utc_offset_h int"


def test_one_case_for_each_reason(spark):
    noon = at(20)  # noon at UTC - 8
    calls = [
        (1, 1, "marketing", noon, -8), (2, 1, "marketing", at(6), -8), (3, 2, "marketing", noon, -8), (4, 3, "marketing", noon, -8), (5, 4, "marketing", noon, -8),
        (6, 5, "transactional", noon, -8), (7, 6, "informational", noon, -8), (8, 7, "collections", noon, -8), (9, 1, "marketing", at(-30), -8),
        (10, 8, "marketing", noon, -8), (11, 1, "marketing", at(16), -8), (12, 1, "marketing", at(29), -8), (13, 6, "informational", at(1000), -8), (14, None, "marketing", noon, -8)]
    events = [(1, "written", "grant", at(-24), 1), (2, "written", "grant", at(-24), 2), (2, "written", "revoke", at(19), 3), (3, "verbal", "grant", at(-24), 4),
              (5, "ebr", "grant", at(-24), 5), (6, "verbal", "grant", at(0), 6), (7, "ebr", "grant", at(20), 7), (8, "written", "grant", at(-24), 8),
              (2, "written", "grant", at(21), 9), (6, "verbal", "revoke", at(999), 11), (6, "verbal", "grant", at(999), 10)]
    dnc = [(8, at(10)), (1, at(2000))]
    got = I.call_consent(spark.createDataFrame(calls, CALLS), spark.createDataFrame(events, "customer_id int, consent_type string, action string, at timestamp, event_id int"),
                         spark.createDataFrame(dnc, "customer_id int, since timestamp"), segment_s=3600)
    assert {r["call_id"]: r["reason"] for r in got.collect()} == {
        1: "verified", 2: "outside_hours", 3: "revoked", 4: "wrong_type", 5: "no_consent", 6: "verified", 7: "verified", 8: "verified", 9: "no_consent", 10: "do_not_call",
        11: "verified", 12: "outside_hours", 13: "revoked", 14: "no_consent"}


def test_consent_at_call_time_against_a_plain_search(spark):
    r = random.Random(1)
    calls = [(i, r.randrange(6), r.choice(list(I.CONSENT_FOR)), at(r.randrange(500)), r.randrange(-8, 3)) for i in range(400)]
    events = [(r.randrange(6), r.choice(I.CONSENT_TYPES), r.choice(["grant", "grant", "revoke"]), at(r.randrange(500)), i) for i in range(120)]
    dnc = [(3, at(200)), (3, at(100)), (4, at(900))]

    def reason(c):
        state = {t: max(((e[3], e[4], e[2]) for e in events if e[0] == c[1] and e[1] == t and e[3] <= c[3]), default=(0, 0, None))[2] for t in I.CONSENT_TYPES}
        need = [state[t] for t in I.CONSENT_FOR[c[2]]]
        if "grant" not in need:
            return "revoked" if "revoke" in need else "wrong_type" if "grant" in state.values() else "no_consent"
        if any(d[0] == c[1] and d[1] <= c[3] for d in dnc):
            return "do_not_call"
        return "verified" if 8 <= (c[3] + dt.timedelta(hours=c[4])).hour < 21 else "outside_hours"

    e = spark.createDataFrame(events, "customer_id int, consent_type string, action string, at timestamp, event_id int")
    got = I.call_consent(spark.createDataFrame(calls, CALLS), e, spark.createDataFrame(dnc, "customer_id int, since timestamp"), segment_s=7 * 3600).collect()
    want = {c[0]: reason(c) for c in calls}
    assert {x["call_id"]: x["reason"] for x in got} == want and set(want.values()) == {"verified", *I.BLOCKS}


# ------------------------------------------------------------------ LIP-16, LIP-26
def test_a_planted_repeat_ranks_first(spark):
    """Three outages, each after a course of its own; the newest hours repeat the course before the second."""
    r = random.Random(7)
    names = L.SIGNAL_NAMES
    values = {(n, t): 100 + r.gauss(0, 1) for n in names for t in range(200)}
    courses = {}
    for start in (50, 100, 150):
        courses[start] = {(n, k): 100 + r.gauss(0, 6) for n in names for k in range(6)}
        values.update({(n, start - 6 + k): v for (n, k), v in courses[start].items()})
        values.update({(n, start + j): 40.0 for n in names[:6] for j in range(3)})
    values.update({(n, 194 + k): v + r.gauss(0, 0.3) for (n, k), v in courses[100].items()})
    rows = [(n, v, at(t), "critical" if v < 50 else "healthy") for (n, t), v in values.items() if r.random() > 0.002 or t > 180]
    df = spark.createDataFrame(rows, "signal_name string, numeric_value double, snapshot_time timestamp, status string")
    got = L.pre_outage_match(df.drop("status"), df, F.lit(at(199)), step_s=3600, steps=6, min_critical=5).collect()
    assert [x["rank"] for x in got] == [1, 2, 3] and got[0]["episode_start"] == at(100) and got[0]["similarity"] > 0.9 > got[1]["similarity"]
    assert {x["episode_start"] for x in got} == {at(50), at(100), at(150)}


def test_threshold_curve_against_a_plain_count(spark):
    r = random.Random(3)
    rows = [(s, float(r.randrange(60, 100)), at(t)) for s in ("Agent Online", "Incidents") for t in range(300)] + [("Agent Online", None, at(1))]
    breaches = sorted({r.randrange(300) for _ in range(40)})
    cands = {"Agent Online": [70.0, 90.0, 80.5, 90.0, 10.0, 200.0], "Incidents": [65.0, 95.0]}
    got = L.threshold_curve(spark.createDataFrame(rows, "signal_name string, numeric_value double, snapshot_time timestamp"),
                            spark.createDataFrame([(at(b),) for b in breaches], "breach_time timestamp"),
                            spark.createDataFrame(list(cands.items()), "signal_name string, candidates array<double>"), horizon_s=4 * 3600).collect()
    want = []
    for s, cs in cands.items():
        mine = [(v, any(t < at(b) <= t + dt.timedelta(hours=4) for b in breaches)) for n, v, t in rows if n == s and v is not None]
        for c in sorted(set(cs)):
            beyond = [f for v, f in mine if (v > c if s == "Incidents" else v < c)]
            normal = [v for v, f in mine if not f]
            good = [v for v in normal if not (v > c if s == "Incidents" else v < c)]
            want.append((s, c, len(beyond), sum(beyond), round(sum(beyond) / len(beyond), 4) if beyond else None, round(len(good) / len(normal), 4)))
    assert sorted(map(tuple, got)) == sorted(want)


# ------------------------------------------------------------------ SRC-14
def test_two_retention_runs_a_week_apart_equal_one(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ab"), at(24 * d + r.randrange(24) + r.random()), float(r.randrange(100))) for d in range(120) for _ in range(6)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double").cache()
    day = lambda d: at(24 * d).date().isoformat()
    one, two = (K.TieredTable(spark, str(tmp_path / n), "metrics", "ts", ["v"], ["k"]) for n in ("one", "two"))
    one.append(df)
    one.roll_up(day(119))
    early = F.col("ts") < F.lit(at(24 * 112))
    late = early & (F.col("ts") >= F.lit(at(24 * 60 + 5))) & (F.col("ts") < F.lit(at(24 * 60 + 15)))  # some rows of one day come a week late
    two.append(df.filter(early & ~late))
    before = two.roll_up(day(112))
    held = two.read(before).count()
    two.append(df.filter(~early | late))
    two.roll_up(day(119))
    rows_of = lambda t: sorted(map(tuple, t.read().collect()))
    assert rows_of(one) == rows_of(two)
    assert two.read(before).count() == held  # the older version stays as it was
    raw = [x for x in rows if x[1].date().isoformat() >= day(112)]
    old = [x for x in rows if day(29) <= x[1].date().isoformat() < day(112)]
    assert one.read().filter("tier = 'raw'").count() == len(raw) and one.read().filter("tier = 'aggregated'").agg(F.sum("n")).first()[0] == len(old)


def test_types_without_an_aggregated_tier(spark, tmp_path):
    t = K.TieredTable(spark, str(tmp_path / "t"), "alerts", "ts", ["v"], ["k"])
    t.append(spark.createDataFrame([("a", at(0), 1.0), ("a", at(24 * 300), 2.0)], "k string, ts timestamp, v double"))
    t.roll_up(at(24 * 400).date().isoformat())
    assert [(r["n"], r["v_sum"], r["tier"]) for r in t.read().collect()] == [(1, 2.0, "raw")]


# ------------------------------------------------------------------ LIP-11, SIG-16
def test_every_template_is_triggered(spark):
    latest = spark.createDataFrame([("App Health", 90.0, "critical", "down", "warning", 93.0), ("Call Quality", 3.7, "warning", "down", "healthy", 3.5),
                                    ("Connectivity", 99.0, "healthy", "up", "critical", 92.0)],
                                   "signal_name string, numeric_value double, status string, direction string, prev_status string, critical_threshold double")
    roc = spark.createDataFrame([("App Health", -3.0, "rapid_decline", 97.0, 90.0), ("New", -3.0, "rapid_decline", 50.0, 40.0)], "signal_name string, slope double, trend string, first_value double, last_value double")
    eta = spark.createDataFrame([("App Health", 18)], "signal_name string, eta_minutes long")
    active = spark.createDataFrame([("Incidents", "Call LOB SLA", 0.8, "act", 5), ("Connectivity", "Call Quality", 0.9, "check paths", 4)],
                                   "signal_a string, signal_b string, confidence double, recommended_action string, insight_template_id int")
    inc = spark.createDataFrame([(7, 2)], "numeric_value long, p1_count long")
    surge = spark.createDataFrame([("2024", 1.0), ("2025", 2.5)], "snapshot_time string, multiplier double")
    match = spark.createDataFrame([(1, at(5), 0.91)], "rank int, episode_start timestamp, similarity double")
    p = lambda v: spark.createDataFrame([(v,)], "probability long")
    subs = spark.createDataFrame([("Call Quality", "Jitter", "critical", 10.0), ("Call Quality", "Packet Loss", "warning", 0.5), ("Call Quality", "x", "unconfigured", None)],
                                 "parent_signal string, sub_name string, status string, threshold double")
    stable = spark.createDataFrame([("b",), ("a",)], "signal_name string")
    trig = L.status_triggers(latest, "5 h")
    for t in (L.decline_triggers(roc, eta, latest, "5 h"), L.correlation_triggers(active, inc, surge, "24 h"), L.pattern_triggers(match, p(40), p(53), eta),
              L.sub_signal_triggers(subs, active), L.stable_triggers(stable, "4")):
        trig = trig.unionByName(t)
    text = [r["insight_text"] for r in L.insights(trig, L.insight_templates(spark), L.domain_map(spark)).collect()]
    assert sorted(text) == sorted([
        "App Health has breached critical threshold at 90.00 (threshold: 93.00). Immediate investigation required.",
        "Call Quality approaching critical levels at 3.70. Trending down over last 5 h.",
        "App Health declining rapidly (97.0→90.0 in 5 h). Breach of 93.0 threshold projected in ~18 minutes.",
        "New declining rapidly (50.0→40.0 in 5 h). Breach of n/a threshold projected in ~n/a minutes.",
        "7 Active Incidents — 2 P1 critical. Incident rate exceeds 24 h rolling average by 2.5x.",
        "Connectivity degradation correlated with Call Quality (90% confidence). check paths",
        "Pattern match: Signal trajectory 91% similar to 2024-03-04 05:00 pre-outage. Probability escalating 40%→53% within 18m.",
        "Call Quality below 1% in Jitter, Packet Loss. Correlated with Connectivity. check paths",
        "Connectivity stable post-degradation. All checks recovered to 99.00+.",
        "a, b — stable for 4+ hrs. No forecast deviation detected."])


def test_sub_signals_by_their_own_thresholds(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "sub_name string, numeric_value double")
    inc = spark.createDataFrame([(1, 0, 4)], "p1_count long, p2_count long, p3_count long")
    got = S.sub_signal_snapshots(spark, {"Agent Online": f(("email", 89.0), ("chat", 93.0)), "App Health": f(("CRM", 94.9), ("Reporting", 85.0), ("Other", 1.0)),
                                         "Call Quality": f(("Jitter", 10.0), ("Packet Loss", 0.4)), "Call LOB SLA": f(("Retention", None))}, inc).collect()
    assert {(r["parent_signal"], r["sub_name"]): r["status"] for r in got} == {
        ("Agent Online", "email"): "warning", ("Agent Online", "chat"): "healthy", ("App Health", "CRM"): "critical", ("App Health", "Reporting"): "warning",
        ("App Health", "Other"): "unconfigured", ("Call Quality", "Jitter"): "warning", ("Call Quality", "Packet Loss"): "healthy", ("Call LOB SLA", "Retention"): "no data",
        ("Incidents", "P1 Critical"): "critical", ("Incidents", "P2 High"): "healthy", ("Incidents", "P3 Medium"): "healthy"}


# ------------------------------------------------------------------ IND-00, IND-11.1, IND-14.1, SRC-9
def test_escalation_over_segments(spark):
    """Runs of one status over many segments, a quiet gap, and a run that ends at a segment's edge."""
    r = random.Random(4)
    rows, t, st = [], 0, "Healthy"
    for _ in range(300):
        st = st if r.random() < 0.9 else r.choice(["Healthy", "At Risk", "Critical"])
        t += 1 if r.random() < 0.97 else 40
        rows.append(("k", T0 + dt.timedelta(minutes=t), st))
    got = I.escalation(spark.createDataFrame(rows, "k string, ts timestamp, status string"), "k", segment_s=420).orderBy("ts").collect()
    start = None
    for i, ((_, ts, status), g) in enumerate(zip(rows, got)):
        if not i or rows[i - 1][2] != status:
            start = ts
        dur = (ts - start).total_seconds() / 60
        want = {"Critical": "Executive notification" if dur > 30 else "Bridge call initiated" if dur > 15 else "Alert Operations Manager + Page On-call",
                "At Risk": "Alert Operations Manager" if dur > 30 else "Alert Team Lead" if dur > 15 else "None"}.get(status, "None")
        assert (g["status_duration"], g["escalation"]) == (dur, want)


def test_quality_predictor_example(spark):
    """The document's example: 15 + 13 + 10 + 7 + 10 + 10 + 10 + 15 = 90; a conversation without audio has four parts unmeasured."""
    turns = [(1, "assistant", "Acme here, this is Ann. I see. Sorry about that. Anything else?"), (1, "user", "sorry sorry right right"), (2, "assistant", "Acme")]
    phrases = {"company": ["Acme"], "agent": ["Ann"], "listening": ["I see", "right"], "empathy": ["sorry"], "resolution": ["anything else"]}
    audio = spark.createDataFrame([(1, 2, 0, 138, True)], "conv_id int, silences int, overlaps int, wpm int, hold_ok boolean")
    got = {r["conv_id"]: r for r in I.qa_predictor(spark.createDataFrame(turns, "conv_id int, role string, text string"), phrases, audio).collect()}
    assert (got[1]["qa_score"], got[1]["band"], got[1]["unmeasured"], got[1]["p_dead_air"]) == (90.0, "Exceeds", 0, 7.0)
    assert (got[2]["qa_score"], got[2]["p_greeting"], got[2]["unmeasured"], got[2]["p_hold"]) == (7.5, 7.5, 4, None)


def test_payment_checks_each_fire(spark):
    card = "4111 1111 1111 1111"
    rows = [(1, "a", True, True, True, "fine", None), (2, "a", False, True, True, "", ""), (3, "a", True, None, True, None, "x"), (4, "a", True, True, False, card, ""),
            (5, "a", True, True, True, "4111 1111 1111 1112", f"my card is {card}")]
    df = spark.createDataFrame(rows, "doc_id int, source string, dtmf_masked boolean, recording_paused boolean, screen_paused boolean, notes string, transcript string")
    r = I.pci_compliance(df).first()
    assert [r[f"{c}_violations"] for c in I.PCI_CHECKS] == [1, 1, 1, 1, 1] and r["compliant"] == 1 and r["compliance_pct"] == 20.0


def test_upsert_takes_the_newest_row(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, at int, v string")
    v1 = K.upsert_latest(spark, str(tmp_path), df(("a", 1, "old"), ("b", 5, "b"), ("n", None, "kept")), ["k"], "at")
    v2 = K.upsert_latest(spark, str(tmp_path), df(("a", 2, "new"), ("b", 4, "late")), ["k"], "at", current=v1)
    assert sorted(map(tuple, spark.read.parquet(v2).collect())) == [("a", 2, "new"), ("b", 5, "b"), ("n", None, "kept")]
    one = K.upsert_latest(spark, str(tmp_path), df(("a", 2, "x"), ("b", 4, "y")), [], "at")
    assert [tuple(r) for r in spark.read.parquet(one).collect()] == [("b", 4, "y")]
    assert spark.read.parquet(K.upsert_latest(spark, str(tmp_path), df(("a", 2, "x")).limit(0), [], "at")).count() == 0
