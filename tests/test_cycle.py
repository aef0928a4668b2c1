"""Rules for what has no value, no thresholds or no configuration; the snapshot table."""

import datetime as dt

from pyspark.sql import functions as F

from opsight.operators import cycle as C
from opsight.operators import indicators as I
from opsight.operators import leading as L
from opsight.operators import signals as S

T0 = dt.datetime(2024, 1, 1)


def at(i):
    return T0 + dt.timedelta(hours=i)


def test_unscored_signals_stay_out_of_the_mean(spark):
    latest = spark.createDataFrame([("App Health", "healthy"), ("Core Systems", "unconfigured"), ("Agent Online", "no data"), ("New", "critical")],
                                   "signal_name string, status string")
    got = {r["domain_key"]: r.asDict() for r in L.domain_scores(latest, L.domain_map(spark)).collect()}
    assert got["app"]["score"] == 100.0 and got["app"]["unscored_count"] == 1 and got["app"]["signal_count"] == 2
    assert got["genesys"]["score"] is None and got["genesys"]["unscored_count"] == 2
    assert got["unmapped"]["score"] == 0.0 and got["unmapped"]["critical_count"] == 1


def test_healthy_run_goes_on_over_an_unscored_snapshot(spark):
    rows = spark.createDataFrame([("a", at(0), "critical"), ("a", at(1), "healthy"), ("a", at(2), "unconfigured"), ("a", at(3), "healthy")],
                                 "signal_name string, snapshot_time timestamp, status string")
    assert {r["snapshot_time"]: r["healthy_run"] for r in L.healthy_streaks(rows).collect()} == {at(0): 0, at(1): 1, at(3): 2}


def test_nothing_measured_is_no_data(spark):
    now = F.lit(at(0))
    empty = spark.createDataFrame([], "ts timestamp, outcome string")
    assert I.session_success(empty, now, 60).first()["status"] == "No Data"
    v = spark.createDataFrame([(None,), (99.0,), (96.0,), (10.0,)], "v double")
    assert [r[0] for r in v.select(I.status(F.col("v"), 98.0, 95.0)).collect()] == ["No Data", "Healthy", "At Risk", "Critical"]
    assert [r[0] for r in v.select(I.status(F.col("v"), 20.0, 97.0, higher_is_better=False)).collect()] == ["No Data", "Critical", "At Risk", "Healthy"]
    paths = spark.createDataFrame([], "ts timestamp, path string, lost boolean, latency_ms double")
    assert S.connectivity_signal(paths, now, 60).first()["status"] == "no data"
    rtt = spark.createDataFrame([], "ts timestamp, rtt_ms double")
    assert S.latency_signal(rtt, now, 60).first()["status"] == "no data"


def test_signal_without_thresholds_keeps_its_place_in_the_projection(spark):
    snap = spark.createDataFrame([(s, 90.0 - 2 * i, at(i)) for s in ("known", "new") for i in range(5)], "signal_name string, numeric_value double, snapshot_time timestamp")
    cfg = spark.createDataFrame([("known", 95.0, 90.0, 80.0, False)], "signal_name string, healthy_threshold double, warning_threshold double, critical_threshold double, is_inverted boolean")
    got = {r["signal_name"]: r["eta_minutes"] for r in L.eta(snap, cfg, F.lit(at(4)), window_s=15 * 3600, per_s=3600).collect()}
    assert got == {"known": 1, "new": None}


def test_incidents_without_an_item_and_triggers_without_a_template(spark):
    inc = spark.createDataFrame([(1, "Open", "a"), (2, "Open", "b"), (3, "Open", "b")], "incident_id int, state string, assignment_group string")
    ci = spark.createDataFrame([(1, "ci-1", True)], "incident_id int, ci string, call_path boolean")
    got = {r["ci"]: (r["incidents"], r["shared"], r["rule_r3"]) for r in L.incident_scope(inc, ci).collect()}
    assert got == {"ci-1": (1, False, "accept_R3"), None: (2, False, "unmapped")}
    trig = spark.createDataFrame([("threshold_breach", "critical", "App Health", None, {"signal_name": "App Health", "current_value": "1", "threshold": "2"}),
                                  ("weather", "info", "App Health", None, {})],
                                 "trigger_type string, severity string, signal_name string, related_signal string, fields map<string,string>")
    text = {r["trigger_type"]: r["insight_text"] for r in L.insights(trig, L.insight_templates(spark), L.domain_map(spark)).collect()}
    assert text["weather"] == "weather: App Health" and text["threshold_breach"].startswith("App Health has breached")


def test_snapshot_table_appends_and_replaces_a_cycle(spark, tmp_path):
    cfg = spark.createDataFrame([("a", 95.0, 90.0, 90.0, False), ("b", 95.0, 90.0, 90.0, False)],
                                "signal_name string, healthy_threshold double, warning_threshold double, critical_threshold double, is_inverted boolean")
    plans = {"a": lambda s: s.filter("n = 'a'"), "b": lambda s: s.filter("n = 'b'")}
    src = lambda a, b: spark.createDataFrame([("a", a), *([("b", b)] if b is not None else [])], "n string, numeric_value double")
    t = C.SnapshotTable(spark, str(tmp_path / "snap"))
    t.append(0, C.signal_rows(plans, src(96.0, 91.0), F.lit(at(0))), cfg)
    for _ in range(2):  # the second run of a cycle replaces the first
        t.append(1, C.signal_rows(plans, src(94.5, None), F.lit(at(1))), cfg, 0)
    got = sorted((r["cycle"], r["signal_name"], r["status"], r["trend"], r["direction"]) for r in t.read().collect())
    assert got == [(0, "a", "healthy", None, "flat"), (0, "b", "warning", None, "flat"), (1, "a", "warning", "-1.5", "down"), (1, "b", "no data", None, "flat")]
