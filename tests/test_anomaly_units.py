"""Unit cases of the anomaly method with the documented series (recomputed values, F17-F21)."""

import pytest
from pyspark.sql import functions as F

from opsight.functions.stats import bonferroni, inv_norm
from opsight.operators.anomaly import run_anomaly

APDEX = [0.93, 0.92, 0.94, 0.91, 0.93, 0.90, 0.92, 0.91, 0.89, 0.90, 0.88, 0.87, 0.86, 0.85, 0.84,
         0.83, 0.82, 0.80, 0.79, 0.78]
PORTS = [310, 325, 318, 340, 335, 328, 342, 350, 355, 360, 368, 375, 380, 390, 398, 410, 425, 440, 458, 472]
RPM = [1180, 1210, 1195, 1220, 1205, 1215, 1230, 1190, 1225, 1240, 1200, 1235, 1250, 1260, 1310, 1400,
       1520, 1650, 1780, 1850]
NOMINAL = [0.94, 0.93, 0.95, 0.94, 0.93, 0.94, 0.93, 0.94] + [0.93, 0.94] * 6

SCHEMA = ("metric_id string, metric_name string, category string, metric_type string, direction string, "
          "capacity double, unit string, history array<double>, rule_set string")


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("apdex", ".NET Apdex Score", "App", "bounded_ratio", "lower_is_bad", None, "score", [float(x) for x in APDEX], "dotnet_apdex"),
        ("ports", "Nuance Port Usage", "Cap", "bounded_capacity", "higher_is_bad", 500.0, "ports", [float(x) for x in PORTS], "port_usage"),
        ("rpm", "Requests Per Minute", "Traffic", "unbounded_count", "both", None, "rpm", [float(x) for x in RPM], "rpm"),
        ("nominal", "Self-Serve Rate", "CX", "bounded_ratio", "lower_is_bad", None, "%", NOMINAL, "self_serve"),
        ("short", "Short", "X", "bounded_ratio", "lower_is_bad", None, "%", [0.90, 0.91, 0.89], "self_serve"),
        ("flat", "Flat", "X", "unbounded_count", "both", None, "rpm", [20.0] * 20, "rpm"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "current_value", F.when(F.col("metric_id") == "nominal", F.lit(0.93)).otherwise(F.element_at("history", -1)))
    out = run_anomaly(df, F.lit("2024-01-30 00:00:00").cast("timestamp"), n_tests=F.lit(5))
    return {r["metric_id"]: r for r in out.collect()}


def test_logit_z(results):
    r = results["apdex"]
    assert r["method"] == "Logit-Z"
    assert r["baseline_mu"] == pytest.approx(2.24038, abs=1e-4)
    assert r["baseline_sigma"] == pytest.approx(0.30794, abs=1e-4)
    assert r["z_score_raw"] == pytest.approx(-3.16525, abs=1e-4)
    assert r["anomaly_score"] == pytest.approx(3.16525, abs=1e-4)
    assert r["risk_level"] == "Critical"
    assert r["trend_slope"] == pytest.approx(-0.0081128, abs=1e-4)
    assert r["trend_r_squared"] == pytest.approx(0.92622, abs=1e-4)
    assert r["hw_level"] == pytest.approx(0.79393, abs=1e-4)
    assert r["hw_trend"] == pytest.approx(-0.0078081, abs=1e-4)
    assert r["residual_se"] == pytest.approx(0.025496, abs=1e-4)
    assert r["periods_to_breach"] == 13


def test_capacity_logit_z_and_holt(results):
    r = results["ports"]
    assert r["baseline_mu"] == pytest.approx(0.84112, abs=1e-4)
    assert r["baseline_sigma"] == pytest.approx(0.23412, abs=1e-4)
    assert r["anomaly_score"] == pytest.approx(8.47284, abs=1e-4)
    assert r["trend_slope"] == pytest.approx(7.731579, abs=1e-4)
    assert r["trend_r_squared"] == pytest.approx(0.937524, abs=1e-4)
    assert r["hw_level"] == pytest.approx(455.43168, abs=1e-4)
    assert r["hw_trend"] == pytest.approx(8.64284, abs=1e-4)
    assert r["forecast_h1"] == pytest.approx(464.07452, abs=1e-4)
    assert r["forecast_h3"] == pytest.approx(481.36020, abs=1e-4)
    assert r["forecast_h5"] == pytest.approx(498.64587, abs=1e-4)
    assert r["residual_se"] == pytest.approx(12.42501, abs=1e-4)
    assert r["breach_threshold"] == pytest.approx(475.0)
    assert r["periods_to_breach"] == 3
    assert r["currently_breached"] is False
    assert r["formatted_value"] == "472 / 500"
    assert r["breach_state"] == "Breach Imminent"
    # ESCALATE rule (breach within 3) of the port-usage rules
    assert r["rx_urgency"] == "urgent" and r["rx_action"].startswith("ESCALATE")


def test_median_mad(results):
    r = results["rpm"]
    assert r["method"] == "Median-MAD"
    assert r["baseline_mu"] == pytest.approx(1217.5)
    assert r["baseline_sigma"] == pytest.approx(25.9455, abs=1e-4)
    assert r["anomaly_score"] == pytest.approx(24.37802, abs=1e-4)
    assert r["trend_r_squared"] == pytest.approx(0.63211, abs=1e-4)
    assert r["hw_level"] == pytest.approx(1686.74874, abs=1e-4)
    assert r["hw_trend"] == pytest.approx(39.51510, abs=1e-4)
    assert r["residual_se"] == pytest.approx(118.69360, abs=1e-3)
    assert r["breach_threshold"] == pytest.approx(2435.0)
    assert r["periods_to_breach"] == 19
    assert r["formatted_value"] == "1,850"
    assert r["rx_action"].startswith("Rule out DDoS")


def test_nominal(results):
    r = results["nominal"]
    assert r["z_score_raw"] == pytest.approx(-0.98893, abs=1e-4)
    assert r["anomaly_score"] == pytest.approx(0.98893, abs=1e-4)
    assert r["risk_level"] == "Nominal"
    assert r["formatted_value"] == "93.0%"


def test_insufficient(results):
    r = results["short"]
    assert r["risk_level"] == "Insufficient Data"
    assert r["hw_level"] is None and r["rx_urgency"] is None and r["periods_to_breach"] is None


def test_zero_spread(results):
    r = results["flat"]
    assert r["z_score_raw"] == 0.0 and r["risk_level"] == "Nominal"


def test_bounds_and_bonferroni(spark):
    from opsight.functions.stats import logit
    row = spark.range(1).select(
        logit(F.lit(1.0)).alias("l1"), logit(F.lit(500.0) / F.lit(500.0)).alias("l2"),
        *[bonferroni(F.lit(n)).alias(f"b{n}") for n in (3, 5, 7, 10)],
        inv_norm(F.lit(0.975)).alias("q975")).first()
    assert row["l1"] == pytest.approx(6.9068, abs=1e-4) and row["l2"] == pytest.approx(6.9068, abs=1e-4)
    exp = {3: (2.128, 2.935), 5: (2.326, 3.090), 7: (2.450, 3.189), 10: (2.576, 3.291)}
    for n, (e, c) in exp.items():
        assert row[f"b{n}"]["elevated"] == pytest.approx(e, abs=1e-3)
        assert row[f"b{n}"]["critical"] == pytest.approx(c, abs=1e-3)
    assert row["q975"] == pytest.approx(1.959964, abs=1e-6)


def test_config_columns_override_the_defaults(spark):
    hist = [float(x) for x in range(100, 120)]
    rows = [("plain", hist, None, None, None, None, None), ("half", hist, 0.5, None, None, None, None),
            ("low", hist, None, 150.0, "below", "Under 150", None), ("spend", hist[:-1] + [500.0], None, 300.0, "above", "Over budget", "monthly_azure_spend")]
    df = spark.createDataFrame([(i, i, "Cost", "unbounded_count", "higher_is_bad", None, "$", h, p, t, d, lab, rs) for i, h, p, t, d, lab, rs in rows],
                               "metric_id string, metric_name string, category string, metric_type string, direction string, capacity double, unit string, "
                               "history array<double>, baseline_window_pct double, breach_threshold double, breach_direction string, breach_label string, rule_set string")
    df = df.withColumn("current_value", F.element_at("history", -1))
    got = {r["metric_id"]: r for r in run_anomaly(df, F.lit("2024-01-30 00:00:00").cast("timestamp")).collect()}
    assert (got["plain"]["baseline_n"], got["half"]["baseline_n"]) == (14, 10)
    assert got["plain"]["breach_threshold"] == pytest.approx(213.0) and got["plain"]["currently_breached"] is False
    assert (got["low"]["breach_threshold"], got["low"]["breach_label"], got["low"]["currently_breached"]) == (150.0, "Under 150", True)
    assert got["spend"]["breach_label"] == "Over budget" and got["spend"]["rx_action"].startswith("Budget exceeded")


def test_cost_rules(spark):
    from opsight.operators.anomaly import prescribe

    ctx = {"score": F.col("score"), "crit": F.lit(3.0), "elev": F.lit(2.0), "breached": F.col("breached"), "periods": F.col("periods"),
           "risk": F.when(F.col("score") > 3, "Critical").when(F.col("score") > 2, "Elevated").otherwise("Nominal"), "slope": F.lit(0.0), "r2": F.lit(0.0)}
    cases = [("monthly_azure_spend", 4.0, True, None, "urgent"), ("monthly_azure_spend", 0.0, False, 5, "moderate"), ("monthly_azure_spend", 0.0, False, 6, "monitor"),
             ("reserved_instance_utilization", 2.5, False, None, "moderate"), ("reserved_instance_utilization", 0.0, False, None, "monitor"),
             ("storage_growth_rate", 4.0, False, None, "urgent"), ("storage_growth_rate", 2.5, False, None, "monitor"), ("ugw_apdex", 2.5, False, None, "moderate")]
    df = spark.createDataFrame(cases, "rs string, score double, breached boolean, periods int, want string")
    got = df.select(prescribe(F.col("rs"), ctx)[0].alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
