"""Cases in which a rule must not lose rows, cap a walk or keep state of an earlier run."""

import pytest
from pyspark.sql import functions as F

from opsight.operators import indicators as I
from opsight.operators import leading as L
from opsight.operators import signals as S


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "signal_a string, signal_b string")


def test_cascade_walks_chains_of_any_length(spark):
    got = {(r.signal, r.root, r.hops) for r in L.cascade(edges(spark, *zip("ABCDEF", "BCDEFG"))).collect()}
    assert got == {(s, "A", i + 1) for i, s in enumerate("BCDEFG")}


def test_cascade_takes_a_cycle_as_its_own_root(spark):
    got = {(r.signal, r.root) for r in L.cascade(edges(spark, ("A", "B"), ("B", "A"), ("B", "C"))).collect()}
    assert got == {("A", "A"), ("B", "A"), ("C", "A")}
    # a cycle that something else causes is no root
    got = {(r.signal, r.root) for r in L.cascade(edges(spark, ("X", "A"), ("A", "B"), ("B", "A"))).collect()}
    assert got == {("A", "X"), ("B", "X")}
    assert L.cascade(edges(spark, ("A", "B")).limit(0)).collect() == []


@pytest.mark.parametrize("value,want", [(100.0, "Healthy"), (99.9, "Healthy"), (99.7, "At Risk"), (99.5, "At Risk"), (99.4, "Critical")])
def test_status_with_a_target_to_reach(spark, value, want):
    assert spark.range(1).select(I.status(F.lit(value), 99.9, 99.5)).first()[0] == want


@pytest.mark.parametrize("value,inclusive,want", [(119.0, False, "Healthy"), (120.0, False, "At Risk"), (180.0, False, "At Risk"), (180.1, False, "Critical"),
                                                  (120.0, True, "Healthy"), (121.0, True, "At Risk")])
def test_status_with_a_limit_to_stay_below(spark, value, inclusive, want):
    assert spark.range(1).select(I.status(F.lit(value), 120.0, 180.0, higher_is_better=False, inclusive=inclusive)).first()[0] == want


def test_sources_without_a_limit_stay(spark):
    ev = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('old', timestamp'2023-01-01 00:00:00') t(source, ts)")
    limits = spark.createDataFrame([("a", 3600)], "source string, limit_s int")
    got = {r.source: (r.limit_s, r.status, r.is_worst) for r in I.data_freshness(ev, limits, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()}
    assert got == {"a": (3600, "Healthy", False), "old": (60, "Critical", True)}


def test_types_queues_and_signals_without_config_stay(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    tx = spark.sql("select 'new' as tx_type, timestamp'2024-01-01 00:30:00' as ts, 9.0D as response_s, false as is_error")
    assert I.crm_response(tx, spark.createDataFrame([("x", 3.0)], "tx_type string, limit_s double"), now, 3600).first()["limit_s"] == 5.0
    calls = spark.sql("select 'Z' as queue, timestamp'2024-01-01 00:30:00' as call_time, 10.0D as wait_sec")
    lob = spark.createDataFrame([("A", "Sales", 20)], "queue string, lob_name string, sla_target_sec int")
    assert S.lob_sla_signal(calls, lob, now, 3600).first()["lob_breakdown"] == "Unlisted:100.0"
    values = spark.createDataFrame([("s", 1.0)], "signal_name string, numeric_value double")
    cfg = spark.createDataFrame([], "signal_name string, healthy_threshold double, warning_threshold double, is_inverted boolean")
    assert L.score_signals(values, cfg).first()["status"] == "unconfigured"


def test_calls_carried_into_a_period_count(spark):
    calls = spark.sql("""select * from values (timestamp'2024-01-01 23:00:00', 120.0D), (timestamp'2024-01-01 23:30:00', 120.0D) t(call_time, duration_min)""")
    got = {r.period[:10]: (r.peak_concurrent, r.avg_concurrent) for r in I.concurrent_calls(calls, 100.0).collect()}
    assert got["2024-01-02"][0] == 2
    # 23:00-23:30 one call, 23:30-24:00 two; next day an hour of two, half an hour of one, half an hour of none
    assert got["2024-01-01"] == (2, 1.5) and got["2024-01-02"][1] == pytest.approx((2 * 60 + 30) / 120)


def test_security_incidents_of_the_last_day(spark):
    make = lambda *p: spark.createDataFrame([(x, t) for x, t in p], "priority int, t string").withColumn("opened_at", F.col("t").cast("timestamp"))
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    status = lambda *p: I.security_incidents_24h(make(*p), now).first()["status"]
    assert status((2, "2024-01-02 12:00:00"), (1, "2024-01-01 12:00:00")) == "Warning"
    assert status((1, "2024-01-02 12:00:00")) == "Critical"
    assert status((3, "2024-01-02 12:00:00")) == "Healthy"


def test_a_new_run_sees_new_files(spark, tmp_path):
    from opsight.sources.adapters import Model

    path = f"{tmp_path}/events.parquet"
    rows = "select {0} as event_id, 1 as user_id, 'new_type' as event_type, 1.0D as value, timestamp'{1}' as ts"
    spark.sql(rows.format(1, "2024-01-01 00:00:00")).write.parquet(path)
    spark.sql("select 1 as n_nationkey, 'N' as n_name, 0 as n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    one = Model(spark, str(tmp_path))
    first = spark.range(1).select(one.as_of().cast("string")).first()[0]
    assert [r.metric_name for r in one.thresholds().collect()] == ["new_type"]
    spark.sql(rows.format(2, "2024-02-01 00:00:00")).write.mode("append").parquet(path)
    two = Model(spark, str(tmp_path))
    assert one.events().count() in (1, 2) and two.events().count() == 2
    assert (first, spark.range(1).select(two.as_of().cast("string")).first()[0]) == ("2024-01-01 00:00:00", "2024-02-01 00:00:00")


def test_a_missing_plan_module_is_an_error(monkeypatch):
    import sys

    from opsight.plans import registry

    monkeypatch.setitem(sys.modules, "opsight.plans.source_plans", None)
    monkeypatch.delattr(sys.modules["opsight.plans"], "source_plans", raising=False)
    with pytest.raises(ImportError):
        registry.load_all()


def test_predictor_examples(spark):
    from opsight.operators import predictors as P

    call = spark.sql("select true as kb_hit, 'none' as transfer, 45.0D as hold_sec, 360.0D as talk_sec, 14.0D as sentiment, cast(null as string) as wrap_code")
    assert round(call.select(P.fcr_score()).first()[0]) == 93  # 79 of 85
    call = spark.sql("select 22.0D as sentiment, 'resolved' as resolution, 80.0D as ces, 'minor' as issue")
    assert call.select(P.nps_score()).first()[0] == 65.0
    rec = spark.sql("select 'm' as menu, timestamp'2024-01-01 00:30:00' as ts, if(id < 947, 'correct', 'rejection') as outcome, 0 as errors, 3 as words from range(1000)")
    got = P.asr_accuracy(rec, F.lit("2024-01-01 01:00:00").cast("timestamp"), 3600).first()
    assert (got["accuracy_pct"], got["status"]) == (94.7, "Healthy")


def run_stream(spark, folder, operator, schema, batches):
    """Each batch is one run of the stream from the same checkpoint; rows of the sink by run."""
    seen, out = 0, []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = (operator(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/ckpt").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        now = [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]
        out.append(now[seen:] if not out else [r for r in now if r not in sum(out, [])])
    return out


def test_hysteresis_marks_late_rows_and_keeps_its_state(spark, tmp_path):
    from opsight.streaming import streams as S

    schema = "application_id int, period long, errors long"
    first, second = run_stream(spark, str(tmp_path), S.hysteresis_stream, schema,
                               [[(1, p, 5) for p in range(3)], [(1, 1, 9), (1, 3, 5), (1, 4, 0)]])
    assert sorted(first) == [(1, 0, 5, 1, 0, "HEALTHY", False), (1, 1, 5, 2, 0, "HEALTHY", False), (1, 2, 5, 3, 0, "HEALTHY", False)]
    assert sorted(second) == [(1, 1, 9, 3, 0, "HEALTHY", True), (1, 3, 5, 4, 0, "DEGRADED", False), (1, 4, 0, 0, 1, "DEGRADED", False)]


def test_holt_marks_late_values_and_applies_equal_times(spark, tmp_path):
    import datetime as dt

    from opsight.streaming import streams as S

    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    schema = "metric_id string, recorded_at timestamp, value double"
    one = run_stream(spark, f"{tmp_path}/a", S.holt_stream, schema, [[("m", t[1], 1.0), ("m", t[2], 2.0)], [("m", t[0], 9.0), ("m", t[2], 3.0), ("m", t[3], 4.0)]])
    two = run_stream(spark, f"{tmp_path}/b", S.holt_stream, schema, [[("m", t[1], 1.0), ("m", t[2], 2.0), ("m", t[2], 3.0), ("m", t[3], 4.0)]])
    late = [r for r in one[1] if r[-1]]
    assert len(late) == 1 and late[0][5] == 2
    last = lambda rows: max((r for r in rows if not r[-1]), key=lambda r: r[5])[2:6]
    assert last(one[1]) == last(two[0]) and last(two[0])[3] == 4


def test_every_insight_template_can_be_chosen(spark):
    ids = [t[0] for t in L.INSIGHT_TEMPLATES]
    rows = [(t, k, s, "IVR / Self-Service", None, {"signal_name": "x"}) for t, k, s, _ in L.INSIGHT_TEMPLATES]
    trig = spark.createDataFrame(rows, "template_id int, trigger_type string, severity string, signal_name string, related_signal string, fields map<string,string>")
    got = L.insights(trig, L.insight_templates(spark), L.domain_map(spark)).collect()
    assert len(got) == len(ids) == 9 and len({r.insight_text for r in got}) == 9
    assert {r.domains for r in got} == {"app,genesys"}
    plain = L.insights(trig.drop("template_id"), L.insight_templates(spark), L.domain_map(spark)).collect()
    assert len(plain) == 9 and not any("Active Incidents" in r.insight_text for r in plain)


def test_maintenance_windows_of_every_scope(spark):
    from opsight.operators import health as H

    st = spark.sql("""select * from values (1, 'one', 'WARNING', 3, 'G1'), (2, 'two', 'CRITICAL', 3, 'G2'), (3, 'three', 'HEALTHY', 0, 'G1')
                      t(application_id, application_name, current_status, error_count, infrastructure_group)""")
    win = "select {id}L as maintenance_id, {app} as application_id, {grp} as infrastructure_group, '{scope}' as scope, 'PLANNED' as maintenance_type, timestamp'{a}' as start_time, timestamp'{b}' as end_time"
    app = win.format(id=1, app="1", grp="cast(null as string)", scope="APP", a="2024-01-01 09:00:00", b="2024-01-01 11:00:00")
    grp = win.format(id=2, app="cast(null as int)", grp="'G2'", scope="GROUP", a="2024-01-01 10:10:00", b="2024-01-01 11:00:00")
    every = win.format(id=3, app="cast(null as int)", grp="cast(null as string)", scope="ALL", a="2024-01-01 08:00:00", b="2024-01-01 09:45:00")
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")

    def modes(*sql):
        got = H.maintenance_mode(st, spark.sql(" union all ".join(sql)), now).collect()
        return sorted(((r.application_id, r.maintenance_id, r.monitoring_mode) for r in got), key=str)

    assert {m[0]: m[2] for m in modes(app)} == {1: "SUPPRESS_DURING_MAINTENANCE", 2: "NORMAL_MONITORING"}
    assert (2, 2, "PRE_MAINTENANCE_WINDOW") in modes(grp, app) and (1, 1, "SUPPRESS_DURING_MAINTENANCE") in modes(grp, app)
    assert modes(every) == [(1, 3, "POST_MAINTENANCE_STABILIZATION"), (2, 3, "POST_MAINTENANCE_STABILIZATION")]
