"""Segmented scans and distributed selection against plain windows, plain loops and numpy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsight.functions.segments import SEG, segmented, streak_summary, with_carried_rows, with_streak
from opsight.functions.selection import exact_percentiles
from opsight.operators import health as H

T0 = dt.datetime(2024, 1, 1)


def series(spark, seed, keys=("hot", "b", None), n=3000, gap_s=40):
    """Most rows on one key; quiet stretches; rows of one time; values that repeat."""
    r = random.Random(seed)
    rows, t = [], dict.fromkeys(keys, 0)
    for i in range(n):
        k = keys[0] if r.random() < 0.8 else r.choice(keys)
        t[k] += r.choice([0, 1, gap_s, gap_s, 20 * gap_s if r.random() < 0.05 else 5])
        rows.append((k, T0 + dt.timedelta(seconds=t[k]), i, float(r.randrange(5)), int(r.random() < 0.85)))
    return spark.createDataFrame(rows, "k string, t timestamp, id long, v double, f int")


@pytest.mark.parametrize("segment_s", [60, 3600, 10 ** 6])
def test_scans_equal_the_plain_window(spark, segment_s):
    df = series(spark, 1)
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = (df.withColumn("isle", F.sum(1 - F.col("f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("streak", F.sum("f").over(Window.partitionBy("k", "isle").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("m", F.sum("v").over(w.rowsBetween(-10, -1))).withColumn("c", F.sum("f").over(w.rowsBetween(-5, 0))))
    want = {r["id"]: (r["streak"], r["m"], r["c"]) for r in plain.collect()}
    seg = with_streak(segmented(df, "t", segment_s), ["k"], ["t", "id"], "f", "streak")
    ws = Window.partitionBy("k", SEG).orderBy("t", "id")
    got = (with_carried_rows(seg, ["k"], ["t", "id"], 10, ["v", "f"]).withColumn("m", F.sum("v").over(ws.rowsBetween(-10, -1)))
           .withColumn("c", F.sum("f").over(ws.rowsBetween(-5, 0))).where("not _halo"))
    assert {r["id"]: (r["streak"], r["m"], r["c"]) for r in got.collect()} == want
    per_key = plain.groupBy("k").agg(F.max("streak"), F.max_by("streak", F.struct("t", "id")), F.sum((F.col("streak") >= 4).cast("int"))).collect()
    summary = streak_summary(segmented(df, "t", segment_s), ["k"], ["t", "id"], "f", 4).collect()
    assert sorted(map(str, map(tuple, summary))) == sorted(map(str, map(tuple, per_key)))


def test_a_hot_key_is_split(spark):
    """No task of the scan holds more than two segments' rows of a key that has them all."""
    rows = spark.range(40_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id")).alias("t"), "id", F.lit(1.0).alias("v"), F.lit(1).alias("f"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        got = with_streak(segmented(rows, "t", 1000), ["k"], ["t"], "f", "streak").withColumn("task", F.spark_partition_id())
        tasks = got.groupBy("task").agg(F.count("*").alias("n"), F.max("streak").alias("m")).collect()
        assert len(tasks) > 20 and max(t["n"] for t in tasks) <= 4000 and max(t["m"] for t in tasks) == 40_000  # some segments share a task by their hash
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("segment", [1, 7, 256])
def test_hysteresis_in_segments_over_100_000_periods(spark, segment):
    r = random.Random(segment)
    n = 100_000 if segment == 256 else 3000
    errors, bad = [], False
    for _ in range(n):
        bad = bad if r.random() < 0.85 else not bad
        errors.append(int(bad))
    status, up, down, want = "DEGRADED", 0, 0, []
    for e in errors:
        up, down = (up + 1, 0) if e else (0, down + 1)
        if status in ("HEALTHY", "RECOVERING") and up >= 8:
            status = "CRITICAL"
        elif status in ("HEALTHY", "RECOVERING") and up >= 4:
            status = "DEGRADED"
        elif status == "DEGRADED" and up >= 8:
            status = "CRITICAL"
        elif status in ("DEGRADED", "CRITICAL") and down >= 5:
            status = "RECOVERING"
        elif status == "RECOVERING" and down >= 8:
            status = "HEALTHY"
        want.append((up, down, status))
    pe = spark.createDataFrame([(7, 1000 + i, e) for i, e in enumerate(errors)], "application_id int, period long, errors long")
    got = H.recovery_status(pe, start="DEGRADED", segment=segment).orderBy("period").collect()
    assert [(r["bad"], r["ok"], r["status"]) for r in got] == want
    assert {s for _, _, s in want} == {"HEALTHY", "DEGRADED", "CRITICAL", "RECOVERING"}


def test_percentiles_equal_numpy(spark):
    r = random.Random(4)
    groups = {"uniform": [r.random() for _ in range(20_000)], "ties": [float(r.randrange(3)) for _ in range(5000)], "one": [7.5],
              "two": [1.0, 2.0], "skewed": [10.0 ** r.randrange(-300, 300) for _ in range(3000)], "same": [4.0] * 999,
              "near": [1.7e9 + r.random() for _ in range(4000)], "negative": [-r.random() * 10 ** r.randrange(9) for _ in range(2500)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("uniform", None), ("null", None), (None, 3.0), (None, 5.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    for accuracy in (200, 10_000):
        got = {x["g"]: [x[n] for n in names] for x in exact_percentiles(df, ["g"], "v", probs, names, accuracy=accuracy).collect()}
        assert set(got) == {*groups, None} and got[None][2] == 4.0
        for k, vs in groups.items():
            np.testing.assert_allclose(got[k], np.quantile(vs, probs), rtol=1e-9)
    whole = exact_percentiles(df, [], "v", [0.5], ["m"], accuracy=200).first()["m"]
    assert whole == pytest.approx(float(np.quantile([v for _, v in rows if v is not None], 0.5)), rel=1e-9)
    assert exact_percentiles(df.limit(0), ["g"], "v", [0.5]).collect() == []
    close = exact_percentiles(df, ["g"], "v", [0.5], ["m"], approx=True).where("g = 'uniform'").first()["m"]
    assert abs(close - 0.5) < 0.05


def test_no_task_holds_a_group(spark):
    """One group of all rows: after the first count by value, its rows lie in brackets of a small part of it."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    plan = exact_percentiles(df, ["g"], "v", [0.5], ["m"], accuracy=500)
    want = float(np.quantile([r[0] for r in df.select("v").collect()], 0.5))
    assert plan.first()["m"] == pytest.approx(want, rel=1e-12)
