"""The bucketed helpers give the same answer as a plain window over each key's whole history."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsight.functions.core import neighbour_within, sessionize

T0 = dt.datetime(2024, 1, 1)


def _rows(n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randrange(1, 6)          # key 0 holds ~40 % of the rows
        t = T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))
        rows.append((i, key, t, rnd.choice(["a", "b", "c"])))
    return rows


def test_neighbour_within_matches_plain_window(spark):
    df = spark.createDataFrame(_rows(), "id long, k int, t timestamp, ch string")
    w = Window.partitionBy("k").orderBy("t", "id")
    for direction, fn in (("prev", F.lag), ("next", F.lead)):
        for window_s in (3600, 86400, 7 * 86400):
            got = neighbour_within(df, ["k"], ["t", "id"], window_s, ["ch"], direction, "n_")
            exp = df.withColumn("nt", fn("t").over(w)).withColumn("nc", fn("ch").over(w))
            gap = (F.col("t") - F.col("nt")) if direction == "prev" else (F.col("nt") - F.col("t"))
            ok = F.col("nt").isNotNull() & (gap <= F.make_dt_interval(secs=F.lit(float(window_s))))
            exp = exp.select("id", F.when(ok, F.col("nt")).alias("n_t"), F.when(ok, F.col("nc")).alias("n_ch"))
            a = sorted(tuple(r) for r in got.select("id", "n_t", "n_ch").collect())
            b = sorted(tuple(r) for r in exp.collect())
            assert a == b, (direction, window_s)


def test_sessionize_matches_running_sum(spark):
    df = spark.createDataFrame(_rows(800, seed=11), "id long, k int, t timestamp, ch string")
    gap = 2 * 86400
    got = sessionize(df, ["k"], ["t", "id"], gap, bucket_s=3 * 86400, out="s")
    w = Window.partitionBy("k").orderBy("t", "id")
    prev = F.lag("t").over(w)
    new = F.when(prev.isNull() | (F.col("t") > prev + F.make_dt_interval(secs=F.lit(float(gap)))), F.col("t"))
    exp = df.withColumn("st", new).withColumn("s", F.max("st").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = sorted(tuple(r) for r in got.select("id", "s").collect())
    b = sorted(tuple(r) for r in exp.select("id", "s").collect())
    assert a == b


def test_bucketed_interval_join_matches_brute_force(spark):
    from opsight.operators.indicators import schedule_adherence
    rnd = random.Random(3)
    day = dt.datetime(2024, 1, 2)
    states, sched = [], []
    for agent in range(6):
        t = day
        while t < day + dt.timedelta(hours=20):                      # back-to-back states of random length
            d = dt.timedelta(minutes=rnd.randrange(5, 200))
            states.append((agent, rnd.choice(["available", "busy", "offline"]), t, t + d))
            t += d
        sched += [(agent, day, "available", day + dt.timedelta(hours=8), day + dt.timedelta(hours=12, minutes=30)),
                  (agent, day, "busy", day + dt.timedelta(hours=13), day + dt.timedelta(hours=17, minutes=45))]
    st = spark.createDataFrame(states, "agent_id int, state string, start_ts timestamp, end_ts timestamp")
    sc = spark.createDataFrame(sched, "agent_id int, day timestamp, state string, start_ts timestamp, end_ts timestamp")
    got = schedule_adherence(st, sc).first()
    adherent = sum(max(0.0, (min(a[3], s[4]) - max(a[2], s[3])).total_seconds() / 60)
                   for a in states for s in sched if a[0] == s[0] and a[1] == s[2])
    scheduled = sum((s[4] - s[3]).total_seconds() / 60 for s in sched)
    assert got["adherent_min"] == round(adherent, 4) and got["scheduled_min"] == round(scheduled, 4)
