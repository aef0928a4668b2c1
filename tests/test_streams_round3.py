"""Alert deduplication with event-time timers, and late rows in a table of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsight.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)
ALERT = "signal string, severity string, ts timestamp, event_id long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def greedy(rows, minutes):
    kept, last = [], {}
    for signal, severity, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        k = (signal, severity)
        if k not in last or ts - last[k] > dt.timedelta(minutes=minutes):
            last[k] = ts
            kept.append((signal, severity, ts, i))
    return sorted(kept)


def test_first_alert_by_event_time_and_state_that_empties(spark, tmp_path):
    """Three deliveries, the rows of each out of order, a restart before each; the last one only moves the watermark on."""
    import random

    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice(["critical", "warning"]), at(r.randrange(200)), i) for i in range(150)]
    rows += [("c", "critical", at(10), 900), ("c", "critical", at(20), 901), ("c", "critical", at(20) + dt.timedelta(microseconds=1), 902), ("c", "critical", at(10), 899)]
    rows.sort(key=lambda x: x[2])
    halves = [rows[: len(rows) // 2], rows[len(rows) // 2:], [("z", "heartbeat", at(2000), -1)]]
    for part in halves:
        r.shuffle(part)
        spark.createDataFrame(part, ALERT).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(ALERT).parquet(str(tmp_path / "in"))
        q = S.start_stateful(S.dedup_alerts(src, ["signal", "severity"], window_s=600, delay_s=120).writeStream.format("parquet").outputMode("append")
                             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True))
        q.awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).where("signal <> 'z'").collect()]
    assert sorted(got) == greedy([x for x in rows], 10)
    left = {}
    for var in ("last", "waiting"):
        state = spark.read.format("statestore").option("stateVarName", var).load(str(tmp_path / "ckpt"))
        left[var] = {x["key"][0] for x in state.select("key").collect()}
    assert left["last"] == set() and left["waiting"] <= {"z"}


class Store:
    """State variables and timers of one key in memory; counts the messages and rows that would go to the state store."""

    def __init__(self):
        self.timers, self.messages, self.rows_read = set(), 0, 0

    def getListState(self, name, schema):
        return Var(self)

    getValueState = getListState

    def registerTimer(self, at):
        self.messages += 1
        self.timers.add(at)


class Var:
    def __init__(self, store):
        self.store, self.value = store, None

    def exists(self):
        return self.value is not None

    def get(self):
        if isinstance(self.value, list):
            self.store.rows_read += len(self.value)
            return iter(list(self.value))
        return self.value

    def put(self, value):
        self.store.messages += 1
        self.value = value

    update = put

    def appendList(self, rows):
        self.put((self.value or []) + list(rows))

    def appendValue(self, row):
        self.appendList([row])

    def clear(self):
        self.value = None


def test_work_of_a_frequent_alert_grows_with_its_rows():
    """A key with many alerts, some of which still wait at each step of the watermark: few messages, each row read a few times."""
    import random
    from types import SimpleNamespace

    r = random.Random(5)
    rows = [{"ts": T0 + dt.timedelta(seconds=r.randrange(6 * 3600)), "event_id": i} for i in range(3000)]
    rows.sort(key=lambda x: x["ts"])
    store, got = Store(), []
    op = S._FirstInWindow(600_000, ["signal"], "ts", "event_id")
    op.init(store)
    for part, hours in ((rows[:1500], 1), (rows[1500:], 5), ([], 30)):
        r.shuffle(part)
        list(op.handleInputRows(("a",), iter(part), None))
        passed = S._millis(T0 + dt.timedelta(hours=hours))
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed)
        for at in sorted(t for t in store.timers if t <= passed):
            got += [(x["created_at"], x["event_id"]) for x in op.handleExpiredTimer(("a",), clock, None)]
            store.timers.discard(at)
    want = greedy([("a", "", x["ts"], x["event_id"]) for x in rows], 10)
    assert got == [x[2:] for x in want]
    assert not store.timers and not op.waiting.exists() and not op.last.exists()
    assert store.messages < 30 and store.rows_read <= 3 * len(rows)


@pytest.mark.parametrize("form", ["tumbling", "sliding", "sessions", "correlate"])
def test_a_late_row_lands_in_the_late_table(spark, tmp_path, form):
    schema = "ts timestamp, k string, v double"
    split = S.LateSplit(spark, str(tmp_path / "rows"), delay_s=3600)
    deliveries = [[(at(m), "a", 1.0) for m in range(0, 600, 30)], [(at(5), "late", 1.0), (at(595), "a", 1.0), (at(540), "edge", 1.0), (None, "none", 1.0)]]
    for part in deliveries:
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # a run that finds nothing new changes nothing
            split.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ckpt"))
    assert sorted(r["k"] for r in split.late().collect()) == ["late", "none"]
    counts = split.counts().agg(F.sum("on_time"), F.sum("late"), F.max("newest")).first()
    assert tuple(counts) == (22, 2, at(595))
    on_time = split.on_time(schema)
    plan = {"tumbling": lambda s: S.tumbling_counts(s, "k", "1 hour", watermark="1 hour"),
            "sliding": lambda s: S.sliding_signal(s, "k", "v", "2 hours", "1 hour", watermark="1 hour"),
            "sessions": lambda s: S.error_sessions(s, "k", "45 minutes", watermark="1 hour"),
            "correlate": lambda s: S.correlate(s.select(F.col("k").alias("a"), F.col("ts").alias("ta")), s.select(F.col("k").alias("b"), F.col("ts").alias("tb")),
                                               "a", "b", "ta", "tb", "1 minute", watermark="1 hour")}[form](on_time)
    mode = "append" if form in ("sessions", "correlate") else "update"
    S.upsert_sink(plan, str(tmp_path / "out"), str(tmp_path / "ckpt2"), mode)
    out = spark.read.parquet(str(tmp_path / "out"))
    if form == "tumbling":
        newest = S.read_upserted(spark, str(tmp_path / "out"), ["k", "w"])
        assert newest.agg(F.sum("n")).first()[0] == 22  # every on-time row is in a window
    assert "late" not in {r[0] for r in out.select("a" if form == "correlate" else "k").collect()}


def test_a_frequent_key_of_a_correlation_is_dealt_by_time(spark, tmp_path):
    """Every pair once, at the edges of the interval too, while the rows of one key lie in the state of many tasks."""
    us = dt.timedelta(microseconds=1)
    left = [("a", at(m), m) for m in range(0, 3000, 20)] + [("a", at(0), 9001), ("b", at(60), 9002), (None, at(0), 9003), ("a", None, 9004)]
    right = [("a", at(m), m) for m in range(10, 3000, 25)] + [("a", at(30), 9101), ("a", at(-30), 9102), ("a", at(30) + us, 9103), ("a", at(-30) - us, 9104),
                                                             ("b", at(30), 9105), ("b", at(90), 9106), ("b", at(90) + us, 9107), (None, at(0), 9108), ("a", None, 9109)]
    for name, rows in (("left", left), ("right", right)):
        spark.createDataFrame(rows, "k string, t timestamp, i long").repartition(2).write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema("k string, t timestamp, i long").parquet(str(tmp_path / n)).select(F.col("k").alias(f"{n}_k"), F.col("t").alias(f"{n}_t"), F.col("i").alias(f"{n}_i"))
            for n in ("left", "right"))
    joined = S.correlate(a, b, "left_k", "right_k", "left_t", "right_t", "30 minutes", watermark="100 days")
    assert joined.columns == [*a.columns, *b.columns]
    S.upsert_sink(joined, str(tmp_path / "out"), str(tmp_path / "ckpt"), "append")
    got = sorted((r["left_i"], r["right_i"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    within = dt.timedelta(minutes=30)
    assert got == sorted((x[2], y[2]) for x in left for y in right if None not in (*x, *y) and x[0] == y[0] and abs(x[1] - y[1]) <= within)
    state = spark.read.format("statestore").option("joinSide", "right").load(str(tmp_path / "ckpt"))
    assert state.where("value.right_k = 'a'").select("partition_id").distinct().count() > 1
