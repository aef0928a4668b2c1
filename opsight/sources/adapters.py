"""Adapters: the given parquet tables -> the model tables the operators take.

The mapping is the one fixed in FIXTURES.md section C; the oracle text in
`opsight.plans.oracle_base` states the same mapping in SQL. Every model table is
a lazy DataFrame over the given tables, so its size grows with them.

`events` carries ~14 rows an hour at sf0.01, so windows the reference states in
minutes are given here in hours (operators take window lengths in seconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import DAY, HOUR, count_if, rnd
from ..session import checkpoint_dir
from .tables import load

# Fixed values of the test mapping (FIXTURES.md section C).
F_CALL_ID = "l_orderkey * 10 + l_linenumber"
N_APP_USERS_MOD = 25      # app = (user_id % 25)^3 div 625
APP_DIVISOR = 625
DEFAULT_THRESHOLD = 60.0  # threshold_config: constant per (entity, metric)
ALERT_VALUE = 100.0       # alerts: error rows with value > 100


def app_of(user_id: str = "user_id"):
    m = F.col(user_id) % F.lit(N_APP_USERS_MOD)
    return F.floor(m * m * m / F.lit(APP_DIVISOR)).cast("int")


class Model:
    """Lazily built model tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # One Model is one run: its tables are listed once and its `now` is evaluated once; the next run has its own.
        self._tables: dict = {}
        self._newest: dict = {}
        self._slice: DataFrame | None = None
        # Event times are wall-clock values without zone; all time arithmetic is in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = load(self.spark, self.sf_dir, name)
        return self._tables[name]

    def sliced(self, lookback_s: int) -> Model:
        """This run with the events of the last `lookback_s` seconds (from the start of that hour) read once and written to the
        shared folder, for jobs whose parts all look at the same recent slice. Alerts and names still come from all events."""
        checkpoint_dir(self.spark)
        recent = self._last_hours(lookback_s).select("event_id", "ts", "user_id", "event_type", "value", "app").checkpoint()
        out = Model(self.spark, self.sf_dir)
        out._tables, out._newest, out._slice = self._tables, self._newest, recent
        return out

    def back(self, steps: int) -> Model:
        """A run of an earlier time: the tables as they were `steps` cycles ago (a cycle is an hour of events, a day of calls and
        of incidents). Its `now` is the newest time in what is left, so every plan runs on it unchanged."""
        out = Model(self.spark, self.sf_dir)
        for table, column, unit in (("events", "ts", HOUR), ("lineitem", "l_shipdate", DAY), ("orders", "o_orderdate", DAY)):
            until = self.newest(table, column) - F.make_dt_interval(secs=F.lit(float(steps * unit)))
            out._tables[table] = self.raw(table).filter(F.col(column).cast("timestamp") <= until)
        for table in ("nation", "region", "supplier", "customer"):
            out._tables[table] = self.raw(table)
        return out

    # -- events: ts cast to timestamp once (watermarks reject timestamp_ntz) --
    def events(self) -> DataFrame:
        return self._slice if self._slice is not None else self._all_events()

    def _all_events(self) -> DataFrame:
        return (self.raw("events")
                .withColumn("ts", F.col("ts").cast("timestamp"))
                .withColumn("app", app_of()))

    def applications(self) -> DataFrame:
        n = self.raw("nation")
        r = self.raw("region")
        # nation/region are fixed-size dimensions (25 / 5 rows at every scale).
        return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                .select(F.col("n_nationkey").alias("application_id"),
                        F.col("n_name").alias("application_name"),
                        F.col("r_name").alias("datacenter_id"),
                        F.col("r_name").alias("infrastructure_group"),
                        F.lit(1).alias("is_active")))

    def app_names(self) -> DataFrame:
        return self.applications().select("application_id", "application_name")

    def error_logs(self) -> DataFrame:
        return (self.events().filter(F.col("event_type") == "error")
                .select(F.col("event_id").alias("error_id"),
                        F.col("app").alias("entity_id"),
                        F.col("app").alias("application_id"),
                        F.col("ts").alias("recorded_at")))

    def host_error_logs(self) -> DataFrame:
        return (self.events().filter(F.col("event_type") == "error")
                .select(F.col("user_id").alias("host_id"),
                        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host_name"),
                        F.col("app").alias("application_id"),
                        F.col("ts").alias("recorded_at")))

    def metrics_long(self) -> DataFrame:
        e = self.events().filter(F.col("event_type") != "error")
        return (e.join(F.broadcast(self.app_names()), e.app == F.col("application_id"))
                .select(F.col("event_id").alias("row_id"),
                        F.col("app").alias("entity_id"),
                        F.col("application_name").alias("entity_name"),
                        F.lit("application").alias("entity_type"),
                        F.col("event_type").alias("metric_name"),
                        F.col("value").alias("metric_value"),
                        F.col("ts").alias("recorded_at")))

    def thresholds(self, metrics: DataFrame | None = None) -> DataFrame:
        """threshold_config: one row per (application, metric), threshold 60.

        A configuration table (applications x metric names); the names are the event types that occur, so a
        new type has a threshold too. `metrics` is accepted for call compatibility and not read.
        """
        n = self.raw("nation").select(F.col("n_nationkey").alias("entity_id"))
        names = (self.raw("events").filter(F.col("event_type") != "error")
                 .agg(F.sort_array(F.collect_set("event_type")).alias("names")).scalar())
        return (n.select("entity_id", F.explode(names).alias("metric_name"))
                .withColumn("threshold_value", F.lit(DEFAULT_THRESHOLD)))

    def _last_hours(self, lookback_s: int | None) -> DataFrame:
        """Events since the start of the hour that lies `lookback_s` before now; the filter reaches the scan."""
        e = self.events()
        if lookback_s is None:
            return e
        return e.filter(F.col("ts") >= F.date_trunc("hour", self.as_of() - F.make_dt_interval(secs=F.lit(lookback_s))))

    def metrics_wide(self, lookback_s: int | None = None) -> DataFrame:
        """Per application and hour: requests, errors, success/error rate, response time."""
        e = self._last_hours(lookback_s)
        agg = (e.groupBy(F.col("app").alias("application_id"),
                         F.date_trunc("hour", "ts").alias("recorded_at"))
               .agg(F.count(F.lit(1)).alias("request_count"),
                    count_if(F.col("event_type") == "error").alias("error_count"),
                    F.avg("value").alias("response_time_ms")))
        return (agg.join(F.broadcast(self.app_names()), "application_id")
                .withColumn("error_rate", F.col("error_count") * 100.0 / F.col("request_count"))
                .withColumn("success_rate", F.lit(100.0) - F.col("error_rate")))

    def synthetic_metrics(self, lookback_s: int | None = None) -> DataFrame:
        return self.metrics_wide(lookback_s).select("application_id", "success_rate", "recorded_at")

    def host_metrics(self, lookback_s: int | None = None) -> DataFrame:
        """Host UNHEALTHY in an hour with any error, else HEALTHY."""
        e = self._last_hours(lookback_s)
        return (e.groupBy(F.col("user_id").alias("host_id"), F.col("app").alias("application_id"),
                          F.date_trunc("hour", "ts").alias("recorded_at"))
                .agg(count_if(F.col("event_type") == "error").alias("n_err"))
                .select("host_id", "application_id", "recorded_at",
                        F.when(F.col("n_err") > 0, "UNHEALTHY").otherwise("HEALTHY").alias("health_status")))

    def alerts(self) -> DataFrame:
        e = self._all_events()
        return (e.filter((F.col("event_type") == "error") & (F.col("value") > ALERT_VALUE))
                .select(F.col("event_id").alias("alert_id"), F.col("app").alias("application_id"),
                        F.lit("ACTIVE").alias("status"), F.col("ts").alias("created_at")))

    def newest(self, table: str, column: str):
        """The newest time of a table as a literal, evaluated once per run (one aggregate over one column)."""
        key = (table, column)
        if key not in self._newest:
            self._newest[key] = self.raw(table).select(F.unix_micros(F.max(F.col(column).cast("timestamp")))).first()[0]
        return F.timestamp_micros(F.lit(self._newest[key]))

    def as_of(self):
        return self.newest("events", "ts")

    def maintenance_windows(self) -> DataFrame:
        """One 10-hour window per infrastructure group near as_of, plus one of scope ALL.

        Region k's window starts at as_of + (k - 2) * 4 h - 5 h, so that across the
        five groups as_of falls before, inside and after a window; the ALL window
        lies 100 h back (matches no one) so only groups decide.
        """
        r = self.raw("region")
        a = self.as_of()
        start = a + F.make_dt_interval(hours=(F.col("r_regionkey") - 2) * 4 - 5)
        per_group = r.select(
            (F.col("r_regionkey") + 1).cast("long").alias("maintenance_id"),
            F.lit(None).cast("int").alias("application_id"),
            F.col("r_name").alias("infrastructure_group"),
            F.lit("GROUP").alias("scope"),
            F.lit("PLANNED").alias("maintenance_type"),
            start.alias("start_time"),
            (start + F.make_dt_interval(hours=F.lit(10))).alias("end_time"))
        all_scope = (r.filter(F.col("r_regionkey") == 0).select(
            F.lit(100).cast("long").alias("maintenance_id"),
            F.lit(None).cast("int").alias("application_id"),
            F.lit(None).cast("string").alias("infrastructure_group"),
            F.lit("ALL").alias("scope"),
            F.lit("PLANNED").alias("maintenance_type"),
            (a - F.make_dt_interval(hours=F.lit(110))).alias("start_time"),
            (a - F.make_dt_interval(hours=F.lit(100))).alias("end_time")))
        return per_group.unionByName(all_scope)

    # -- anomaly pipeline input: daily points per metric --------------------------------
    def _daily_counts(self) -> DataFrame:
        e = self.events()
        return (e.groupBy((F.col("user_id") % 5).alias("k"), F.date_trunc("day", "ts").alias("day"), "event_type")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")))

    def metrics_raw(self) -> DataFrame:
        """metrics_raw (metric_id, recorded_at, value): daily points of four metric families.

        <event_type>_<k>: daily mean value (unbounded_count); error_share_<k> and
        success_share_<k>: daily share of error events (bounded_ratio, both directions);
        daily_events_<k>: daily event count (bounded_capacity); k = user_id % 5.
        """
        g = self._daily_counts()
        per_k = (g.groupBy("k", "day")
                 .agg(F.sum("n").alias("n"),
                      F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)).alias("ne")))
        kk = F.col("k").cast("string")
        unb = g.select(F.concat(F.col("event_type"), F.lit("_"), kk).alias("metric_id"),
                       F.col("day").alias("recorded_at"), (F.col("s") / F.col("n")).alias("value"))
        share = F.col("ne") / F.col("n")
        hi = per_k.select(F.concat(F.lit("error_share_"), kk).alias("metric_id"), F.col("day").alias("recorded_at"),
                          share.alias("value"))
        lo = per_k.select(F.concat(F.lit("success_share_"), kk).alias("metric_id"), F.col("day").alias("recorded_at"),
                          (F.lit(1.0) - share).alias("value"))
        cap = per_k.select(F.concat(F.lit("daily_events_"), kk).alias("metric_id"), F.col("day").alias("recorded_at"),
                           F.col("n").cast("double").alias("value"))
        return unb.unionByName(hi).unionByName(lo).unionByName(cap)

    def metric_config(self) -> DataFrame:
        """metric_config rows for the metrics of `metrics_raw` (capacity = 1.2 x max daily count)."""
        g = self._daily_counts()
        per_k = g.groupBy("k", "day").agg(F.sum("n").alias("n"))
        kk = F.col("k").cast("string")
        common = [F.lit(0.70).alias("baseline_window_pct"), F.lit(20).alias("history_min_points"),
                  F.lit(True).alias("is_active")]

        def fam(df, mid, cat, mtype, direction, capacity, unit):
            return df.select(mid.alias("metric_id"), mid.alias("metric_name"), F.lit(cat).alias("category"),
                             F.lit(mtype).alias("metric_type"), F.lit(direction).alias("direction"),
                             capacity.cast("double").alias("capacity"), F.lit(unit).alias("unit"), *common)

        types = g.select("k", "event_type").distinct()
        ks = per_k.groupBy("k").agg((F.max("n") * 1.2).alias("cap"))
        return (fam(types, F.concat(F.col("event_type"), F.lit("_"), kk), "Traffic", "unbounded_count", "both",
                    F.lit(None), "value")
                .unionByName(fam(ks, F.concat(F.lit("error_share_"), kk), "Reliability", "bounded_ratio",
                                 "higher_is_bad", F.lit(None), "%"))
                .unionByName(fam(ks, F.concat(F.lit("success_share_"), kk), "Reliability", "bounded_ratio",
                                 "lower_is_bad", F.lit(None), "%"))
                .unionByName(fam(ks, F.concat(F.lit("daily_events_"), kk), "Capacity", "bounded_capacity",
                                 "higher_is_bad", F.col("cap"), "events")))

    # -- leading-indicator snapshots ------------------------------------------------------
    EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

    def signal_snapshots(self) -> DataFrame:
        """Dense hourly snapshots (signal_name, numeric_value, snapshot_time).

        Series = event_type x (user_id % 3), value = hourly mean; the first fourteen
        series carry the fourteen signal names. Each series runs from its first hour
        to the newest hour (its own hour sequence, exploded: no cross join) and an
        hour without events repeats the last value, as a per-cycle snapshot job would.
        """
        from ..operators.leading import SIGNAL_NAMES
        e = self.events()
        g = (e.groupBy("event_type", (F.col("user_id") % 3).alias("k"), F.date_trunc("hour", "ts").alias("h"))
             .agg(rnd(F.avg("value"), 9).alias("v")))
        idx = (F.array_position(F.array(*[F.lit(t) for t in self.EVENT_TYPES]), F.col("event_type")) - 1) * 3 + F.col("k")
        names = F.array(*[F.lit(n) for n in SIGNAL_NAMES])
        name = F.when((idx >= 0) & (idx < len(SIGNAL_NAMES)), F.element_at(names, (idx + 1).cast("int"))) \
            .otherwise(F.concat(F.col("event_type"), F.lit("_"), F.col("k").cast("string")))
        g = g.withColumn("signal_name", name)
        last_h = F.date_trunc("hour", self.as_of())
        span = (g.groupBy("signal_name").agg(F.min("h").alias("h0"))
                .select("signal_name", F.explode(F.sequence(F.col("h0"), last_h, F.expr("INTERVAL 1 HOUR")))
                        .alias("snapshot_time")))
        d = span.join(g.select("signal_name", F.col("h").alias("snapshot_time"), "v"), ["signal_name", "snapshot_time"],
                      "left")
        w = Window.partitionBy("signal_name").orderBy("snapshot_time").rowsBetween(Window.unboundedPreceding, 0)
        return d.select("signal_name", F.last("v", ignorenulls=True).over(w).alias("numeric_value"), "snapshot_time")

    def calibration_end(self):
        """End of the calibration period: 20 days after the first event day."""
        first = self.events().select(F.min("ts")).scalar()
        return F.date_trunc("day", first) + F.make_dt_interval(days=F.lit(20))

    # -- contact-centre tables from the TPC-H-like tables --------------------------------
    _CALL = (("call_id", F_CALL_ID), ("agent_id", "l_suppkey"), ("duration_min", "l_quantity"), ("mos", "5.0D - 20.0D * l_discount"),
             ("queue", "l_returnflag"), ("call_time", "cast(l_shipdate as timestamp)"), ("wait_sec", "l_tax * 1000.0D"),
             ("line_status", "l_linestatus"))

    def calls(self) -> DataFrame:
        """Calls: one per lineitem. agent = l_suppkey, duration (min) = l_quantity, mos = 5 - 20 * l_discount,
        queue = l_returnflag, time = l_shipdate, wait (s) = 1000 * l_tax, status = l_linestatus. No join."""
        return self.raw("lineitem").select(*[F.expr(e).alias(n) for n, e in self._CALL])

    def calls_geo(self) -> DataFrame:
        """Calls with vendor = s_nationkey % 5 and the region of the supplier's nation."""
        li = self.raw("lineitem")
        su = self.raw("supplier").select("s_suppkey", "s_nationkey")
        geo = (self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
               .select("n_nationkey", F.col("r_name").alias("region")))
        j = li.join(su, li.l_suppkey == su.s_suppkey).join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
        return j.select(*[F.expr(e).alias(n) for n, e in self._CALL], (F.col("s_nationkey") % 5).cast("int").alias("vendor_id"), "region")

    def incidents(self, groups: bool = False) -> DataFrame:
        """Incidents: one per order. priority = first digit of o_orderpriority, state from
        o_orderstatus (F resolved, O open, P in progress), opened_at = o_orderdate;
        with `groups` also the assignment group = c_mktsegment (a join with customer)."""
        j = self.raw("orders")
        if groups:
            c = self.raw("customer").select("c_custkey", "c_mktsegment")
            j = j.join(c, j.o_custkey == c.c_custkey)
        return j.select(
            F.col("o_orderkey").alias("incident_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
            F.when(F.col("o_orderstatus") == "F", "Resolved").when(F.col("o_orderstatus") == "O", "Open")
            .otherwise("In Progress").alias("state"),
            F.col("o_orderdate").cast("timestamp").alias("opened_at"),
            F.col("o_totalprice").alias("impact_value"), *([F.col("c_mktsegment").alias("assignment_group")] if groups else []))

    def contacts(self) -> DataFrame:
        """Contacts: customer = user_id, category and channel = event_type, time = ts."""
        return self.events().select(F.col("event_id").alias("contact_id"), F.col("user_id").alias("customer_id"),
                                    F.col("event_type").alias("category"), F.col("event_type").alias("channel"),
                                    F.col("ts").alias("contact_time"), F.col("value"))

    def numstat(self, authors: bool = True) -> DataFrame:
        """Commit numstat: repo = l_returnflag, branch = l_linestatus, commit = order, path = part,
        added = l_quantity, deleted = l_linenumber; author = o_custkey % 20 (a join with orders) unless not asked for."""
        j = self.raw("lineitem")
        if authors:
            o = self.raw("orders").select("o_orderkey", "o_custkey")
            j = j.join(o, j.l_orderkey == o.o_orderkey)
        return j.select(F.col("l_returnflag").alias("repo"), F.col("l_linestatus").alias("branch"),
                        F.col("l_orderkey").cast("string").alias("commit"),
                        *([F.concat(F.lit("author-"), (F.col("o_custkey") % 20).cast("string")).alias("author")] if authors else []),
                        F.col("l_shipdate").cast("timestamp").alias("committed_at"),
                        F.concat(F.lit("src/part-"), F.col("l_partkey").cast("string")).alias("path"),
                        F.col("l_quantity").cast("long").cast("string").alias("added"),
                        F.col("l_linenumber").cast("string").alias("deleted"))


UNIT = HOUR
