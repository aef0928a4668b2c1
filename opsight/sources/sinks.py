"""Sinks and table maintenance (SRC-2, 7, 8, 9, 12, 13, 14).

No Delta in this environment: upserts write a new version folder from
(current version UNION updates) keeping the newest row per key, and never read
and overwrite the same path. Every writer takes its base folder from the caller
(on a cluster: the shared storage the job is given).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import DAY, since


def save(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> str:
    """Partitioned parquet write (SRC-7); overwrite replaces only the partitions present (dynamic)."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def upsert_latest(spark: SparkSession, base: str, updates: DataFrame, keys, order: str,
                  current: str | None = None) -> str:
    """MERGE-like upsert (SRC-8; keys=[] is the single-row MERGE ON 1=1 of SRC-9).

    new version = newest row per key of (current version UNION updates), written to a
    fresh folder under `base`; returns its path. A failed write leaves the current
    version untouched.
    """
    rows = updates if current is None else spark.read.parquet(current).unionByName(updates, allowMissingColumns=True)
    # A maximum merges before the shuffle, so a key (or, without keys, the table) is one row of each task by then.
    newest = F.max_by(F.struct(*rows.columns), F.struct(F.col(order).isNotNull(), F.col(order)))
    out = rows.groupBy(*keys).agg(newest.alias("_r")).filter(F.col("_r").isNotNull()).select("_r.*")
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    out.write.parquet(path)
    return path


def to_csv(df: DataFrame, path: str) -> str:
    """CSV export with header (SRC-13)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def roll_up_and_expire(df: DataFrame, ts: str, value_cols, keys, as_of: Column, raw_days: int = 7,
                       keep_days: int = 90, unit: str = "hour") -> DataFrame:
    """Retention (SRC-14): raw rows of the last `raw_days`, per-`unit` aggregates (count, mean, min,
    max) for older rows up to `keep_days`, nothing older. Returns both tiers with a `tier` column."""
    raw = df.filter(since(ts, as_of, raw_days * DAY))
    old = df.filter(~since(ts, as_of, raw_days * DAY) & since(ts, as_of, keep_days * DAY))
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in value_cols:
        aggs += [F.avg(v).alias(f"{v}_avg"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    rolled = old.groupBy(*keys, F.date_trunc(unit, ts).alias(ts)).agg(*aggs).withColumn("tier", F.lit("aggregated"))
    raw_t = raw.select(*keys, ts, F.lit(1).cast("long").alias("n"),
                       *[c for v in value_cols for c in (F.col(v).alias(f"{v}_avg"), F.col(v).alias(f"{v}_min"),
                                                          F.col(v).alias(f"{v}_max"))]).withColumn("tier", F.lit("raw"))
    return raw_t.unionByName(rolled)


# Retention by data type, in days: raw rows, and aggregated rows (None: no aggregated tier).
RETENTION = {"metrics": (7, 90), "error_logs": (30, 365), "baselines": (30, None), "alerts": (365, None), "maintenance_windows": (365, None)}


class TieredTable:
    """A table in two tiers (SRC-14): raw rows by day, and per-`unit` aggregates of older days.

    Folders are never changed. A manifest version lists which folder holds which day of which tier; writing a new version
    swaps the table, and readers of an older version keep theirs. `roll_up` reads only the raw days that expire.
    """

    def __init__(self, spark: SparkSession, base: str, data_type: str, ts: str, values, keys, unit: str = "hour"):
        self.spark, self.base, self.ts, self.values, self.keys, self.unit = spark, base.rstrip("/"), ts, list(values), list(keys), unit
        self.raw_days, self.keep_days = RETENTION[data_type]

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{self.base}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(path) if fs.exists(jvm.Path(f.getPath(), "_SUCCESS")))

    def manifest(self, version: int | None = None) -> list[tuple[str, str, str]]:
        """(tier, day, folder) of a version, by default the newest: one row for each day and write."""
        done = self._versions()
        if not done:
            return []
        rows = self.spark.read.parquet(f"{self.base}/manifest/v={done[-1] if version is None else version}").collect()
        return sorted((r["tier"], r["day"], r["folder"]) for r in rows)

    def _swap(self, rows) -> int:
        version = max(self._versions(), default=-1) + 1
        self.spark.createDataFrame(rows, "tier string, day string, folder string").coalesce(1).write.parquet(f"{self.base}/manifest/v={version}")
        return version

    def _write(self, rows: DataFrame, tier: str) -> list[tuple[str, str, str]]:
        folder = f"{self.base}/{tier}-{uuid.uuid4().hex[:12]}"
        rows.write.partitionBy("day").parquet(folder)
        days = [r[0] for r in self.spark.read.parquet(folder).select(F.col("day").cast("string")).distinct().collect()]  # one value for each day
        return [(tier, d, f"{folder}/day={d}") for d in days]

    def append(self, rows: DataFrame) -> int:
        """Adds raw rows; a day may come in parts."""
        day = F.date_format(self.ts, "yyyy-MM-dd")
        return self._swap(self.manifest() + self._write(rows.select(*self.keys, self.ts, *self.values, day.alias("day")), "raw"))

    def roll_up(self, now: str) -> int:
        """Applies the policy as of the day `now`: raw days older than it allows are rolled up, aggregates too old are dropped."""
        import datetime

        today = datetime.date.fromisoformat(now)
        day_before = lambda n: (today - datetime.timedelta(days=n)).isoformat()
        held = self.manifest()
        keep = [m for m in held if m[0] == "raw" and m[1] >= day_before(self.raw_days)]
        if self.keep_days is not None:
            oldest = day_before(self.keep_days)
            keep += [m for m in held if m[0] == "aggregated" and m[1] >= oldest]
            due = [m for m in held if m[0] == "raw" and oldest <= m[1] < day_before(self.raw_days)]
            if due:
                keep += self._write(self._aggregate(self.spark.read.parquet(*[m[2] for m in due])), "aggregated")
        return self._swap(keep)

    def _aggregate(self, raw: DataFrame) -> DataFrame:
        aggs = [a for v in self.values for a in (F.sum(v).alias(f"{v}_sum"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))]
        g = raw.groupBy(*self.keys, F.date_trunc(self.unit, self.ts).alias(self.ts)).agg(F.count(F.lit(1)).alias("n"), *aggs)
        return g.withColumn("day", F.date_format(self.ts, "yyyy-MM-dd"))

    def read(self, version: int | None = None) -> DataFrame:
        """Both tiers in one form (n, sum, min, max of each value); parts of an hour that came after its roll-up are merged."""
        rows, out = self.manifest(version), None
        stats = [f"{v}_{k}" for v in self.values for k in ("sum", "min", "max")]
        for tier in ("raw", "aggregated"):
            folders = [m[2] for m in rows if m[0] == tier]
            if not folders:
                continue
            t = self.spark.read.parquet(*folders)
            if tier == "raw":
                t = t.withColumn("n", F.lit(1).cast("long")).withColumns({f"{v}_{k}": F.col(v) for v in self.values for k in ("sum", "min", "max")})
            else:
                merged = [a for v in self.values for a in (F.sum(f"{v}_sum").alias(f"{v}_sum"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max"))]
                t = t.groupBy(*self.keys, self.ts).agg(F.sum("n").alias("n"), *merged)
            t = t.select(*self.keys, self.ts, "n", *stats, F.lit(tier).alias("tier"))
            out = t if out is None else out.unionByName(t)
        return out


def shape_synthetic(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Synthetic-monitor executions from JSON text (SRC-2): is_healthy = code 200 and duration < 3000 ms."""
    schema = "monitorName string, responseCode int, duration double, executionTimestamp string"
    p = raw.select(F.from_json(payload, schema).alias("x")).select("x.*")
    return p.select(F.col("monitorName").alias("app_name"), F.col("responseCode").alias("response_code"),
                    F.col("duration").alias("response_time_ms"),
                    F.when((F.col("responseCode") == 200) & (F.col("duration") < 3000), 1).otherwise(0).alias("is_healthy"),
                    F.to_timestamp("executionTimestamp").alias("check_time"))


def newest_insights(insights: DataFrame, n: int = 10) -> DataFrame:
    """The n newest active insights; of one time the most severe first, then by text."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return insights.orderBy(F.col("created_at").desc(), rank, "insight_text").limit(n)


DOCUMENT = """timestamp string, enterprise_score double, outage_probability double,
  signals array<struct<signal_name: string, numeric_value: double, status: string, trend: string, direction: string>>,
  domains array<struct<domain_key: string, score: double>>,
  insights array<struct<severity: string, insight_text: string, domains: string, related_signals: string>>"""


def document_rows(documents: DataFrame) -> DataFrame:
    """A serving document as rows (section, name, value, text); null values are left out of the JSON and come back as null."""
    d = documents.select(F.from_json("document", DOCUMENT).alias("d")).select("d.*")
    text = F.lit(None).cast("string")
    value = F.lit(None).cast("double")
    parts = F.concat(
        F.array(F.struct(F.lit("enterprise_score").alias("section"), F.lit("").alias("name"), F.col("enterprise_score").alias("value"), text.alias("text")),
                F.struct(F.lit("outage_probability").alias("section"), F.lit("").alias("name"), F.col("outage_probability").alias("value"), text.alias("text"))),
        F.transform("signals", lambda s: F.struct(F.lit("signal").alias("section"), s["signal_name"].alias("name"), s["numeric_value"].alias("value"), s["status"].alias("text"))),
        F.transform("domains", lambda s: F.struct(F.lit("domain").alias("section"), s["domain_key"].alias("name"), s["score"].alias("value"), text.alias("text"))),
        F.transform("insights", lambda s: F.struct(F.lit("insight").alias("section"), s["related_signals"].alias("name"), value.alias("value"), s["insight_text"].alias("text"))))
    return d.select(F.explode(parts).alias("p")).select("p.*")


def serving_document(signals: DataFrame, domains: DataFrame, probability: DataFrame, insights: DataFrame,
                     as_of: Column) -> DataFrame:
    """One JSON document (SRC-12 / LIP-20): signals, domains, enterprise score, outage probability, newest insights.

    Each part is aggregated to one row (collect_list of small, bounded sets: one row per
    signal / domain / insight); the one-value parts are attached as scalar subqueries.
    """
    sig = signals.agg(F.sort_array(F.collect_list(F.struct("signal_name", "numeric_value", "status", "trend",
                                                            "direction"))).alias("signals"))
    dom = domains.agg(F.sort_array(F.collect_list(F.struct("domain_key", "score"))).alias("d"),
                      F.round(F.avg(F.when(F.col("domain_key") != "unmapped", F.col("score"))), 1).alias("e"))
    # The other parts are one value each: scalar subqueries on the signals row (no joins).
    j = sig.withColumns({
        "domains": dom.select("d").scalar(), "enterprise_score": dom.select("e").scalar(),
        "outage_probability": probability.select("probability").scalar(),
        "insights": insights.agg(F.sort_array(F.collect_list(F.struct("severity", "insight_text", "domains",
                                                                       "related_signals")))).scalar()})
    doc = F.struct(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "enterprise_score",
                   "outage_probability", "signals", "domains", "insights")
    return j.select(F.to_json(doc).alias("document"))
