"""Column helpers shared by every operator.

Rules kept here so each operator states them once:
  * no wall clock: time is measured against an `as_of` Column (default: max of the
    event-time column, as an in-plan scalar subquery, so no driver round trip);
  * windows are parameters in seconds (`MIN`, `HOUR`, `DAY` multiply counts);
  * zero guards via try_divide (ANSI mode raises on /0).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN = 60
HOUR = 3600
DAY = 86400


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_of(df: DataFrame, ts: str = "ts") -> Column:
    """Newest event time of `df` as a scalar-subquery Column (evaluated once)."""
    return df.select(F.max(ts)).scalar()


def resolve_as_of(as_of, df: DataFrame, ts: str) -> Column:
    if as_of is None:
        return as_of_of(df, ts)
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def secs(n: float) -> Column:
    """Day-time interval of `n` seconds."""
    return F.make_dt_interval(secs=F.lit(float(n)).cast("decimal(18,6)"))


def ago(as_of: Column, seconds: float) -> Column:
    return as_of - secs(seconds)


def since(ts: str | Column, as_of: Column, seconds: float) -> Column:
    """Lookback predicate `ts >= as_of - seconds` (FLT-1)."""
    return col(ts) >= ago(as_of, seconds)


def bucket(ts: str | Column, unit_seconds: int) -> Column:
    """Index of the `unit_seconds`-long period holding ts (epoch aligned).

    With unit 60 this is the minute, with 3600 the hour: the meaning of
    `COUNT(DISTINCT minute)` without the minute-of-hour fault.
    """
    return F.floor(F.unix_micros(col(ts)) / F.lit(unit_seconds * 1_000_000)).cast("long")


def day_type(ts: str | Column) -> Column:
    """WEEKEND for Sunday (1) and Saturday (7), else WEEKDAY."""
    return F.when(F.dayofweek(col(ts)).isin(1, 7), F.lit("WEEKEND")).otherwise(F.lit("WEEKDAY"))


def ladder(rules: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """Searched CASE, first match wins (PRJ-1)."""
    expr = None
    for cond, val in rules:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    if otherwise is None:
        return expr
    return expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def rank_of(c: str | Column, order: Iterable[str]) -> Column:
    """Sort key for a status column from an ordered list of values (PRJ-2)."""
    order = list(order)
    return ladder([(col(c) == v, i + 1) for i, v in enumerate(order)], len(order) + 1)


def rnd(c: str | Column, digits: int = 4) -> Column:
    """Round to `digits` places as round(x * 10^d) / 10^d.

    Spark's round(x, d) rounds the shortest decimal text of x half-up, while
    SQL engines commonly round the binary value; scaling first makes both agree
    on ties (35.26125 stored as 35.261249999...).
    Both engines first snap to 9 places, which absorbs last-ulp differences of
    sums taken in another order, then round the snapped value.
    """
    snap = F.round(col(c).cast("double") * F.lit(1e9)) / F.lit(1e9)
    p = float(10 ** digits)
    return F.round(snap * F.lit(p)) / F.lit(p)


def r4(c: str | Column) -> Column:
    return rnd(c, 4)


def pct(num: Column, den: Column) -> Column:
    """100·num/den, NULL when den is 0 (AGG-11)."""
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def ts_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def latest(df: DataFrame, ts: str, by: Sequence[str] | None = None) -> DataFrame:
    """Rows of the newest `ts` (SRC-10): overall, or per key `by`.

    Overall: filter against a scalar subquery. Per key: a window partitioned by
    the key, the usual top-1-per-key plan (one shuffle on the key).
    """
    if not by:
        return df.filter(F.col(ts) == df.select(F.max(ts)).scalar())
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    return df.withColumn("_mx", F.max(ts).over(w)).filter(F.col(ts) == F.col("_mx")).drop("_mx")


def elapsed_text(minutes: Column) -> Column:
    """'45m', '3h 5m', '2d 4h' from a number of minutes (EXEC elapsed labels)."""
    m = minutes.cast("long")
    return ladder([
        (m < 60, F.concat(m.cast("string"), F.lit("m"))),
        (m < 1440, F.concat((m / 60).cast("long").cast("string"), F.lit("h "),
                            (m % 60).cast("string"), F.lit("m"))),
    ], F.concat((m / 1440).cast("long").cast("string"), F.lit("d "),
                ((m % 1440) / 60).cast("long").cast("string"), F.lit("h")))


def mmss(seconds: Column) -> Column:
    """m:ss text of a duration in seconds."""
    s = F.round(seconds).cast("long")
    return F.format_string("%d:%02d", (s / 60).cast("long"), s % 60)


def fixed(c: str | Column, digits: int) -> Column:
    """Fixed-point text of a value ('%.2f'), rounded first so both engines print the same digits; null for a null value."""
    v = rnd(c, digits)
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f", v))


def neighbour_within(df: DataFrame, keys, order, window_s: float, cols, direction: str = "prev",
                     prefix: str = "nb_") -> DataFrame:
    """Previous (or next) row of the same keys if it lies within `window_s` of this row, else NULL.

    Adds `prefix + order[0]` and `prefix + c` for each c in `cols`. Instead of one window per key
    over its whole history (a hot key would sit in one task), rows are partitioned by
    (keys, time bucket of width window_s) and each row is also copied, as a halo, into the
    adjacent bucket: a neighbour within window_s is always in the same or the adjacent bucket,
    so the result is exact while a hot key is split over its buckets.
    """
    from pyspark.sql import Window

    ts = order[0]
    w_us = int(window_s * 1_000_000)
    b = F.floor(F.unix_micros(col(ts)) / F.lit(w_us)).cast("long")
    shift = 1 if direction == "prev" else -1
    prim = df.withColumn("_nb_b", b).withColumn("_nb_h", F.lit(0))
    halo = df.withColumn("_nb_b", b + shift).withColumn("_nb_h", F.lit(1))
    u = prim.unionByName(halo)
    w = Window.partitionBy(*keys, "_nb_b").orderBy(*order)
    nb = F.struct(*[col(c).alias(c) for c in [ts, *cols]])
    pick = F.lag(nb).over(w) if direction == "prev" else F.lead(nb).over(w)
    u = u.withColumn("_nb", pick).filter(F.col("_nb_h") == 0)
    gap = F.col(ts) - F.col(f"_nb.{ts}") if direction == "prev" else F.col(f"_nb.{ts}") - F.col(ts)
    ok = F.col("_nb").isNotNull() & (gap <= F.make_dt_interval(secs=F.lit(float(window_s))))
    out = u
    for c in [ts, *cols]:
        out = out.withColumn(prefix + c, F.when(ok, F.col(f"_nb.{c}")))
    return out.drop("_nb", "_nb_b", "_nb_h")


def sessionize(df: DataFrame, keys, order, gap_s: float, bucket_s: float, out: str = "session_start") -> DataFrame:
    """Gap-based sessions per key without a window over a key's whole history.

    A row starts a session when no earlier row of its key lies within `gap_s` (bucketed
    neighbour test). Its session is the latest start at or before it: a running max inside
    (key, time bucket) plus a carry-in = the latest start of the key's earlier buckets, taken
    from a per-(key, bucket) aggregate (one row per bucket, not per event). Exact.
    """
    from pyspark.sql import Window

    ts = order[0]
    s = neighbour_within(df, keys, order, gap_s, [], "prev", "_gp_").withColumn(
        "_start", F.when(F.col(f"_gp_{ts}").isNull(), F.col(ts))).drop(f"_gp_{ts}")
    s = s.withColumn("_bk", F.floor(F.unix_micros(col(ts)) / F.lit(int(bucket_s * 1_000_000))).cast("long"))
    per_b = s.groupBy(*keys, "_bk").agg(F.max("_start").alias("_bmax"))
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_b.withColumn("_carry", F.max("_bmax").over(wb)).drop("_bmax")
    wi = Window.partitionBy(*keys, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_in", F.max("_start").over(wi)).join(carry, [*keys, "_bk"], "left")
    return s.withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))).drop("_start", "_bk", "_in", "_carry")
