"""Windows over a key's whole history, without one task for a key: segmented scans.

Rows are cut into segments (key, time bucket). A segment is reduced to a summary of fixed size, a scan over the summaries
(one row a segment) gives what each segment carries in from those before it, and the rows of a segment are then
worked on alone. Results equal the plain window over the key; a hot key is spread over its segments.

  * `with_carried_rows`: the last n rows before a segment, for windows of n preceding rows;
  * `with_streak`: consecutive rows with a flag; `streak_summary`: longest, current and counted streaks from summaries only;
  * `asof_last`: the last value of another table at or before a row's time;
  * `machine_table`, `carried_states`: a finite state machine, whose segments are functions start state -> end state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import col

SEG = "_seg"


def segmented(df: DataFrame, ts: str, segment_s: float) -> DataFrame:
    """df with the number of the time bucket of `segment_s` seconds that holds each row."""
    return df.withColumn(SEG, F.floor(F.unix_micros(col(ts)) / F.lit(int(segment_s * 1_000_000))).cast("long"))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = a[SEG] == b[SEG]
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], *cols: str) -> DataFrame:
    return rows.join(carry, _same(rows, carry, keys), "left").select(*[rows[c] for c in rows.columns], *[carry[c] for c in cols])


# --------------------------------------------------------------------------- rolling rows
def with_carried_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, cols: Sequence[str]) -> DataFrame:
    """Rows of `segmented` with each segment's n preceding rows of its key added, marked by `_halo`.

    The added rows hold the key, the order columns and `cols`. A window of up to n preceding rows over (key, segment) is then exact;
    drop the added rows after it.
    """
    fields = [*order, *[c for c in cols if c not in order]]
    back = Window.partitionBy(*keys, SEG).orderBy(*[F.desc(o) for o in order])
    tails = (rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
             .groupBy(*keys, SEG).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_tail")))
    # Each segment has a row at least, so the n segments before one hold its n preceding rows.
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(-n, -1)
    none = F.array_repeat(F.lit(None).cast(tails.schema["_tail"].dataType.elementType), n)
    carried = tails.select(*keys, SEG, F.flatten(F.collect_list("_tail").over(before)).alias("_rows"))
    carried = carried.select(*keys, SEG, F.explode(F.slice(F.concat(none, "_rows"), -n, n)).alias("_row"))
    halo = carried.where("_row is not null").select(*keys, SEG, *[F.col(f"_row.{c}").alias(c) for c in fields], F.lit(True).alias("_halo"))
    return rows.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)


# --------------------------------------------------------------------------- streaks
def _islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    w = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_isle", F.sum(1 - F.col(flag)).over(w))


def _runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, more: dict[str, Column]) -> DataFrame:
    """One row a segment: rows `_len`, leading run `_lead`, trailing run `_trail`, and `more` aggregates over its runs
    (columns `_isle`, `_run`), with `_carry`: the run that reaches the segment's first row from before."""
    isles = _islands(rows, keys, order, flag).groupBy(*keys, SEG, "_isle").agg(F.sum(flag).alias("_run"), F.count(F.lit(1)).alias("_n"))
    seg = isles.groupBy(*keys, SEG).agg(
        F.sum("_n").alias("_len"), F.coalesce(F.max(F.when(F.col("_isle") == 0, F.col("_run"))), F.lit(0)).alias("_lead"),
        F.max_by("_run", "_isle").alias("_trail"), (F.max("_isle") == 0).alias("_whole"), *[c.alias(k) for k, c in more.items()])
    w = Window.partitionBy(*keys).orderBy(SEG)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # Rows up to a segment's end, and, at the last segment with a break, its trailing run less those rows.
    seg = (seg.withColumn("_upto", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_since", F.last(F.when(~F.col("_whole"), F.col("_trail") - F.col("_upto")), ignorenulls=True).over(before)))
    return seg.withColumn("_carry", F.coalesce("_since", F.lit(0)) + F.col("_upto") - F.col("_len"))


def with_streak(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, out: str) -> DataFrame:
    """Length of the run of flagged rows (flag 1) that ends at each row of `segmented`; 0 where the flag is 0."""
    carry = _runs(rows, keys, order, flag, {}).select(*keys, SEG, "_carry")
    isles = _islands(rows, keys, order, flag)
    w = Window.partitionBy(*keys, SEG, "_isle").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = isles.withColumn(out, F.sum(flag).over(w))
    met = _join_carry(local, carry, keys, "_carry")
    return met.withColumn(out, F.col(out) + F.when(F.col("_isle") == 0, F.col("_carry")).otherwise(0)).drop("_isle", "_carry")


def streak_summary(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, n: int) -> DataFrame:
    """Per key: `max_streak`, `current_streak` (at the last row) and `long_rows` (rows whose streak is n or more)."""
    beyond = lambda c: F.greatest(c - (n - 1), F.lit(0))
    inner = F.col("_isle") > 0
    seg = _runs(rows, keys, order, flag, {"_best": F.max(F.when(inner, F.col("_run"))), "_beyond": F.sum(F.when(inner, beyond(F.col("_run"))))})
    lead = F.col("_carry") + F.col("_lead")
    here = F.when(F.col("_whole"), lead).otherwise(F.col("_trail"))
    return seg.groupBy(*keys).agg(
        F.max(F.greatest(lead, F.coalesce("_best", F.lit(0)))).alias("max_streak"), F.max_by(here, SEG).alias("current_streak"),
        F.sum(F.coalesce("_beyond", F.lit(0)) + beyond(lead) - beyond(F.col("_carry"))).alias("long_rows"))


def with_run_start(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The time (order[0]) at which the run of equal `value` began that holds each row of `segmented`."""
    w = Window.partitionBy(*keys, SEG).orderBy(*order)
    halo = with_carried_rows(rows, keys, order, 1, [value])
    before = F.lag(F.struct(F.col(value).alias("v"))).over(w)
    begun = halo.withColumn("_prev", before).withColumn(out, F.when(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(value)), F.col(order[0])))
    own = begun.filter(~F.col("_halo")).drop("_halo", "_prev")
    ends = own.groupBy(*keys, SEG).agg(F.max(out).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, SEG, F.max("_end").over(earlier).alias("_carry"))
    met = _join_carry(own.withColumn(out, F.max(out).over(w.rowsBetween(Window.unboundedPreceding, 0))), carry, keys, "_carry")
    return met.withColumn(out, F.coalesce(out, "_carry")).drop("_carry")


# --------------------------------------------------------------------------- as-of
def asof_last(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], cols: Sequence[str], segment_s: float) -> DataFrame:
    """`left` with, for each of `cols`, the last value that is not null of `right` rows of its key at or before its time.

    `right` has the keys, `ts`, `order` (which breaks ties of one time) and `cols`.
    """
    names = [f"_r_{c}" for c in cols]
    r = right.select(*keys, ts, F.lit(0).alias("_side"), F.struct(*order).alias("_tie"), *[F.col(c).alias(n) for c, n in zip(cols, names)])
    tie = r.schema["_tie"].dataType
    l = left.select(*keys, ts, F.lit(1).alias("_side"), F.lit(None).cast(tie).alias("_tie"), *[F.lit(None).cast(r.schema[n].dataType).alias(n) for n in names],
                    F.struct(*left.columns).alias("_row"))
    rows = segmented(r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)).unionByName(l), ts, segment_s)
    at = F.struct(F.col(ts), F.col("_tie"))
    ends = rows.groupBy(*keys, SEG).agg(*[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), at)).alias(n) for n in names])
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, SEG, *[F.last(n, ignorenulls=True).over(before).alias(f"_c{n}") for n in names])
    upto = Window.partitionBy(*keys, SEG).orderBy(ts, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.select(*keys, SEG, "_side", "_row", *[F.last(n, ignorenulls=True).over(upto).alias(n) for n in names]).where("_side = 1")
    met = _join_carry(here, carry, keys, *[f"_c{n}" for n in names])
    return met.select("_row.*", *[F.coalesce(n, f"_c{n}").alias(c) for n, c in zip(names, cols)])


# --------------------------------------------------------------------------- state machines
def machine_table(states: Sequence, inputs: Sequence, step: Callable) -> Column:
    """step(state, input) as an array by input of arrays by state: numbers of the next states."""
    number = {s: i for i, s in enumerate(states)}
    return F.array(*[F.array(*[F.lit(number[step(s, x)]) for s in states]) for x in inputs])


def carried_states(rows: DataFrame, keys: Sequence[str], order: str, symbol: str, table: Column, n_states: int, start: int) -> DataFrame:
    """(keys, _seg, _state): the number of the machine's state before each segment's first row.

    `symbol` is the input's number. A segment's rows compose to one array start state -> end state; a key's arrays, one a segment,
    are applied in order.
    """
    same = F.array(*[F.lit(i) for i in range(n_states)])
    points = rows.groupBy(*keys, SEG).agg(F.sort_array(F.collect_list(F.struct(order, symbol))).alias("_pts"))

    def compose(acc, p):
        return F.transform(F.array(F.get(table, p[symbol])), lambda t: F.transform(acc, lambda s: F.get(t, s)))[0]

    ends = points.select(*keys, SEG, F.aggregate("_pts", same, compose).alias("_map"))
    by_key = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(SEG, "_map"))).alias("_segs"))
    first = F.struct(F.lit(start).alias("state"), F.array().cast(f"array<struct<{SEG}:bigint,_state:int>>").alias("out"))

    def apply(acc, s):
        return F.struct(F.get(s["_map"], acc["state"]).alias("state"),
                        F.concat(acc["out"], F.array(F.struct(s[SEG].alias(SEG), acc["state"].alias("_state")))).alias("out"))

    return by_key.select(*keys, F.inline(F.aggregate("_segs", first, apply)["out"]))
