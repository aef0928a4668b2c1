"""Exact percentiles by distributed selection.

`F.percentile` holds a histogram of a group's values in one task. Here a mergeable quantile sketch of fixed size brackets each
wanted rank by two values of the group (an equi-depth histogram of its range), and only the values inside the bracket, some
`4 * margin / accuracy` of the group, are counted in order; those below are one number. Values are counted by
(key, value) first, so ties cost nothing and a group of all rows is spread over its values. If a rank should lie
outside its bracket, the job fails instead of giving a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: Sequence[str] | None = None,
                      accuracy: int = 10_000, margin: int = 4, approx: bool = False) -> DataFrame:
    """(keys, one column for each of `probs`): linear interpolation between the two ranks around p * (n - 1), as `percentile` gives.

    Null values are left out; a group of nulls alone has no row. `approx=True` returns the sketch's values at once.
    """
    names = list(out) if out else [f"p{round(p * 100)}" for p in probs]
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if approx:
        q = F.percentile_approx("_v", [float(p) for p in probs], accuracy)
        return vals.groupBy(*keys).agg(q.alias("_q")).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    ends = [(p - margin / accuracy, p + margin / accuracy) for p in probs]
    ask = [min(1.0, max(0.0, e)) for pair in ends for e in pair]
    stats = vals.groupBy(*keys).agg(F.percentile_approx("_v", ask, accuracy).alias("_q"), F.count(F.lit(1)).alias("_n"))
    # A group so small that a bracket would hold less than two ranks is taken whole: some 2 * accuracy / margin values.
    small = F.col("_n") * margin < 2 * accuracy
    low, high = F.lit(float("-inf")), F.lit(float("nan"))  # NaN is the greatest double
    parts = []
    for i, p in enumerate(probs):
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
                              (low if ends[i][0] <= 0 else F.when(small, low).otherwise(F.col("_q")[2 * i])).alias("lo"),
                              (high if ends[i][1] >= 1 else F.when(small, high).otherwise(F.col("_q")[2 * i + 1])).alias("hi")))
    asked = stats.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], "_n", F.array(*parts).alias("_ask"))
    asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_salt0", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    on = F.col("_salt0") == F.col("_salt")
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    met = counted.join(asked, on).select(*keys, "_n", "_v", "_c", F.explode("_ask").alias("a")).where(F.col("_v") <= F.col("a.hi"))
    at = (F.col("_n") - 1) * F.col("a.p")
    bins = met.groupBy(*keys, "_n", at.alias("_at"), F.col("a.i").alias("_i"), F.when(F.col("_v") >= F.col("a.lo"), F.col("_v")).alias("_v")).agg(F.sum("_c").alias("_c"))
    upto = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("_upto", F.sum("_c").over(upto))

    def holds(rank):
        return F.max(F.when(F.col("_v").isNotNull() & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v")))

    picked = ranked.groupBy(*keys, "_i", "_at").agg(holds(F.floor("_at")).alias("_a"), holds(F.ceil("_at")).alias("_b"))
    share = F.col("_at") - F.floor("_at")
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b"))
    sure = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket: raise margin")).cast("double")).otherwise(exact)
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, sure)).alias(n) for i, n in enumerate(names)])


def with_percentiles(groups: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, named: dict[str, float], **options) -> DataFrame:
    """`groups` (one row for each of `keys`) with exact percentiles of `value` over the rows of the group; null where it has none."""
    ps = exact_percentiles(rows, keys, value, list(named.values()), list(named), **options)
    ps = ps.select(*[F.col(k).alias(f"_p{j}") for j, k in enumerate(keys)], *named)
    on = F.lit(True)
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_p{j}"))
    return groups.join(ps, on, "left").drop(*[f"_p{j}" for j in range(len(keys))])
