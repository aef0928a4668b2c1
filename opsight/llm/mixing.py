"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with n_s of the corpus' tokens has the natural share p_s = n_s / sum(n). Weights are p_s^a, normalised; the exponent a in
0..1 is narrowed until the mix meets its target: the least a at which no source is read more than `max_repeats`
times, or the greatest a whose entropy reaches `target_entropy`. A token budget then gives source s
floor(w_s * budget) tokens: whole passes over the source, each in a permutation of its own (the order of a hash
of seed, pass and document), and a last pass that stops where the running sum of tokens reaches the
rest of the source's budget. Each pass is dealt into blocks of equal share, so that every block of the mix holds the sources
in their weights.

All steps are DataFrame operations. The running sum of the last pass is taken in two levels: token sums of 4096 hash
ranges for each source, and a window inside the one range where the budget ends, so a hot source is never
sorted in one task. What is drawn is known from one hash threshold for each source: rows needn't be shuffled.

Tokens are words (runs of other characters than blank, tab, LF, VT, FF, CR). Edge cases: a null source is a source; null and
empty texts have no tokens and are drawn with their source's passes; sources without tokens have weight 0 and are not drawn;
rows equal in id and text share a place and are drawn together; an empty table gives an empty
mix; input columns named like output columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialise

SEED = 42
BITS, RANGE_BITS = 60, 12
GRID, ROUNDS, DIGITS = 64, 6, 9
OUT = ["epoch", "mix_block", "mix_key"]


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


def mix_key(epoch: Column, doc: Column, seed: int) -> Column:
    """60-bit hash that orders pass `epoch`; `doc` identifies the document."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), doc).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def doc_key(id_col: str, text_col: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))


def solve_exponent(totals: DataFrame, budget: float, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent for (source, n) totals: a range of 0..1 is cut into 64 parts again and again, each round one aggregation over
    all sources that returns 65 rows. It is rounded to 9 digits to the side that meets the target."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    total = totals.agg(F.sum("n")).first()[0]
    if not total:
        return 1.0
    p = totals.select((F.col("n") / F.lit(float(total))).alias("p"))

    def met(low: float, high: float) -> list[tuple[float, bool]]:
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        grid = p.select("p", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(points)])).alias("g"))
        sums = grid.groupBy("g.i").agg(F.sum(F.pow("p", "g.a")).alias("z"), F.sum(F.pow("p", "g.a") * F.col("g.a") * F.log("p")).alias("e"),
                                       F.max(F.pow("p", F.col("g.a") - 1)).alias("m")).collect()
        out = []
        for r in sorted(sums, key=lambda r: r["i"]):
            entropy = math.log(r["z"]) - r["e"] / r["z"]
            ok = r["m"] / r["z"] * budget / total <= max_repeats * (1 + 1e-12) if max_repeats is not None else entropy >= target_entropy - 1e-12
            out.append((points[r["i"]], ok))
        return out

    rising = max_repeats is not None  # met from some exponent on; the entropy target is met up to some exponent
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = met(low, high)
        if not points[-1 if rising else 0][1]:
            raise ValueError("no exponent in 0..1 meets the target")
        if points[0 if rising else -1][1]:
            return points[0 if rising else -1][0]
        i = next(i for i, (_, ok) in enumerate(points) if ok == rising)
        low, high = points[i - 1][0], points[i][0]
    scale = 10 ** DIGITS
    return math.ceil(high * scale - 1e-4) / scale if rising else math.floor(low * scale + 1e-4) / scale


def mixing_plan(df: DataFrame, budget_share: float = 1.0, max_repeats: float | None = None, target_entropy: float | None = None,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(source, n, weight, budget, passes, rest, cut): whole passes and the hash where the last pass stops, for each source."""
    rows = materialise(df.select(F.col(f"`{source_col}`").cast("string").alias("source"), n_tokens(F.col(f"`{text_col}`")).alias("tokens"),
                                 doc_key(id_col, text_col).alias("doc")), "mix-rows")
    totals = materialise(rows.groupBy("source").agg(F.sum("tokens").alias("n")).where("n > 0"), "mix-totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    a = solve_exponent(totals, budget_share * total, max_repeats, target_entropy)
    share = F.col("n") / F.lit(float(total or 1))
    z = totals.agg(F.sum(F.pow(share, F.lit(a))).alias("z")).first()["z"] or 1.0
    plan = (totals.withColumn("weight", F.pow(share, F.lit(a)) / F.lit(z))
            .withColumn("budget", F.floor(F.col("weight") * F.lit(budget_share * total)).cast("long"))
            .withColumn("passes", F.floor(F.col("budget") / F.col("n")).cast("long"))
            .withColumn("rest", F.col("budget") - F.col("passes") * F.col("n")))
    plan = materialise(plan, "mix-plan")

    last = plan.where("rest > 0").select(F.col("source").alias("s"), "passes", "rest")
    keyed = (rows.join(last, rows["source"].eqNullSafe(last["s"])).withColumn("key", mix_key(F.col("passes"), F.col("doc"), seed))
             .withColumn("range", F.shiftright("key", BITS - RANGE_BITS)).select("source", "rest", "tokens", "key", "range"))
    sums = keyed.groupBy("source", "rest", "range").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    edge = (sums.withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0)))
            .where("start < rest and start + t >= rest").select(F.col("source").alias("s"), F.col("range").alias("r"), "start"))
    inside = keyed.join(edge, keyed["source"].eqNullSafe(edge["s"]) & (keyed["range"] == edge["r"]))
    inside = inside.groupBy("source", "range", "rest", "start", "key").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    cuts = placed.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("at") >= F.col("rest"), F.col("key"))),
                                                   F.shiftleft(F.max("range") + 1, BITS - RANGE_BITS)).alias("cut")).withColumnRenamed("source", "s")
    out = plan.join(cuts, plan["source"].eqNullSafe(cuts["s"]), "left").drop("s").withColumn("cut", F.coalesce("cut", F.lit(0)).cast("long"))
    return materialise(out, "mix-cuts")


def mix_sources(df: DataFrame, budget_share: float = 1.0, max_repeats: float | None = None, target_entropy: float | None = None,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", blocks: int = 64, seed: int = SEED) -> DataFrame:
    """The drawn rows of df (once for each pass that draws them) with epoch, mix_block (0..blocks-1) and mix_key.

    Reading the mix means reading block after block, each in the order of mix_key.
    """
    cols = [c for c in df.columns if c not in OUT]
    plan = mixing_plan(df, budget_share, max_repeats, target_entropy, id_col, source_col, text_col, seed)
    plan_, doc_ = free_names([*cols, *OUT], "plan", "doc")
    terms = plan.where("budget > 0").select(F.struct(F.col("source"), "passes", "cut").alias(plan_))
    rows = df.select(*[F.col(f"`{c}`") for c in cols], doc_key(id_col, text_col).alias(doc_))
    met = rows.join(terms, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(f"{plan_}.source")))
    passed = met.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col(f"{plan_}.passes").cast("int"))))
    keyed = passed.withColumn("mix_key", mix_key(F.col("epoch"), F.col(doc_), seed))
    drawn = keyed.where((F.col("epoch") < F.col(f"{plan_}.passes")) | (F.col("mix_key") < F.col(f"{plan_}.cut")))
    unit = float(1 << BITS)
    at = (F.col("epoch") + F.col("mix_key") / F.lit(unit)) / (F.col(f"{plan_}.passes") + F.col(f"{plan_}.cut") / F.lit(unit))
    return drawn.select(*[F.col(f"`{c}`") for c in cols], "epoch", F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("int").alias("mix_block"), "mix_key")


def mix_sql(budget_share: float, max_repeats: float, blocks: int = 64, seed: int = SEED) -> str:
    """DuckDB statement for mix_sources(documents, ..., max_repeats): doc_id, source, tokens, epoch, mix_block, mix_key."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS tokens,
         concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS doc
  FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS n FROM d GROUP BY source HAVING sum(tokens) > 0),
t AS (SELECT sum(n)::DOUBLE AS total, list(n::DOUBLE) AS ns FROM s),
reps AS (SELECT total, list_transform(ns, lambda n: n / total) AS ps FROM t),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1))) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2)))
                 * {budget_share} <= {max_repeats} * (1 + 1e-12) AS ok
        FROM bisect, reps WHERE i < 45)),
e AS (SELECT ceil(hi * 1e9 - 1e-4) / 1e9 AS a FROM bisect WHERE i = 45),
w AS (SELECT source, n, total, pow(n / total, a) / sum(pow(n / total, a)) OVER () AS weight FROM s, reps, e),
b AS (SELECT source, n, floor(weight * ({budget_share} * total))::BIGINT AS budget FROM w),
plan AS (SELECT source, n, budget, budget // n AS passes, budget % n AS rest FROM b WHERE budget > 0),
keyed AS (
  SELECT d.*, passes, rest, epoch::INTEGER AS epoch,
         ('0x' || substr(md5(concat_ws('|', '{seed}', epoch::VARCHAR, doc)), 1, 15))::BIGINT AS mix_key
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source, unnest(range(0, passes + 1)) AS u(epoch)),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY mix_key RANGE UNBOUNDED PRECEDING) - sum(tokens) OVER (PARTITION BY source, epoch, mix_key) AS start
  FROM keyed),
ends AS (SELECT source, max(mix_key >> {BITS - RANGE_BITS}) AS r FROM placed WHERE epoch = passes AND start < rest GROUP BY source),
cuts AS (
  SELECT p.source, coalesce(min(CASE WHEN start >= rest AND mix_key >> {BITS - RANGE_BITS} = r THEN mix_key END), (any_value(r) + 1) << {BITS - RANGE_BITS}) AS cut
  FROM placed p JOIN ends ON p.source IS NOT DISTINCT FROM ends.source WHERE epoch = passes GROUP BY p.source)
SELECT doc_id, p.source, tokens::BIGINT AS tokens, epoch,
       least(floor((epoch + mix_key / {float(1 << BITS)!r}) / (passes + coalesce(cut, 0) / {float(1 << BITS)!r}) * {blocks}), {blocks - 1})::INTEGER AS mix_block, mix_key
FROM placed p LEFT JOIN cuts ON p.source IS NOT DISTINCT FROM cuts.source
WHERE epoch < passes OR (rest > 0 AND start < rest)
"""
