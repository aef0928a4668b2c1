"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..N-1 in a fixed order (a hash of its columns, then the columns),
the permutation maps the number to another one, and that number alone gives the shard (modulo)
and the slot in it (quotient). Nothing is drawn at run time: the same rows, shard count and seed
give the same placement on any cluster, and `place` computes it for a single number.

Edge cases: null columns are ordinary values of the order; rows equal in all columns are interchangeable and
get consecutive numbers; an empty table gives an empty result; an input column named
like an output column (row_number, permuted, shard, slot) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
WALK = 64
OUT = ["row_number", "permuted", "shard", "slot"]


def permute(x: Column, n: Column, seed: int) -> Column:
    """Image of x (0 <= x < n) under a seeded permutation of 0..n-1.

    An alternating Feistel network on the grid a x b, a = ceil(sqrt(n)), b = ceil(n / a): the grid
    holds fewer than a points beyond n, so a walk (apply again while outside) leaves it after one step for
    all but about 1/sqrt(n) of the rows. A walk visits each outside point once at most, so WALK steps
    are enough below n = 4096; above, the chance that any row needs more is under n**-31, and
    then the query fails instead of returning a wrong number.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(v: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            left, right = acc["l"], acc["r"]
            even = i % 2 == 0
            moved = F.pmod(F.xxhash64(F.lit(seed), i, F.when(even, right).otherwise(left)), F.when(even, a).otherwise(b))
            return F.struct(F.when(even, (left + moved) % a).otherwise(left).alias("l"),
                            F.when(even, right).otherwise((right + moved) % b).alias("r"))

        start = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda acc: acc["l"] * b + acc["r"])

    first = step(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))
    y = F.when(first < n, first).otherwise(walked)
    return F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk too long: choose another seed")).cast("long"))


def place(x: Column, n: Column, n_shards: int, seed: int) -> Column:
    """Struct (permuted, shard, slot) of the row number x of n rows."""
    y = permute(x, n, seed)
    return F.struct(y.alias("permuted"), (y % n_shards).cast("int").alias("shard"), F.floor(y / n_shards).cast("long").alias("slot"))


def number_rows(df: DataFrame, buckets: int = 4096, hot_rows: int = 1_000_000, chunk: int = 100_000) -> DataFrame:
    """df with `row_number` (0..N-1) and `n_rows`, without a global sort or a single task.

    Rows fall into `buckets` by a hash of all their columns; a prefix sum over the bucket counts
    (a table of `buckets` rows) gives each bucket's first number, a window the rest. Rows equal in all columns
    that occur more than `hot_rows` times are counted instead of sorted and unfolded again in chunks.
    """
    cols = df.columns
    base = df.withColumn("__h", F.xxhash64(*cols)).withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int"))
    full = base.groupBy("__b").count().where(F.col("count") > hot_rows).select("__b")
    hot = (base.select("__b", "__h").join(F.broadcast(full), "__b", "left_semi")  # at most `buckets` rows
           .groupBy("__h").count().where(F.col("count") > hot_rows).select("__h"))  # at most N / hot_rows rows
    usual = base.join(F.broadcast(hot), "__h", "left_anti")
    heavy = base.join(F.broadcast(hot), "__h", "left_semi").groupBy("__b", "__h", *cols).agg(F.count("*").alias("__n"))

    units = usual.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.lit(0).alias("__u"), "__n")
    order = Window.partitionBy("__b").orderBy("__h", *cols)
    heavy = heavy.withColumn("__u", F.row_number().over(order))
    units = units.unionByName(heavy.select("__b", "__u", "__n"))
    before = Window.orderBy("__b", "__u").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__b", "__u").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = units.select("__b", "__u", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"), F.sum("__n").over(every).alias("n_rows"))
    starts = F.broadcast(starts)  # at most buckets + N / hot_rows rows

    plain = (usual.join(starts.where("__u = 0").drop("__u"), "__b")
             .withColumn("row_number", F.col("__s") + F.row_number().over(order) - 1))
    unfolded = (heavy.join(starts, ["__b", "__u"])
                .withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))))
                .repartition("__h", "__c")
                .withColumn("__i", F.explode(F.sequence(F.col("__c") * chunk, F.least(F.col("__c") * chunk + chunk, F.col("__n")) - 1)))
                .withColumn("row_number", F.col("__s") + F.col("__i")))
    keep = [F.col(f"`{c}`") for c in cols] + [F.col("row_number"), F.col("n_rows")]
    return plain.select(*keep).unionByName(unfolded.select(*keep))


def feistel_shards(df: DataFrame, n_shards: int, seed: int = 42, **numbering) -> DataFrame:
    """df with row_number, permuted, shard (int, 0..n_shards-1) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most. `numbering`: parameters of number_rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    df = df.drop(*OUT)
    cols = df.columns
    own = [f"c{i}" for i in range(len(cols))]  # names of our own, so that the rows may use any
    numbered = number_rows(df.toDF(*own), **numbering)
    placed = numbered.withColumn("__p", place(F.col("row_number"), F.col("n_rows"), n_shards, seed))
    return placed.select(*[F.col(o).alias(c) for o, c in zip(own, cols)], "row_number", "__p.permuted", "__p.shard", "__p.slot")
