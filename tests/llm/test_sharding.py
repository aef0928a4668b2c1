import zlib
from collections import Counter

from pyspark.sql import functions as F

from opsight.llm import queries as Q
from opsight.llm.sharding import feistel_shards, permute

SF = "/root/testdata/sf0.001"


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 24, 1000, 4097):
        df = spark.range(n).select(permute(F.col("id"), F.lit(n).cast("long"), 42).alias("y"))
        assert sorted(r.y for r in df.collect()) == list(range(n))


def test_query_holds_the_rows_law(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = Q.QUERIES["op1_feistel_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_same_rows_same_places(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    one = {tuple(r) for r in feistel_shards(df, 5).collect()}
    assert one == {tuple(r) for r in feistel_shards(df.repartition(13).orderBy(F.desc("doc_id")), 5).collect()}
    assert one != {tuple(r) for r in feistel_shards(df, 5, seed=1).collect()}


def test_edge_rows(spark):
    schema = "doc_id long, text string, shard string, `Slot` string"
    hot = [(None, None, "x", None)] * 300
    rows = hot + [(1, "", "a", "b"), (1, "", "a", "b"), (2, "x" * 100_000, None, None)]
    out = feistel_shards(spark.createDataFrame(rows, schema).drop("Slot"), 4, hot_rows=50, chunk=40)
    got = out.collect()
    assert sorted(r.row_number for r in got) == list(range(303)) == sorted(r.permuted for r in got)
    assert Counter(r.doc_id for r in got) == {None: 300, 1: 2, 2: 1}
    again = feistel_shards(spark.createDataFrame(rows[::-1], schema).drop("Slot").repartition(5), 4, hot_rows=50, chunk=40)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert feistel_shards(spark.createDataFrame([], schema), 4).collect() == []


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(i, 7, 8, 9, 10, 11) for i in range(50)], "doc_id long, n_rows int, __h int, __b int, __n int, shard int")
    got = feistel_shards(df, 3).collect()
    assert {(r["n_rows"], r["__h"], r["__b"], r["__n"]) for r in got} == {(7, 8, 9, 10)} and {r["shard"] for r in got} == {0, 1, 2}
