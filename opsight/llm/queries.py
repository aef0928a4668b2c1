"""The registered queries of the operators: thin forms that return each contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, linededup, mixing, redirects, warc
from .bitpack import read_token_files, write_token_files
from .bpe import bpe_decode, bpe_encode, digests
from .common import materialise, shared_path, ship_code, table
from .covertree import embedding_neighbours
from .runs import periodic_runs
from .sharding import feistel_shards
from .simhash import simhash_groups
from .topk import top_inner_products
from .toxicity import toxicity_scores

SHARDS = 24
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE, END_ID = "word_bpe_49k.json", 2
MIX = {"budget_share": 1.0, "max_repeats": 1.25}
PHRASES = {"max_words": 3, "least": 10, "inside": 50, "top": 2000}
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    placed = feistel_shards(materialise(docs, "op1-rows"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_embedding_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neighbours(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BPE_RANKS)
    ids = bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    both = bpe_decode(ids, ranks)
    return both.select("doc_id", *digests(both))


def op4_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_topk_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_inner_products(rows, rows.where("vec_id % 20 = 0"), k=20)


def op6_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), shared_path(spark, "ids"), public_tokenizers.path(WORD_BPE), END_ID)
    return read_token_files(files)


def op7_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), **MIX)
    return mix.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens"), "epoch", "mix_block", "mix_key")


def op9_toxicity_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])


def op10_line_dedup_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", linededup.url_host(F.col("url")).alias("host"), linededup.page_lines(F.col("html")).alias("text"))
    clean = linededup.drop_boilerplate(materialise(pages, "op10-pages"), "host", "text")
    return clean.select("page_id", "host", "n_lines", "dropped_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), **PHRASES)


def op12_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = redirects.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)
    return verdicts.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The words joined by a space; by the rule of the contract a tenth of the documents repeats from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), tail), F.lit(1), n), " ")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    return F.when(h % 10 == 0, made).otherwise(text)


def op13_scale_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs, ["doc_id"])
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[F.concat(r[c].cast("string"), F.lit("\n") if c == "period" else F.lit("")) for c in ("start", "length", "period")]))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.coalesce(F.sha2(F.col("collapsed").cast("binary"), 256), F.col("whole")).alias("collapsed_sha256"))


def _shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_feistel_sharding, op2_embedding_cover_tree, op3_bpe_merge_replay, op4_warc_capture_index, op5_topk_norm_sorted,
    op6_bit_packed_ids, op7_simhash_bk_tree, op8_temperature_mixing, op9_toxicity_factorization_machine, op10_line_dedup_by_host,
    op11_setm_collocations, op12_redirect_url_filter, op13_scale_tiled_runs)}
ORACLES: dict[str, str] = {"op8_temperature_mixing": mixing.mix_sql(**MIX), "op11_setm_collocations": collocations.collocations_sql(**PHRASES)}
