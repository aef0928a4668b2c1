"""Documents to training tokens in five stages, each one operator of opsight.llm.

Every stage works on all that its predecessor kept, which is written as Parquet in the shared folder and read again.
Toxic documents go; lines that a source repeats on many of its documents go from the texts; of documents
within two bits of each other's fingerprint (and of exact copies) one stays; the sources are mixed by temperature without reading
any document twice; the texts are encoded and decoded again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm import bpe, linededup, mixing, simhash, toxicity
from opsight.llm.common import materialise, ship_code, table

BUDGET_SHARE, MAX_REPEATS = 0.8, 1.0
# Share of a source's documents beyond which a line goes, by its words. On sf0.1 lines of one to four words repeat by chance on up
# to 4.8 % of a source; copied lines of 5 to 50 words are on 0.6 to 13 %, of over 50 words on 0.6 to 0.8 %. Pairs are left to the near copies.
LINE_RATIOS, LINE_DOCS = {1: 0.05, 5: 0.005, 51: 0.001}, 3
RANKS = "byte_bpe_multi_50k.tiktoken"
ORACLE_SQL = None  # scores of a trained model and fingerprints have no SQL form; tests use brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    ship_code(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over LINE_RATIOS of a source's documents (and LINE_DOCS at least) go; every document stays."""
    ship_code(spark)
    clean = linededup.drop_boilerplate(docs, "source", "text", LINE_RATIOS, LINE_DOCS)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints that link at two bits or fewer the document of the smallest id stays."""
    ship_code(spark)
    return simhash.simhash_dedup(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """0.8 of the tokens, in source weights as even as they get without reading a source more than once."""
    ship_code(spark)
    return mixing.mix_sources(docs, budget_share=BUDGET_SHARE, max_repeats=MAX_REPEATS).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the digests of ids and decoded bytes."""
    ship_code(spark)
    path = public_tokenizers.path(RANKS)
    ids = bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    both = bpe.bpe_decode(ids, path)
    return both.select("doc_id", "lang", "source", "ids", *bpe.digests(both))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
