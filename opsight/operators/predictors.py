"""Predictors and recognition accuracy (IND-6.2, 9.1, 9.3) and the weighted indices with a status (IND-1.2, 5.3, 14.3).

Points, weights, targets and limits are fixed values of the indicator definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_if, ladder, pct, r4, since
from .indicators import status, weighted_index

# Points of the first-contact-resolution predictor.
KB_HIT, HOLD_LOW, HOLD_RATIO, RESOLVED = 20.0, 20.0, 0.15, 15.0
TRANSFER_POINTS = {"none": 25.0, "warm": 15.0, "cold": 0.0}
MAX_WITHOUT_WRAP, MAX_SCORE = 85.0, 100.0
# Points of the promoter predictor.
RESOLUTION_POINTS = {"resolved": 25.0, "partial": 15.0, "unresolved": 5.0}
SEVERITY_POINTS = {"billing": 5.0, "outage": 15.0, "fraud": 20.0, "minor": 2.0}


def _points(c: str, table: dict, default: float = 0.0) -> Column:
    return ladder([(F.col(c) == k, v) for k, v in table.items()], default)


def asr_accuracy(recognitions: DataFrame, as_of: Column, window_s: int, by: str = "menu") -> DataFrame:
    """IND-6.2: share of correct intents, and 100 - word error rate (substitutions, insertions, deletions per word).

    recognitions: (menu, ts, outcome, errors, words); outcome 'correct' is a correct intent.
    """
    g = recognitions.filter(since("ts", as_of, window_s)).groupBy(by).agg(
        F.count(F.lit(1)).alias("attempts"), count_if(F.col("outcome") == "correct").alias("correct"),
        count_if(F.col("outcome") == "rejection").alias("rejections"), F.sum("errors").alias("errors"), F.sum("words").alias("words"))
    acc = pct(F.col("correct"), F.col("attempts"))
    return g.select(by, "attempts", "correct", "rejections", r4(acc).alias("accuracy_pct"),
                    r4(F.lit(100.0) - pct(F.col("errors"), F.col("words"))).alias("word_accuracy_pct"), status(acc, 92.0, 88.0).alias("status"))


def fcr_score() -> Column:
    """IND-9.1: share of the points that can be reached so far; a call without a wrap code is scored out of 85."""
    low_hold = F.try_divide(F.col("hold_sec"), F.col("talk_sec")) < HOLD_RATIO
    got = (F.when(F.col("kb_hit"), KB_HIT).otherwise(0.0) + _points("transfer", TRANSFER_POINTS)
           + F.when(low_hold, HOLD_LOW).otherwise(0.0) + F.greatest(F.lit(0.0), F.least(F.lit(20.0), F.col("sentiment")))
           + F.when(F.col("wrap_code") == "resolved", RESOLVED).otherwise(0.0))
    return got * 100.0 / F.when(F.col("wrap_code").isNull(), MAX_WITHOUT_WRAP).otherwise(MAX_SCORE)


def fcr_predictor(interactions: DataFrame, as_of: Column, window_s: int, by: str = "queue") -> DataFrame:
    """Mean first-contact-resolution score of the interactions of a queue."""
    g = (interactions.filter(since("ts", as_of, window_s)).withColumn("score", fcr_score()).groupBy(by)
         .agg(F.avg("score").alias("s"), F.count(F.lit(1)).alias("interactions"), count_if(F.col("wrap_code").isNull()).alias("pending")))
    return g.select(by, "interactions", "pending", r4("s").alias("fcr_predictor"), status(r4("s"), 85.0, 70.0).alias("status"))


def nps_score() -> Column:
    """IND-9.3: sentiment (0-25) + resolution + effort (CES / 4) - issue severity."""
    return (F.greatest(F.lit(0.0), F.least(F.lit(25.0), F.col("sentiment"))) + _points("resolution", RESOLUTION_POINTS)
            + F.col("ces") / 4.0 - _points("issue", SEVERITY_POINTS))


def nps_predictor(interactions: DataFrame, as_of: Column, window_s: int, by: str = "queue") -> DataFrame:
    """Mean promoter score of a queue and its predicted promoters (70 and over), passives and detractors (below 50)."""
    g = (interactions.filter(since("ts", as_of, window_s)).withColumn("score", nps_score()).groupBy(by)
         .agg(F.avg("score").alias("s"), F.count(F.lit(1)).alias("interactions"), count_if(F.col("score") >= 70).alias("promoters"),
              count_if((F.col("score") >= 50) & (F.col("score") < 70)).alias("passives"), count_if(F.col("score") < 50).alias("detractors")))
    return g.select(by, "interactions", "promoters", "passives", "detractors", r4("s").alias("nps_predictor"), status(r4("s"), 65.0, 50.0).alias("status"))


def index_with_status(components: DataFrame, weights: dict, target: float, critical: float, keys) -> DataFrame:
    """Weighted index of component columns with its status, for each key."""
    scored = weighted_index(components, weights, "_s")
    return scored.select(*keys, r4("_s").alias("score"), status(r4("_s"), target, critical).alias("status"))
