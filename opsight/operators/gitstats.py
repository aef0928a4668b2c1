"""Repository contribution statistics (GIT-1..4) over a commit-numstat table.

numstat: (repo, branch, commit, author, committed_at, path, added string, deleted string);
'-' in added/deleted marks a binary file, which is left out of line counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = r"^\d+$"


def _period(numstat: DataFrame, since=None, until=None) -> DataFrame:
    d = numstat
    if since is not None:
        d = d.filter(F.col("committed_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        d = d.filter(F.col("committed_at") <= F.lit(until).cast("timestamp"))
    return d


def _numeric(d: DataFrame) -> DataFrame:
    return d.filter(F.col("added").rlike(NUMERIC) & F.col("deleted").rlike(NUMERIC)) \
        .withColumn("added_n", F.col("added").cast("long")).withColumn("deleted_n", F.col("deleted").cast("long"))


def contributions(numstat: DataFrame, since=None, until=None) -> DataFrame:
    """GIT-1: added / deleted / net lines and commits per repo, branch and author in the period."""
    d = _numeric(_period(numstat, since, until))
    return d.groupBy("repo", "branch", "author").agg(
        F.sum("added_n").alias("lines_added"), F.sum("deleted_n").alias("lines_deleted"),
        (F.sum("added_n") - F.sum("deleted_n")).alias("net_lines"),
        F.countDistinct("commit").alias("commits"))


def active_branches(numstat: DataFrame, since=None, until=None) -> DataFrame:
    """GIT-2: branches with at least one commit in the period."""
    return _period(numstat, since, until).select("repo", "branch").distinct()


def lines_per_branch(numstat: DataFrame) -> DataFrame:
    """GIT-3: current lines per branch from a (repo, branch, path, lines) snapshot.

    The snapshot is the net of all numeric changes per file; files at or below zero
    lines are treated as deleted.
    """
    d = _numeric(numstat)
    files = d.groupBy("repo", "branch", "path").agg((F.sum("added_n") - F.sum("deleted_n")).alias("lines"))
    live = files.filter(F.col("lines") > 0)
    return live.groupBy("repo", "branch").agg(F.sum("lines").alias("total_lines"), F.count(F.lit(1)).alias("files"))


def author_branches(numstat: DataFrame, since=None, until=None) -> DataFrame:
    """GIT-4: each author with the ';'-joined sorted list of branches they committed to."""
    d = _period(numstat, since, until)
    return d.groupBy("author").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "repo", "branch"))), ";").alias("branches"),
        F.countDistinct("repo", "branch").alias("branch_count"))
