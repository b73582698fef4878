"""What forks contribute: own commits, combined with pull-request and fork facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.functions.dates import age_in_days
from forklore.operators.aggregates import category_counts
from forklore.operators.sets import claimed_once


def own_commits_once(classified: DataFrame, project: str = "parent_id") -> DataFrame:
    """``only_F`` and ``F2U`` commits that no other fork of the project claims too."""
    mine = classified.filter(F.col("category").isin("only_F", "F2U"))
    return claimed_once(mine, [project, "category", "sha"], "repo_id")


def contribution_table(classified: DataFrame, project: str = "parent_id") -> DataFrame:
    """Per fork: own commits after removing those claimed twice, and the upstream's counts."""
    keys = [project, "repo_id"]
    own = own_commits_once(classified, project).groupBy(*keys).agg(
        F.count_if(F.col("category") == "only_F").alias("only_F"),
        F.count_if(F.col("category") == "F2U").alias("F2U"),
    )
    commits = classified.select(*keys, "sha", "category").distinct()
    every = category_counts(commits, *keys).select(*keys, "only_U", "U2F")
    return every.join(own, keys, "left").select(
        *keys,
        F.coalesce("only_F", F.lit(0)).alias("only_F"),
        F.coalesce("F2U", F.lit(0)).alias("F2U"),
        "only_U",
        "U2F",
    )


def commits_to_ingest(own: DataFrame, files: DataFrame, below: int) -> DataFrame:
    """Own commits that change at least one and fewer than ``below`` files, with the number."""
    sizes = files.groupBy("sha").agg(F.count(F.lit(1)).alias("n_files"))
    return own.join(sizes.filter(F.col("n_files") < below), "sha")


def combined_table(
    contributions: DataFrame, repositories: DataFrame, pr_results: DataFrame, as_of
) -> DataFrame:
    """Fork contribution, fork facts with ages, and pull-request results, joined on the fork."""
    facts = repositories.select(
        "repo_id",
        "language",
        "stars",
        age_in_days(F.col("created_on"), as_of).alias("fork_age"),
        age_in_days(F.col("pushed_on"), as_of).alias("last_commit_age"),
    )
    return contributions.join(facts, "repo_id", "left").join(pr_results, "repo_id", "left")
