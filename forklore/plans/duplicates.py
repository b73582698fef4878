"""Duplicate pull requests as told by comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.functions.text import commit_sha_mention, is_duplicate_comment, referenced_numbers

PR = ["project_id", "pr_id"]


def duplicate_comments(comments: DataFrame) -> DataFrame:
    """The first comment of each pull request that sounds like a duplicate notice."""
    notices = comments.filter(is_duplicate_comment(F.lower("body")))
    best = notices.groupBy(*PR).agg(
        F.min_by(F.struct("comment_pos", "commenter_id", "body"), "comment_pos").alias("c")
    )
    return best.select(*PR, "c.comment_pos", "c.commenter_id", "c.body")


def duplicate_pairs(notices: DataFrame, prs: DataFrame) -> DataFrame:
    """Unmerged pull requests with the numbers their duplicate notice names."""
    unmerged = prs.filter(~F.col("is_merged")).select(*PR)
    return (
        notices.join(unmerged, PR, "left_semi")
        .select(
            *PR, "commenter_id", F.explode(referenced_numbers(F.col("body"))).alias("dup_pr_id")
        )
        .filter(F.col("dup_pr_id").isNotNull())
    )


def duplicate_commits(notices: DataFrame, prs: DataFrame) -> DataFrame:
    """Unmerged pull requests with the commit hash their duplicate notice names."""
    unmerged = prs.filter(~F.col("is_merged")).select(*PR)
    return (
        notices.join(unmerged, PR, "left_semi")
        .select(*PR, commit_sha_mention(F.col("body")).alias("dup_sha"))
        .filter(F.col("dup_sha").isNotNull())
    )


def false_positive_duplicates(pairs: DataFrame, prs: DataFrame) -> DataFrame:
    """Pairs where the one who commented wrote the named pull request: own work, no duplicate."""
    authors = prs.select(
        "project_id", F.col("pr_id").alias("dup_pr_id"), F.col("author_id").alias("commenter_id")
    )
    return pairs.join(authors, ["project_id", "dup_pr_id", "commenter_id"], "left_semi").select(
        *PR, "dup_pr_id"
    )
