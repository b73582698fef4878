"""Social ties between those who send and those who close pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.operators.joins import first_follow


def social_connection(prs: DataFrame, followers: DataFrame) -> DataFrame:
    """Flag per closed pull request: its author followed the closer before sending it."""
    ties = first_follow(followers).select(
        F.col("user_id").alias("closer_id"), F.col("follower_id").alias("author_id"), "followed_at"
    )
    tied = F.col("followed_at").isNotNull() & (F.col("created_at") > F.col("followed_at"))
    return (
        prs.filter(F.col("is_closed"))
        .join(ties, ["closer_id", "author_id"], "left")
        .select(
            "project_id",
            "pr_id",
            (tied & (F.col("closer_id") != F.col("author_id"))).alias("social_connection"),
        )
    )
