"""Project-level roll-ups and the table that joins them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.operators.aggregates import ratio
from forklore.operators.groups import grouped_medians


def issue_before_pr(links: DataFrame, prs: DataFrame) -> DataFrame:
    """Share of linked pull requests with an issue that is older than they are."""
    rows = links.join(prs.select("project_id", "pr_id", "created_at"), ["project_id", "pr_id"])
    per_pr = rows.groupBy("project_id", "pr_id").agg(
        F.bool_or(F.col("issue_created_on") < F.to_date("created_at")).alias("issue_first")
    )
    n_first, n = F.count_if("issue_first"), F.count(F.lit(1))
    return per_pr.groupBy("project_id").agg(
        n.alias("n_linked"), n_first.alias("n_issue_first"), ratio(n_first, n).alias("ratio")
    )


def social_ratio(flags: DataFrame) -> DataFrame:
    tied, n = F.count_if("social_connection"), F.count(F.lit(1))
    return flags.groupBy("project_id").agg(ratio(tied, n).alias("social_ratio"))


def merge_experience(prs: DataFrame) -> DataFrame:
    """Median number of earlier merged pull requests of an author, over their projects.

    The number per author comes from a plain count, its median from the per-author rows.
    """
    per_author = prs.groupBy("project_id", "author_id").agg(
        F.count_if("is_merged").alias("n_merged")
    )
    return grouped_medians(per_author, ["project_id"], {"median_merge_experience": "n_merged"})


def mean_hotness(hot: DataFrame, value: str = "n_hot_commits") -> DataFrame:
    return hot.groupBy("project_id").agg(F.round(F.avg(value), 6).alias("mean_hotness"))


def active_fork_counts(repositories: DataFrame) -> DataFrame:
    """Active forks per upstream, first-level forks, and their share of all forks below it."""
    forks = repositories.filter(F.col("is_fork"))
    active = F.count_if(F.col("created_on") < F.col("pushed_on"))
    n = F.count(F.lit(1))
    return forks.groupBy("parent_id").agg(
        n.alias("n_forks"), active.alias("n_active"), ratio(active, n).alias("active_share")
    )


def first_level_share(tree: DataFrame) -> DataFrame:
    """Share of direct forks among all forks below a root, from the fork tree."""
    direct, n = F.count_if(F.col("level") == 1), F.count(F.lit(1))
    return tree.groupBy("root_id").agg(
        direct.alias("n_first_level"), n.alias("n_all"), ratio(direct, n).alias("share")
    )


def join_metrics(base: DataFrame, metrics: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Left-join metric tables that share the keys; each has one row per key."""
    return reduce(lambda a, b: a.join(b, keys, "left"), metrics, base)
