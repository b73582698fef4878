"""Signs that a fork has become a project of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.functions.text import names_differ, same_description, url_repo, unordered_pair_key
from forklore.operators.joins import absent, forks_with_upstream
from forklore.sources.sinks import least_per_key


def renamed_forks(pairs: DataFrame, threshold: int = 2) -> DataFrame:
    """Forks whose repository name differs from the upstream's by more than the threshold."""
    return pairs.filter(
        names_differ(url_repo(F.col("fork_url")), url_repo(F.col("upstream_url")), threshold)
    )


def says_fork_of(description: Column) -> Column:
    return F.coalesce(F.lower(description).contains("fork of"), F.lit(False))


def unchecked_pairs(pairs: DataFrame, checked: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs, whichever way round, that were not looked at before; each once."""
    keyed = pairs.withColumn("pair_key", unordered_pair_key(F.col(a), F.col(b)))
    return absent(least_per_key(keyed, ["pair_key"]), checked, ["pair_key"])


def hard_forks_per_upstream(hard_forks: DataFrame) -> DataFrame:
    """Hard forks of each upstream, of ``hard_forks(repo_id, upstream_id)``, and whether there are several."""
    counts = hard_forks.groupBy("upstream_id").agg(F.count_distinct("repo_id").alias("n_hard_forks"))
    return counts.withColumn("has_many", F.col("n_hard_forks") > 1)


def hard_fork_signs(
    repositories: DataFrame, unmerged: DataFrame, contribution: DataFrame
) -> DataFrame:
    """All signs per fork.

    ``unmerged(repo_id, sha)`` are commits the upstream lacks, ``contribution(repo_id,
    external_prs, external_authors)``. A fork is inactive if nothing was pushed after
    it was made.
    """
    facts = repositories.select(
        "repo_id", "description", "created_on", "pushed_on", "stars"
    )
    parents = repositories.select(
        F.col("repo_id").alias("upstream_id"), F.col("description").alias("_upstream_description")
    )
    lacking = unmerged.groupBy("repo_id").agg(F.count_distinct("sha").alias("n_unmerged"))
    return (
        forks_with_upstream(repositories)
        .join(facts, "repo_id")
        .join(parents, "upstream_id")
        .join(lacking, "repo_id", "left")
        .join(contribution, "repo_id", "left")
        .select(
            "repo_id",
            "upstream_id",
            names_differ(url_repo(F.col("fork_url")), url_repo(F.col("upstream_url"))).alias(
                "is_renamed"
            ),
            says_fork_of(F.col("description")).alias("says_fork_of"),
            same_description(F.col("description"), F.col("_upstream_description")).alias(
                "same_description"
            ),
            F.coalesce("n_unmerged", F.lit(0)).alias("n_unmerged"),
            F.coalesce("external_prs", F.lit(0)).alias("external_prs"),
            F.coalesce("external_authors", F.lit(0)).alias("external_authors"),
            (F.col("pushed_on") <= F.col("created_on")).alias("is_inactive"),
        )
    )
