"""Joins. Sides are never hinted: their sizes are for statistics and AQE to judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commits_of_prs(commits: DataFrame, pr_commits: DataFrame, prs: DataFrame) -> DataFrame:
    """Commits of the given pull requests."""
    wanted = pr_commits.join(prs.select("project_id", "pr_id"), ["project_id", "pr_id"], "left_semi")
    return wanted.join(commits, "sha")


def pr_changed_files(
    prs: DataFrame, pr_commits: DataFrame, commits: DataFrame, files: DataFrame
) -> DataFrame:
    """Pull request, its commits and the files they change."""
    return (
        prs.select("project_id", "pr_id")
        .join(pr_commits, ["project_id", "pr_id"])
        .join(commits.select("sha"), "sha", "left_semi")
        .join(files, "sha")
    )


def files_of_prs(pr_commits: DataFrame, files: DataFrame) -> DataFrame:
    return pr_commits.join(files, "sha")


def pr_commits_with_files(pr_commits: DataFrame, files: DataFrame, kept=None) -> DataFrame:
    """All commits of pull requests; file columns are NULL for commits without kept files."""
    right = files if kept is None else files.filter(kept)
    return pr_commits.join(right, "sha", "left")


def existing(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(other.select(*keys).distinct(), list(keys), "left_semi")


def absent(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(other.select(*keys), list(keys), "left_anti")


def lookup(
    rows: DataFrame, dimension: DataFrame, on: dict[str, str], take: dict[str, str]
) -> DataFrame:
    """Attach attributes of a dimension: ``on`` and ``take`` map row names to dimension names."""
    side = dimension.select(
        *[F.col(d).alias(r) for r, d in on.items()], *[F.col(d).alias(r) for r, d in take.items()]
    )
    return rows.join(side, list(on), "left")


def forks_with_upstream(repositories: DataFrame) -> DataFrame:
    """``repo_id, fork_url, upstream_id, upstream_url`` of every fork whose parent is known."""
    upstream = repositories.select(
        F.col("repo_id").alias("upstream_id"), F.col("url").alias("upstream_url")
    )
    return (
        repositories.filter(F.col("parent_id").isNotNull())
        .select("repo_id", F.col("url").alias("fork_url"), F.col("parent_id").alias("upstream_id"))
        .join(upstream, "upstream_id")
    )


def fork_pull_requests(
    pairs: DataFrame, prs: DataFrame, history: DataFrame
) -> DataFrame:
    """History of the pull requests from each fork to its own upstream, one left row per request without history.

    ``pairs(repo_id, upstream_id, ...)``, ``prs(pr_id, head_repo_id, base_repo_id)``, ``history(pr_id, ...)``. A
    request of the fork to any other repository is none of the pair's.
    """
    named = prs.select(
        "pr_id", F.col("head_repo_id").alias("repo_id"), F.col("base_repo_id").alias("upstream_id")
    )
    return pairs.join(named, ["repo_id", "upstream_id"]).join(history, "pr_id", "left")


def stars_or_default(rows: DataFrame, repositories: DataFrame, url: str) -> DataFrame:
    """Add ``stars``: 0 for a known repository without any, -1 for an unknown one."""
    known = repositories.select(
        F.col("url").alias(url), F.coalesce("stars", F.lit(0)).alias("stars")
    )
    return rows.join(known, url, "left").withColumn("stars", F.coalesce("stars", F.lit(-1)))


def follower_names(followers: DataFrame, users: DataFrame) -> DataFrame:
    """Follow edges with both logins."""
    followee = users.select("user_id", F.col("login").alias("user_login"))
    follower = users.select(
        F.col("user_id").alias("follower_id"), F.col("login").alias("follower_login")
    )
    return followers.join(followee, "user_id").join(follower, "follower_id")


def first_follow(followers: DataFrame) -> DataFrame:
    """One row per (user, follower): the earliest follow date."""
    return followers.groupBy("user_id", "follower_id").agg(
        F.min("followed_at").alias("followed_at")
    )


def unmerged_commits(fork_commits: DataFrame, upstream_commits: DataFrame) -> DataFrame:
    """Fork commits the upstream does not have: ``repo_id, parent_id, sha``.

    ``upstream_commits(repo_id, sha)``; the join is on repository and hash, so no key
    gathers more than the copies of one commit in one repository.
    """
    up = upstream_commits.select(F.col("repo_id").alias("parent_id"), "sha")
    return fork_commits.select("repo_id", "parent_id", "sha").join(
        up, ["parent_id", "sha"], "left_anti"
    )


def foreign_copies(fork_commits: DataFrame, commits: DataFrame) -> DataFrame:
    """Per fork, pairs of an own commit and a copy of it outside the upstream.

    The pairs are counted, not formed: all copies of the hash, less those that the
    upstream holds.
    """
    mine = fork_commits.groupBy("repo_id", "parent_id", "sha").agg(F.count(F.lit(1)).alias("n"))
    every = commits.groupBy("sha").agg(F.count(F.lit(1)).alias("n_all"))
    upstream = commits.groupBy(F.col("repo_id").alias("parent_id"), "sha").agg(
        F.count(F.lit(1)).alias("n_up")
    )
    pairs = F.col("n") * (F.col("n_all") - F.coalesce("n_up", F.lit(0)))
    return (
        mine.join(every, "sha")
        .join(upstream, ["parent_id", "sha"], "left")
        .groupBy("repo_id")
        .agg(F.sum(pairs).alias("n_pairs"))
    )


def names_inside_others(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct names that occur inside another name.

    Every substring of a name is produced and equi-joined with the names, so the cost
    is bounded by the squared length of a name and no two names are compared that do
    not match.
    """
    distinct = names.filter(F.col(column) != "").select(F.col(column).alias("outer_name")).distinct()
    size = F.length("outer_name")
    starts = distinct.select("outer_name", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    parts = starts.select(
        "outer_name",
        F.explode(
            F.expr(
                "transform(sequence(1, length(outer_name) - start + 1),"
                " n -> substring(outer_name, start, n))"
            )
        ).alias(column),
    ).filter(F.col(column) != F.col("outer_name"))
    needles = distinct.select(F.col("outer_name").alias(column))
    return needles.join(parts.select(column).distinct(), column, "left_semi")


def core_team_members(teams: DataFrame, finals: DataFrame, separator: str = ", ") -> DataFrame:
    """Listed core team members, one row each, of projects in the final selection or not."""
    return (
        teams.join(finals.select("project_id", F.lit(True).alias("in_final")), "project_id", "left")
        .select(
            "project_id",
            F.coalesce("in_final", F.lit(False)).alias("in_final"),
            F.explode(F.split("members", separator)).alias("login"),
        )
    )


def flag_members(rows: DataFrame, members: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Add a boolean: the row's keys are in the member table."""
    known = members.select(*keys).distinct().withColumn(out, F.lit(True))
    return rows.join(known, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(False)))
