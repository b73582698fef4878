"""Row filters on pull requests, files, repositories, branches and commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.functions.text import contains_any, ends_with_any


def closed_prs(prs: DataFrame) -> DataFrame:
    return prs.filter(F.col("is_closed"))


def external_prs_by_verdict(
    prs: DataFrame,
    members: DataFrame,
    merged: bool,
    login: str = "author_login",
    member_login: str = "login",
) -> DataFrame:
    """Pull requests with the given verdict whose author is neither core team nor a bot.

    ``members(project_id, login)`` is anti-joined, so it may be of any size.
    """
    team = members.select("project_id", F.col(member_login).alias(login)).distinct()
    return prs.filter((F.col("is_merged") == F.lit(merged)) & ~F.col(login).contains("bot")).join(
        team, ["project_id", login], "left_anti"
    )


def rejected_prs(prs: DataFrame, projects: DataFrame) -> DataFrame:
    """Closed but not merged pull requests of known projects."""
    return prs.filter(F.col("is_closed") & ~F.col("is_merged")).join(
        projects.select("project_id", "url"), "project_id"
    )


def without_metric(base: DataFrame, metric: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose metric is still to be computed."""
    return base.join(metric.select(*keys).distinct(), list(keys), "left_anti")


def source_files(files: DataFrame, suffixes: Sequence[str], column: str = "filename") -> DataFrame:
    return files.filter(ends_with_any(F.col(column), suffixes))


def without_stop_files(
    files: DataFrame, words: Sequence[str], column: str = "filename"
) -> DataFrame:
    return files.filter(~contains_any(F.col(column), words))


def development_forks(
    forks: DataFrame, words: Sequence[str], fork: str = "fork_url", upstream: str = "upstream_url"
) -> DataFrame:
    """Fork pairs where neither url is empty or sounds like a non-development repository."""
    f, u = F.col(fork), F.col(upstream)
    named = f.isNotNull() & u.isNotNull() & (f != "") & (u != "")
    return forks.filter(named & ~contains_any(f, words) & ~contains_any(u, words))


def is_active(created: Column, pushed: Column) -> Column:
    """Something was pushed after the fork was made."""
    return created < pushed


def active_forks(repositories: DataFrame, require_push: bool = True) -> DataFrame:
    forks = repositories.filter(F.col("is_fork"))
    if require_push:
        forks = forks.filter(is_active(F.col("created_on"), F.col("pushed_on")))
    return forks


def contributing_forks(counts: DataFrame) -> DataFrame:
    """Forks with at least one own commit, merged back or not."""
    return counts.filter(F.col("only_F") + F.col("F2U") > 0).select("repo_id").distinct()


def external_commits(
    commits: DataFrame,
    members: DataFrame,
    login: str = "login",
    keep_null_author: bool = False,
) -> DataFrame:
    """Commits whose author is neither in the project's core team nor a bot.

    An anti-join keeps rows with a NULL login, so the policy for them is one filter.
    """
    author = F.col(login)
    human = ~author.contains("bot")
    kept = commits.filter(human | author.isNull() if keep_null_author else human)
    return kept.join(
        members.select("project_id", F.col("login").alias(login)).distinct(),
        ["project_id", login],
        "left_anti",
    )


def small_commits(files: DataFrame, max_files: int = 50, key: str = "sha") -> DataFrame:
    """File rows of commits that change at most ``max_files`` files.

    Sizes are counted with a map-side aggregate and joined back. A window over the
    commit would put a mass commit into one task.
    """
    small = files.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_files)
    return files.join(small.select(key), key, "left_semi")


def added_or_modified(files: DataFrame, status: str = "status") -> DataFrame:
    return files.filter(F.col(status).isin("added", "modified", "A", "M"))


def stale_branches(branches: DataFrame, fork_points: DataFrame) -> DataFrame:
    """Fork branches to be ignored, of ``branches(pair_id, branch, sha, head_at)``.

    A branch is stale when its head lies before the fork point, provided the fork has
    more than one branch, or when the head's year does not begin with ``20``. Without a
    known fork point only the year counts.
    """
    sizes = branches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_branches"))
    facts = sizes.join(fork_points.select("pair_id", "forked_at"), "pair_id", "left")
    old = (F.col("n_branches") > 1) & F.coalesce(F.col("head_at") < F.col("forked_at"), F.lit(False))
    odd_year = ~F.date_format("head_at", "yyyy").startswith("20")
    return (
        branches.join(facts, "pair_id")
        .filter(old | odd_year)
        .select("pair_id", "branch", "sha", "head_at")
    )


def reconcile_stale(stale: DataFrame, upstream_branches: DataFrame) -> DataFrame:
    """Stale fork branches matched by name with the upstream's branches.

    ``verdict``: ``ignore_both`` when the upstream branch has the same head,
    ``keep`` when it moved on, ``ignore_fork`` when there is no such branch.
    """
    up = upstream_branches.select("pair_id", "branch", F.col("sha").alias("upstream_sha"))
    verdict = (
        F.when(F.col("upstream_sha").isNull(), "ignore_fork")
        .when(F.col("upstream_sha") == F.col("sha"), "ignore_both")
        .otherwise("keep")
    )
    return stale.join(up, ["pair_id", "branch"], "left").select(
        "pair_id", "branch", "sha", verdict.alias("verdict")
    )


def forks_seen_in_prs(prs: DataFrame, fork_url: str = "fork_url", project: str = "project_url"):
    """Distinct fork urls in a pull-request export, the project itself excepted."""
    f = F.col(fork_url)
    return prs.filter((f != "") & (f != F.col(project))).select(project, fork_url).distinct()


def repositories_to_refresh(pairs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Urls of forks and upstreams whose facts are missing from the repository table."""
    urls = (
        pairs.select(F.col("fork_url").alias("url"))
        .unionByName(pairs.select(F.col("upstream_url").alias("url")))
        .distinct()
    )
    known = repositories.filter(F.col("pushed_on").isNotNull()).select("url").distinct()
    return urls.join(known, "url", "left_anti")


def own_commits(commits: DataFrame, f2u: str = "f2u", only_f: str = "only_f") -> DataFrame:
    """Commits known to be the fork's own: merged back or only in the fork."""
    return commits.filter(F.col(f2u).isNotNull() | F.col(only_f).isNotNull())


def non_merge_since(commits: DataFrame, since: Column, parents: str = "parents") -> DataFrame:
    """Distinct non-merge commits after a moment, over all branches given."""
    n_parents = F.coalesce(F.size(parents), F.lit(0))
    return (
        commits.filter((n_parents < 2) & (F.col("committed_at") > since))
        .select("project_id", "sha", "committed_at")
        .distinct()
    )


def commits_by_authors(commits: DataFrame, authors: DataFrame) -> DataFrame:
    """Commits in any branch written under one of the authors' logins or e-mails.

    Two hash semi-joins instead of one with ``OR``, which would compare all pairs.
    """
    by_login = commits.join(
        authors.filter(F.col("login").isNotNull()).select("login").distinct(), "login", "left_semi"
    )
    by_email = commits.join(
        authors.filter(F.col("email").isNotNull()).select("email").distinct(), "email", "left_semi"
    )
    return by_login.unionByName(by_email).distinct()


def whole_repository(commits: DataFrame) -> DataFrame:
    """The commit set of a repository over all its branches."""
    return commits.select("repo_id", "sha").distinct()


def first_column(df: DataFrame) -> DataFrame:
    return df.select(df.columns[0])
