"""Aggregations. All have a map-side partial step; none collects an unbounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_pairs(rows: DataFrame, condition: Column, *columns: str) -> DataFrame:
    return rows.filter(condition).select(*columns).distinct()


def count_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_count_by(rows: DataFrame, keys: list[str], value: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias(name))


def pr_states_per_fork(history: DataFrame) -> DataFrame:
    """Merged beats closed beats open, of ``history(repo_id, pr_id, action)``; counts per fork."""
    rank = F.when(F.col("action") == "merged", 2).when(F.col("action") == "closed", 1).otherwise(0)
    state = history.groupBy("repo_id", "pr_id").agg(F.max(rank).alias("state"))
    return state.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("submitted"),
        F.count_if(F.col("state") == 2).alias("merged"),
        F.count_if(F.col("state") == 1).alias("closed"),
        F.count_if(F.col("state") == 0).alias("open"),
    )


def upstreams_with_many(pairs: DataFrame, upstream: str, fork: str, more_than: int = 1):
    """All (fork, upstream) pairs of upstreams that have more than one such fork."""
    many = (
        pairs.groupBy(upstream)
        .agg(F.count_distinct(fork).alias("_n"))
        .filter(F.col("_n") > more_than)
        .select(upstream)
    )
    return pairs.select(fork, upstream).distinct().join(many, upstream, "left_semi")


def external_contribution(prs: DataFrame, fork: str = "repo_id") -> DataFrame:
    """Per fork: pull requests by others than the owner, their authors, and all."""
    foreign = F.col("author") != F.col("owner")
    return prs.groupBy(fork).agg(
        F.count_if(foreign).alias("external_prs"),
        F.count_distinct(F.when(foreign, F.col("author"))).alias("external_authors"),
        F.count(F.lit(1)).alias("all_prs"),
    )


def geometric_mean(value: Column) -> Column:
    """Mean of positive values on the log scale; zeros and NULLs are left out."""
    return F.exp(F.avg(F.when(value > 0, F.ln(value))))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """Quotient as a rounded double, NULL where the whole is zero."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def status_ratios(prs: DataFrame) -> DataFrame:
    """Merged, rejected and open pull requests per project, counted and as a share."""
    merged = F.count_if(F.col("is_merged"))
    rejected = F.count_if(F.col("is_closed") & ~F.col("is_merged"))
    still_open = F.count_if(~F.col("is_closed"))
    total = F.count(F.lit(1))
    return prs.groupBy("project_id").agg(
        total.alias("n_prs"),
        merged.alias("n_merged"),
        rejected.alias("n_rejected"),
        still_open.alias("n_open"),
        ratio(merged, total).alias("merged_ratio"),
        ratio(rejected, total).alias("rejected_ratio"),
        ratio(still_open, total).alias("open_ratio"),
    )


def co_change_support(files: DataFrame, commit: str = "sha", block: int = 500) -> DataFrame:
    """Times two files changed together, the diagonal included: ``file_a <= file_b``.

    The files of a commit are dealt by hash into blocks of about ``block``, and each pair of blocks is joined apart from the
    others: a commit of any size is spread over many keys, none of which has more than ``block`` squared pairs.
    """
    one = files.select(commit, "filename").distinct()
    sizes = one.groupBy(commit).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = one.join(sizes, commit).withColumn("_own", F.pmod(F.xxhash64("filename"), F.col("_blocks")).cast("int"))
    low = dealt.select(
        commit, F.col("filename").alias("_x"), F.col("_own").alias("_low"),
        F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_high"),
    )
    high = dealt.select(
        commit, F.col("filename").alias("_y"), F.col("_own").alias("_high"),
        F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_low"),
    )
    return (
        low.join(high, [commit, "_low", "_high"])
        .filter((F.col("_low") < F.col("_high")) | (F.col("_x") <= F.col("_y")))
        .groupBy(F.least("_x", "_y").alias("file_a"), F.greatest("_x", "_y").alias("file_b"))
        .agg(F.count(F.lit(1)).alias("support"))
    )


def upstream_totals(pairs: DataFrame, prs: DataFrame, commits: DataFrame) -> DataFrame:
    """Per upstream: pull requests, commits of its forks, and those by the owner of the fork.

    ``pairs(repo_id, upstream_id, owner_id)``, ``prs(upstream_id, pr_id)``, ``commits(repo_id, sha, author_id)``.
    Each total is its own aggregate, joined on the upstream; none is formed over a joined table.
    """
    n_prs = prs.groupBy("upstream_id").agg(F.count(F.lit(1)).alias("n_prs"))
    made = commits.join(pairs.select("repo_id", "upstream_id", "owner_id"), "repo_id").groupBy("upstream_id").agg(
        F.count(F.lit(1)).alias("n_commits"),
        F.count_if(F.col("author_id") == F.col("owner_id")).alias("n_by_owner"),
    )
    counts = ["n_prs", "n_commits", "n_by_owner"]
    every = pairs.select("upstream_id").distinct().join(n_prs, "upstream_id", "left").join(made, "upstream_id", "left")
    return every.fillna(0, counts)


# The five categories of a classified commit.
CATEGORIES = ["only_F", "only_U", "F2U", "U2F", "before"]


def category_counts(commits: DataFrame, *keys: str) -> DataFrame:
    """Commits per category as columns. Explicit conditions: no pass to find the values."""
    return commits.groupBy(*keys).agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    )


def category_dates(commits: DataFrame, *keys: str) -> DataFrame:
    """First and last commit date per category group."""
    return commits.groupBy(*keys, "category").agg(
        F.min("committed_at").alias("first_at"), F.max("committed_at").alias("last_at")
    )


def set_sizes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Members of the set per key, un-collected, and the size of the set."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_members"))
