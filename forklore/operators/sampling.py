"""Limits and samples. All are reproducible: order and seed are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.operators.groups import shuffled_rank
from forklore.operators.windows import latest_per_group


def first_forks(forks: DataFrame, n: int, project: str = "project_id", by: str = "repo_id"):
    """At most ``n`` forks of each project in a stable order."""
    return latest_per_group(forks, [project], [F.col(by)], n).drop("rank")


def _order(key: str, seed: int) -> Column:
    """Reproducible random order: the MD5 of key and seed, the same in any engine."""
    return F.concat_ws("-", F.col(key), F.lit(seed))


def sample_exactly(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement: the smallest hashes of a unique key.

    Each task keeps its own ``n`` smallest, so nothing is sorted as a whole.
    """
    return rows.orderBy(F.md5(_order(key, seed).cast("binary"))).limit(n)


def sample_prs(
    prs: DataFrame, keep_all_up_to: int, share: int, seed: int = 0
) -> DataFrame:
    """Pull requests per project and verdict: all of a small group, else a third and one."""
    keys = ["project_id", "is_merged"]
    sizes = prs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    quota = F.when(F.col("_n") <= keep_all_up_to, F.col("_n")).otherwise(
        F.floor(F.col("_n") / share) + 1
    )
    ranked = shuffled_rank(prs, keys, _order("pr_id", seed), "_rank")
    return ranked.join(sizes, keys).filter(F.col("_rank") <= quota).drop("_n", "_rank")
