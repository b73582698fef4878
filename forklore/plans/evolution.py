"""How a fork and its upstream went on after they parted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.functions.dates import whole_years_between


def evolution_records(classified: DataFrame) -> DataFrame:
    """One record per pair from ``classified(pair_id, category, committed_at)``.

    Latest fork activity is that of ``only_F`` and ``F2U``, latest upstream activity that of
    ``only_U`` and ``U2F``; the fork point is the first commit from before the fork. Pairs
    that lack one of the three give no record.
    """
    is_ = {c: F.col("category") == c for c in ("only_F", "only_U", "F2U", "U2F", "before")}
    at = F.col("committed_at")
    points = classified.groupBy("pair_id").agg(
        F.min(F.when(is_["before"], at)).alias("fork_point"),
        F.max(F.when(is_["only_F"] | is_["F2U"], at)).alias("latest_fork_at"),
        F.max(F.when(is_["only_U"] | is_["U2F"], at)).alias("latest_upstream_at"),
        F.count_if(is_["before"]).alias("n_before"),
        F.count_if(is_["only_F"]).alias("n_only_F"),
        F.count_if(is_["F2U"]).alias("n_F2U"),
        F.count_if(is_["U2F"]).alias("n_U2F"),
    )
    upstream_side = classified.filter(is_["only_U"] | is_["U2F"])
    after = (
        upstream_side.join(points.select("pair_id", "fork_point"), "pair_id")
        .filter(at > F.col("fork_point"))
        .groupBy("pair_id")
        .agg(F.count(F.lit(1)).alias("n_upstream_after"))
    )
    early = F.least("latest_fork_at", "latest_upstream_at")
    late = F.greatest("latest_fork_at", "latest_upstream_at")
    return (
        points.filter(
            F.col("fork_point").isNotNull()
            & F.col("latest_fork_at").isNotNull()
            & F.col("latest_upstream_at").isNotNull()
        )
        .join(after, "pair_id", "left")
        .withColumn("n_upstream_after", F.coalesce("n_upstream_after", F.lit(0)))
        .withColumn("gap_years", whole_years_between(early, late))
    )
