"""How invasive a pull request is: the share of added files among those it changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.functions.text import ends_with_any
from forklore.operators.aggregates import geometric_mean
from forklore.operators.groups import grouped_medians
from forklore.operators.joins import pr_changed_files
from forklore.session import materialize


def easiness(
    prs: DataFrame,
    pr_commits: DataFrame,
    commits: DataFrame,
    files: DataFrame,
    suffixes: Sequence[str],
    compat: bool = False,
) -> DataFrame:
    """``added / (added + modified)`` on distinct names, and the same for source files.

    A file both added and modified counts as added. With ``compat`` the unfiltered
    variant counts it in both sets of the denominator, as the published numbers do.
    No file at all gives 0.
    """
    touched = pr_changed_files(prs, pr_commits, commits, files)
    per_file = touched.groupBy("project_id", "pr_id", "filename").agg(
        F.bool_or(F.col("status") == "added").alias("is_added"),
        F.bool_or(F.col("status") == "modified").alias("is_modified"),
    )
    source = ends_with_any(F.col("filename"), suffixes)
    added = F.col("is_added")
    changed = F.col("is_modified") & ~F.col("is_added")
    sizes = per_file.groupBy("project_id", "pr_id").agg(
        F.count_if(added).alias("n_added"),
        F.count_if(F.col("is_modified") if compat else changed).alias("n_changed"),
        F.count_if(added & source).alias("n_added_source"),
        F.count_if(changed & source).alias("n_changed_source"),
    )

    def share(part: str, rest: str):
        total = F.nullif(F.col(part) + F.col(rest), F.lit(0))
        return F.coalesce(F.col(part) / total, F.lit(0.0))

    return sizes.select(
        "project_id",
        "pr_id",
        share("n_added", "n_changed").alias("easiness"),
        share("n_added_source", "n_changed_source").alias("easiness_filtered"),
    )


def project_easiness(prs: DataFrame, per_pr: DataFrame) -> DataFrame:
    """Mean, median and geometric mean per project for all, merged and rejected requests.

    One pass with grouping sets; ``verdict`` is ``all``, ``merged`` or ``rejected``.
    """
    verdict = F.when(F.col("is_merged"), "merged").when(F.col("is_closed"), "rejected")
    rows = per_pr.join(prs, ["project_id", "pr_id"]).select(
        "project_id", verdict.alias("verdict"), "easiness", "easiness_filtered"
    )
    rows = materialize(rows, "easiness")  # read for the means and for the medians
    both = rows.withColumn(
        "verdict", F.explode(F.array_compact(F.array(F.lit("all"), F.col("verdict"))))
    )
    medians = grouped_medians(
        both,
        ["project_id", "verdict"],
        {"median_easiness": "easiness", "median_filtered": "easiness_filtered"},
    )
    grouped = rows.groupingSets(
        [["project_id"], ["project_id", "verdict"]], "project_id", "verdict"
    ).agg(
        F.grouping("verdict").alias("_all"),
        F.count(F.lit(1)).alias("n_prs"),
        F.round(F.avg("easiness"), 6).alias("mean_easiness"),
        F.round(geometric_mean(F.col("easiness")), 6).alias("geomean_easiness"),
        F.round(F.avg("easiness_filtered"), 6).alias("mean_filtered"),
        F.round(geometric_mean(F.col("easiness_filtered")), 6).alias("geomean_filtered"),
    )
    return (
        grouped.withColumn(
            "verdict", F.when(F.col("_all") == 1, "all").otherwise(F.col("verdict"))
        )
        .filter(F.col("verdict").isNotNull())
        .drop("_all")
        .join(medians, ["project_id", "verdict"])
        .withColumns({c: F.round(c, 6) for c in ("median_easiness", "median_filtered")})
    )


def change_sizes(
    prs: DataFrame, pr_commits: DataFrame, files: DataFrame, suffixes: Sequence[str]
) -> DataFrame:
    """Lines and files changed per pull request, and the line-based easiness."""
    touched = prs.select("project_id", "pr_id").join(pr_commits, ["project_id", "pr_id"]).join(
        files, "sha"
    )
    code = ends_with_any(F.col("filename"), suffixes)
    lines = F.col("additions")
    sizes = touched.groupBy("project_id", "pr_id").agg(
        F.sum(F.when(code, lines).otherwise(0)).alias("loc"),
        F.count_distinct("filename").alias("n_files"),
        F.sum(F.when(F.col("status") == "added", lines).otherwise(0)).alias("_new"),
        F.sum(F.when(F.col("status").isin("added", "modified"), lines).otherwise(0)).alias("_all"),
    )
    return sizes.select(
        "project_id",
        "pr_id",
        "loc",
        "n_files",
        (F.col("_new") / F.nullif(F.col("_all"), F.lit(0))).alias("easiness_loc"),
    )


def project_change_sizes(per_pr: DataFrame) -> DataFrame:
    per_pr = materialize(per_pr, "sizes")  # read for the means and for the medians
    medians = grouped_medians(
        per_pr,
        ["project_id"],
        {"median_loc": "loc", "median_files": "n_files", "median_easiness_loc": "easiness_loc"},
    )
    means = per_pr.groupBy("project_id").agg(
        F.round(F.avg("loc"), 6).alias("mean_loc"),
        F.round(F.avg("n_files"), 6).alias("mean_files"),
        F.round(F.avg("easiness_loc"), 6).alias("mean_easiness_loc"),
    )
    rounded = {c: F.round(c, 6) for c in medians.columns[1:]}
    return means.join(medians, "project_id").withColumns(rounded)
