"""What each commit changes, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.functions.commits import change_flags


def change_profile(changes: DataFrame) -> DataFrame:
    """Flags and line counts per changed file of ``changes(sha, filename, status, added, deleted)``.

    ``status`` is the letter of the change type.
    """
    return changes.select(
        "sha",
        "filename",
        *change_flags(F.col("filename"), F.col("status"), F.col("added"), F.col("deleted")),
    )


def commit_totals(profile: DataFrame) -> DataFrame:
    """The profile summed per commit."""
    names = [c for c in profile.columns if c not in ("sha", "filename", "about_config")]
    return profile.groupBy("sha").agg(
        *[F.sum(c).alias(c) for c in names], F.bool_or("about_config").alias("about_config")
    )
