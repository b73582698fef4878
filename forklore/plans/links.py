"""Links from pull requests to issues, as written in titles, comments and commit messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.functions.text import issue_links


def text_links(texts: DataFrame, parts: int = 1) -> DataFrame:
    """Issue numbers written in ``texts(project_id, pr_id, body)``, each once.

    With ``parts`` the links of a pull request are brought together in so many tasks.
    """
    found = texts.select(
        "project_id", "pr_id", F.explode(issue_links(F.col("body"))).alias("issue_id")
    )
    return (found.repartition(parts, "project_id", "pr_id") if parts > 1 else found).distinct()


def pr_issue_links(issues: DataFrame, *texts: DataFrame, parts: int = 1) -> DataFrame:
    """Links to issues that exist in the project and are not the pull request itself; for ``parts`` see above."""
    found = reduce(
        lambda a, b: a.unionByName(b), [t.select("project_id", "pr_id", "body") for t in texts]
    )
    written = text_links(found, parts).filter(F.col("issue_id") != F.col("pr_id"))
    return (
        (written.repartition(parts, "project_id", "issue_id") if parts > 1 else written)
        .join(issues.select("project_id", "issue_id", "created_on"), ["project_id", "issue_id"])
        .select("project_id", "pr_id", "issue_id", F.col("created_on").alias("issue_created_on"))
    )
