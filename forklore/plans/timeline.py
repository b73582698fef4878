"""Facts read from issue and pull-request timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.operators.windows import close_after_merge, first_seen_attributes, seen_before

THREAD = ["project_id", "thread_type", "thread_id"]

# Associations that make a commenter a member of the core team.
MEMBER_ASSOCIATIONS = ("MEMBER", "OWNER", "COLLABORATOR")


def cross_references(timeline: DataFrame) -> DataFrame:
    """References from one thread to another, each once, with normalised type."""
    return (
        timeline.filter(F.col("event") == "cross-referenced")
        .select(
            *THREAD,
            F.col("ref_pr_id").alias("ref_id"),
            F.when(F.col("ref_type") == "pull_request", "pr").otherwise("issue").alias("ref_type"),
            "ref_state",
        )
        .distinct()
    )


def resolve_reference_projects(references: DataFrame, repositories: DataFrame) -> DataFrame:
    """Attach the id of the referenced repository by url; NULL where it is not known yet."""
    ids = repositories.select(
        F.col("url").alias("ref_project"), F.col("repo_id").alias("ref_project_id")
    )
    return references.join(ids, "ref_project", "left")


def event_list(timeline: DataFrame) -> DataFrame:
    """Events other than commits, counted per thread and kind."""
    return (
        timeline.filter(F.col("event") != "committed")
        .groupBy(*THREAD, "event")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def thread_labels(timeline: DataFrame, event: str = "labeled") -> DataFrame:
    """Distinct labels per thread, one row each."""
    return timeline.filter(F.col("event") == event).select(*THREAD, "label").distinct()


def participants(timeline: DataFrame) -> DataFrame:
    """Distinct people per thread, with the attributes first seen in the project."""
    people = timeline.filter(F.col("actor_id").isNotNull())
    attributes = first_seen_attributes(
        people, ["project_id", "actor_id"], ["association", "user_type"],
        ["thread_type", "thread_id", "event_pos"],
    )
    return people.select(*THREAD, "actor_id").distinct().join(
        attributes, ["project_id", "actor_id"]
    )


def core_team(timeline: DataFrame, authors: DataFrame) -> DataFrame:
    """Core team per project: ``project_id, actor_id``.

    Those who close a thread of someone else, who close right after a merge, or who
    comment as member, owner or collaborator. ``authors(project_id, thread_type,
    thread_id, author_id)``; an unknown author is nobody.
    """
    closes = timeline.filter((F.col("event") == "closed") & F.col("actor_id").isNotNull())
    by_closing = (
        closes.join(authors, THREAD, "left")
        .filter(F.col("author_id").isNull() | (F.col("author_id") != F.col("actor_id")))
        .select("project_id", "actor_id")
    )
    by_merging = close_after_merge(
        timeline.select(*THREAD, "event_pos", "event", "actor_id"), THREAD
    ).select("project_id", "actor_id")
    by_association = timeline.filter(
        (F.col("event") == "commented")
        & F.upper("association").isin(*MEMBER_ASSOCIATIONS)
    ).select("project_id", "actor_id")
    return (
        by_closing.unionByName(by_merging)
        .unionByName(by_association)
        .filter(F.col("actor_id").isNotNull())
        .distinct()
    )


def pre_communication(
    timeline: DataFrame, owners: DataFrame, pr_authors: DataFrame, thread_type: str = "issue"
) -> DataFrame:
    """Pull requests whose author had a part in the thread before referencing it.

    ``project_id, thread_id, pr_id, same_owner``. Threads are issues, or pull requests with ``thread_type`` ``pr``, where
    a request that names itself does not count. Part in a thread have: its owner from
    the start, the actor of each cross-reference, and the author of each referencing
    pull request. ``owners(project_id, thread_id, owner_id)``, ``pr_authors(project_id,
    pr_id, author_id)``.
    """
    issue = ["project_id", "thread_id"]
    references = timeline.filter(
        (F.col("event") == "cross-referenced") & (F.col("thread_type") == thread_type)
    ).select(*issue, "event_pos", "actor_id", "ref_pr_id", "ref_type")
    by_pr = (
        references.filter(F.col("ref_type") == "pull_request")
        .withColumnRenamed("ref_pr_id", "pr_id")
        .join(pr_authors, ["project_id", "pr_id"])
        .select(*issue, "event_pos", "pr_id", "author_id")
    )
    sightings = (
        owners.select(*issue, F.col("owner_id").alias("author_id"), F.lit(-1).alias("position"))
        .unionByName(
            references.select(
                *issue, F.col("actor_id").alias("author_id"), F.col("event_pos").alias("position")
            )
        )
        .unionByName(by_pr.select(*issue, "author_id", F.col("event_pos").alias("position")))
        .filter(F.col("author_id").isNotNull())
    )
    found = seen_before(by_pr, sightings, issue, "author_id")
    if thread_type == "pr":
        found = found.filter(F.col("pr_id") != F.col("thread_id"))
    return (
        found.join(owners, issue, "left")
        .select(
            *issue,
            "pr_id",
            F.coalesce(F.col("author_id") == F.col("owner_id"), F.lit(False)).alias("same_owner"),
        )
        .distinct()
    )
