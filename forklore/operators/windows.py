"""Order-sensitive operators on timelines, keyed by thread and event position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forklore.operators.groups import previous_value

#: A thread is a number of one project; numbers repeat between projects.
THREAD_KEYS = ("project_id", "thread_id")


def comments_around_close(timeline: DataFrame, keys: Sequence[str] = THREAD_KEYS) -> DataFrame:
    """Comments and participants before the last close, after it, and in total.

    Without a close everything counts as before. Actors of any event are participants,
    the one who closes included. The last close per thread is an aggregate joined
    back, not a window.
    """
    closes = (
        timeline.filter(F.col("event") == "closed")
        .groupBy(*keys)
        .agg(F.max("event_pos").alias("_close"))
    )
    rows = timeline.select(*keys, "event", "event_pos", "actor_id").join(closes, list(keys), "left")
    before = F.col("_close").isNull() | (F.col("event_pos") <= F.col("_close"))
    comment = F.col("event") == "commented"
    counted = rows.groupBy(*keys).agg(
        F.count_if(comment & before).alias("comments_before"),
        F.count_if(comment).alias("comments_total"),
        F.count_distinct(F.when(before, F.col("actor_id"))).alias("participants_before"),
        F.count_distinct("actor_id").alias("participants_total"),
    )
    return counted.withColumn(
        "comments_after", F.col("comments_total") - F.col("comments_before")
    ).withColumn(
        "participants_after", F.col("participants_total") - F.col("participants_before")
    )


def last_closer(timeline: DataFrame, keys: Sequence[str] = THREAD_KEYS) -> DataFrame:
    """Actor of the last ``closed`` event of each thread."""
    return (
        timeline.filter(F.col("event") == "closed")
        .groupBy(*keys)
        .agg(F.max_by("actor_id", "event_pos").alias("closer_id"))
    )


def seen_before(
    references: DataFrame, sightings: DataFrame, keys: list[str], user: str
) -> DataFrame:
    """References whose user was sighted earlier in the same thread.

    ``sightings`` is reduced to the first position per (thread, user) and joined on
    both, so a busy thread is spread over its users.
    """
    first = sightings.groupBy(*keys, user).agg(F.min("position").alias("_first"))
    return references.join(first, [*keys, user]).filter(F.col("_first") < F.col("event_pos")).drop(
        "_first"
    )


def close_after_merge(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """``closed`` events directly after a ``merged`` one in the row order of the thread."""
    return previous_value(timeline, keys, "event_pos", "event", "_previous").filter(
        (F.col("event") == "closed") & (F.col("_previous") == "merged")
    ).drop("_previous")


def first_seen_attributes(
    timeline: DataFrame, keys: list[str], attributes: list[str], order: list[str]
) -> DataFrame:
    """Attributes of a user from the first comment, else from the first event seen."""
    rank = F.struct(
        F.when(F.col("event") == "commented", 0).otherwise(1), *[F.col(c) for c in order]
    )
    best = timeline.groupBy(*keys).agg(
        F.min_by(F.struct(*attributes), rank).alias("_best")
    )
    return best.select(*keys, *[F.col(f"_best.{a}").alias(a) for a in attributes])


def latest_per_group(
    rows: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group.

    A filtered ``row_number``: Spark keeps only ``n`` rows per group and task before
    the shuffle, so a hot group does not travel.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)


def last_comments_before_close(
    timeline: DataFrame, n: int = 3, keys: tuple[str, ...] = ("thread_id",)
) -> DataFrame:
    """The last ``n`` non-empty comments before the first close, newest first."""
    closes = (
        timeline.filter(F.col("event") == "closed")
        .groupBy(*keys)
        .agg(F.min("event_pos").alias("_close"))
    )
    comments = (
        timeline.filter((F.col("event") == "commented") & (F.col("body") != ""))
        .join(closes, list(keys), "left")
        .filter(F.col("_close").isNull() | (F.col("event_pos") < F.col("_close")))
        .drop("_close")
    )
    return latest_per_group(comments, list(keys), [F.desc("event_pos")], n)


def head_of_branch(commits: DataFrame, keys: list[str], moment: str = "committed_at") -> DataFrame:
    """Latest and first commit of each branch; ties go to the greater and lesser hash."""
    order = F.struct(moment, "sha")
    return commits.groupBy(*keys).agg(
        F.max_by("sha", order).alias("head_sha"), F.min_by("sha", order).alias("first_sha")
    )


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key."""
    return rows.select(*keys).distinct()
