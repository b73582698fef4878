"""How a pull request was merged, when the merge button was not used.

Rules are ranked; each gives candidate rows and the lowest rank wins. The order is:
closing commit and merge event (whichever comes later in the timeline), then the last
comment, then the last three, then referenced commits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.functions.text import (
    commit_sha_mention,
    has_broad_merge_keyword,
    has_merge_keyword,
    is_duplicate_comment,
    names_other_pr,
)
from forklore.operators.windows import THREAD_KEYS, last_comments_before_close

VERDICTS = ["merged-1", "merged-2", "merged-5", "duplicate", "rejected", "merged-4", "merged-3",
            "merged-2ref"]


def merge_verdicts(
    timeline: DataFrame, known_shas: DataFrame, keys: Sequence[str] = THREAD_KEYS, prefix: int = 7
) -> DataFrame:
    """One verdict per thread: ``*keys, verdict``.

    ``known_shas(project_id, sha)`` are the commits of each repository, as text; only those of the
    thread's own project count. A mention of seven characters matches a known commit by its first seven.
    """
    keys = list(keys)
    at = ["project_id", "mention"]
    threads = timeline.select(*keys).distinct()
    known = (
        known_shas.select("project_id", F.substring("sha", 1, prefix).alias("mention"))
        .unionByName(known_shas.select("project_id", F.col("sha").alias("mention")))
        .distinct()
    )

    closing = (
        (F.col("event") == "closed") & F.col("sha").isNotNull() & (F.col("sha") != "")
    ) | (F.col("event") == "merged")
    by_event = (
        timeline.filter(closing)
        .groupBy(*keys)
        .agg(F.max_by("event", "event_pos").alias("event"))
        .select(
            *keys,
            F.lit(1).alias("rank"),
            F.when(F.col("event") == "merged", "merged-1").otherwise("merged-2").alias("verdict"),
        )
    )

    comments = (
        last_comments_before_close(timeline, 3, keys)
        .withColumn("sha_named", commit_sha_mention(F.col("body")))
        # Most comments name no commit; a key of their own keeps them apart in the join.
        .withColumn("mention", F.coalesce("sha_named", F.concat_ws(" ", F.lit(""), *keys)))
        .join(known.withColumn("_known", F.lit(True)), at, "left")
        .withColumn("sha_merged", F.coalesce("_known", F.lit(False)))
    )
    names_pr = names_other_pr(F.col("body"))
    duplicate = is_duplicate_comment(F.col("body"))
    weighed = F.col("sha_named").isNotNull() & ~F.col("body").contains("codecov")
    of_last = (
        F.when(weighed & ~duplicate & F.col("sha_merged"), "merged-5")
        .when(weighed & duplicate & (names_pr | F.col("sha_merged")), "duplicate")
        .when(names_pr, "rejected")
        .when(has_merge_keyword(F.col("body")), "merged-4")
    )
    by_last = (
        comments.filter(F.col("rank") == 1)
        .select(*keys, F.lit(2).alias("rank"), of_last.alias("verdict"))
        .filter(F.col("verdict").isNotNull())
    )
    by_three = comments.filter(has_broad_merge_keyword(F.col("body")) & F.col("sha_merged")).select(
        *keys, F.lit(3).alias("rank"), F.lit("merged-3").alias("verdict")
    )
    referenced = timeline.filter((F.col("event") == "referenced") & (F.col("sha") != "")).select(
        *dict.fromkeys(["project_id", *keys]), F.col("sha").alias("mention")
    )
    by_reference = referenced.join(known, at, "left_semi").select(
        *keys, F.lit(4).alias("rank"), F.lit("merged-2ref").alias("verdict")
    )
    otherwise = threads.select(*keys, F.lit(5).alias("rank"), F.lit("rejected").alias("verdict"))
    candidates = (
        by_event.unionByName(by_last)
        .unionByName(by_three)
        .unionByName(by_reference)
        .unionByName(otherwise)
    )
    return candidates.groupBy(*keys).agg(F.min_by("verdict", "rank").alias("verdict"))


def merged_by_own_commits(
    timeline: DataFrame, known_shas: DataFrame, keys: Sequence[str] = THREAD_KEYS
) -> DataFrame:
    """Threads with a ``committed`` event whose commit is in the project's repository (type 6)."""
    own = timeline.filter((F.col("event") == "committed") & (F.col("sha") != "")).select(
        *dict.fromkeys(["project_id", *keys]), "sha"
    )
    known = known_shas.select("project_id", "sha")
    return own.join(known, ["project_id", "sha"], "left_semi").select(*keys).distinct()


def merge_flags(
    verdicts: DataFrame, own_commits: DataFrame, keys: Sequence[str] = THREAD_KEYS
) -> DataFrame:
    """Boolean columns per merge type, and whether any of them holds."""
    six = own_commits.select(*keys, F.lit(True).alias("merge_6"))
    rows = verdicts.join(six, list(keys), "left")
    flags = {
        name: F.coalesce(F.col("verdict") == f"merged-{name}", F.lit(False))
        for name in ("1", "2", "2ref", "3", "4", "5")
    }
    any_flag = F.coalesce("merge_6", F.lit(False))
    for flag in flags.values():
        any_flag = any_flag | flag
    return rows.select(
        *keys,
        *[flag.alias(f"merge_{name}") for name, flag in flags.items()],
        F.coalesce("merge_6", F.lit(False)).alias("merge_6"),
        any_flag.alias("merge_any"),
    )
