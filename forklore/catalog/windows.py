"""Order-sensitive operators, limits and samples (W1 - W9, O1 - O5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.operators import joins, sampling, windows

CLOSE_COUNTS = """last_close AS (
      SELECT thread_id, max(event_pos) AS pos FROM timeline WHERE event='closed' GROUP BY 1),
    r AS (SELECT t.*, c.pos IS NULL OR t.event_pos<=c.pos AS b
      FROM timeline t LEFT JOIN last_close c ON c.thread_id=t.thread_id),
    counted AS (SELECT thread_id,
      count(*) FILTER (event='commented' AND b) AS comments_before,
      count(*) FILTER (event='commented') AS comments_total,
      count(DISTINCT CASE WHEN b THEN actor_id END) AS participants_before,
      count(DISTINCT actor_id) AS participants_total FROM r GROUP BY 1)"""


@query(
    "w01_comments_around_close",
    f"""WITH {CLOSE_COUNTS}
    SELECT *, comments_total-comments_before AS comments_after,
      participants_total-participants_before AS participants_after FROM counted""",
)
def w01(t: Tables):
    return windows.comments_around_close(t.timeline, ["thread_id"])


@query(
    "w01_comments_around_close_by_project",
    """WITH t AS (SELECT project_id, thread_id//25 AS number, event, event_pos, actor_id FROM timeline_full),
    c AS (SELECT project_id, number, max(event_pos) AS pos FROM t WHERE event='closed' GROUP BY 1, 2),
    r AS (SELECT t.*, c.pos IS NULL OR t.event_pos<=c.pos AS b FROM t
      LEFT JOIN c ON c.project_id=t.project_id AND c.number=t.number)
    SELECT project_id, number, count(*) FILTER (event='commented' AND b) AS comments_before,
      count(*) FILTER (event='commented') AS comments_total,
      count(*) FILTER (event='commented' AND NOT b) AS comments_after,
      count(DISTINCT CASE WHEN b THEN actor_id END) AS participants_before,
      count(DISTINCT actor_id) AS participants_total,
      count(DISTINCT actor_id)-count(DISTINCT CASE WHEN b THEN actor_id END) AS participants_after
    FROM r GROUP BY 1, 2""",
)
def w01b(t: Tables):
    return windows.comments_around_close(_numbered(t), ["project_id", "number"])


def _numbered(t: Tables):
    """Threads by project and number; all projects use the same numbers."""
    return t.timeline_full.withColumn("number", F.expr("thread_id div 25"))


@query(
    "w02_last_closer_by_project",
    """SELECT project_id, thread_id//25 AS number, max_by(actor_id, event_pos) AS closer_id
    FROM timeline_full WHERE event='closed' GROUP BY 1, 2""",
)
def w02b(t: Tables):
    return windows.last_closer(_numbered(t), ["project_id", "number"])


@query(
    "w02_last_closer",
    """SELECT thread_id, max_by(actor_id, event_pos) AS closer_id FROM timeline
    WHERE event='closed' GROUP BY 1""",
)
def w02(t: Tables):
    return windows.last_closer(t.timeline, ["thread_id"])


@query(
    "w03_reference_by_known_user",
    """SELECT t.thread_id, t.event_pos, t.actor_id FROM timeline t
    WHERE t.event='cross-referenced' AND EXISTS (
      SELECT 1 FROM timeline s WHERE s.thread_id=t.thread_id AND s.actor_id=t.actor_id
        AND s.event_pos<t.event_pos)""",
)
def w03(t: Tables):
    events = t.timeline.select("thread_id", "event_pos", "actor_id", "event")
    references = events.filter("event = 'cross-referenced'").drop("event")
    sightings = events.withColumn("position", F.col("event_pos"))
    return windows.seen_before(references, sightings, ["thread_id"], "actor_id").select(
        "thread_id", "event_pos", "actor_id"
    )


@query(
    "w04_close_right_after_merge",
    """SELECT thread_id, event_pos, actor_id FROM (
      SELECT *, lag(event) OVER (PARTITION BY thread_id ORDER BY event_pos) AS p FROM timeline)
    WHERE event='closed' AND p='merged'""",
)
def w04(t: Tables):
    return windows.close_after_merge(t.timeline, ["thread_id"]).select(
        "thread_id", "event_pos", "actor_id"
    )


@query(
    "w05_first_seen_attributes",
    """SELECT project_id, actor_id, association, user_type, event_pos FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, actor_id
        ORDER BY CASE WHEN event='commented' THEN 0 ELSE 1 END, event_pos) AS rn
      FROM timeline_full) WHERE rn=1""",
)
def w05(t: Tables):
    return windows.first_seen_attributes(
        t.timeline_full,
        ["project_id", "actor_id"],
        ["association", "user_type", "event_pos"],
        ["event_pos"],
    )


@query(
    "w06_last_comments_before_close",
    """WITH c AS (SELECT thread_id, min(event_pos) AS pos FROM timeline_full WHERE event='closed'
      GROUP BY 1)
    SELECT thread_id, event_pos, body, rank::INT AS rank FROM (
      SELECT t.*, row_number() OVER (PARTITION BY t.thread_id ORDER BY t.event_pos DESC) AS rank
      FROM timeline_full t LEFT JOIN c ON c.thread_id=t.thread_id
      WHERE t.event='commented' AND (c.pos IS NULL OR t.event_pos<c.pos))
    WHERE rank<=3""",
)
def w06(t: Tables):
    return windows.last_comments_before_close(t.timeline_full).select(
        "thread_id", "event_pos", "body", "rank"
    )


@query(
    "w07_latest_commits_per_project",
    """SELECT project_id, sha, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY committed_at DESC, sha) AS rank
      FROM commit_login) WHERE rank<=50""",
)
def w07(t: Tables):
    return windows.latest_per_group(
        t.commit_login, ["project_id"], [F.desc("committed_at"), F.col("sha")], 50
    ).select("project_id", "sha", "rank")


@query(
    "w08_branch_heads",
    """SELECT pair_id, concat('b', CAST(sha%3 AS STRING)) AS branch,
      max_by(sha, row(commit_at, sha)) AS head_sha, min_by(sha, row(commit_at, sha)) AS first_sha
    FROM dag GROUP BY 1, 2""",
)
def w08(t: Tables):
    commits = t.dag.withColumn("branch", F.concat(F.lit("b"), F.col("sha") % 3))
    return windows.head_of_branch(commits, ["pair_id", "branch"], "commit_at")


@query(
    "w09_first_seen_participants",
    "SELECT DISTINCT project_id, thread_id, actor_id FROM timeline_full",
)
def w09(t: Tables):
    return windows.first_seen(t.timeline_full, ["project_id", "thread_id", "actor_id"])


@query(
    "o01_ordered_references",
    """SELECT thread_id, ref_pr_id, event_pos FROM timeline WHERE event='cross-referenced'
    ORDER BY thread_id, event_pos""",
)
def o01(t: Tables):
    return (
        t.timeline.filter("event = 'cross-referenced'")
        .select("thread_id", "ref_pr_id", "event_pos")
        .orderBy("thread_id", "event_pos")
    )


@query(
    "o02_exists",
    """SELECT project_id, pr_id FROM pull_request p WHERE EXISTS (
      SELECT 1 FROM pr_commit m WHERE m.project_id=p.project_id AND m.pr_id=p.pr_id)""",
)
def o02(t: Tables):
    return joins.existing(
        t.pull_request.select("project_id", "pr_id"), t.pr_commit, ["project_id", "pr_id"]
    )


@query(
    "o03_first_forks",
    """SELECT parent_id, repo_id FROM (
      SELECT parent_id, repo_id, row_number() OVER (PARTITION BY parent_id ORDER BY repo_id) AS r
      FROM repository WHERE is_fork) WHERE r<=2""",
)
def o03(t: Tables):
    forks = t.repository.filter("is_fork").select("parent_id", "repo_id")
    return sampling.first_forks(forks, 2, "parent_id")


@query(
    "o04_sample_exactly",
    """SELECT pr_id FROM pull_request ORDER BY md5(concat(pr_id, '-', 7)) LIMIT 1500""",
)
def o04(t: Tables):
    return sampling.sample_exactly(t.pull_request.select("pr_id"), 1500, "pr_id", seed=7)


@query(
    "o05_stratified_pr_sample",
    """SELECT project_id, is_merged, pr_id FROM (
      SELECT project_id, is_merged, pr_id,
        row_number() OVER (PARTITION BY project_id, is_merged ORDER BY md5(concat(pr_id, '-', 3)))
          AS r,
        count(*) OVER (PARTITION BY project_id, is_merged) AS n
      FROM pull_request)
    WHERE r <= CASE WHEN n<=100 THEN n ELSE n//3+1 END""",
)
def o05(t: Tables):
    return sampling.sample_prs(
        t.pull_request.select("project_id", "is_merged", "pr_id"), keep_all_up_to=100, share=3, seed=3
    )
