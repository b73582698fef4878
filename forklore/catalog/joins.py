"""Joins (J1 - J19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.operators import intervals, joins
from forklore.operators.dag import nearest_heads


@query(
    "j01_commits_of_listed_prs",
    """SELECT c.sha, m.project_id, m.pr_id, c.committed_at FROM pr_commit m
    JOIN commit c ON c.sha=m.sha
    WHERE (m.project_id, m.pr_id) IN (SELECT project_id, pr_id FROM pull_request WHERE is_merged)""",
)
def j01(t: Tables):
    listed = t.pull_request.filter("is_merged")
    return joins.commits_of_prs(t.commit, t.pr_commit, listed).select(
        "sha", "project_id", "pr_id", "committed_at"
    )


@query(
    "j02_pr_commit_file_join",
    """SELECT p.project_id, p.pr_id, m.sha, f.filename, f.status
    FROM pull_request p JOIN pr_commit m ON p.project_id=m.project_id AND p.pr_id=m.pr_id
    JOIN commit c ON m.sha=c.sha JOIN commit_file f ON c.sha=f.sha""",
)
def j02(t: Tables):
    return joins.pr_changed_files(t.pull_request, t.pr_commit, t.commit, t.commit_file).select(
        "project_id", "pr_id", "sha", "filename", "status"
    )


@query(
    "j03_outer_written_inner",
    """SELECT m.project_id, m.pr_id, f.sha, f.filename
    FROM commit_file f LEFT JOIN pr_commit m ON f.sha=m.sha WHERE m.project_id IS NOT NULL""",
)
def j03(t: Tables):
    return joins.files_of_prs(t.pr_commit, t.commit_file).select(
        "project_id", "pr_id", "sha", "filename"
    )


@query(
    "j04_pr_commits_with_or_without_files",
    """SELECT m.project_id, m.pr_id, m.sha, f.filename FROM commit_file f
    RIGHT JOIN pr_commit m ON m.sha=f.sha AND f.status<>'removed'""",
)
def j04(t: Tables):
    return joins.pr_commits_with_files(
        t.pr_commit, t.commit_file, F.col("status") != "removed"
    ).select("project_id", "pr_id", "sha", "filename")


PAIRS = """SELECT a.project_id, a.pr_id, count(*) AS n_prior, min(b.pr_id) AS lowest_prior
    FROM pull_request a JOIN pull_request b ON a.project_id=b.project_id AND b.is_closed
      AND {extra} b.age_in_day BETWEEN a.age_in_day+{low} AND a.age_in_day+90
    GROUP BY 1, 2"""


@query("j05_prior_window_join", PAIRS.format(extra="b.pr_id<a.pr_id AND", low=0))
def j05(t: Tables):
    return intervals.prior_window_lower(t.pull_request)


@query("j06_open_window_join", PAIRS.format(extra="", low=1))
def j06(t: Tables):
    return intervals.prior_window_summary(t.pull_request, low=1)


@query(
    "j06_open_window_counts",
    """SELECT a.project_id, a.pr_id, count(b.pr_id) AS n_prior
    FROM pull_request a LEFT JOIN pull_request b ON a.project_id=b.project_id AND b.is_closed
      AND b.age_in_day BETWEEN a.age_in_day+1 AND a.age_in_day+90
    GROUP BY 1, 2""",
)
def j06b(t: Tables):
    return intervals.prior_window_counts(t.pull_request)


@query(
    "j07_semi_join_on_subquery",
    """SELECT project_id, pr_id, sha FROM pr_commit
    WHERE sha IN (SELECT sha FROM commit_file WHERE status='added')""",
)
def j07(t: Tables):
    return joins.existing(t.pr_commit, t.commit_file.filter("status = 'added'"), ["sha"])


@query(
    "j08_anti_join_processed",
    """SELECT project_id, pr_id, sha FROM pr_commit m
    WHERE NOT EXISTS (SELECT 1 FROM fork_commit c WHERE c.sha=m.sha AND c.category='only_F')""",
)
def j08(t: Tables):
    return joins.absent(t.pr_commit, t.fork_commit.filter("category = 'only_F'"), ["sha"])


@query(
    "j09_forks_with_upstream",
    "SELECT repo_id, fork_url, upstream_id, upstream_url FROM fork_pair",
)
def j09(t: Tables):
    return joins.forks_with_upstream(t.repository)


@query(
    "j10_follower_names",
    """SELECT f.user_id, f.follower_id, f.followed_at, u.login AS user_login,
      v.login AS follower_login FROM follower f
    JOIN user_account u ON u.user_id=f.user_id JOIN user_account v ON v.user_id=f.follower_id""",
)
def j10(t: Tables):
    return joins.follower_names(t.follower, t.user_account)


@query(
    "j11_first_follow_before_pr",
    """SELECT DISTINCT p.project_id, p.pr_id FROM pull_request p
    JOIN follower f ON f.user_id=p.closer_id AND f.follower_id=p.author_id
      AND p.created_at>f.followed_at
    WHERE p.closer_id<>p.author_id AND p.is_closed""",
)
def j11(t: Tables):
    from forklore.plans.social import social_connection

    return (
        social_connection(t.pull_request, t.follower)
        .filter("social_connection")
        .select("project_id", "pr_id")
    )


@query(
    "j12_fork_pr_history",
    """SELECT f.fork_url, f.upstream_url, h.pr_id, h.action FROM fork_pair f
    JOIN pr_history h ON h.repo_id=f.repo_id""",
)
def j12(t: Tables):
    return joins.forks_with_upstream(t.repository).join(t.pr_history, "repo_id").select(
        "fork_url", "upstream_url", "pr_id", "action"
    )


@query(
    "j12_fork_pr_history_by_base",
    """WITH pr AS (SELECT DISTINCT repo_id AS head, pr_id,
      CASE WHEN pr_id%3=0 THEN repo_id-1 ELSE repo_id-repo_id%5 END AS base FROM pr_history)
    SELECT f.fork_url, f.upstream_url, pr.pr_id, h.action FROM fork_pair f
    JOIN pr ON pr.head=f.repo_id AND pr.base=f.upstream_id
    LEFT JOIN (SELECT repo_id, pr_id, action FROM pr_history WHERE action<>'opened') h
      ON h.pr_id=pr.pr_id AND h.repo_id=pr.head""",
)
def j12b(t: Tables):
    head = F.concat_ws("-", "repo_id", "pr_id").alias("pr_id")  # numbers are those of a fork here
    base = F.when(F.col("pr_id") % 3 == 0, F.col("repo_id") - 1).otherwise(F.col("repo_id") - F.col("repo_id") % 5)
    prs = t.pr_history.select(
        head, F.col("repo_id").alias("head_repo_id"), base.alias("base_repo_id"), F.col("pr_id").alias("number")
    ).distinct()
    history = t.pr_history.filter("action <> 'opened'").select(head, "action")
    found = joins.fork_pull_requests(joins.forks_with_upstream(t.repository), prs, history)
    return found.join(prs.select("pr_id", "number"), "pr_id").select(
        "fork_url", "upstream_url", F.col("number").alias("pr_id"), "action"
    )


COPIES = """copy AS (SELECT DISTINCT l_suppkey AS repo_id, l_partkey AS sha FROM lineitem),
    mine AS (SELECT repo_id, repo_id - repo_id%5 AS parent_id, sha FROM copy)"""


def _copies(t: Tables):
    copies = t.lineitem.select(
        F.col("l_suppkey").alias("repo_id"), F.col("l_partkey").alias("sha")
    ).distinct()
    mine = copies.withColumn("parent_id", F.col("repo_id") - F.col("repo_id") % 5)
    return mine, copies


@query(
    "j13_foreign_copies_theta",
    f"""WITH {COPIES}
    SELECT m.repo_id, count(*) AS n_pairs FROM mine m JOIN copy c
      ON c.sha=m.sha AND c.repo_id<>m.parent_id GROUP BY 1""",
)
def j13(t: Tables):
    mine, copies = _copies(t)
    return joins.foreign_copies(mine, copies).filter("n_pairs > 0")


@query(
    "j13_unmerged_commits",
    f"""WITH {COPIES}
    SELECT m.repo_id, count(*) AS n_unmerged FROM mine m WHERE NOT EXISTS (
      SELECT 1 FROM copy c WHERE c.repo_id=m.parent_id AND c.sha=m.sha) GROUP BY 1""",
)
def j13b(t: Tables):
    mine, copies = _copies(t)
    return joins.unmerged_commits(mine, copies).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_unmerged")
    )


@query(
    "j14_project_facts",
    """SELECT f.fork_url, coalesce(r.stars, -1) AS stars, r.language, r.pushed_on, r.description
    FROM fork_pair f LEFT JOIN (SELECT * FROM repository WHERE repo_id%6<>0) r
      ON r.url=f.fork_url""",
)
def j14(t: Tables):
    known = t.repository.filter(F.col("repo_id") % 6 != 0)
    facts = {c: c for c in ("stars", "language", "pushed_on", "description")}
    return joins.lookup(
        t.fork_pair.select("fork_url"), known, {"fork_url": "url"}, facts
    ).withColumn("stars", F.coalesce("stars", F.lit(-1)))


@query(
    "j14_stars_or_default",
    """SELECT f.fork_url, CASE WHEN r.url IS NULL THEN -1 ELSE coalesce(r.stars, 0) END AS stars
    FROM fork_pair f LEFT JOIN (SELECT url, CASE WHEN repo_id%4<>0 THEN stars END AS stars
      FROM repository WHERE repo_id%6<>0) r ON r.url=f.fork_url""",
)
def j14b(t: Tables):
    known = t.repository.filter(F.col("repo_id") % 6 != 0).withColumn(
        "stars", F.when(F.col("repo_id") % 4 != 0, F.col("stars"))
    )
    return joins.stars_or_default(t.fork_pair.select("fork_url"), known, "fork_url")


@query(
    "j15_keyed_result_join",
    """SELECT r.repo_id, r.stars, c.n_commits, h.n_prs FROM repository r
    LEFT JOIN (SELECT repo_id, count(*) AS n_commits FROM fork_commit GROUP BY 1) c
      ON c.repo_id=r.repo_id
    LEFT JOIN (SELECT repo_id, count(DISTINCT pr_id) AS n_prs FROM pr_history GROUP BY 1) h
      ON h.repo_id=r.repo_id""",
)
def j15(t: Tables):
    from forklore.plans.summary import join_metrics

    commits = t.fork_commit.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_commits"))
    prs = t.pr_history.groupBy("repo_id").agg(F.count_distinct("pr_id").alias("n_prs"))
    return join_metrics(t.repository.select("repo_id", "stars"), [commits, prs], ["repo_id"])


@query(
    "j16_names_inside_others",
    """WITH n AS (SELECT DISTINCT url AS name FROM repository)
    SELECT DISTINCT a.name FROM n a JOIN n b ON contains(b.name, a.name) AND a.name<>b.name""",
)
def j16(t: Tables):
    return joins.names_inside_others(t.repository.select(F.col("url").alias("name")))


@query(
    "j17_nearest_head_membership",
    """WITH RECURSIVE walk AS (
      SELECT pair_id, side, sha AS head, sha, 0 AS d FROM side_head
      UNION
      SELECT w.pair_id, w.side, w.head, e.parent, w.d+e.parent_pos FROM walk w
      JOIN dag_edge e ON e.pair_id=w.pair_id AND e.sha=w.sha WHERE e.parent IS NOT NULL),
    near AS (SELECT pair_id, side, sha, min(row(d, head)) AS best FROM walk GROUP BY 1, 2, 3)
    SELECT n.pair_id, n.side, n.sha, h.sha AS head, n.best[1]::INT AS distance,
      date_diff('day', CAST(c.commit_at AS DATE), CAST(h.head_at AS DATE)) AS days_to_head
    FROM near n JOIN side_head h ON h.pair_id=n.pair_id AND h.side=n.side AND h.sha=n.best[2]
    JOIN dag c ON c.pair_id=n.pair_id AND c.sha=n.sha""",
)
def j17(t: Tables):
    heads = t.stored("side_head")
    near = nearest_heads(t.stored("dag_edge"), heads)
    dates = t.dag.select("pair_id", "sha", "commit_at")
    known = heads.select("pair_id", "side", F.col("sha").alias("head"), "head_at")
    days = F.datediff("head_at", "commit_at").cast("long").alias("days_to_head")
    return (
        near.join(known, ["pair_id", "side", "head"])
        .join(dates, ["pair_id", "sha"])
        .select("pair_id", "side", "sha", "head", "distance", days)
    )


@query(
    "j19_core_team_members",
    """SELECT DISTINCT m.project_id, m.login, coalesce(f.in_final, false) AS in_final
    FROM (SELECT project_id, unnest(string_split(
        concat(login, ', ', 'lead', CAST(project_id AS STRING)), ', ')) AS login
      FROM member_login) m
    LEFT JOIN (SELECT project_id, true AS in_final FROM project WHERE project_id%3=0) f
      ON f.project_id=m.project_id""",
)
def j19(t: Tables):
    teams = t.member_login.select(
        "project_id", F.concat_ws(", ", "login", F.concat(F.lit("lead"), "project_id")).alias(
            "members"
        )
    )
    finals = t.project.filter(F.col("project_id") % 3 == 0)
    return joins.core_team_members(teams, finals).distinct()
