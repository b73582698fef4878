"""Aggregations (A1 - A19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore.catalog.metrics import EASINESS, LINKS, SOURCE_SUFFIXES, _easiness, written_links
from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.operators import aggregates as agg
from forklore.operators.dag import fork_tree
from forklore.plans import easiness as ease
from forklore.plans import summary


@query(
    "a01_distinct_reference_pairs",
    """SELECT DISTINCT thread_id, ref_pr_id FROM timeline_full
    WHERE event='cross-referenced' AND thread_type='issue' AND ref_type='pull_request'
      AND project_id=ref_pr_id%25""",
)
def a01(t: Tables):
    condition = (
        (F.col("event") == "cross-referenced")
        & (F.col("thread_type") == "issue")
        & (F.col("ref_type") == "pull_request")
        & (F.col("project_id") == F.col("ref_pr_id") % 25)
    )
    return agg.distinct_pairs(t.timeline_full, condition, "thread_id", "ref_pr_id")


@query(
    "a02_added_and_modified_files_per_pr",
    """SELECT DISTINCT m.project_id, m.pr_id, f.status, f.filename FROM pr_commit m
    JOIN commit_file f ON f.sha=m.sha WHERE f.status IN ('added', 'modified')""",
)
def a02(t: Tables):
    # One row per member of the set: a pull request may change any number of files.
    kept = t.commit_file.filter(F.col("status").isin("added", "modified"))
    return t.pr_commit.join(kept, "sha").select(
        "project_id", "pr_id", "status", "filename"
    ).distinct()


@query(
    "a03_counts_per_upstream",
    """SELECT p.project_id, count(*) AS n_prs, sum(CASE WHEN u.login LIKE 'bot%' THEN 1 ELSE 0 END)
      ::BIGINT AS n_by_bots FROM pull_request p JOIN user_account u ON u.user_id=p.author_id
    GROUP BY 1""",
)
def a03(t: Tables):
    return t.pr_author.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_prs"),
        F.count_if(F.col("author_login").startswith("bot")).alias("n_by_bots"),
    )


@query(
    "a03_upstream_totals",
    """WITH pair AS (SELECT repo_id, upstream_id, repo_id%50 AS owner_id FROM fork_pair),
    p AS (SELECT project_id*5 AS upstream_id, count(*) AS n FROM pull_request GROUP BY 1),
    c AS (SELECT pair.upstream_id, count(*) AS n, count(*) FILTER (login_id%50=owner_id) AS o
      FROM commit x JOIN pair ON pair.repo_id=x.repo_id GROUP BY 1)
    SELECT u.upstream_id, coalesce(p.n, 0) AS n_prs, coalesce(c.n, 0) AS n_commits,
      coalesce(c.o, 0) AS n_by_owner FROM (SELECT DISTINCT upstream_id FROM pair) u
    LEFT JOIN p ON p.upstream_id=u.upstream_id LEFT JOIN c ON c.upstream_id=u.upstream_id""",
)
def a03b(t: Tables):
    pairs = t.fork_pair.select("repo_id", "upstream_id", (F.col("repo_id") % 50).alias("owner_id"))
    prs = t.pull_request.select((F.col("project_id") * 5).alias("upstream_id"), "pr_id")
    commits = t.commit.select("repo_id", "sha", (F.col("login_id") % 50).alias("author_id"))
    return agg.upstream_totals(pairs, prs, commits)


@query(
    "a04_pr_states_per_fork",
    """WITH s AS (SELECT repo_id, pr_id, bool_or(action='merged') AS m, bool_or(action='closed') AS c
      FROM pr_history GROUP BY 1, 2)
    SELECT repo_id, count(*) AS submitted, count(*) FILTER (m) AS merged,
      count(*) FILTER (NOT m AND c) AS closed, count(*) FILTER (NOT m AND NOT c) AS open
    FROM s GROUP BY 1""",
)
def a04(t: Tables):
    return agg.pr_states_per_fork(t.pr_history)


@query(
    "a05_distinct_counts",
    """SELECT project_id, count(DISTINCT sha) AS n_commits, count(DISTINCT pr_id) AS n_prs
    FROM pr_commit GROUP BY 1""",
)
def a05(t: Tables):
    return t.pr_commit.groupBy("project_id").agg(
        F.count_distinct("sha").alias("n_commits"), F.count_distinct("pr_id").alias("n_prs")
    )


@query(
    "a06_upstreams_with_many_hard_forks",
    """WITH hard AS (SELECT fork_url, upstream_url FROM fork_pair WHERE repo_id%3<>0)
    SELECT DISTINCT fork_url, upstream_url FROM hard WHERE upstream_url IN (
      SELECT upstream_url FROM hard GROUP BY 1 HAVING count(DISTINCT fork_url)>2)""",
)
def a06(t: Tables):
    hard = t.fork_pair.filter(F.col("repo_id") % 3 != 0)
    return agg.upstreams_with_many(hard, "upstream_url", "fork_url", more_than=2)


def _fork_prs(t: Tables):
    return t.sql(
        """SELECT h.repo_id, h.pr_id, h.author, h.owner FROM (
        SELECT author_id%100 AS repo_id, pr_id, concat('user', CAST(author_id%7 AS STRING)) AS author,
          concat('user', CAST(author_id%100%7 AS STRING)) AS owner FROM pull_request) h"""
    )


@query(
    "a07_external_contribution",
    """WITH h AS (SELECT author_id%100 AS repo_id, pr_id, author_id%7 AS author,
        author_id%100%7 AS owner FROM pull_request)
    SELECT repo_id, count(*) FILTER (author<>owner) AS external_prs,
      count(DISTINCT CASE WHEN author<>owner THEN author END) AS external_authors,
      count(*) AS all_prs FROM h GROUP BY 1""",
)
def a07(t: Tables):
    return agg.external_contribution(_fork_prs(t))


@query(
    "a08_commits_per_pr",
    "SELECT project_id, pr_id, count(*) AS num_commit FROM pr_commit GROUP BY 1, 2",
)
def a08(t: Tables):
    return agg.count_by(t.pr_commit, "project_id", "pr_id", name="num_commit")


@query(
    "a08_comments_per_pr",
    "SELECT project_id, pr_id, count(*) AS num_comments FROM pr_comment GROUP BY 1, 2",
)
def a08b(t: Tables):
    return agg.count_by(t.pr_comment, "project_id", "pr_id", name="num_comments")


@query(
    "a09_easiness_by_published_rule",
    """WITH f AS (
      SELECT pc.project_id, pc.pr_id, f.filename, bool_or(f.status='added') AS a,
        bool_or(f.status='modified') AS m,
        f.filename LIKE '%.java' OR f.filename LIKE '%.py' AS s
      FROM pr_commit pc JOIN commit_file f ON f.sha=pc.sha GROUP BY 1, 2, 3)
    SELECT project_id, pr_id,
      coalesce(sum(a::INT)/nullif(sum(a::INT)+sum(m::INT), 0), 0) AS easiness,
      coalesce(sum((a AND s)::INT)/nullif(sum(((a OR m) AND s)::INT), 0), 0)
        AS easiness_filtered FROM f GROUP BY 1, 2""",
)
def a09(t: Tables):
    return ease.easiness(
        t.pull_request, t.pr_commit, t.commit, t.commit_file, SOURCE_SUFFIXES, compat=True
    )


@query(
    "a10_project_easiness",
    f"""WITH {EASINESS},
    r AS (SELECT e.*, CASE WHEN p.is_merged THEN 'merged' WHEN p.is_closed THEN 'rejected' END AS v
      FROM easy e JOIN pull_request p ON p.project_id=e.project_id AND p.pr_id=e.pr_id),
    x AS (SELECT *, 'all' AS verdict FROM r UNION ALL SELECT *, v FROM r WHERE v IS NOT NULL)
    SELECT project_id, verdict, count(*) AS n_prs,
      round(avg(easiness), 6) AS mean_easiness, round(median(easiness), 6) AS median_easiness,
      round(exp(avg(CASE WHEN easiness>0 THEN ln(easiness) END)), 6) AS geomean_easiness,
      round(avg(easiness_filtered), 6) AS mean_filtered,
      round(median(easiness_filtered), 6) AS median_filtered,
      round(exp(avg(CASE WHEN easiness_filtered>0 THEN ln(easiness_filtered) END)), 6)
        AS geomean_filtered
    FROM x GROUP BY 1, 2""",
)
def a10(t: Tables):
    return ease.project_easiness(t.pull_request, _easiness(t))


@query(
    "a11_change_sizes",
    """WITH s AS (
      SELECT p.project_id, p.pr_id,
        sum(CASE WHEN f.filename LIKE '%.java' OR f.filename LIKE '%.py' THEN additions ELSE 0 END)
          AS loc,
        count(DISTINCT f.filename) AS n_files,
        sum(CASE WHEN status='added' THEN additions ELSE 0 END)
          / nullif(sum(CASE WHEN status<>'removed' THEN additions ELSE 0 END), 0) AS easiness_loc
      FROM pr_commit p JOIN commit_file f ON f.sha=p.sha GROUP BY 1, 2)
    SELECT project_id, round(avg(loc), 6) AS mean_loc, round(median(loc), 6) AS median_loc,
      round(avg(n_files), 6) AS mean_files, round(median(n_files), 6) AS median_files,
      round(avg(easiness_loc), 6) AS mean_easiness_loc,
      round(median(easiness_loc), 6) AS median_easiness_loc
    FROM s GROUP BY 1""",
)
def a11(t: Tables):
    return ease.project_change_sizes(
        ease.change_sizes(t.pull_request, t.pr_commit, t.commit_file, SOURCE_SUFFIXES)
    )


STATUS = """SELECT project_id, count(*) AS n_prs, count(*) FILTER (is_merged) AS n_merged,
      count(*) FILTER (is_closed AND NOT is_merged) AS n_rejected,
      count(*) FILTER (NOT is_closed) AS n_open,
      round(count(*) FILTER (is_merged)/count(*), 6) AS merged_ratio,
      round(count(*) FILTER (is_closed AND NOT is_merged)/count(*), 6) AS rejected_ratio,
      round(count(*) FILTER (NOT is_closed)/count(*), 6) AS open_ratio
    FROM pull_request GROUP BY 1"""


@query("a12_pr_status_ratios", STATUS)
def a12(t: Tables):
    return agg.status_ratios(t.pull_request)


@query(
    "a13_issue_before_pr",
    f"""WITH {LINKS},
    l AS (SELECT p.project_id, p.pr_id, bool_or(k.issue_created_on < CAST(p.created_at AS DATE)) AS first
      FROM link k JOIN pull_request p ON p.project_id=k.project_id AND p.pr_id=k.pr_id GROUP BY 1, 2)
    SELECT project_id, count(*) AS n_linked, count(*) FILTER (first) AS n_issue_first,
      round(count(*) FILTER (first)/count(*), 6) AS ratio FROM l GROUP BY 1""",
)
def a13(t: Tables):
    return summary.issue_before_pr(written_links(t), t.pull_request)


@query(
    "a14_merge_experience",
    """WITH a AS (SELECT project_id, author_id, count(*) FILTER (is_merged) AS n
      FROM pull_request GROUP BY 1, 2)
    SELECT project_id, median(n) AS median_merge_experience FROM a GROUP BY 1""",
)
def a14(t: Tables):
    return summary.merge_experience(t.pull_request)


@query(
    "a15_active_fork_counts",
    """SELECT parent_id, count(*) AS n_forks, count(*) FILTER (created_on<pushed_on) AS n_active,
      round(count(*) FILTER (created_on<pushed_on)/count(*), 6) AS active_share
    FROM repository WHERE is_fork GROUP BY 1""",
)
def a15(t: Tables):
    return summary.active_fork_counts(t.repository)


@query(
    "a15_first_level_share",
    """WITH RECURSIVE tree AS (
      SELECT repo_id AS root_id, repo_id, 0 AS level FROM repository_tree
        WHERE parent_id IS NULL OR parent_id NOT IN (SELECT repo_id FROM repository_tree)
      UNION ALL
      SELECT tr.root_id, r.repo_id, tr.level+1 FROM tree tr
      JOIN repository_tree r ON r.parent_id=tr.repo_id)
    SELECT root_id, count(*) FILTER (level=1) AS n_first_level, count(*) AS n_all,
      round(count(*) FILTER (level=1)/count(*), 6) AS share
    FROM tree WHERE level>0 GROUP BY 1""",
)
def a15b(t: Tables):
    return summary.first_level_share(fork_tree(t.repository_tree))


@query(
    "a16_co_change_support",
    """WITH k AS (SELECT DISTINCT sha, filename FROM commit_file)
    SELECT a.filename AS file_a, b.filename AS file_b, count(*) AS support
    FROM k a JOIN k b ON a.sha=b.sha AND a.filename<=b.filename GROUP BY 1, 2""",
)
def a16(t: Tables):
    return agg.co_change_support(t.commit_file)


@query(
    "a17_category_counts",
    """SELECT repo_id, count(*) FILTER (category='only_F') AS "only_F", 0::BIGINT AS "only_U",
      count(*) FILTER (category='F2U') AS "F2U", count(*) FILTER (category='U2F') AS "U2F",
      0::BIGINT AS before FROM fork_commit GROUP BY 1""",
)
def a17(t: Tables):
    return agg.category_counts(t.fork_commit, "repo_id")


@query(
    "a18_category_dates",
    """SELECT repo_id, category, min(committed_at) AS first_at, max(committed_at) AS last_at
    FROM fork_commit GROUP BY 1, 2""",
)
def a18(t: Tables):
    return agg.category_dates(t.fork_commit, "repo_id")


@query(
    "a19_participant_set_sizes",
    "SELECT thread_id, count(DISTINCT actor_id) AS n_members FROM timeline GROUP BY 1",
)
def a19(t: Tables):
    return agg.set_sizes(t.timeline, ["thread_id"], "actor_id")
