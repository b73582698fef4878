"""Projections, filters and predicates (P1 - P21)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from forklore.catalog.metrics import SOURCE_SUFFIXES
from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.operators import filters as flt
from forklore.operators.aggregates import category_counts
from forklore.operators.joins import flag_members, lookup

# Word lists used on the derived tables.
STOP_WORDS = ["F1", ".md"]
NON_DEVELOPMENT_WORDS = ["Owner1", "repo33"]


@query("p01_closed_prs", "SELECT project_id, pr_id, created_at FROM pull_request WHERE is_closed")
def p01(t: Tables):
    return flt.closed_prs(t.pull_request).select("project_id", "pr_id", "created_at")


@query(
    "p02_external_prs_by_verdict",
    """SELECT project_id, pr_id, author_login FROM pr_author p
    WHERE is_merged AND author_login NOT LIKE '%bot%' AND NOT EXISTS (
      SELECT 1 FROM member_login m WHERE m.project_id=p.project_id AND m.login=p.author_login)""",
)
def p02(t: Tables):
    return flt.external_prs_by_verdict(t.pr_author, t.member_login, merged=True).select(
        "project_id", "pr_id", "author_login"
    )


@query(
    "p03_rejected_prs",
    """SELECT p.project_id, p.pr_id, j.url FROM pull_request p JOIN project j
    ON j.project_id=p.project_id WHERE p.is_closed AND NOT p.is_merged""",
)
def p03(t: Tables):
    return flt.rejected_prs(t.pull_request, t.project).select("project_id", "pr_id", "url")


@query(
    "p04_prs_without_metric",
    """SELECT project_id, pr_id FROM pull_request p WHERE NOT EXISTS (
      SELECT 1 FROM pr_comment c WHERE c.project_id=p.project_id AND c.pr_id=p.pr_id
        AND c.body LIKE 'needs%')""",
)
def p04(t: Tables):
    done = t.pr_comment.filter(F.col("body").startswith("needs"))
    return flt.without_metric(t.pull_request, done, ["project_id", "pr_id"]).select(
        "project_id", "pr_id"
    )


@query(
    "p05_source_files",
    """SELECT sha, filename, status, additions FROM commit_file
    WHERE lower(filename) LIKE '%.java' OR lower(filename) LIKE '%.py'""",
)
def p05(t: Tables):
    return flt.source_files(t.commit_file, SOURCE_SUFFIXES)


@query(
    "p06_without_stop_files",
    """SELECT DISTINCT filename FROM commit_file
    WHERE NOT contains(lower(filename), 'f1') AND NOT contains(lower(filename), '.md')""",
)
def p06(t: Tables):
    return flt.without_stop_files(t.commit_file, STOP_WORDS).select("filename").distinct()


@query(
    "p07_development_forks",
    """SELECT fork_url, upstream_url FROM fork_pair
    WHERE NOT contains(fork_url, 'owner1') AND NOT contains(fork_url, 'repo33')
      AND NOT contains(upstream_url, 'owner1') AND NOT contains(upstream_url, 'repo33')""",
)
def p07(t: Tables):
    return flt.development_forks(t.fork_pair, NON_DEVELOPMENT_WORDS).select(
        "fork_url", "upstream_url"
    )


@query(
    "p08_active_forks",
    "SELECT repo_id, url FROM repository WHERE is_fork AND created_on < pushed_on",
)
def p08(t: Tables):
    return flt.active_forks(t.repository).select("repo_id", "url")


@query(
    "p09_contributing_forks",
    "SELECT DISTINCT repo_id FROM fork_commit WHERE category IN ('only_F', 'F2U')",
)
def p09(t: Tables):
    return flt.contributing_forks(category_counts(t.fork_commit, "repo_id"))


EXTERNAL = """SELECT project_id, sha, login FROM commit_login c
    WHERE {null} AND NOT EXISTS (
      SELECT 1 FROM member_login m WHERE m.project_id=c.project_id AND m.login=c.login)"""


@query("p10_external_commits", EXTERNAL.format(null="login NOT LIKE '%bot%'"))
def p10(t: Tables):
    return flt.external_commits(t.commit_login, t.member_login).select(
        "project_id", "sha", "login"
    )


@query(
    "p10_external_commits_null_kept",
    EXTERNAL.format(null="(login IS NULL OR login NOT LIKE '%bot%')"),
)
def p10b(t: Tables):
    return flt.external_commits(t.commit_login, t.member_login, keep_null_author=True).select(
        "project_id", "sha", "login"
    )


@query(
    "p11_small_commits",
    """SELECT sha, filename, status FROM commit_file WHERE sha IN (
      SELECT sha FROM commit_file GROUP BY sha HAVING count(*)<=2)""",
)
def p11(t: Tables):
    return flt.small_commits(t.commit_file, 2).select("sha", "filename", "status")


@query(
    "p12_added_or_modified",
    "SELECT sha, filename, status FROM commit_file WHERE status IN ('added', 'modified')",
)
def p12(t: Tables):
    return flt.added_or_modified(t.commit_file).select("sha", "filename", "status")


STALE = """stale AS (
  SELECT b.pair_id, b.branch, b.sha, b.head_at
  FROM dag_branch b LEFT JOIN dag_fork_point f ON f.pair_id=b.pair_id
  JOIN (SELECT pair_id, count(*) AS n FROM dag_branch GROUP BY 1) s ON s.pair_id=b.pair_id
  WHERE (s.n>1 AND b.head_at<f.forked_at) OR year(b.head_at) NOT BETWEEN 2000 AND 2099)"""


@query("p13_stale_branches", f"WITH {STALE} SELECT * FROM stale")
def p13(t: Tables):
    return flt.stale_branches(t.dag_branch, t.dag_fork_point)


@query(
    "p14_reconciled_branches",
    f"""WITH {STALE}
    SELECT s.pair_id, s.branch, s.sha,
      CASE WHEN u.sha IS NULL THEN 'ignore_fork' WHEN u.sha=s.sha THEN 'ignore_both'
        ELSE 'keep' END AS verdict
    FROM stale s LEFT JOIN dag_up_branch u ON u.pair_id=s.pair_id AND u.branch=s.branch""",
)
def p14(t: Tables):
    return flt.reconcile_stale(flt.stale_branches(t.dag_branch, t.dag_fork_point), t.dag_up_branch)


@query(
    "p15_forks_seen_in_prs",
    """SELECT DISTINCT project_url, fork_url FROM pr_author
    WHERE fork_url<>'' AND fork_url<>project_url""",
)
def p15(t: Tables):
    return flt.forks_seen_in_prs(t.pr_author)


@query(
    "p16_lookups",
    """SELECT p.project_id, p.pr_id, j.url AS project_url, a.login AS author_login,
      c.login AS closer_login FROM pull_request p
    LEFT JOIN project j ON j.project_id=p.project_id
    LEFT JOIN user_account a ON a.user_id=p.author_id
    LEFT JOIN user_account c ON c.user_id=p.closer_id""",
)
def p16(t: Tables):
    prs = lookup(t.pull_request, t.project, {"project_id": "project_id"}, {"project_url": "url"})
    prs = lookup(prs, t.user_account, {"author_id": "user_id"}, {"author_login": "login"})
    prs = lookup(prs, t.user_account, {"closer_id": "user_id"}, {"closer_login": "login"})
    return prs.select("project_id", "pr_id", "project_url", "author_login", "closer_login")


@query(
    "p17_repositories_to_refresh",
    """WITH known AS (SELECT url FROM repository WHERE repo_id%7<>0)
    SELECT DISTINCT url FROM (
      SELECT fork_url AS url FROM fork_pair UNION ALL SELECT upstream_url FROM fork_pair) u
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.url=u.url)""",
)
def p17(t: Tables):
    facts = t.repository.withColumn(
        "pushed_on", F.when(F.col("repo_id") % 7 != 0, F.col("pushed_on"))
    )
    return flt.repositories_to_refresh(t.fork_pair, facts)


@query(
    "p18_own_commits",
    "SELECT repo_id, sha, category FROM fork_commit WHERE category IN ('only_F', 'F2U')",
)
def p18(t: Tables):
    flagged = t.fork_commit.withColumn(
        "f2u", F.when(F.col("category") == "F2U", 1)
    ).withColumn("only_f", F.when(F.col("category") == "only_F", 1))
    return flt.own_commits(flagged).select("repo_id", "sha", "category")


@query(
    "p19_non_merge_commits_since",
    """SELECT DISTINCT pair_id AS project_id, sha, commit_at AS committed_at FROM dag
    WHERE (parent1 IS NULL OR parent2 IS NULL) AND commit_at > TIMESTAMP '1998-01-01'""",
)
def p19(t: Tables):
    commits = t.dag.select(
        F.col("pair_id").alias("project_id"),
        "sha",
        F.col("commit_at").alias("committed_at"),
        F.array_compact(F.array("parent1", "parent2")).alias("parents"),
    )
    return flt.non_merge_since(commits, F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz"))


@query(
    "p20_commits_by_authors",
    """WITH author AS (
      SELECT CASE WHEN user_id%3=0 THEN login END AS login,
        CASE WHEN user_id%3=1 THEN concat('mail', user_id, '@example.org') END AS email
      FROM user_account WHERE user_id%3<2)
    SELECT DISTINCT repo_id, sha, login, email FROM commit_login c
    WHERE login IN (SELECT login FROM author WHERE login IS NOT NULL)
      OR email IN (SELECT email FROM author WHERE email IS NOT NULL)""",
)
def p20(t: Tables):
    users, kind = t.user_account, F.col("user_id") % 3
    authors = users.filter(kind < 2).select(
        F.when(kind == 0, F.col("login")).alias("login"),
        F.when(kind == 1, F.concat(F.lit("mail"), "user_id", F.lit("@example.org"))).alias("email"),
    )
    return flt.commits_by_authors(
        t.commit_login.select("repo_id", "sha", "login", "email"), authors
    )


@query("p20_whole_repository", "SELECT DISTINCT repo_id, sha FROM branch_commit")
def p20b(t: Tables):
    return flt.whole_repository(t.branch_commit)


@query("p21_first_column", "SELECT url FROM repository")
def p21(t: Tables):
    return flt.first_column(t.repository.select("url", "repo_id"))


@query(
    "j18_core_team_flags",
    """SELECT p.project_id, p.pr_id, p.author_login,
      EXISTS (SELECT 1 FROM member_login m
        WHERE m.project_id=p.project_id AND m.login=p.author_login) AS is_core
    FROM pr_author p""",
)
def j18(t: Tables):
    members = t.member_login.withColumnRenamed("login", "author_login")
    prs = t.pr_author.select("project_id", "pr_id", "author_login")
    return flag_members(prs, members, ["project_id", "author_login"], "is_core")
