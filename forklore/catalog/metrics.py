"""Composite metrics (M1 - M26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.catalog.functions import CHANGES, FLAGS, any_match
from forklore.catalog.graphs import DISTANCE, dated_categories
from forklore.functions import text
from forklore.functions.text import unordered_pair_key
from forklore.operators.aggregates import external_contribution, status_ratios
from forklore.operators.groups import grouped_medians
from forklore.operators.joins import lookup, unmerged_commits
from forklore.operators.windows import comments_around_close, last_closer
from forklore.plans import (
    change_profile,
    classify,
    contribution,
    duplicates,
    evolution,
    hardforks,
    hotness,
    links,
    merge_status,
    modularity,
    summary,
    timeline,
)
from forklore.plans import easiness as ease
from forklore.plans.social import social_connection
from forklore.session import materialize

# Suffixes taken as source code in the derived tables.
SOURCE_SUFFIXES = [".java", ".py"]
PROFILE_COLUMNS = [
    "is_a", "is_c", "is_d", "is_m", "is_r", "lines_in_added_files", "lines_in_modified_files",
    "lines_deleted", "readme_lines_added",
]

TOUCHES = """
touch AS (
  SELECT pc.project_id, pc.pr_id, p.age_in_day, p.is_closed, pc.sha, f.filename,
    bool_or(f.status<>'removed') AS is_kept
  FROM pr_commit pc
  JOIN pull_request p ON p.project_id=pc.project_id AND p.pr_id=pc.pr_id
  JOIN commit_file f ON f.sha=pc.sha
  GROUP BY ALL
),
prior AS (
  SELECT a.project_id, a.pr_id, b.pr_id AS prior_pr_id
  FROM pull_request a JOIN pull_request b ON a.project_id=b.project_id AND b.pr_id<a.pr_id
    AND b.is_closed AND b.age_in_day BETWEEN a.age_in_day AND a.age_in_day+90
  WHERE a.is_closed
),
hot_file AS (
  SELECT DISTINCT q.project_id, q.pr_id, t.filename
  FROM prior q JOIN touch t ON t.project_id=q.project_id AND t.pr_id=q.prior_pr_id
  WHERE t.is_kept
)"""


@query(
    "m01_hot_commits_per_pr",
    f"""WITH {TOUCHES}
    SELECT p.project_id, p.pr_id,
      count(DISTINCT CASE WHEN h.filename IS NOT NULL THEN t.sha END) AS n_hot_commits
    FROM pull_request p LEFT JOIN touch t ON t.project_id=p.project_id AND t.pr_id=p.pr_id
    LEFT JOIN hot_file h
      ON h.project_id=t.project_id AND h.pr_id=t.pr_id AND h.filename=t.filename
    WHERE p.is_closed AND EXISTS (
      SELECT 1 FROM hot_file x WHERE x.project_id=p.project_id AND x.pr_id=p.pr_id)
    GROUP BY 1, 2""",
)
def m01(t: Tables):
    return hotness.hot_commits(t.pull_request, t.pr_commit, t.commit_file)


@query(
    "m02_hot_commits_local_changes",
    f"""WITH {TOUCHES}
    SELECT t.project_id, t.pr_id,
      count(DISTINCT CASE WHEN h.filename IS NOT NULL THEN t.sha END) AS n_hot_commits
    FROM touch t LEFT JOIN hot_file h
      ON h.project_id=t.project_id AND h.pr_id=t.pr_id AND h.filename=t.filename
    WHERE t.is_closed AND t.is_kept AND EXISTS (
      SELECT 1 FROM hot_file x WHERE x.project_id=t.project_id AND x.pr_id=t.pr_id)
    GROUP BY 1, 2""",
)
def m02(t: Tables):
    return hotness.hot_commits_local(t.pull_request, t.pr_commit, t.commit_file)


@query(
    "m03_hot_files_per_commit",
    f"""WITH {TOUCHES}
    SELECT t.project_id, t.pr_id, t.sha, count(*) AS n_hot_files
    FROM touch t JOIN hot_file h
      ON h.project_id=t.project_id AND h.pr_id=t.pr_id AND h.filename=t.filename
    WHERE t.is_closed GROUP BY 1, 2, 3""",
)
def m03(t: Tables):
    return hotness.hot_files_per_commit(t.pull_request, t.pr_commit, t.commit_file)


@query(
    "m04_commit_based_hotness",
    f"""WITH {TOUCHES},
    kept AS (SELECT * FROM touch WHERE is_kept AND is_closed),
    pair AS (
      SELECT a.project_id, a.pr_id, count(DISTINCT b.sha) AS n
      FROM (SELECT DISTINCT project_id, pr_id, age_in_day, filename FROM kept) a
      JOIN kept b ON b.project_id=a.project_id AND b.filename=a.filename AND b.pr_id<a.pr_id
        AND b.age_in_day BETWEEN a.age_in_day AND a.age_in_day+90
      GROUP BY 1, 2)
    SELECT k.project_id, k.pr_id, coalesce(max(p.n), 0) AS n_prior_commits
    FROM kept k LEFT JOIN pair p ON p.project_id=k.project_id AND p.pr_id=k.pr_id
    GROUP BY 1, 2""",
)
def m04(t: Tables):
    return hotness.commit_hotness(t.pull_request, t.pr_commit, t.commit_file)


EASINESS = """
per_file AS (
  SELECT pc.project_id, pc.pr_id, f.filename, bool_or(f.status='added') AS a,
    bool_or(f.status='modified') AS m,
    f.filename LIKE '%.java' OR f.filename LIKE '%.py' AS s
  FROM pr_commit pc JOIN commit_file f ON f.sha=pc.sha GROUP BY 1, 2, 3
),
easy AS (
  SELECT project_id, pr_id,
    coalesce(sum(a::INT)/nullif(sum((a OR m)::INT), 0), 0) AS easiness,
    coalesce(sum((a AND s)::INT)/nullif(sum(((a OR m) AND s)::INT), 0), 0)
      AS easiness_filtered
  FROM per_file GROUP BY 1, 2
)"""


def _easiness(t: Tables):
    return ease.easiness(
        t.pull_request, t.pr_commit, t.commit, t.commit_file, SOURCE_SUFFIXES
    )


@query("m05_easiness_per_pr", f"WITH {EASINESS} SELECT * FROM easy")
def m05(t: Tables):
    return _easiness(t)


REF = text.PR_REFERENCE
NOTICE = f"""notice AS (SELECT project_id, pr_id, min(comment_pos) AS comment_pos,
      min_by(commenter_id, comment_pos) AS commenter_id, min_by(body, comment_pos) AS body
    FROM pr_comment WHERE {any_match("lower(body)", text.DUPLICATE_COMMENT_LOOSE)} GROUP BY 1, 2),
    pair AS (SELECT DISTINCT n.project_id, n.pr_id, n.commenter_id,
      unnest(regexp_extract_all(n.body, '{REF}', 7))::BIGINT AS dup_pr_id
      FROM notice n JOIN pull_request p ON p.project_id=n.project_id AND p.pr_id=n.pr_id
      WHERE NOT p.is_merged)"""


def _distinct_comments(t: Tables):
    """Comments by distinct position: the derived ones may share a line number."""
    return t.sql(
        """SELECT project_id, pr_id, comment_pos, min(commenter_id) AS commenter_id,
        min(body) AS body FROM pr_comment GROUP BY 1, 2, 3"""
    )


NOTICE = NOTICE.replace(
    "FROM pr_comment WHERE",
    "FROM (SELECT project_id, pr_id, comment_pos, min(commenter_id) AS commenter_id,"
    " min(body) AS body FROM pr_comment GROUP BY 1, 2, 3) c WHERE",
)


@query(
    "m06_duplicate_comments",
    f"WITH {NOTICE} SELECT project_id, pr_id, comment_pos, commenter_id, body FROM notice",
)
def m06(t: Tables):
    return duplicates.duplicate_comments(_distinct_comments(t))


def _pairs(t: Tables):
    return duplicates.duplicate_pairs(m06(t), t.pull_request)


@query("m07_duplicate_pairs", f"WITH {NOTICE} SELECT * FROM pair")
def m07(t: Tables):
    return _pairs(t)


@query(
    "m08_duplicate_by_commit",
    f"""WITH {NOTICE} SELECT n.project_id, n.pr_id,
      trim(regexp_extract(n.body, '{text.COMMIT_SHA}', 0)) AS dup_sha
    FROM notice n JOIN pull_request p ON p.project_id=n.project_id AND p.pr_id=n.pr_id
    WHERE NOT p.is_merged AND regexp_matches(n.body, '{text.COMMIT_SHA}')""",
)
def m08(t: Tables):
    return duplicates.duplicate_commits(m06(t), t.pull_request)


@query(
    "m09_false_positive_duplicates",
    f"""WITH {NOTICE} SELECT DISTINCT d.project_id, d.pr_id, d.dup_pr_id FROM pair d
    JOIN pull_request p ON p.project_id=d.project_id AND p.pr_id=d.dup_pr_id
      AND p.author_id%25=d.commenter_id%25""",
)
def m09(t: Tables):
    group = (F.col("commenter_id") % 25).alias("commenter_id")
    pairs = _pairs(t).withColumn("commenter_id", group)
    prs = t.pull_request.withColumn("author_id", F.col("author_id") % 25)
    return duplicates.false_positive_duplicates(pairs, prs).distinct()


VERDICT = rf"""tl AS (SELECT *, CASE WHEN event='closed' AND thread_id%4<>0 THEN NULL ELSE sha END AS s,
      CASE WHEN event='merged' AND thread_id%3<>0 THEN 'referenced' ELSE event END AS e
      FROM timeline_full),
    fullsha AS (
      SELECT (event_id%300+event_id%7%2)%25 AS project_id, CAST(event_id*100+1 AS STRING) AS sha FROM events WHERE event_id%2=0
      UNION ALL SELECT (event_id%300+event_id%7%2)%25, CAST(1000000+event_id AS STRING) FROM events WHERE event_id%3=0),
    known AS (SELECT DISTINCT project_id, unnest([sha, left(sha, 7)]) AS sha FROM fullsha),
    ev AS (SELECT project_id, thread_id, 1 AS rank, max_by(CASE WHEN e='merged' THEN 'merged-1' ELSE 'merged-2' END,
      event_pos) AS v FROM tl WHERE e='merged' OR (e='closed' AND s IS NOT NULL) GROUP BY 1, 2),
    fc AS (SELECT project_id, thread_id, min(event_pos) AS pos FROM tl WHERE e='closed' GROUP BY 1, 2),
    c3 AS (SELECT t.thread_id, t.project_id, t.body, row_number() OVER (PARTITION BY t.project_id, t.thread_id
      ORDER BY t.event_pos DESC) AS r FROM tl t LEFT JOIN fc ON fc.project_id=t.project_id AND fc.thread_id=t.thread_id
      WHERE t.e='commented' AND (fc.pos IS NULL OR t.event_pos<fc.pos)),
    c AS (SELECT x.*, m.sha IS NOT NULL AS merged FROM (SELECT *, nullif(trim(regexp_extract(body,
        '{text.COMMIT_SHA}', 0)), '') AS mention FROM c3 WHERE r<=3) x
      LEFT JOIN known m ON m.sha=x.mention AND m.project_id=x.project_id),
    f AS (SELECT *, regexp_matches(lower(body), '{REF}') AS names,
      {any_match("body", text.DUPLICATE_COMMENT_LOOSE)} AS dup FROM c),
    lastc AS (SELECT project_id, thread_id, 2 AS rank, CASE
      WHEN mention IS NOT NULL AND NOT dup AND merged THEN 'merged-5'
      WHEN mention IS NOT NULL AND dup AND (names OR merged) THEN 'duplicate'
      WHEN names THEN 'rejected'
      WHEN regexp_matches(lower(body),
        '{text.MERGE_KEYWORDS_TYPE_4}')
        THEN 'merged-4' END AS v FROM f WHERE r=1),
    three AS (SELECT project_id, thread_id, 3 AS rank, 'merged-3' AS v FROM f WHERE merged
      AND {any_match("lower(body)", text.MERGE_KEYWORDS_BROAD)}),
    ref AS (SELECT t.project_id, t.thread_id, 4 AS rank, 'merged-2ref' AS v FROM tl t
      JOIN known k ON k.sha=CAST(t.s AS STRING) AND k.project_id=t.project_id WHERE t.e='referenced'),
    allc AS (SELECT * FROM ev UNION ALL SELECT * FROM lastc WHERE v IS NOT NULL
      UNION ALL SELECT * FROM three UNION ALL SELECT * FROM ref
      UNION ALL SELECT DISTINCT project_id, thread_id, 5, 'rejected' FROM tl),
    verdict AS (SELECT project_id, thread_id, min_by(v, rank) AS verdict FROM allc GROUP BY 1, 2),
    six AS (SELECT DISTINCT t.project_id, t.thread_id FROM tl t JOIN fullsha k ON k.sha=CAST(t.s AS STRING) AND k.project_id=t.project_id
      WHERE t.e='committed')"""


def _merge_inputs(t: Tables):
    timeline = t.timeline_full.withColumn(
        "sha",
        F.when((F.col("event") == "closed") & (F.col("thread_id") % 4 != 0), None)
        .otherwise(F.col("sha"))
        .cast("string"),
    ).withColumn(
        "event",
        F.when((F.col("event") == "merged") & (F.col("thread_id") % 3 != 0), "referenced")
        .otherwise(F.col("event")),
    )
    known = t.sql(
        """SELECT (event_id%300+event_id%7%2)%25 AS project_id, CAST(event_id*100+1 AS STRING) AS sha
        FROM events WHERE event_id%2=0
        UNION ALL SELECT (event_id%300+event_id%7%2)%25, CAST(1000000+event_id AS STRING) FROM events WHERE event_id%3=0"""
    )
    return timeline, known


@query("m10_merge_verdicts", f"WITH {VERDICT} SELECT project_id, thread_id, verdict FROM verdict")
def m10(t: Tables):
    return merge_status.merge_verdicts(*_merge_inputs(t))


@query(
    "m10_merge_flags",
    f"""WITH {VERDICT}
    SELECT v.project_id, v.thread_id, verdict='merged-1' AS merge_1, verdict='merged-2' AS merge_2,
      verdict='merged-2ref' AS merge_2ref, verdict='merged-3' AS merge_3,
      verdict='merged-4' AS merge_4, verdict='merged-5' AS merge_5,
      s.thread_id IS NOT NULL AS merge_6,
      verdict LIKE 'merged%' OR s.thread_id IS NOT NULL AS merge_any
    FROM verdict v LEFT JOIN six s ON s.project_id=v.project_id AND s.thread_id=v.thread_id""",
)
def m10b(t: Tables):
    timeline, known = _merge_inputs(t)
    return merge_status.merge_flags(
        merge_status.merge_verdicts(timeline, known),
        merge_status.merged_by_own_commits(timeline, known),
    )


@query(
    "m11_comments_before_and_after_close",
    """WITH c AS (SELECT project_id, thread_id, max(event_pos) AS pos FROM timeline_full
      WHERE event='closed' GROUP BY 1, 2),
    r AS (SELECT t.*, c.pos IS NULL OR t.event_pos<=c.pos AS b FROM timeline_full t
      LEFT JOIN c ON c.project_id=t.project_id AND c.thread_id=t.thread_id WHERE t.thread_type='pr')
    SELECT project_id, thread_id, count(*) FILTER (event='commented' AND b) AS comments_before,
      count(*) FILTER (event='commented') AS comments_total,
      count(*) FILTER (event='commented' AND NOT b) AS comments_after,
      count(DISTINCT CASE WHEN b THEN actor_id END) AS participants_before,
      count(DISTINCT actor_id) AS participants_total,
      count(DISTINCT actor_id)-count(DISTINCT CASE WHEN b THEN actor_id END) AS participants_after
    FROM r GROUP BY 1, 2""",
)
def m11(t: Tables):
    return comments_around_close(t.timeline_full.filter("thread_type = 'pr'"))


@query(
    "m12_pr_closer",
    """SELECT t.project_id, t.thread_id, u.login FROM (SELECT project_id, thread_id, max_by(actor_id, event_pos) AS closer_id
      FROM timeline_full WHERE event='closed' AND thread_type='pr' GROUP BY 1, 2) t
    LEFT JOIN user_account u ON u.user_id=t.closer_id""",
)
def m12(t: Tables):
    closers = last_closer(t.timeline_full.filter("thread_type = 'pr'"))
    return lookup(closers, t.user_account, {"closer_id": "user_id"}, {"login": "login"}).select(
        "project_id", "thread_id", "login"
    )


SOCIAL = """social AS (SELECT p.project_id, p.pr_id, p.closer_id<>p.author_id AND EXISTS (
      SELECT 1 FROM follower f WHERE f.user_id=p.closer_id AND f.follower_id=p.author_id
        AND p.created_at>f.followed_at) AS social_connection
    FROM pull_request p WHERE p.is_closed)"""


@query("m13_social_connection", f"WITH {SOCIAL} SELECT * FROM social")
def m13(t: Tables):
    return social_connection(t.pull_request, t.follower)


def _thread_authors(t: Tables):
    return t.sql(
        """SELECT DISTINCT project_id, thread_type, thread_id, thread_id%50 AS author_id
        FROM timeline_full WHERE thread_id%7<>0"""
    )


@query(
    "m14_core_team",
    """WITH a AS (SELECT DISTINCT project_id, thread_type, thread_id, thread_id%50 AS author_id
      FROM timeline_full WHERE thread_id%7<>0),
    l AS (SELECT *, lag(event) OVER (PARTITION BY project_id, thread_type, thread_id
      ORDER BY event_pos) AS p FROM timeline_full)
    SELECT project_id, actor_id FROM l WHERE event='closed' AND p='merged'
    UNION SELECT l.project_id, l.actor_id FROM l LEFT JOIN a ON a.project_id=l.project_id
      AND a.thread_type=l.thread_type AND a.thread_id=l.thread_id
      WHERE l.event='closed' AND (a.author_id IS NULL OR a.author_id<>l.actor_id)
    UNION SELECT project_id, actor_id FROM l WHERE event='commented'
      AND upper(association) IN ('MEMBER', 'OWNER', 'COLLABORATOR')""",
)
def m14(t: Tables):
    return timeline.core_team(t.timeline_full, _thread_authors(t))


@query(
    "m15_event_list",
    """SELECT project_id, thread_type, thread_id, event, count(*) AS n_events FROM timeline_full
    WHERE event<>'committed' GROUP BY ALL""",
)
def m15(t: Tables):
    return timeline.event_list(t.timeline_full)


REFERENCES = """refs AS (SELECT DISTINCT project_id, thread_type, thread_id, ref_pr_id AS ref_id,
      CASE WHEN ref_type='pull_request' THEN 'pr' ELSE 'issue' END AS ref_type, ref_state
      FROM timeline_full WHERE event='cross-referenced')"""


@query(
    "m16_resolved_references",
    f"""WITH {REFERENCES}
    SELECT r.*, concat('owner', r.ref_id%25, '/repo', r.ref_id) AS ref_project,
      p.repo_id AS ref_project_id FROM refs r
    LEFT JOIN repository p ON p.url=concat('owner', r.ref_id%25, '/repo', r.ref_id)""",
)
def m16(t: Tables):
    references = timeline.cross_references(t.timeline_full).withColumn(
        "ref_project",
        F.concat(F.lit("owner"), F.col("ref_id") % 25, F.lit("/repo"), F.col("ref_id")),
    )
    return timeline.resolve_reference_projects(references, t.repository)


@query(
    "m17_thread_labels",
    """SELECT DISTINCT project_id, thread_type, thread_id, label FROM timeline_full
    WHERE event='commented'""",
)
def m17(t: Tables):
    return timeline.thread_labels(t.timeline_full, event="commented")


@query(
    "m17_participants",
    """WITH a AS (SELECT project_id, actor_id, association, user_type FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, actor_id
        ORDER BY CASE WHEN event='commented' THEN 0 ELSE 1 END, event_pos) AS r
      FROM timeline_full) WHERE r=1)
    SELECT DISTINCT t.project_id, t.thread_type, t.thread_id, t.actor_id, a.association, a.user_type
    FROM timeline_full t JOIN a ON a.project_id=t.project_id AND a.actor_id=t.actor_id""",
)
def m17b(t: Tables):
    return timeline.participants(t.timeline_full)


LINKS = f"""texts AS (SELECT project_id, pr_id, body FROM pr_comment
      UNION ALL SELECT project_id, pr_id, concat(labels, ' #', pr_id+7) FROM pull_request
      UNION ALL SELECT project_id, pr_id, concat('fix #', sha%1000, ', see #', pr_id+3) FROM pr_commit),
    link AS (SELECT x.project_id, x.pr_id, x.issue_id, i.created_on AS issue_created_on FROM (
        SELECT DISTINCT project_id, pr_id,
          unnest(regexp_extract_all(body, '{text.ISSUE_LINK}', 1))::BIGINT AS issue_id
        FROM texts) x
      JOIN issue i ON i.project_id=x.project_id AND i.issue_id=x.issue_id
      WHERE x.issue_id<>x.pr_id)"""


def written_links(t: Tables):
    n = t.parts("lineitem")
    t = t.spread("lineitem", "l_orderkey")
    titles = t.pull_request.select(
        "project_id", "pr_id", F.concat("labels", F.lit(" #"), F.col("pr_id") + 7).alias("body")
    )
    message = F.concat(F.lit("fix #"), F.col("sha") % 1000, F.lit(", see #"), F.col("pr_id") + 3)
    messages = t.pr_commit.select("project_id", "pr_id", message.alias("body"))
    return links.pr_issue_links(t.issue, t.pr_comment, titles, messages, parts=n)


@query("m18_pr_issue_links", f"WITH {LINKS} SELECT * FROM link")
def m18(t: Tables):
    return written_links(t)


PRE_COMMUNICATION = """WITH own AS (SELECT DISTINCT project_id, thread_id, thread_id%20 AS owner_id
      FROM timeline_full WHERE thread_type='issue'),
    au AS (SELECT CAST(pr_id%25 AS INT) AS project_id, pr_id, author_id%20 AS author_id
      FROM pull_request),
    ref AS (SELECT project_id, thread_id, event_pos, actor_id%20 AS actor_id, event_pos AS ref_pr_id,
      CASE WHEN event_pos%3=0 THEN 'pull_request' ELSE 'issue' END AS ref_type
      FROM timeline_full WHERE event='cross-referenced' AND thread_type='issue'),
    bypr AS (SELECT r.project_id, r.thread_id, r.event_pos, a.pr_id, a.author_id FROM ref r
      JOIN au a ON a.project_id=r.project_id AND a.pr_id=r.ref_pr_id
      WHERE r.ref_type='pull_request'),
    seen AS (SELECT project_id, thread_id, owner_id AS u, -1 AS pos FROM own
      UNION ALL SELECT project_id, thread_id, actor_id, event_pos FROM ref
      UNION ALL SELECT project_id, thread_id, author_id, event_pos FROM bypr)
    SELECT DISTINCT b.project_id, b.thread_id, b.pr_id, b.author_id=o.owner_id AS same_owner
    FROM bypr b JOIN own o ON o.project_id=b.project_id AND o.thread_id=b.thread_id
    WHERE EXISTS (SELECT 1 FROM seen s WHERE s.project_id=b.project_id
      AND s.thread_id=b.thread_id AND s.u=b.author_id AND s.pos<b.event_pos)"""


def _pre_communication(t: Tables, thread_type: str):
    events = (
        t.timeline_full.withColumn("actor_id", F.col("actor_id") % 20)
        .withColumn("ref_pr_id", F.col("event_pos"))
        .withColumn(
            "ref_type", F.when(F.col("event_pos") % 3 == 0, "pull_request").otherwise("issue")
        )
    )
    owners = events.filter(F.col("thread_type") == thread_type).select(
        "project_id", "thread_id", (F.col("thread_id") % 20).alias("owner_id")
    ).distinct()
    authors = t.pull_request.select(
        (F.col("pr_id") % 25).cast("int").alias("project_id"),
        "pr_id",
        (F.col("author_id") % 20).alias("author_id"),
    )
    return timeline.pre_communication(events, owners, authors, thread_type)


@query("m19_pre_communication", PRE_COMMUNICATION)
def m19(t: Tables):
    return _pre_communication(t, "issue")


@query(
    "m19_pre_communication_of_prs",
    PRE_COMMUNICATION.replace("thread_type='issue'", "thread_type='pr'").replace(
        "AND s.u=b.author_id AND s.pos<b.event_pos)",
        "AND s.u=b.author_id AND s.pos<b.event_pos) AND b.pr_id<>b.thread_id"
    ),
)
def m19_prs(t: Tables):
    return _pre_communication(t, "pr")


def _modularity_sql(limit: int, scope: str) -> str:
    return f"""WITH sized AS (SELECT * FROM commit_file WHERE sha IN (
      SELECT sha FROM commit_file GROUP BY sha HAVING count(*)<={limit})),
    ext AS (SELECT * FROM commit_login c WHERE login NOT LIKE '%bot%' AND NOT EXISTS (
      SELECT 1 FROM member_login m WHERE m.project_id=c.project_id AND m.login=c.login)
      AND sha IN (SELECT sha FROM sized)),
    pick AS (SELECT project_id, sha FROM (SELECT *, row_number() OVER (PARTITION BY project_id
      ORDER BY committed_at DESC, sha) AS r FROM ext) WHERE r<=50),
    rows AS (SELECT DISTINCT p.project_id, p.sha, f.filename FROM pick p JOIN sized f ON f.sha=p.sha
      WHERE f.status IN ('added', 'modified') {scope}),
    n AS (SELECT project_id, count(DISTINCT filename) AS n_files FROM rows GROUP BY 1),
    pr AS (SELECT project_id, count(*) AS n_pairs FROM (SELECT DISTINCT a.project_id,
      a.filename AS x, b.filename AS y FROM rows a JOIN rows b ON a.project_id=b.project_id
      AND a.sha=b.sha AND a.filename<b.filename) GROUP BY 1)
    SELECT n.project_id, n.n_files, coalesce(pr.n_pairs, 0) AS n_pairs,
      round(200*coalesce(pr.n_pairs, 0)/nullif(n.n_files*(n.n_files-1), 0), 4) AS modularity
    FROM n LEFT JOIN pr ON pr.project_id=n.project_id"""


@query("m20_modularity", _modularity_sql(50, ""))
def m20(t: Tables):
    return modularity.modularity(
        t.commit_login, t.commit_file, members=t.member_login, max_files=50, n_commits=50
    )


@query(
    "m20_modularity_source_files",
    _modularity_sql(50, "AND (filename LIKE '%.java' OR filename LIKE '%.py')"),
)
def m20b(t: Tables):
    return modularity.modularity(
        t.commit_login, t.commit_file, suffixes=SOURCE_SUFFIXES, members=t.member_login,
        max_files=50, n_commits=50,
    )


GRID = " UNION ALL ".join(
    f"""SELECT {limit} AS max_files, '{scope}' AS scope, g{limit}{i}.* FROM (
      {_modularity_sql(limit, where)}) g{limit}{i}"""
    for limit in (10, 30)
    for i, (scope, where) in enumerate(
        [("all_files", ""), ("source_only", "AND (filename LIKE '%.java' OR filename LIKE '%.py')")]
    )
)


@query("m20_modularity_grid", GRID)
def m20c(t: Tables):
    return modularity.modularity_grid(
        t.commit_login, t.commit_file, SOURCE_SUFFIXES, members=t.member_login, n_commits=50
    )


@query(
    "m21_commit_change_profile",
    f"""WITH change AS ({CHANGES}), flag AS ({FLAGS})
    SELECT sha, {", ".join(f"sum({c})::BIGINT AS {c}" for c in PROFILE_COLUMNS)},
      bool_or(about_config) AS about_config FROM flag GROUP BY 1""",
)
def m21(t: Tables):
    return change_profile.commit_totals(change_profile.change_profile(t.sql(CHANGES)))


@query(
    "m22_fork_commit_counts",
    f"""WITH RECURSIVE {DISTANCE}
    SELECT pair_id, count(*) FILTER (category='only_F') AS "only_F",
      count(*) FILTER (category='only_U') AS "only_U", count(*) FILTER (category='F2U') AS "F2U",
      count(*) FILTER (category='U2F') AS "U2F", count(*) FILTER (category='before') AS before
    FROM class GROUP BY 1""",
)
def m22(t: Tables):
    return classify.fork_commit_counts(t.stored("dag_edge"), t.stored("dag_head"))


def _on_forks_that_went_on(sql: str) -> str:
    """The same SQL on long histories, for forks and upstreams that both went on after they parted."""
    return sql.replace("dag_edge", "deep_edge").replace("dag_head", "evolved_head").replace(" dag ", " deep_dag ")


@query(
    "m23_fork_evolution",
    f"""WITH RECURSIVE {_on_forks_that_went_on(DISTANCE)},
    c AS (SELECT c.pair_id, c.commit_at AS day,
      CASE WHEN CAST(c.commit_at AS DATE)<=f.forked_on THEN 'before' ELSE c.category END AS k
      FROM class c LEFT JOIN evolved_fork_point f ON f.pair_id=c.pair_id),
    p AS (SELECT pair_id, min(day) FILTER (k='before') AS fork_point,
      max(day) FILTER (k IN ('only_F', 'F2U')) AS latest_fork_at,
      max(day) FILTER (k IN ('only_U', 'U2F')) AS latest_upstream_at,
      count(*) FILTER (k='before') AS n_before, count(*) FILTER (k='only_F') AS "n_only_F",
      count(*) FILTER (k='F2U') AS "n_F2U", count(*) FILTER (k='U2F') AS "n_U2F" FROM c GROUP BY 1)
    SELECT p.*, (SELECT count(*) FROM c WHERE c.pair_id=p.pair_id AND c.k IN ('only_U', 'U2F')
        AND c.day>p.fork_point) AS n_upstream_after,
      (abs(date_diff('day', CAST(latest_fork_at AS DATE), CAST(latest_upstream_at AS DATE)))//365)
        ::INT AS gap_years
    FROM p WHERE fork_point IS NOT NULL AND latest_fork_at IS NOT NULL
      AND latest_upstream_at IS NOT NULL""",
)
def m23(t: Tables):
    return evolution.evolution_records(dated_categories(t, "deep", "evolved"))


CONTRIBUTION = """k AS (SELECT DISTINCT parent_id, repo_id, sha, category FROM fork_commit),
    once AS (SELECT parent_id, category, sha, min(repo_id) AS repo_id FROM k
      WHERE category IN ('only_F', 'F2U') GROUP BY 1, 2, 3 HAVING count(DISTINCT repo_id)=1),
    own AS (SELECT repo_id, count(*) FILTER (category='only_F') AS f,
      count(*) FILTER (category='F2U') AS u FROM once GROUP BY 1),
    contrib AS (SELECT k.parent_id, k.repo_id, coalesce(max(o.f), 0) AS "only_F",
      coalesce(max(o.u), 0) AS "F2U", count(*) FILTER (k.category='only_U') AS "only_U",
      count(*) FILTER (k.category='U2F') AS "U2F"
      FROM k LEFT JOIN own o ON o.repo_id=k.repo_id GROUP BY 1, 2)"""


@query("m24_fork_contribution", f"WITH {CONTRIBUTION} SELECT * FROM contrib")
def m24(t: Tables):
    return contribution.contribution_table(t.fork_commit)


@query(
    "m24_combined_table",
    f"""WITH {CONTRIBUTION}
    SELECT c.*, r.language, r.stars,
      date_diff('day', r.created_on, DATE '2001-08-02')::INT AS fork_age,
      date_diff('day', r.pushed_on, DATE '2001-08-02')::INT AS last_commit_age, h.n_prs
    FROM contrib c LEFT JOIN repository r ON r.repo_id=c.repo_id
    LEFT JOIN (SELECT repo_id, count(DISTINCT pr_id) AS n_prs FROM pr_history GROUP BY 1) h
      ON h.repo_id=c.repo_id""",
)
def m24b(t: Tables):
    prs = t.pr_history.groupBy("repo_id").agg(F.count_distinct("pr_id").alias("n_prs"))
    as_of = F.lit("2001-08-02").cast("date")
    return contribution.combined_table(m24(t), t.repository, prs, as_of)


@query(
    "m25_hard_fork_signs",
    """WITH copy AS (SELECT DISTINCT l_suppkey AS repo_id, l_partkey AS sha FROM lineitem),
    un AS (SELECT m.repo_id, count(*) AS n FROM copy m WHERE NOT EXISTS (SELECT 1 FROM copy c
      WHERE c.repo_id=m.repo_id-m.repo_id%5 AND c.sha=m.sha) GROUP BY 1),
    ext AS (SELECT author_id%100 AS repo_id, count(*) FILTER (author_id%7<>author_id%100%7) AS p,
      count(DISTINCT CASE WHEN author_id%7<>author_id%100%7 THEN author_id%7 END) AS a
      FROM pull_request GROUP BY 1)
    SELECT r.repo_id, u.repo_id AS upstream_id,
      levenshtein(split_part(r.url, '/', 2), split_part(u.url, '/', 2))>2 AS is_renamed,
      contains(lower(r.description), 'fork of') AS says_fork_of,
      trim(r.description)=trim(u.description) AS same_description,
      coalesce(un.n, 0) AS n_unmerged, coalesce(ext.p, 0) AS external_prs,
      coalesce(ext.a, 0) AS external_authors, r.pushed_on<=r.created_on AS is_inactive
    FROM repository r JOIN repository u ON u.repo_id=r.parent_id
    LEFT JOIN un ON un.repo_id=r.repo_id LEFT JOIN ext ON ext.repo_id=r.repo_id""",
)
def m25(t: Tables):
    copies = t.lineitem.select(
        F.col("l_suppkey").alias("repo_id"), F.col("l_partkey").alias("sha")
    ).distinct()
    mine = copies.withColumn("parent_id", F.col("repo_id") - F.col("repo_id") % 5)
    prs = t.sql(
        """SELECT author_id%100 AS repo_id, author_id%7 AS author, author_id%100%7 AS owner
        FROM pull_request"""
    )
    return hardforks.hard_fork_signs(
        t.repository, unmerged_commits(mine, copies), external_contribution(prs)
    )


@query(
    "m24_commits_to_ingest",
    """SELECT f.repo_id, f.sha, s.n AS n_files FROM (
      SELECT DISTINCT repo_id, sha FROM fork_commit WHERE category IN ('only_F', 'F2U')) f
    JOIN (SELECT sha, count(*) AS n FROM commit_file GROUP BY 1 HAVING count(*)<100) s ON s.sha=f.sha""",
)
def m24c(t: Tables):
    own = t.fork_commit.filter(F.col("category").isin("only_F", "F2U")).select("repo_id", "sha").distinct()
    return contribution.commits_to_ingest(own, t.commit_file, below=100)


@query(
    "m25_renamed_forks",
    """SELECT repo_id, fork_url, upstream_url FROM fork_pair
    WHERE levenshtein(split_part(fork_url, '/', 2), split_part(upstream_url, '/', 2))>0""",
)
def m25b(t: Tables):
    return hardforks.renamed_forks(t.fork_pair, 0).select("repo_id", "fork_url", "upstream_url")


UNCHECKED = """checked AS (SELECT fork_url, upstream_url FROM fork_pair WHERE repo_id%3=0),
    seen AS (SELECT least(fork_url, upstream_url) || ',' || greatest(fork_url, upstream_url) AS pair_key FROM checked),
    turned AS (SELECT fork_url AS a, upstream_url AS b FROM fork_pair
      UNION ALL SELECT upstream_url, fork_url FROM fork_pair WHERE repo_id%2=0)"""


@query(
    "m25_unchecked_pairs",
    f"""WITH {UNCHECKED} SELECT DISTINCT least(a, b) || ',' || greatest(a, b) AS pair_key FROM turned
    WHERE least(a, b) || ',' || greatest(a, b) NOT IN (SELECT pair_key FROM seen)""",
)
def m25c(t: Tables):
    pair = [F.col("fork_url").alias("a"), F.col("upstream_url").alias("b")]
    pairs = t.fork_pair.select(*pair)
    pairs = pairs.unionByName(t.fork_pair.filter("repo_id % 2 = 0").select(pair[1].alias("a"), pair[0].alias("b")))
    checked = t.fork_pair.filter("repo_id % 3 = 0").select(
        unordered_pair_key(F.col("fork_url"), F.col("upstream_url")).alias("pair_key")
    )
    return hardforks.unchecked_pairs(pairs, checked, "a", "b").select("pair_key")


@query(
    "m25_upstreams_with_hard_forks",
    """SELECT upstream_id, count(DISTINCT repo_id) AS n_hard_forks, count(DISTINCT repo_id)>1 AS has_many
    FROM fork_pair WHERE repo_id%3<>0 GROUP BY 1""",
)
def m25d(t: Tables):
    return hardforks.hard_forks_per_upstream(t.fork_pair.filter("repo_id % 3 <> 0"))


@query(
    "m26_project_summary",
    f"""WITH {EASINESS}, {TOUCHES}, {SOCIAL},
    hot AS (SELECT p.project_id, p.pr_id,
      count(DISTINCT CASE WHEN h.filename IS NOT NULL THEN t.sha END) AS n
      FROM pull_request p LEFT JOIN touch t ON t.project_id=p.project_id AND t.pr_id=p.pr_id
      LEFT JOIN hot_file h
        ON h.project_id=t.project_id AND h.pr_id=t.pr_id AND h.filename=t.filename
      WHERE p.is_closed AND EXISTS (SELECT 1 FROM hot_file x WHERE x.project_id=p.project_id
        AND x.pr_id=p.pr_id) GROUP BY 1, 2)
    SELECT p.project_id, p.url, s.n_prs, s.merged_ratio, e.mean_easiness, e.median_easiness,
      h.mean_hotness, c.social_ratio FROM project p
    LEFT JOIN (SELECT project_id, count(*) AS n_prs,
      round(count(*) FILTER (is_merged)/count(*), 6) AS merged_ratio FROM pull_request GROUP BY 1) s
      ON s.project_id=p.project_id
    LEFT JOIN (SELECT project_id, round(avg(easiness), 6) AS mean_easiness,
      round(median(easiness), 6) AS median_easiness FROM easy GROUP BY 1) e
      ON e.project_id=p.project_id
    LEFT JOIN (SELECT project_id, round(avg(n), 6) AS mean_hotness FROM hot GROUP BY 1) h
      ON h.project_id=p.project_id
    LEFT JOIN (SELECT project_id, round(count(*) FILTER (social_connection)/count(*), 6)
      AS social_ratio FROM social GROUP BY 1) c ON c.project_id=p.project_id""",
)
def m26(t: Tables):
    per_pr = materialize(_easiness(t), "easiness")
    easy = per_pr.groupBy("project_id").agg(F.round(F.avg("easiness"), 6).alias("mean_easiness")).join(
        grouped_medians(per_pr, ["project_id"], {"median_easiness": "easiness"}).withColumn(
            "median_easiness", F.round("median_easiness", 6)
        ),
        "project_id",
    )
    ratios = status_ratios(t.pull_request).select("project_id", "n_prs", "merged_ratio")
    return summary.join_metrics(
        t.project,
        [ratios, easy, summary.mean_hotness(m01(t)), summary.social_ratio(m13(t))],
        ["project_id"],
    )
