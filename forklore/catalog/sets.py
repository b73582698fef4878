"""Set operations (U1 - U10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.operators import sets

NODE = ["pair_id", "sha"]


def _sides(t: Tables):
    fork = t.dag.filter(F.col("sha") % 3 != 0).select(*NODE)
    upstream = t.dag.filter(F.col("sha") % 4 != 0).select(*NODE)
    return fork, upstream


SIDES = """f AS (SELECT pair_id, sha FROM dag WHERE sha%3<>0),
    u AS (SELECT pair_id, sha FROM dag WHERE sha%4<>0)"""


@query("u01_union_of_branches", f"WITH {SIDES} SELECT * FROM f UNION SELECT * FROM u")
def u01(t: Tables):
    return sets.union_distinct(*_sides(t))


@query(
    "u02_without_merges",
    "SELECT pair_id, sha FROM dag EXCEPT SELECT pair_id, sha FROM dag WHERE parent2 IS NOT NULL",
)
def u02(t: Tables):
    return sets.difference(
        t.dag.select(*NODE), t.dag.filter(F.col("parent2").isNotNull()), NODE
    )


@query("u03_in_both_histories", f"WITH {SIDES} SELECT * FROM f INTERSECT SELECT * FROM u")
def u03(t: Tables):
    return sets.intersection(*_sides(t), NODE)


@query(
    "u04_one_sided",
    f"""WITH {SIDES}
    SELECT pair_id, sha, 'left' AS side FROM (SELECT * FROM f EXCEPT SELECT * FROM u)
    UNION ALL
    SELECT pair_id, sha, 'right' FROM (SELECT * FROM u EXCEPT SELECT * FROM f)""",
)
def u04(t: Tables):
    return sets.one_sided(*_sides(t), NODE)


@query(
    "u05_claimed_once",
    """SELECT parent_id, category, sha, min(repo_id) AS repo_id FROM (
      SELECT l_suppkey - l_suppkey%5 AS parent_id, l_returnflag AS category, l_partkey AS sha,
        l_suppkey AS repo_id FROM lineitem)
    GROUP BY 1, 2, 3 HAVING count(DISTINCT repo_id)=1""",
)
def u05(t: Tables):
    commits = t.lineitem.select(
        (F.col("l_suppkey") - F.col("l_suppkey") % 5).alias("parent_id"),
        F.col("l_returnflag").alias("category"),
        F.col("l_partkey").alias("sha"),
        F.col("l_suppkey").alias("repo_id"),
    )
    return sets.claimed_once(commits, ["parent_id", "category", "sha"], "repo_id")


SOURCE = """CASE l_linenumber WHEN 1 THEN 'author_only_F' WHEN 2 THEN 'author_F2U' WHEN 3 THEN 'pr'
    WHEN 4 THEN 'graph_only_F' WHEN 5 THEN 'graph_F2U' WHEN 6 THEN 'graph_U2F'
    ELSE 'graph_only_U' END"""


@query(
    "u06_combined_approaches",
    f"""WITH s AS (SELECT l_suppkey AS repo_id, l_partkey AS sha, {SOURCE} AS source FROM lineitem),
    g AS (SELECT repo_id, sha,
      bool_or(source IN ('author_only_F', 'graph_only_F')) AS of,
      bool_or(source='graph_only_U') AS ou,
      bool_or(source IN ('author_F2U', 'pr', 'graph_F2U')) AS fu,
      bool_or(source='graph_U2F') AS uf FROM s GROUP BY 1, 2)
    SELECT repo_id, sha, of AS "in_only_F", ou AS "in_only_U", fu AND NOT ou AS "in_F2U",
      uf AND NOT (fu AND NOT ou) AS "in_U2F" FROM g""",
)
def u06(t: Tables):
    tagged = t.sql(
        f"SELECT l_suppkey AS repo_id, l_partkey AS sha, {SOURCE} AS source FROM lineitem"
    )
    return sets.combine_approaches(tagged, ["repo_id"])


PR_SETS = """WITH s AS (SELECT l_suppkey AS repo_id, l_partkey AS sha,
      bool_or(l_returnflag='A') AS m, bool_or(l_returnflag='R') AS r FROM lineitem GROUP BY 1, 2)
    SELECT repo_id, count(*) AS attempted, count(*) FILTER ({m}) AS merged,
      count(*) FILTER ({r}) AS rejected FROM s GROUP BY 1"""


def _pr_rows(t: Tables):
    return t.lineitem.select(
        F.col("l_suppkey").alias("repo_id"),
        F.col("l_partkey").alias("sha"),
        F.when(F.col("l_returnflag") == "A", "merged")
        .when(F.col("l_returnflag") == "R", "closed")
        .otherwise("open")
        .alias("state"),
    )


@query("u07_pr_commit_sets_merged_first", PR_SETS.format(m="m", r="r AND NOT m"))
def u07(t: Tables):
    return sets.pr_commit_sets(_pr_rows(t), ["repo_id"], "merged")


@query("u07_pr_commit_sets_rejected_first", PR_SETS.format(m="m AND NOT r", r="r"))
def u07b(t: Tables):
    return sets.pr_commit_sets(_pr_rows(t), ["repo_id"], "rejected")


@query(
    "u08_contained_branches",
    """WITH m AS (SELECT DISTINCT c_nationkey AS repo_id,
        concat('b', CAST(c_custkey AS STRING)) AS branch, l_partkey%40 AS sha
      FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey),
    n AS (SELECT repo_id, branch, count(*) AS size FROM m GROUP BY 1, 2),
    shared AS (SELECT a.repo_id, a.branch, b.branch AS ob, count(*) AS s FROM m a
      JOIN m b ON a.repo_id=b.repo_id AND a.sha=b.sha AND a.branch<>b.branch GROUP BY 1, 2, 3)
    SELECT DISTINCT s.repo_id, s.branch FROM shared s
    JOIN n x ON x.repo_id=s.repo_id AND x.branch=s.branch
    JOIN n y ON y.repo_id=s.repo_id AND y.branch=s.ob
    WHERE s.s=x.size AND (y.size>x.size OR (y.size=x.size AND s.branch<s.ob))""",
)
def u08(t: Tables):
    branches = t.sql(
        """SELECT c_nationkey AS repo_id, concat('b', CAST(c_custkey AS STRING)) AS branch,
        l_partkey%40 AS sha
        FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey"""
    )
    return sets.contained_branches(branches)


@query(
    "u09_distinct_lines",
    """SELECT line FROM (SELECT DISTINCT concat(url, ',', language) AS line FROM repository
      WHERE language IS NOT NULL) INTERSECT SELECT concat(url, ',', language) FROM repository
      WHERE stars>300""",
)
def u09(t: Tables):
    line = F.concat("url", F.lit(","), "language").alias("line")
    known = t.repository.filter(F.col("language").isNotNull()).select(line)
    return known.intersect(t.repository.filter(F.col("stars") > 300).select(line))


@query(
    "u10_prs_sharing_files",
    """SELECT DISTINCT m.project_id, m.pr_id FROM pr_commit m JOIN commit_file f ON f.sha=m.sha
    WHERE f.status='added' AND f.filename IN (SELECT filename FROM commit_file
      WHERE status='removed' AND additions>48)""",
)
def u10(t: Tables):
    added = t.pr_commit.join(t.commit_file.filter("status = 'added'"), "sha")
    removed = t.commit_file.filter("status = 'removed' AND additions > 48")
    return sets.files_in_common(added, removed, ["filename"]).select(
        "project_id", "pr_id"
    ).distinct()
