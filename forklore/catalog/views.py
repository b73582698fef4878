"""Fork and pull-request tables derived from the given star-schema tables.

One SQL text per view serves Spark (as DataFrames) and the checking database (as
leading CTEs). ``@NAME(...)@`` marks the few places where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from forklore.session import materialize

# The end of the observed period, counted back from.
SNAPSHOT = "2001-08-02"

# Rows of a table in a task, where they are dealt by number.
TASK_ROWS = 1 << 18

BASE = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
}

VIEWS: dict[str, str] = {
    "project": """
SELECT n_nationkey AS project_id,
  concat('org', CAST(n_regionkey AS STRING), '/', lower(n_name)) AS url
FROM nation""",
    "user_account": """
SELECT c_custkey AS user_id,
  CASE WHEN c_custkey%9=0 THEN concat('bot', CAST(c_custkey AS STRING))
    ELSE concat('user', CAST(c_custkey AS STRING)) END AS login,
  c_nationkey AS project_id
FROM customer""",
    "repository": """
SELECT s_suppkey AS repo_id,
  concat('owner', CAST(s_nationkey AS STRING), '/repo', CAST(s_suppkey AS STRING)) AS url,
  s_suppkey%5<>0 AS is_fork,
  CASE WHEN s_suppkey%5<>0 THEN s_suppkey - s_suppkey%5 END AS parent_id,
  CAST((s_suppkey*7919)%1000 AS INT) AS stars,
  CASE s_suppkey%4 WHEN 0 THEN 'Java' WHEN 1 THEN 'Python' WHEN 2 THEN 'Go' END AS language,
  @ADD(DATE '1995-01-01'|CAST((s_suppkey*37)%2000 AS INT))@ AS created_on,
  @ADD(DATE '1995-01-01'|CAST((s_suppkey*37)%2000 + (s_suppkey*53)%400 - 100 AS INT))@ AS pushed_on,
  CASE WHEN s_suppkey%5=1 THEN concat('fork of repo', CAST(s_suppkey - 1 AS STRING))
    WHEN s_suppkey%5=2 THEN 'shared words'
    WHEN s_suppkey%5=0 THEN ' shared words '
    ELSE 'own words' END AS description
FROM supplier""",
    "pull_request": """
SELECT c.c_nationkey AS project_id, o.o_orderkey AS pr_id, o.o_custkey AS author_id,
  (o.o_custkey*7+o.o_orderkey)%97 AS closer_id, o.o_orderdate AS created_at,
  o.o_orderstatus<>'O' AS is_closed, o.o_orderstatus='F' AS is_merged,
  @DAYS(DATE '2001-08-02'|o.o_orderdate)@ AS age_in_day,
  o.o_orderpriority AS labels
FROM orders o JOIN customer c ON c.c_custkey=o.o_custkey""",
    "pr_commit": """
SELECT DISTINCT p.project_id, p.pr_id, l.l_orderkey*100+l.l_linenumber AS sha
FROM pull_request p JOIN lineitem l ON l.l_orderkey=p.pr_id""",
    "commit_file": """
SELECT DISTINCT l_orderkey*100+l_linenumber AS sha,
  concat('src/f', CAST(l_partkey%500 AS STRING),
    CASE l_partkey%3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.md' END) AS filename,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'modified' ELSE 'removed' END AS status,
  CAST(l_quantity AS INT) AS additions
FROM lineitem""",
    "commit": """
SELECT l_orderkey*100+l_linenumber AS sha, min(l_suppkey) AS repo_id,
  min(l_shipdate) AS committed_at, min(l_suppkey*13+l_partkey)%1200 AS login_id
FROM lineitem GROUP BY l_orderkey*100+l_linenumber""",
    "issue": """
SELECT project_id, pr_id+10 AS issue_id, (author_id*3)%1000 AS author_id,
  @ADD(CAST(created_at AS DATE)|20 - CAST(pr_id%41 AS INT))@ AS created_on,
  is_closed AS closed
FROM pull_request""",
    "timeline": """
SELECT event_id%300 AS thread_id, event_id AS event_pos, user_id AS actor_id,
  CASE event_type WHEN 'signup' THEN 'committed' WHEN 'error' THEN 'closed'
    WHEN 'click' THEN 'commented' WHEN 'view' THEN 'cross-referenced' ELSE 'merged' END AS event,
  CAST(@JSON(props|k)@ AS INT) AS ref_pr_id
FROM events""",
    "timeline_full": """
SELECT t.thread_id, t.event_pos, t.actor_id, t.event, t.ref_pr_id,
  CAST((t.thread_id + t.event_pos%7%2)%25 AS INT) AS project_id,
  CASE WHEN t.thread_id%2=0 THEN 'pr' ELSE 'issue' END AS thread_type,
  CASE t.actor_id%5 WHEN 0 THEN 'MEMBER' WHEN 1 THEN 'NONE' WHEN 2 THEN 'contributor'
    WHEN 3 THEN 'OWNER' ELSE '' END AS association,
  CASE WHEN t.actor_id%11=0 THEN 'Bot' ELSE 'User' END AS user_type,
  CASE WHEN t.ref_pr_id%4=0 THEN 'pull_request' ELSE 'issue' END AS ref_type,
  CASE WHEN t.ref_pr_id%7=0 THEN 'open' ELSE 'closed' END AS ref_state,
  concat('label-', CAST(t.ref_pr_id%6 AS STRING)) AS label,
  CASE WHEN t.ref_pr_id%3=0 THEN t.event_pos*100+1 END AS sha,
  CASE t.ref_pr_id%6
    WHEN 0 THEN concat('already solved by #', CAST(t.ref_pr_id AS STRING))
    WHEN 1 THEN concat('landed as ', CAST(1000000+t.event_pos AS STRING), ' thanks')
    WHEN 2 THEN 'squashed, thanks'
    WHEN 3 THEN concat('fixed in ', CAST(1000000+t.event_pos AS STRING), ' now')
    WHEN 4 THEN concat('see https://github.com/o/r/pull/', CAST(t.ref_pr_id AS STRING))
    ELSE 'looks good to me' END AS body
FROM timeline t""",
    "dag": """
SELECT o_custkey AS pair_id, o_orderkey AS sha, o_orderdate AS commit_at,
  lag(o_orderkey,1) OVER w AS parent1,
  CASE WHEN o_orderkey%4=0 THEN lag(o_orderkey,3) OVER w END AS parent2
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "dag_edge": """
SELECT pair_id, sha, parent1 AS parent, 0 AS parent_pos FROM dag
UNION ALL
SELECT pair_id, sha, parent2, 1 FROM dag WHERE parent2 IS NOT NULL""",
    "side_dag": """
SELECT o_custkey AS pair_id, o_orderkey AS sha, o_orderdate AS commit_at,
  CASE WHEN o_orderkey%4=0 AND lag(o_orderkey,2) OVER w IS NOT NULL
    THEN lag(o_orderkey,2) OVER w ELSE lag(o_orderkey,1) OVER w END AS parent1,
  CASE WHEN o_orderkey%4=0 AND lag(o_orderkey,2) OVER w IS NOT NULL
    THEN lag(o_orderkey,1) OVER w END AS parent2
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "side_edge": """
SELECT pair_id, sha, parent1 AS parent, 0 AS parent_pos FROM side_dag
UNION ALL
SELECT pair_id, sha, parent2, 1 FROM side_dag WHERE parent2 IS NOT NULL""",
    "deep_commit": """
SELECT o_custkey%15 AS pair_id, o_orderkey AS sha, o_orderdate AS commit_at,
  row_number() OVER (PARTITION BY o_custkey%15 ORDER BY o_orderdate, o_orderkey) AS place
FROM orders""",
    "deep_dag": """
SELECT pair_id, sha, commit_at, place,
  CASE place%7 WHEN 3 THEN coalesce(lag(sha,5) OVER w, lag(sha,1) OVER w)
    WHEN 5 THEN coalesce(lag(sha,3) OVER w, lag(sha,1) OVER w) ELSE lag(sha,1) OVER w END AS parent1,
  CASE WHEN place%7=6 THEN lag(sha,2) OVER w END AS parent2
FROM deep_commit WINDOW w AS (PARTITION BY pair_id ORDER BY place)""",
    "deep_edge": """
SELECT pair_id, sha, parent1 AS parent, 0 AS parent_pos FROM deep_dag
UNION ALL
SELECT pair_id, sha, parent2, 1 FROM deep_dag WHERE parent2 IS NOT NULL""",
    "deep_head": """
SELECT pair_id, CASE place%7 WHEN 0 THEN 'fork' ELSE 'upstream' END AS side, max_by(sha, place) AS sha
FROM deep_commit WHERE place%7=0 OR place%28=6 GROUP BY pair_id, CASE place%7 WHEN 0 THEN 'fork' ELSE 'upstream' END""",
    "evolved": """
SELECT pair_id, max(place)-2 AS top FROM deep_commit WHERE place%7=4 GROUP BY pair_id""",
    "evolved_head": """
SELECT d.pair_id, CASE WHEN d.place=e.top THEN 'upstream' ELSE 'fork' END AS side, d.sha
FROM evolved e JOIN deep_commit d ON d.pair_id=e.pair_id AND d.place IN (e.top, e.top+2, e.top-12)""",
    "evolved_fork_point": """
SELECT d.pair_id, d.commit_at AS forked_at, CAST(d.commit_at AS DATE) AS forked_on
FROM evolved e JOIN deep_commit d ON d.pair_id=e.pair_id AND d.place=e.top-20""",
    "side_head": """
SELECT pair_id, CASE WHEN sha%2=0 THEN 'upstream' ELSE 'fork' END AS side,
  max_by(sha, @STRUCT(commit_at|sha)@) AS sha, max(commit_at) AS head_at
FROM dag GROUP BY pair_id, CASE WHEN sha%2=0 THEN 'upstream' ELSE 'fork' END, sha%5""",
    "dag_head": """
SELECT pair_id, CASE WHEN sha%2=0 THEN 'upstream' ELSE 'fork' END AS side,
  max_by(sha, @STRUCT(commit_at|sha)@) AS sha, max(commit_at) AS head_at
FROM dag GROUP BY pair_id, CASE WHEN sha%2=0 THEN 'upstream' ELSE 'fork' END""",
    "pr_text": """
SELECT project_id, pr_id, author_id AS commenter_id, is_merged, CASE pr_id%6
  WHEN 0 THEN concat('Duplicate of #', CAST(pr_id+10 AS STRING))
  WHEN 1 THEN concat('superseded by https://github.com/o/r/pull/', CAST(pr_id+20 AS STRING))
  WHEN 2 THEN concat('Merged in 0123abc , see #', CAST(pr_id+30 AS STRING))
  WHEN 3 THEN concat('fixes #', CAST(pr_id+40 AS STRING), ' and #', CAST(pr_id+50 AS STRING))
  WHEN 4 THEN 'cherry-picked as 0123456789abcdef0123456789abcdef01234567'
  ELSE 'looks good to me' END AS body
FROM pull_request""",
    "pr_comment": """
SELECT p.project_id, p.pr_id, 0 AS comment_pos, p.commenter_id, p.body FROM pr_text p
UNION ALL
SELECT p.project_id, p.pr_id, l.l_linenumber,
  l.l_suppkey*7%1000,
  CASE l.l_linenumber%4 WHEN 0 THEN concat('this is a dup of #', CAST(p.pr_id+3 AS STRING),
      CASE WHEN p.pr_id%3=0 THEN concat(' see 89abcde ', CAST(p.pr_id AS STRING)) ELSE '' END)
    WHEN 1 THEN 'please rebase' WHEN 2 THEN concat('better solution in #', CAST(p.pr_id+4 AS STRING))
    ELSE 'needs tests' END
FROM pull_request p JOIN lineitem l ON l.l_orderkey=p.pr_id""",
    "follower": """
SELECT DISTINCT o_custkey%97 AS user_id, c_custkey AS follower_id, o_orderdate AS followed_at
FROM orders JOIN customer ON c_custkey=o_custkey""",
    "core_member": """
SELECT DISTINCT c_nationkey AS project_id, c_custkey AS user_id
FROM customer WHERE c_mktsegment='BUILDING'""",
    "pr_author": """
SELECT p.project_id, p.pr_id, p.author_id, u.login AS author_login, j.url AS project_url,
  p.created_at, p.is_closed, p.is_merged,
  CASE p.author_id%4 WHEN 0 THEN '' WHEN 1 THEN j.url
    ELSE concat(u.login, ':dev/repo', CAST(p.project_id AS STRING)) END AS fork_url
FROM pull_request p JOIN user_account u ON u.user_id=p.author_id
JOIN project j ON j.project_id=p.project_id""",
    "member_login": """
SELECT m.project_id, u.login FROM core_member m JOIN user_account u ON u.user_id=m.user_id""",
    "commit_login": """
SELECT c.sha, c.repo_id, CAST(c.login_id%25 AS INT) AS project_id, c.committed_at,
  CASE WHEN c.login_id%13<>0 THEN u.login END AS login,
  concat('mail', CAST(c.login_id AS STRING), '@example.org') AS email
FROM commit c LEFT JOIN user_account u ON u.user_id=c.login_id""",
    "fork_pair": """
SELECT r.repo_id, r.url AS fork_url, u.repo_id AS upstream_id, u.url AS upstream_url
FROM repository r JOIN repository u ON u.repo_id=r.parent_id""",
    "repository_tree": """
SELECT s_suppkey AS repo_id,
  CASE WHEN s_suppkey%10<>0 THEN s_suppkey - 1 - s_suppkey%3%2 END AS parent_id
FROM supplier""",
    "branch_commit": """
SELECT l_suppkey AS repo_id,
  concat('b', CAST(l_linenumber AS STRING), '-', l_returnflag) AS branch, l_partkey AS sha
FROM lineitem""",
    "dag_branch": """
SELECT pair_id, concat('b', CAST(sha%3 AS STRING)) AS branch,
  max_by(sha, @STRUCT(commit_at|sha)@) AS sha, max(commit_at) AS head_at
FROM dag GROUP BY pair_id, concat('b', CAST(sha%3 AS STRING))""",
    "dag_up_branch": """
SELECT pair_id, concat('b', CAST(sha%3 AS STRING)) AS branch,
  max_by(sha, @STRUCT(commit_at|sha)@) AS sha
FROM dag WHERE sha%7<>0 GROUP BY pair_id, concat('b', CAST(sha%3 AS STRING))""",
    "dag_fork_point": """
SELECT pair_id, max(commit_at) AS forked_at, max(CAST(commit_at AS DATE)) AS forked_on
FROM dag WHERE sha%4=1 GROUP BY pair_id""",
    "pr_history": """
SELECT p.author_id%100 AS repo_id, p.pr_id,
  CASE l.l_linenumber%4 WHEN 0 THEN 'merged' WHEN 1 THEN 'opened' WHEN 2 THEN 'opened'
    ELSE 'closed' END AS action
FROM pull_request p JOIN lineitem l ON l.l_orderkey=p.pr_id""",
    "fork_commit": """
SELECT l_suppkey AS repo_id, l_suppkey - l_suppkey%5 AS parent_id,
  l_orderkey*100+l_linenumber AS sha,
  CASE l_returnflag WHEN 'A' THEN 'only_F' WHEN 'R' THEN 'F2U' ELSE 'U2F' END AS category,
  l_shipdate AS committed_at
FROM lineitem""",
}


def _convert(sql: str, rules: dict[str, str]) -> str:
    def one(match: re.Match) -> str:
        args = match.group(2).split("|")
        return rules[match.group(1)].format(*args)

    return re.sub(r"@([A-Z]+)\((.*?)\)@", one, sql)


SPARK_RULES = {
    "DAYS": "datediff({0}, {1})",
    "ADD": "date_add({0}, {1})",
    "JSON": "get_json_object({0}, '$.{1}')",
    "STRUCT": "struct({0}, {1})",
}
DUCKDB_RULES = {
    "DAYS": "CAST(date_diff('day', CAST({1} AS DATE), {0}) AS INTEGER)",
    "ADD": "CAST(({0}) + CAST({1} AS INTEGER) AS DATE)",
    "JSON": "json_extract_string({0}, '$.{1}')",
    "STRUCT": "row({0}, {1})",
}


def _names_in(sql: str) -> list[str]:
    words = re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", sql)
    return [w for w in dict.fromkeys(words) if w in VIEWS or w in BASE]


class Tables:
    """The given tables and the derived views of one scale directory, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self._derive(VIEWS[name])
        return self._made[name]

    def stored(self, name: str) -> DataFrame:
        """A view written once as a table, for operators that read it many times."""
        key = f"stored {name}"
        if key not in self._made:
            self._made[key] = materialize(getattr(self, name), name)
        return self._made[key]

    def parts(self, name: str, rows: int = TASK_ROWS) -> int:
        """Tasks that a table needs if each is to have ``rows`` of its rows."""
        return max(1, -(-getattr(self, name).count() // rows))

    def spread(self, name: str, key: str, rows: int = TASK_ROWS) -> Tables:
        """The same tables, one of them dealt by a key into tasks of about ``rows`` rows.

        Joins on that key keep these tasks. Sized by bytes they would grow, as few bytes of a shuffle can
        be many rows of a sort or an aggregate.
        """
        dealt = Tables(self.spark, self.sf_dir)
        if (n := self.parts(name, rows)) > 1:
            dealt._made[name] = getattr(self, name).repartition(n, key)
        return dealt

    def sql(self, text: str) -> DataFrame:
        """Run a query that names tables or views plainly."""
        return self._derive(text)

    def _derive(self, text: str) -> DataFrame:
        names = _names_in(text)
        text = _convert(text, SPARK_RULES)
        text = re.sub(
            r"((?:FROM|JOIN)\s+)([a-z_]+)",
            lambda m: f"{m.group(1)}{{{m.group(2)}}} {_alias(m.group(2), m.string[m.end():])}"
            if m.group(2) in names
            else m.group(0),
            text,
        )
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def _alias(name: str, rest: str) -> str:
    following = re.match(r"\s+([A-Za-z_]+)", rest)
    keywords = {"where", "group", "order", "join", "left", "union", "window", "on", "union"}
    if following and following.group(1).lower() not in keywords:
        return ""
    return f"AS {name}"


def with_views(body: str) -> str:
    """Checking SQL: the body with the views it needs as leading CTEs."""
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in _names_in(sql):
            if name in VIEWS and name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(body)
    ctes = [f"{n} AS ({_convert(VIEWS[n], DUCKDB_RULES)})" for n in ordered]
    body = _convert(body, DUCKDB_RULES).strip()
    if body[:5].upper() == "WITH ":
        recursive = ""
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            recursive, rest = "RECURSIVE ", rest[10:]
        return f"WITH {recursive}" + ",\n".join(ctes + [rest])
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
