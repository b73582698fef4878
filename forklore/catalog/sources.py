"""Scans, sources and sinks (S1 - S24), on exports written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forklore import schemas
from forklore.catalog.registry import query
from forklore.catalog.views import Tables
from forklore.session import materialize, new_path
from forklore.sources import documents, exports, logs, sinks


def iso(column: str):
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def write_exports(df: DataFrame, schema, file: str, label: str) -> str:
    """Write one CSV folder per export name; columns the rows lack are left empty."""
    path = new_path(df.sparkSession, label)
    have = set(df.columns)
    cells = [
        (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c)
        for c in schema.names
    ]
    (
        df.select(*cells, F.col(file).alias("file"))
        .repartition("file")
        .write.partitionBy("file")
        .options(header=True, quote='"', escape='"')
        .csv(path)
    )
    return path


def _pr_export(t: Tables) -> DataFrame:
    rows = t.pr_author.select(
        F.col("pr_id").alias("row"),
        F.col("author_login").alias("author"),
        F.when(F.col("is_closed"), iso("created_at")).alias("closed_at"),
        iso("created_at").alias("created_at"),
        "fork_url",
        "pr_id",
        F.when(F.col("pr_id") % 9 == 0, "bug, Duplicate").alias("labels"),
        F.when(F.col("is_merged"), iso("created_at")).alias("merged_at"),
        F.concat(F.lit('Say "hi",\nplease '), "pr_id").alias("title"),
        F.concat(F.lit("get_prs."), F.replace("project_url", F.lit("/"), F.lit(".")), F.lit(".csv"))
        .alias("file"),
    )
    path = write_exports(rows, schemas.PULL_REQUESTS, "file", "prs")
    return exports.read_csv(t.spark, path, schemas.PULL_REQUESTS)


@query(
    "s01_quoted_csv_scan",
    """SELECT CAST(pr_id AS STRING) AS pr_id, concat('Say "hi",', chr(10), 'please ', pr_id) AS title
    FROM pr_author""",
)
def s01(t: Tables):
    return _pr_export(t).select("pr_id", "title")


def _write_lines(df: DataFrame) -> str:
    path = new_path(df.sparkSession, "lines")
    sinks.write_text(df, path)
    return path


@query(
    "s02_line_list",
    "SELECT url AS value FROM repository WHERE repo_id%3<>0",
)
def s02(t: Tables):
    blanked = t.repository.select(
        F.when(F.col("repo_id") % 3 != 0, F.col("url")).otherwise("").alias("value")
    )
    return logs.lines(t.spark, _write_lines(blanked))


@query(
    "s03_list_lines",
    """SELECT sha::STRING AS key, parent1::STRING AS item FROM dag
    UNION ALL SELECT sha::STRING, parent2::STRING FROM dag WHERE parent2 IS NOT NULL""",
)
def s03(t: Tables):
    text = t.dag.select(
        F.concat(
            F.col("sha").cast("string"), F.lit(",["), F.concat_ws(", ", "parent1", "parent2"),
            F.lit("]"),
        ).alias("value")
    )
    scanned = logs.list_lines(logs.lines(t.spark, _write_lines(text)))
    return scanned.select("key", F.explode_outer("items").alias("item"))


@query(
    "s04_key_from_file_name",
    """SELECT DISTINCT concat('org.', project_id) AS project, thread_type, thread_id
    FROM timeline_full""",
)
def s04(t: Tables):
    path = F.concat(
        F.lit("/exports/get_"), "thread_type", F.lit("_timeline.org."), "project_id", F.lit("_"),
        "thread_id", F.lit(".csv"),
    )
    return t.timeline_full.select(path.alias("path")).distinct().select(
        *exports.thread_key(F.col("path"))
    )


@query(
    "s05_pull_request_export",
    """SELECT replace(project_url, '/', '.') AS project, pr_id, author_login AS author,
      CASE WHEN fork_url<>'' THEN fork_url END AS fork_url, created_at, is_closed, is_merged,
      pr_id%9=0 AS is_duplicate, concat('Say "hi",', chr(10), 'please ', pr_id) AS title
    FROM pr_author""",
)
def s05(t: Tables):
    return exports.pull_requests(_pr_export(t)).withColumn(
        "fork_url", F.nullif("fork_url", F.lit(""))
    )


@query(
    "s06_issue_export",
    """SELECT concat('p', project_id) AS project, issue_id, concat('user', author_id) AS author,
      closed, CAST(created_on AS TIMESTAMP) AS created_at, concat('issue ', issue_id) AS title
    FROM issue""",
)
def s06(t: Tables):
    rows = t.issue.select(
        F.col("issue_id").alias("row"),
        F.concat(F.lit("user"), "author_id").alias("author"),
        "closed",
        iso("created_on").alias("created_at"),
        "issue_id",
        F.concat(F.lit("issue "), "issue_id").alias("title"),
        F.concat(F.lit("get_issues.p"), "project_id", F.lit(".csv")).alias("file"),
    )
    path = write_exports(rows, schemas.ISSUES, "file", "issues")
    return exports.issues(exports.read_csv(t.spark, path, schemas.ISSUES))


def _as_scanned(rows: DataFrame, schema, name: str) -> DataFrame:
    """What a scan of one file per item gives: all cells as text, and the path.

    The files themselves would be one per request or commit of the tables, 10 to 70 ms each to write and list; tests scan
    such files.
    """
    have = set(rows.columns)
    cells = [
        (F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c)
        for c in schema.names
    ]
    return rows.select(*cells, F.concat(F.lit("/exports/"), name).alias("path"))


def _pr_commit_export(t: Tables) -> DataFrame:
    """The commits of each request, as scanned from one file per request."""
    facts = t.commit.join(t.commit_login.select("sha", "login", "email"), "sha")
    rows = t.pr_commit.join(facts, "sha").select(
        F.col("sha").alias("row"),
        "login",
        "email",
        F.concat(F.lit("Dev, "), F.upper("login")).alias("author_name"),
        iso("committed_at").alias("created_at"),
        F.concat(F.lit('fix "it"\nin '), "sha").alias("message"),
        "sha",
        F.concat(F.lit("get_pr_commits.p"), "project_id", F.lit("_"), "pr_id", F.lit(".csv")).alias("file"),
    )
    return _as_scanned(rows, schemas.PR_COMMITS, "file")


@query(
    "s07_pr_commit_export_commits",
    """SELECT concat('p', p.project_id) AS project, p.sha::STRING AS sha, c.login, c.email,
      'Dev, ' || upper(c.login) AS author_name,
      strftime(c.committed_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at
    FROM (SELECT DISTINCT project_id, sha FROM pr_commit) p JOIN commit_login c ON c.sha=p.sha""",
)
def s07c(t: Tables):
    return exports.pr_commits(_pr_commit_export(t))[0]


@query(
    "s07_pr_commit_export_map",
    """SELECT concat('p', project_id) AS project, pr_id::STRING AS pr_id, sha::STRING AS sha
    FROM pr_commit WHERE (project_id, pr_id) IN (
      SELECT (project_id, pr_id) FROM pr_commit GROUP BY project_id, pr_id
      HAVING count(*) BETWEEN 1 AND 49)""",
)
def s07(t: Tables):
    return exports.pr_commits(_pr_commit_export(t), exports.PUBLISHED_MAX_COMMITS)[1]


@query(
    "s07_pr_commit_export_map_all",
    """SELECT DISTINCT concat('p', project_id) AS project, pr_id::STRING AS pr_id, sha::STRING AS sha
    FROM pr_commit""",
)
def s07a(t: Tables):
    return exports.pr_commits(_pr_commit_export(t))[1]


@query(
    "s07_pr_commit_export_counts",
    """SELECT concat('p', project_id) AS project, pr_id::STRING AS pr_id, count(*) AS num_commit
    FROM pr_commit GROUP BY 1, 2""",
)
def s07b(t: Tables):
    return exports.pr_commits(_pr_commit_export(t))[2]


@query(
    "s08_changed_file_export",
    """SELECT 'p'||sha%25 AS project, sha::STRING AS sha, (additions+1)::INT AS pos, filename,
      additions, (additions%7)::INT AS deletions, status='removed' AS is_removed FROM commit_file""",
)
def s08(t: Tables):
    rows = t.commit_file.select(
        F.col("additions").alias("row"),
        "additions",
        (F.col("additions") + F.col("additions") % 7).alias("changes"),
        (F.col("additions") % 7).alias("deletions"),
        "filename",
        "status",
        F.concat(
            F.lit("get_commit_changedFile.p"), F.col("sha") % 25, F.lit("_"), "sha", F.lit(".csv")
        ).alias("file"),
    )
    return exports.changed_files(_as_scanned(rows, schemas.CHANGED_FILES, "file"))


def timeline_export(t: Tables) -> str:
    rows = t.timeline_full.select(
        F.col("event_pos").alias("row"),
        F.col("actor_id").alias("actor"),
        "association",
        "user_type",
        "body",
        "sha",
        F.concat("actor_id", F.lit("@example.org")).alias("email"),
        "event",
        F.col("ref_pr_id").alias("ref_id"),
        "label",
        "ref_type",
        F.concat(
            F.lit("get_"), "thread_type", F.lit("_timeline.p"), "project_id", F.lit("_"),
            "thread_id", F.lit(".csv"),
        ).alias("file"),
    )
    return write_exports(rows, schemas.TIMELINE, "file", "timelines")


TIMELINE_SQL = """SELECT thread_type, concat('p', project_id) AS project, thread_id, event_pos,
      CASE WHEN event='committed' THEN concat(actor_id, '@example.org') ELSE actor_id::STRING END
        AS actor, event, ref_pr_id::BIGINT AS ref_id, body FROM timeline_full"""
TIMELINE_COLUMNS = [
    "thread_type", "project", "thread_id", "event_pos", "actor", "event", "ref_id", "body",
]


@query("s09_timeline_export", TIMELINE_SQL)
def s09(t: Tables):
    raw = exports.read_csv(t.spark, timeline_export(t), schemas.TIMELINE)
    return exports.timeline(raw).select(*TIMELINE_COLUMNS)


@query(
    "s10_file_changes_from_logs",
    """SELECT l_orderkey AS sha, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)::INT AS pos,
      l_linenumber AS added, l_quantity::INT AS deleted, concat('src/f', l_partkey) AS filename,
      CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'R' ELSE 'M' END AS status FROM lineitem""",
)
def s10(t: Tables):
    within = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    rows = materialize(t.lineitem.withColumn("pos", F.row_number().over(within)), "log_lines")
    pos = "pos"
    file = F.concat(F.lit("src/f"), "l_partkey")
    numstat = rows.select(
        F.col("l_orderkey").alias("sha"),
        pos,
        F.concat_ws("\t", "l_linenumber", F.col("l_quantity").cast("int"), file).alias("value"),
    )
    letter = F.expr("CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'R100' ELSE 'M' END")
    status = rows.select(
        F.col("l_orderkey").alias("sha"), pos, F.concat_ws("\t", letter, file).alias("value")
    )
    return logs.file_changes(numstat, status)


@query(
    "s11_parents_log",
    """SELECT pair_id, sha::STRING AS sha, parent::STRING AS parent, parent_pos FROM dag_edge""",
)
def s11(t: Tables):
    from forklore.operators.dag import edges_from_history

    lines = t.dag.select(
        "pair_id",
        F.concat("sha", F.lit(":"), F.concat_ws(" ", "parent1", "parent2")).alias("value"),
    )
    return edges_from_history(logs.parents_log(lines))


@query(
    "s12_commit_headers",
    """SELECT sha::STRING AS sha, concat('name', sha%7) AS author, concat(sha%7, '@x.org') AS email,
      commit_at AS created_at FROM dag""",
)
def s12(t: Tables):
    who = F.col("sha") % 7
    lines = t.dag.select(
        F.concat_ws(
            "~", "sha", F.concat(F.lit("name"), who), F.concat(who, F.lit("@x.org")),
            iso("commit_at"),
        ).alias("value")
    )
    return logs.commit_headers(lines)


def _repository_json(t: Tables) -> DataFrame:
    parent = t.fork_pair.select("repo_id", F.col("upstream_url").alias("p"))
    return t.repository.join(parent, "repo_id", "left").select(
        "repo_id",
        F.to_json(
            F.struct(
                F.col("repo_id").alias("id"),
                F.col("url").alias("full_name"),
                F.col("is_fork").alias("fork"),
                F.col("stars").alias("stargazers_count"),
                "language",
                iso("created_on").alias("created_at"),
                iso("pushed_on").alias("pushed_at"),
                F.struct(
                    F.split_part("url", F.lit("/"), F.lit(1)).alias("login"),
                    F.lit("User").alias("type"),
                ).alias("owner"),
                F.when(F.col("p").isNotNull(), F.struct(F.col("p").alias("full_name"))).alias(
                    "parent"
                ),
            )
        ).alias("document"),
    )


@query(
    "s13_repository_documents",
    """SELECT r.repo_id, r.url, r.is_fork, r.stars::BIGINT AS stars, r.language,
      CAST(r.created_on AS TIMESTAMP) AS created_at, CAST(r.pushed_on AS TIMESTAMP) AS pushed_at,
      split_part(r.url, '/', 1) AS owner, 'User' AS owner_type, f.upstream_url AS parent_url
    FROM repository r LEFT JOIN fork_pair f ON f.repo_id=r.repo_id""",
)
def s13(t: Tables):
    return documents.repositories(_repository_json(t)).drop("forks")


@query(
    "s14_array_or_object",
    """SELECT repo_id, url AS full_name FROM repository WHERE repo_id%3=0
    UNION ALL SELECT repo_id, url FROM repository WHERE repo_id%3=1
    UNION ALL SELECT repo_id, url FROM repository WHERE repo_id%3=1""",
)
def s14(t: Tables):
    one = F.col("document")
    shaped = _repository_json(t).withColumn(
        "document",
        F.when(F.col("repo_id") % 3 == 0, one)
        .when(F.col("repo_id") % 3 == 1, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
        .otherwise("[]"),
    )
    return documents.array_or_object(shaped, schemas.REPOSITORY_JSON).select(
        "repo_id", F.col("item")["full_name"].alias("full_name")
    )


@query(
    "s15_pr_listing_documents",
    """SELECT p.project_id, p.pr_id, concat('user', p.author_id) AS author,
      CASE WHEN NOT is_closed THEN 'open' WHEN NOT is_merged THEN 'closed' ELSE 'merged' END AS state,
      coalesce(c.n, 0) AS n_commits
    FROM pull_request p LEFT JOIN (SELECT project_id, pr_id, count(DISTINCT sha) AS n FROM pr_commit
      GROUP BY 1, 2) c ON c.project_id=p.project_id AND c.pr_id=p.pr_id""",
)
def s15(t: Tables):
    listing = t.pull_request.select(
        "project_id",
        F.to_json(
            F.struct(
                F.col("pr_id").alias("number"),
                F.struct(F.concat(F.lit("user"), "author_id").alias("login")).alias("user"),
                F.when(F.col("is_closed"), iso("created_at")).alias("closed_at"),
                F.when(F.col("is_merged"), iso("created_at")).alias("merged_at"),
            )
        ).alias("document"),
    )
    return documents.pr_listing(listing, t.pr_commit)


@query(
    "s16_search_page_hits",
    """SELECT page_id, 0::INT AS position, concat('org', page_id%7, '/name', page_id) AS name
    FROM pages""",
)
def s16(t: Tables):
    hit = F.concat(
        F.lit('<div class="x repo-list-item"><p>by</p><a href="/r">org'), F.col("page_id") % 7,
        F.lit("/name"), "page_id", F.lit('</a><a href="/s">other</a></div>'),
    )
    return documents.search_hits(
        t.pages.select("page_id", F.replace("html", F.lit("<nav>"), F.concat(hit, F.lit("<nav>")))
                       .alias("html"))
    )


@query(
    "s17_pr_fork_lines",
    """SELECT DISTINCT CASE WHEN contains(fork_url, ':')
      THEN concat(split_part(fork_url, ':', 1), '/', split_part(fork_url, '/', 2))
      ELSE fork_url END AS fork_url FROM pr_author WHERE fork_url<>''""",
)
def s17(t: Tables):
    document = F.to_json(F.struct(F.col("fork_url").alias("forkURL")))
    lines = t.pr_author.select(
        F.concat("pr_id", F.lit("----["), document, F.lit("]")).alias("value")
    )
    return logs.pr_fork_lines(logs.lines(t.spark, _write_lines(lines)))


@query(
    "s18_overwrite_and_append",
    """SELECT pr_id::STRING AS pr_id FROM pull_request WHERE is_merged
    UNION ALL SELECT pr_id::STRING FROM pull_request WHERE NOT is_closed""",
)
def s18(t: Tables):
    path = new_path(t.spark, "csv")
    prs = t.pull_request
    sinks.write_csv(prs.filter("is_closed").select("pr_id"), path)
    sinks.write_csv(prs.filter("is_merged").select("pr_id"), path)
    sinks.write_csv(prs.filter("NOT is_closed").select("pr_id"), path, append=True)
    return t.spark.read.schema("pr_id string").option("header", True).csv(path)


@query("s19_table_store", "SELECT project_id, pr_id, is_merged FROM pull_request")
def s19(t: Tables):
    path = new_path(t.spark, "table")
    sinks.write_table(
        t.pull_request.select("project_id", "pr_id", "is_merged"), path, ["project_id"]
    )
    return t.spark.read.parquet(path).select("project_id", "pr_id", "is_merged")


@query(
    "s20_insert_absent",
    """SELECT DISTINCT project_id, author_id FROM pull_request""",
)
def s20(t: Tables):
    path = new_path(t.spark, "insert")
    keys = ["project_id", "author_id"]
    people = t.pull_request.select(*keys)
    people.filter("is_merged").distinct().write.parquet(path)
    for _ in range(2):
        sinks.insert_absent(people, path, keys)
    return t.spark.read.parquet(path)


@query(
    "s21_keyed_metric_join",
    """SELECT p.project_id, p.pr_id, c.n AS num_commit, m.n AS num_comments FROM pull_request p
    LEFT JOIN (SELECT project_id, pr_id, count(*) AS n FROM pr_commit GROUP BY 1, 2) c
      ON c.project_id=p.project_id AND c.pr_id=p.pr_id
    LEFT JOIN (SELECT project_id, pr_id, count(*) AS n FROM pr_comment GROUP BY 1, 2) m
      ON m.project_id=p.project_id AND m.pr_id=p.pr_id""",
)
def s21(t: Tables):
    from forklore.operators.aggregates import count_by
    from forklore.plans.summary import join_metrics

    keys = ["project_id", "pr_id"]
    return join_metrics(
        t.pull_request.select(*keys),
        [
            count_by(t.pr_commit, *keys, name="num_commit"),
            count_by(t.pr_comment, *keys, name="num_comments"),
        ],
        keys,
    )


PATCH = """SELECT repo_id, CAST(stars+1 AS INT) AS stars,
      CASE WHEN repo_id%4=0 THEN 'NULL' WHEN repo_id%4=1 THEN 'Rust' END AS language
    FROM repository WHERE repo_id%3=0"""


@query(
    "s22_keyed_patch",
    f"""SELECT r.repo_id, coalesce(p.stars, r.stars) AS stars,
      coalesce(CASE WHEN p.language='NULL' THEN '' ELSE p.language END, r.language) AS language
    FROM repository r LEFT JOIN ({PATCH}) p ON p.repo_id=r.repo_id""",
)
def s22(t: Tables):
    base = t.repository.select("repo_id", "stars", "language")
    return sinks.apply_patch(base, t.sql(PATCH), ["repo_id"], ["stars", "language"])


@query(
    "s22_upsert",
    """SELECT repo_id, coalesce(p.stars, r.stars) AS stars FROM
      (SELECT repo_id, stars FROM repository WHERE repo_id%2=0) r
    FULL JOIN (SELECT repo_id, CAST(stars+1 AS INT) AS stars FROM repository WHERE repo_id%3=0) p
      USING (repo_id)""",
)
def s22b(t: Tables):
    base = t.repository.filter(F.col("repo_id") % 2 == 0).select("repo_id", "stars")
    return sinks.upsert(base, t.sql(PATCH).drop("language"), ["repo_id"], ["stars"])


@query(
    "s23_hard_fork_rows",
    """SELECT concat('f', o_orderkey) AS fork_url, concat('u', o_custkey) AS upstream_url,
      o_orderkey%3 AS "only_F", o_orderkey%2 AS "only_U", o_custkey%2 AS "F2U", 0::BIGINT AS "U2F",
      CASE WHEN o_orderkey%5=0 THEN concat('g', o_custkey) END AS grandparent_url,
      CASE WHEN o_orderkey%5=0 THEN o_custkey END AS grandparent_stars
    FROM orders WHERE o_orderkey%3+o_orderkey%2+o_custkey%2>0""",
)
def s23(t: Tables):
    has_grandparent = F.col("o_orderkey") % 5 == 0
    ragged = F.concat_ws(
        ",",
        F.concat(F.lit("f"), "o_orderkey"),
        F.concat(F.lit("u"), "o_custkey"),
        F.col("o_orderkey") % 3,
        F.col("o_orderkey") % 2,
        F.col("o_custkey") % 2,
        F.lit("0"),
        F.when(has_grandparent, F.concat(F.lit("g"), "o_custkey")),
        F.when(has_grandparent, F.col("o_custkey")),
    )
    path = _write_lines(t.orders.select(ragged.alias("value")))
    raw = exports.read_csv(t.spark, path, schemas.HARD_FORK, header=False)
    return sinks.hard_fork_rows(raw)


@query(
    "s24_active_fork_rows",
    """WITH lines AS (SELECT concat('new', o_orderkey%500) AS fork_url,
        concat('owner', o_orderkey%500%25, '/repo', o_orderkey%500) AS upstream_url,
        1000::BIGINT AS project_id FROM orders)
    SELECT DISTINCT l.fork_url, l.project_id, coalesce(r.repo_id, 1000) AS upstream_id
    FROM lines l LEFT JOIN repository r ON r.url=l.upstream_url""",
)
def s24(t: Tables):
    number = F.col("o_orderkey") % 500
    lines = t.orders.select(
        F.concat(F.lit("new"), number).alias("fork_url"),
        F.concat(F.lit("owner"), number % 25, F.lit("/repo"), number).alias("upstream_url"),
        F.lit(1000).cast("long").alias("project_id"),
    )
    return sinks.active_fork_rows(lines, t.repository)
