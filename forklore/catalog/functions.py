"""Scalar functions (F1 - F26), each over every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore.catalog.registry import query
from forklore.catalog.views import SNAPSHOT, Tables
from forklore.functions import commits, dates, text

REF = text.PR_REFERENCE


def any_match(column: str, patterns) -> str:
    """SQL: one of the published patterns is found."""
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


@query(
    "f01_ascii_fold",
    r"""SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS folded
    FROM documents""",
)
def f01(t: Tables):
    return t.documents.select("doc_id", text.ascii_fold(F.col("text")).alias("folded"))


@query(
    "f02_fork_url_canonical",
    """SELECT DISTINCT fork_url, CASE WHEN contains(fork_url, ':')
      THEN concat(split_part(fork_url, ':', 1), '/', split_part(fork_url, '/', 2))
      ELSE fork_url END AS canonical FROM pr_author""",
)
def f02(t: Tables):
    return t.pr_author.select(
        "fork_url", text.fork_url_canonical(F.col("fork_url")).alias("canonical")
    ).distinct()


@query(
    "f03_url_parts",
    """SELECT url, split_part(url, '/', 1) AS owner, split_part(url, '/', 2) AS repo,
      replace(url, '/', '.') AS dotted, replace(url, '/', '~') AS tilded FROM repository""",
)
def f03(t: Tables):
    url = F.col("url")
    return t.repository.select(
        "url",
        text.url_owner(url).alias("owner"),
        text.url_repo(url).alias("repo"),
        text.url_as_file_name(url).alias("dotted"),
        text.url_as_file_name(url, "~").alias("tilded"),
    )


@query("f04_strip_api_prefix", "SELECT repo_id, url AS stripped FROM repository")
def f04(t: Tables):
    api = F.concat(F.lit("https://api.github.com/repos/"), "url")
    return t.repository.select("repo_id", text.strip_api_prefix(api).alias("stripped"))


@query(
    "f05_unordered_pair_key",
    """SELECT fork_url, upstream_url, CASE WHEN fork_url<=upstream_url
      THEN concat(fork_url, ',', upstream_url) ELSE concat(upstream_url, ',', fork_url) END AS pair
    FROM fork_pair""",
)
def f05(t: Tables):
    return t.fork_pair.select(
        "fork_url",
        "upstream_url",
        text.unordered_pair_key(F.col("fork_url"), F.col("upstream_url")).alias("pair"),
    )


@query(
    "f06_name_distance",
    """SELECT p_partkey, levenshtein(lower(p_name), lower(p_type))::INT AS distance,
      levenshtein(lower(p_name), lower(p_type))>2 AS differs FROM part""",
)
def f06(t: Tables):
    a, b = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey",
        text.name_distance(a, b).alias("distance"),
        text.names_differ(a, b).alias("differs"),
    )


@query(
    "f07_duplicate_pr_text",
    f"""SELECT project_id, pr_id, comment_pos, body, 
      {any_match("body", text.DUPLICATE_PR_STRICT)} AS is_duplicate FROM pr_comment""",
)
def f07(t: Tables):
    return t.pr_comment.select(
        "project_id", "pr_id", "comment_pos", "body",
        text.is_duplicate_pr_text(F.col("body")).alias("is_duplicate"),
    )


@query(
    "f08_duplicate_comment",
    f"""SELECT conv_id, turn, {any_match("text", text.DUPLICATE_COMMENT_LOOSE)} AS is_duplicate FROM conversations
    UNION ALL SELECT pr_id, comment_pos, {any_match("body", text.DUPLICATE_COMMENT_LOOSE)} FROM pr_comment""",
)
def f08(t: Tables):
    talk = t.conversations.select("conv_id", "turn", "text")
    comments = t.pr_comment.select("pr_id", "comment_pos", "body")
    both = talk.union(comments)
    return both.select(
        "conv_id", "turn", text.is_duplicate_comment(F.col("text")).alias("is_duplicate")
    )


@query(
    "f09_referenced_numbers",
    f"""SELECT DISTINCT project_id, pr_id, comment_pos,
      unnest(regexp_extract_all(body, '{REF}', 7))::BIGINT AS number FROM pr_comment""",
)
def f09(t: Tables):
    return t.pr_comment.select(
        "project_id", "pr_id", "comment_pos",
        F.explode(text.referenced_numbers(F.col("body"))).alias("number"),
    ).distinct()


@query(
    "f10_issue_links",
    f"""SELECT DISTINCT project_id, pr_id, comment_pos,
      unnest(regexp_extract_all(body, '{text.ISSUE_LINK}', 1))::BIGINT AS number
    FROM pr_comment""",
)
def f10(t: Tables):
    return t.pr_comment.select(
        "project_id", "pr_id", "comment_pos",
        F.explode(text.issue_links(F.col("body"))).alias("number"),
    ).distinct()


@query(
    "f11_commit_sha_mention",
    f"""SELECT project_id, pr_id, nullif(trim(regexp_extract(body,
      '{text.COMMIT_SHA}', 0)), '') AS sha FROM pr_text""",
)
def f11(t: Tables):
    return t.pr_text.select(
        "project_id", "pr_id", text.commit_sha_mention(F.col("body")).alias("sha")
    )


@query(
    "f12_names_other_pr",
    f"""WITH x AS (SELECT *, CASE pr_id%3 WHEN 0 THEN body
        WHEN 1 THEN concat('https://github.com/o/r/pull/', pr_id, '#issuecomment-', pr_id)
        ELSE concat(body, ' https://github.com/o/r/issues/', pr_id, '#issuecomment-1') END AS b
      FROM pr_text),
    y AS (SELECT *, regexp_extract(lower(b), '{REF}', 0) AS link,
      regexp_extract(lower(b), '{text.ISSUE_COMMENT_REFERENCE}', 0) AS comment FROM x)
    SELECT project_id, pr_id, link<>'' AND (comment='' OR
      NOT contains(comment, replace(link, '#', ''))) AS names_pr FROM y""",
)
def f12(t: Tables):
    pr = F.col("pr_id").cast("string")
    body = (
        F.when(F.col("pr_id") % 3 == 0, F.col("body"))
        .when(
            F.col("pr_id") % 3 == 1,
            F.concat(F.lit("https://github.com/o/r/pull/"), pr, F.lit("#issuecomment-"), pr),
        )
        .otherwise(
            F.concat("body", F.lit(" https://github.com/o/r/issues/"), pr, F.lit("#issuecomment-1"))
        )
    )
    return t.pr_text.withColumn("b", body).select(
        "project_id", "pr_id", text.names_other_pr(F.col("b")).alias("names_pr")
    )


@query(
    "f13_merge_keywords",
    f"""SELECT thread_id, event_pos,
      regexp_matches(lower(body), '{text.MERGE_KEYWORDS_TYPE_4}') AS type_4,
      {any_match("lower(body)", text.MERGE_KEYWORDS_BROAD)}
        AS broad FROM timeline_full""",
)
def f13(t: Tables):
    body = F.col("body")
    return t.timeline_full.select(
        "thread_id",
        "event_pos",
        text.has_merge_keyword(body).alias("type_4"),
        text.has_broad_merge_keyword(body).alias("broad"),
    )


@query(
    "f14_digits_only_id",
    r"""SELECT page_id, try_cast(nullif(regexp_replace(url, '\D+', '', 'g'), '') AS BIGINT) AS digits
    FROM pages""",
)
def f14(t: Tables):
    return t.pages.select("page_id", text.digits_only_id(F.col("url")).alias("digits"))


@query(
    "f15_date_maths",
    f"""SELECT repo_id, date_diff('day', created_on, DATE '{SNAPSHOT}')::INT AS fork_age,
      (date_diff('day', created_on, DATE '{SNAPSHOT}')//365)::INT AS years,
      CAST(created_on - INTERVAL 3 MONTH AS DATE) AS since FROM repository""",
)
def f15(t: Tables):
    as_of = F.lit(SNAPSHOT).cast("date")
    created = F.col("created_on")
    return t.repository.select(
        "repo_id",
        dates.age_in_days(created, as_of).alias("fork_age"),
        dates.whole_years_between(created, as_of).alias("years"),
        dates.months_before(created).alias("since"),
    )


@query("f16_iso_timestamp", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def f16(t: Tables):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select(
        "event_id", dates.iso_timestamp(iso).cast("timestamp_ntz").alias("parsed")
    )


@query(
    "f17_same_author",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_suppkey%10=l_linenumber, false)
      OR coalesce(CASE WHEN l_returnflag<>'N' THEN l_linestatus END=l_returnflag, false)
      OR l_partkey%10=l_suppkey%7 AS same FROM lineitem""",
)
def f17(t: Tables):
    mail = F.array((F.col("l_partkey") % 10).cast("string"))
    other = F.array((F.col("l_suppkey") % 7).cast("string"), F.lit("x"))
    same = commits.same_author(
        F.col("l_suppkey") % 10,
        F.col("l_linenumber"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")),
        F.col("l_returnflag"),
        mail,
        other,
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", same.alias("same"))


@query(
    "f18_strip_brackets",
    """SELECT conv_id, turn, replace(replace(replace(text, chr(10), ''), '[', ''), ']', '')
      AS stripped FROM conversations""",
)
def f18(t: Tables):
    return t.conversations.select(
        "conv_id", "turn", text.strip_brackets(F.col("text")).alias("stripped")
    )


CHANGES = """SELECT sha, concat(CASE sha%9 WHEN 0 THEN 'README/' WHEN 1 THEN 'config/' ELSE '' END,
      filename) AS filename,
      CASE WHEN sha%17=0 THEN 'C' WHEN sha%19=0 THEN 'R' WHEN status='added' THEN 'A'
        WHEN status='modified' THEN 'M' ELSE 'D' END AS status,
      additions AS added, CAST(sha%13 AS INT) AS deleted FROM commit_file"""
FLAGS = """SELECT sha, filename, (status='A')::INT AS is_a, (status='C')::INT AS is_c,
      (status='D')::INT AS is_d, (status='M')::INT AS is_m, (status='R')::INT AS is_r,
      CASE WHEN status='A' THEN added ELSE 0 END AS lines_in_added_files,
      CASE WHEN status='M' THEN added ELSE 0 END AS lines_in_modified_files,
      deleted AS lines_deleted,
      CASE WHEN contains(lower(filename), 'readme') THEN added ELSE 0 END AS readme_lines_added,
      contains(lower(filename), 'config') AS about_config FROM change"""


@query("f19_change_flags", f"WITH change AS ({CHANGES}) {FLAGS}")
def f19(t: Tables):
    return t.sql(CHANGES).select(
        "sha",
        "filename",
        *commits.change_flags(
            F.col("filename"), F.col("status"), F.col("added"), F.col("deleted")
        ),
    )


@query(
    "f20_same_description",
    """SELECT r.repo_id, coalesce(trim(r.description)=trim(u.description), false) AS same
    FROM repository r JOIN repository u ON u.repo_id=r.parent_id""",
)
def f20(t: Tables):
    up = t.repository.select(F.col("repo_id").alias("parent_id"), F.col("description").alias("d"))
    return t.repository.join(up, "parent_id").select(
        "repo_id", text.same_description(F.col("description"), F.col("d")).alias("same")
    )


LOGINS = """SELECT repo_id, url, CASE repo_id%5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null'
      WHEN 3 THEN url ELSE concat('user', CAST(repo_id AS STRING)) END AS login FROM repository"""


@query(
    "f21_owner_login_repaired",
    f"""WITH l AS ({LOGINS})
    SELECT repo_id, CASE WHEN login IS NULL OR login IN ('', 'null') OR contains(login, '/')
      THEN split_part(url, '/', 1) ELSE login END AS repaired FROM l""",
)
def f21(t: Tables):
    return t.sql(LOGINS).select(
        "repo_id", text.owner_login_repaired(F.col("login"), F.col("url")).alias("repaired")
    )


@query(
    "f22_year_bucket",
    f"""SELECT repo_id, least(10, date_sub('year', created_on, DATE '{SNAPSHOT}'))::INT AS bucket
    FROM repository""",
)
def f22(t: Tables):
    bucket = dates.year_bucket(F.col("created_on"), F.lit(SNAPSHOT).cast("date"), cap=10)
    return t.repository.select("repo_id", bucket.alias("bucket"))


@query(
    "f23_pr_state",
    """SELECT project_id, pr_id, CASE WHEN NOT is_closed THEN 'open' WHEN NOT is_merged
      THEN 'closed' ELSE 'merged' END AS state FROM pull_request""",
)
def f23(t: Tables):
    at = F.col("created_at")
    state = dates.pr_state(F.when(F.col("is_closed"), at), F.when(F.col("is_merged"), at))
    return t.pull_request.select("project_id", "pr_id", state.alias("state"))


@query(
    "f24_commit_facts_from_json",
    """SELECT sha, coalesce(login, '') AS login, email, (sha%2+1)::INT AS n_parents
    FROM commit_login""",
)
def f24(t: Tables):
    sha = F.col("sha").cast("string")
    document = F.to_json(
        F.struct(
            sha.alias("sha"),
            F.struct(F.struct(F.col("email").alias("name"), "email").alias("author")).alias(
                "commit"
            ),
            F.when(F.col("login").isNotNull(), F.struct("login")).alias("author"),
            F.when(
                F.col("sha") % 2 == 1, F.array(F.struct(sha.alias("sha")), F.struct(sha.alias("sha")))
            )
            .otherwise(F.array(F.struct(sha.alias("sha"))))
            .alias("parents"),
        )
    )
    facts = t.commit_login.select(commits.commit_facts(document).alias("c"))
    return facts.select(
        F.col("c.sha").cast("bigint").alias("sha"),
        "c.login",
        "c.email",
        F.size("c.parents").alias("n_parents"),
    )


@query(
    "f25_is_merge",
    "SELECT pair_id, sha, parent2 IS NOT NULL AS is_merge FROM dag",
)
def f25(t: Tables):
    parents = F.array_compact(F.array("parent1", "parent2"))
    return t.dag.select("pair_id", "sha", commits.is_merge(parents).alias("is_merge"))


@query(
    "f26_sha_cells",
    """SELECT pair_id, sha, parent1 AS parent FROM dag
    UNION ALL SELECT pair_id, sha, parent2 FROM dag WHERE parent2 IS NOT NULL""",
)
def f26(t: Tables):
    cell = F.concat(F.lit("["), F.concat_ws("/ ", "parent1", "parent2"), F.lit("]"))
    return (
        t.dag.select("pair_id", "sha", F.explode_outer(text.parse_sha_cell(cell)).alias("parent"))
        .withColumn("parent", F.col("parent").cast("bigint"))
    )
