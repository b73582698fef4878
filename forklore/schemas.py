"""Schemas of the export files. Columns are told apart by position, as in the exports."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PULL_REQUESTS = _strings(
    "row", "author", "c2", "c3", "c4", "closed_at", "created_at", "fork_url", "c8", "pr_id",
    "labels", "merged_at", "title", "c13",
)
ISSUES = _strings(
    "row", "author", "closed", "closed_at", "created_at", "issue_id", "title", "updated_at"
)
PR_COMMITS = _strings(
    "row", "login", "email", "author_name", "created_at", "c5", "message", "c7", "sha"
)
PR_COMMENTS = _strings("row", "author", "body")
TIMELINE = _strings(
    "row", "c1", "actor", "association", "user_type", "body", "sha", "c7", "email", "event",
    "ref_id", "label", "ref_project", "ref_state", "ref_type",
)
CHANGED_FILES = _strings("row", "additions", "changes", "deletions", "filename", "status")
GRAPH_RESULT = _strings("fork", "upstream", "only_F", "only_U", "F2U", "U2F", "before")
COMMIT_CATEGORY = _strings("sha", "category", "relative_date", "iso_date")
HARD_FORK = _strings(
    "fork_url", "upstream_url", "only_F", "only_U", "F2U", "U2F", "grandparent_url",
    "grandparent_stars",
)

OWNER_JSON = T.StructType(
    [T.StructField("login", T.StringType()), T.StructField("type", T.StringType())]
)
REPOSITORY_JSON = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("fork", T.BooleanType()),
        T.StructField("forks_count", T.LongType()),
        T.StructField("stargazers_count", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("pushed_at", T.StringType()),
        T.StructField("owner", OWNER_JSON),
        T.StructField("parent", T.StructType([T.StructField("full_name", T.StringType())])),
    ]
)
PR_JSON = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("closed_at", T.StringType()),
        T.StructField("merged_at", T.StringType()),
        T.StructField("user", OWNER_JSON),
    ]
)
