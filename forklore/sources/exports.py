"""CSV exports. The key of an export (project, number, kind) is in its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forklore.functions.dates import iso_timestamp

# File-name patterns of the exports.
THREAD_FILE = r"get_(pr|issue)_timeline\.(.+?)_(\d+)(\.0)?\.csv"
KEYED_FILE = r"get_[a-z_A-Z]+?\.(.+?)_([0-9a-f]+)(\.0)?\.csv"
PROJECT_FILE = r"get_(?:prs|issues)\.([^/]+?)\.csv"

#: The most commits of a request in the published map.
PUBLISHED_MAX_COMMITS = 49


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, comment: str = "#"
) -> DataFrame:
    """Quoted, multi-line CSV with ``""`` as escape and comment lines; adds ``path``.

    A multi-line file cannot be split, so its rows come in order to one task and the
    row index in the export, not the file order, says the position.
    """
    return (
        spark.read.schema(schema)
        .options(
            multiLine=True, quote='"', escape='"', comment=comment, header=header,
            mode="PERMISSIVE",
        )
        .csv(path)
        .withColumn("path", F.url_decode(F.col("_metadata.file_path")))
    )


def thread_key(path: Column) -> list[Column]:
    """``thread_type, project, thread_id`` from the path of a timeline export."""
    return [
        F.nullif(F.regexp_extract(path, THREAD_FILE, 1), F.lit("")).alias("thread_type"),
        F.nullif(F.regexp_extract(path, THREAD_FILE, 2), F.lit("")).alias("project"),
        F.regexp_extract(path, THREAD_FILE, 3).try_cast("bigint").alias("thread_id"),
    ]


def project_key(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, PROJECT_FILE, 1), F.lit("")).alias("project")


def keyed(path: Column, name: str) -> list[Column]:
    """``project`` and a number or hash from the path of a per-item export."""
    return [
        F.nullif(F.regexp_extract(path, KEYED_FILE, 1), F.lit("")).alias("project"),
        F.nullif(F.regexp_extract(path, KEYED_FILE, 2), F.lit("")).alias(name),
    ]


def _filled(column: str) -> Column:
    value = F.col(column)
    return value.isNotNull() & (value != "")


def pull_requests(raw: DataFrame) -> DataFrame:
    """Typed pull requests from an export; closed and merged follow from the dates."""
    return raw.filter(F.col("pr_id").try_cast("bigint").isNotNull()).select(
        project_key(F.col("path")),
        F.col("pr_id").cast("bigint").alias("pr_id"),
        "author",
        "fork_url",
        iso_timestamp(F.col("created_at")).cast("timestamp_ntz").alias("created_at"),
        _filled("closed_at").alias("is_closed"),
        _filled("merged_at").alias("is_merged"),
        F.coalesce(F.lower("labels").contains("duplicate"), F.lit(False)).alias("is_duplicate"),
        "title",
    )


def issues(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("issue_id").try_cast("bigint").isNotNull()).select(
        project_key(F.col("path")),
        F.col("issue_id").cast("bigint").alias("issue_id"),
        "author",
        (F.lower("closed") == "true").alias("closed"),
        iso_timestamp(F.col("created_at")).cast("timestamp_ntz").alias("created_at"),
        "title",
    )


def pr_commits(raw: DataFrame, max_commits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits, the map of pull requests to commits, and the number of commits of each.

    With ``max_commits`` the first two leave out pull requests with more; the number is for all.
    """
    rows = raw.select(*keyed(F.col("path"), "pr_id"), "*").drop("path").filter(_filled("sha"))
    keys = ["project", "pr_id"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_commit"))
    kept = rows
    if max_commits is not None:
        usual = counts.filter(F.col("num_commit") <= max_commits)
        kept = rows.join(usual.select(*keys), keys, "left_semi")
    commits = kept.groupBy("project", "sha").agg(
        F.min_by(F.struct("login", "email", "author_name", "created_at"), "pr_id").alias("_c")
    ).select("project", "sha", "_c.*")
    return commits, kept.select(*keys, "sha").distinct(), counts


def changed_files(raw: DataFrame) -> DataFrame:
    return raw.filter(_filled("filename")).select(
        *keyed(F.col("path"), "sha"),
        (F.col("row").cast("int") + 1).alias("pos"),
        "filename",
        F.col("additions").cast("int").alias("additions"),
        F.col("deletions").cast("int").alias("deletions"),
        (F.col("status") == "removed").alias("is_removed"),
    )


def timeline(raw: DataFrame) -> DataFrame:
    """Typed timeline events; rows without an event are dropped, committers known by mail."""
    committed = F.col("event") == "committed"
    return raw.filter(_filled("event")).select(
        *thread_key(F.col("path")),
        F.col("row").cast("bigint").alias("event_pos"),
        F.when(committed, F.col("email")).otherwise(F.col("actor")).alias("actor"),
        F.when(committed, F.col("actor")).alias("full_name"),
        "association",
        "user_type",
        "body",
        "sha",
        "event",
        F.col("ref_id").try_cast("bigint").alias("ref_id"),
        "label",
        "ref_project",
        "ref_state",
        "ref_type",
    )
