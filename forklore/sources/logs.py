"""Line-oriented dumps: lists, ``key,[a, b]`` lines, commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forklore.functions.dates import iso_timestamp
from forklore.functions.text import fork_url_canonical

MAX_WORDS = 10_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines as ``value``."""
    return spark.read.text(path).filter(F.col("value") != "")


def word_list(spark: SparkSession, path: str, at_most: int = MAX_WORDS) -> list[str]:
    """A configuration list for the driver. Refuses lists that are data rather than words."""
    words = [r.value for r in lines(spark, path).limit(at_most + 1).collect()]
    if len(words) > at_most:
        raise ValueError(f"{path} has more than {at_most} lines; join it instead")
    return words


def list_lines(values: DataFrame) -> DataFrame:
    """``key,[a, b]`` to ``key, items``; an empty list gives an empty array."""
    parts = F.split("value", r",\[", 2)
    body = F.regexp_replace(F.get(parts, 1), r"[\[\]]", "")
    return values.select(
        F.get(parts, 0).alias("key"),
        F.filter(F.split(body, ", "), lambda x: x != "").alias("items"),
    )


def parents_log(values: DataFrame) -> DataFrame:
    """``sha:p1 p2`` lines, keyed by the other columns, to ``sha, parents``."""
    keys = [c for c in values.columns if c != "value"]
    parts = F.split("value", ":", 2)
    return values.select(
        *keys,
        F.get(parts, 0).alias("sha"),
        F.filter(F.split(F.get(parts, 1), " "), lambda x: x != "").alias("parents"),
    )


def commit_headers(values: DataFrame) -> DataFrame:
    """``sha~name~email~date`` lines."""
    parts = F.split("value", "~", 4)
    return values.select(
        F.get(parts, 0).alias("sha"),
        F.get(parts, 1).alias("author"),
        F.get(parts, 2).alias("email"),
        iso_timestamp(F.get(parts, 3)).cast("timestamp_ntz").alias("created_at"),
    )


def file_changes(numstat: DataFrame, name_status: DataFrame) -> DataFrame:
    """Join the two dumps of a commit's files on ``(sha, pos)``.

    ``numstat(sha, pos, value)`` holds ``added<TAB>deleted<TAB>file`` (``-`` for binary
    files, read as 0) and ``name_status(sha, pos, value)`` holds ``letter<TAB>file``; of
    a letter with a score (``R100``) the letter counts.
    """
    n = F.split("value", "\t")
    s = F.split("value", "\t")
    counts = numstat.select(
        "sha",
        "pos",
        F.coalesce(F.get(n, 0).try_cast("int"), F.lit(0)).alias("added"),
        F.coalesce(F.get(n, 1).try_cast("int"), F.lit(0)).alias("deleted"),
        F.get(n, 2).alias("filename"),
    )
    letters = name_status.select(
        "sha", "pos", F.substring(F.get(s, 0), 1, 1).alias("status")
    )
    return counts.join(letters, ["sha", "pos"])


def pr_fork_lines(values: DataFrame) -> DataFrame:
    """``prefix----[json]`` lines to distinct canonical fork urls."""
    document = F.regexp_replace(F.get(F.split("value", r"----\[", 2), 1), r"\]$", "")
    url = F.get_json_object(document, "$.forkURL")
    return (
        values.select(fork_url_canonical(url).alias("fork_url"))
        .filter(F.col("fork_url").isNotNull() & (F.col("fork_url") != ""))
        .distinct()
    )
