"""Sinks: files, tables, insert-if-absent, keyed patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forklore.operators.joins import absent

# Rows per statement of the published loaders.
BATCH_ROWS = 100


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(
        path, header=True, quote='"', escape='"', quoteAll=False
    )


def write_text(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), append: bool = False):
    """Parquet is the primary store; partition large tables by project."""
    df.write.mode("append" if append else "overwrite").partitionBy(*partition_by).parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """One-off import; with a partition column the table is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if partition_column:
        low, high = bounds
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=str(partitions),
        )
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = BATCH_ROWS, **options: str):
    df.write.format("jdbc").options(
        url=url, dbtable=table, batchsize=str(batch_rows), **options
    ).mode("append").save()


def new_rows(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to insert: one per key, the least by its other columns, and only keys that are not there yet."""
    return absent(least_per_key(rows, keys), existing, keys)


def least_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the least by its other columns in their order."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select(*[f"_least.{c}" if c in rest else c for c in rows.columns])


def insert_absent(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys the parquet table lacks. Running it again adds nothing."""
    existing = rows.sparkSession.read.schema(rows.schema).parquet(path)
    new_rows(rows, existing, keys).write.mode("append").parquet(path)


def apply_patch(
    base: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Overwrite columns where the patch has a value; the text ``NULL`` reads as empty."""
    types = dict(patch.dtypes)
    side = patch.select(
        *keys,
        *[
            (F.when(F.col(c) == "NULL", "").otherwise(F.col(c)) if types[c] == "string"
             else F.col(c)).alias(f"_{c}")
            for c in columns
        ],
    )
    joined = base.join(side, list(keys), "left")
    return joined.select(
        *[
            F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )


def upsert(base: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]):
    """Patch the rows that exist and add those that do not."""
    patched = apply_patch(base, rows, keys, columns)
    return patched.unionByName(new_rows(rows, base, keys), allowMissingColumns=True)


def hard_fork_rows(raw: DataFrame) -> DataFrame:
    """Candidate rows with a count in any category; missing grandparent columns are NULL."""
    counts = ["only_F", "only_U", "F2U", "U2F"]
    typed = raw.select(
        "fork_url",
        "upstream_url",
        *[F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).alias(c) for c in counts],
        F.nullif("grandparent_url", F.lit("")).alias("grandparent_url"),
        F.col("grandparent_stars").try_cast("bigint").alias("grandparent_stars"),
    )
    return typed.filter(sum((F.col(c) for c in counts), F.lit(0)) > 0)


def active_fork_rows(forks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Forks not in the repository table yet, with the id of their upstream.

    ``forks(fork_url, upstream_url, project_id)``; an upstream that is unknown or the
    project itself resolves to the project.
    """
    known = repositories.select(F.col("url").alias("fork_url"))
    fresh = least_per_key(forks.join(known, "fork_url", "left_anti"), ["fork_url"])
    ids = repositories.select(
        F.col("url").alias("upstream_url"), F.col("repo_id").alias("_upstream_id")
    )
    return fresh.join(ids, "upstream_url", "left").select(
        "fork_url", "project_id", F.coalesce("_upstream_id", "project_id").alias("upstream_id")
    )
