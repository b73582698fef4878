"""Co-change modularity of a project from its latest external commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.functions.text import ends_with_any
from forklore.operators.filters import added_or_modified
from forklore.operators.windows import latest_per_group
from forklore.session import materialize


def latest_external_commits(
    commits: DataFrame, members: DataFrame | None = None, n: int = 50, since: Column | None = None,
    keys: Sequence[str] = ("project_id",),
) -> DataFrame:
    """The latest ``n`` commits per project (or ``keys``) by people outside the core team."""
    rows = commits if since is None else commits.filter(F.col("committed_at") >= since)
    if members is not None:
        rows = rows.filter(F.col("login").isNotNull() & ~F.col("login").contains("bot")).join(
            members.select("project_id", "login").distinct(), ["project_id", "login"], "left_anti"
        )
    return latest_per_group(rows, list(keys), [F.desc("committed_at"), F.col("sha")], n)


def modularity(
    commits: DataFrame,
    files: DataFrame,
    suffixes: Sequence[str] | None = None,
    stop_names: Sequence[str] = (),
    *,
    max_files: int | None,
    n_commits: int,
    members: DataFrame | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Share of file pairs that changed together: ``project_id, n_files, n_pairs, modularity``.

    ``commits(project_id, sha, committed_at, login)``. Commits with more than
    ``max_files`` files (none if it is None) are passed over before the latest are taken. With ``suffixes``
    only source files count, less the exact ``stop_names``. Fewer than two files give
    NULL.
    """
    scope = "all_files" if suffixes is None else "source_only"
    found = modularity_grid(
        commits, files, suffixes or [], [max_files], [scope],
        stop_names=stop_names, n_commits=n_commits, members=members, since=since,
    )
    return found.drop("max_files", "scope")


def modularity_grid(
    commits: DataFrame,
    files: DataFrame,
    suffixes: Sequence[str],
    thresholds: Sequence[int | None] = (10, 30),
    scopes: Sequence[str] = ("all_files", "source_only"),
    *,
    n_commits: int,
    stop_names: Sequence[str] = (),
    members: DataFrame | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Modularity for each combination of commit-size limit and file scope, in one pass over the files.

    A commit is marked with every limit it keeps, its files with every scope. Files that changed in the same commits of a cell
    are one class: its pairs all changed together, and two classes share a commit or none of their pairs does. So
    pairs of classes are formed, not pairs of files, and a commit of very many files is as cheap as the few
    classes it falls into.
    """
    sizes = files.groupBy("sha").agg(F.count(F.lit(1)).alias("_size"))
    limits = F.filter(
        F.array(*[F.lit(t).cast("long") for t in thresholds]), lambda t: t.isNull() | (F.col("_size") <= t)
    )
    marked = commits.join(sizes, "sha").withColumn("max_files", F.explode(limits)).drop("_size")
    cell = ["project_id", "max_files"]
    chosen = latest_external_commits(marked, members, n_commits, since, cell).select(*cell, "sha").distinct()
    kept = added_or_modified(files).select("sha", "filename").distinct()
    is_source = ends_with_any(F.col("filename"), suffixes) if suffixes else F.lit(False)
    if stop_names:
        is_source &= ~F.col("filename").isin(*stop_names)
    of_file = F.filter(
        F.array(*[F.lit(s) for s in scopes]), lambda s: (s == "all_files") | is_source
    )
    cell = [*cell, "scope"]
    rows = chosen.join(kept, "sha").withColumn("scope", F.explode(of_file)).withColumn(
        "max_files", F.coalesce("max_files", F.lit(-1))
    )
    rows = materialize(rows.select(*cell, "sha", "filename"), "co_change")
    kinds = rows.groupBy(*cell, "filename").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("sha")).alias("_h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "sha")).alias("_h2"),
    )
    classes = materialize(
        kinds.groupBy(*cell, "_n", "_h1", "_h2").agg(
            F.min("filename").alias("filename"), F.count(F.lit(1)).alias("size")
        ).select(*cell, "filename", "size"),
        "classes",
    )
    n_files = classes.groupBy(*cell).agg(
        F.sum("size").alias("n_files"), F.sum(F.expr("size * (size - 1) div 2")).alias("_inside")
    )
    one = rows.join(classes, [*cell, "filename"]).select(*cell, "sha", F.col("filename").alias("_a"), F.col("size").alias("_na"))
    two = one.withColumnRenamed("_a", "_b").withColumnRenamed("_na", "_nb")
    between = (
        one.join(two, [*cell, "sha"])
        .filter(F.col("_a") < F.col("_b"))
        .groupBy(*cell, "_a", "_b")
        .agg(F.first(F.col("_na") * F.col("_nb")).alias("_pairs"))
        .groupBy(*cell)
        .agg(F.sum("_pairs").alias("_between"))
    )
    cells = F.nullif(F.col("n_files") * (F.col("n_files") - 1), F.lit(0))
    found = n_files.join(between, cell, "left").withColumn(
        "n_pairs", F.col("_inside") + F.coalesce("_between", F.lit(0))
    )
    return found.select(
        F.nullif(F.col("max_files"), F.lit(-1)).cast("int").alias("max_files"), "scope", "project_id", "n_files", "n_pairs",
        F.round(200 * F.col("n_pairs") / cells, 4).alias("modularity"),
    )
