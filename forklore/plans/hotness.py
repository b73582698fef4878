"""How busy the files of a pull request were in the weeks before it.

Inputs: ``prs(project_id, pr_id, age_in_day, is_closed)``, ``pr_commits(project_id,
pr_id, sha)`` and ``files(sha, filename, status)``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forklore.operators.intervals import lowest_prior_id
from forklore.operators.search import in_groups
from forklore.session import materialize, materialize_counted


def _touches(prs: DataFrame, pr_commits: DataFrame, files: DataFrame) -> DataFrame:
    """One row per (pull request, commit, file), with the pull request's facts."""
    facts = prs.select("project_id", "pr_id", "age_in_day", "is_closed")
    touched = files.groupBy("sha", "filename").agg(
        F.bool_or(F.col("status") != "removed").alias("is_kept")
    )
    return pr_commits.join(facts, ["project_id", "pr_id"]).join(touched, "sha")


def _candidate():
    return F.when(F.col("is_closed") & F.col("is_kept"), F.col("pr_id"))


def _flag_hot(touches: DataFrame, window: int) -> DataFrame:
    """Touches of closed pull requests with ``is_hot``.

    The file was changed, not just removed, by a closed pull request of the window that
    has a lower number. That follows from the lowest candidate number per day window,
    so no pair of pull requests is formed.
    """
    lowest = lowest_prior_id(touches, ["project_id", "filename"], _candidate(), window)
    return (
        touches.filter("is_closed")
        .join(lowest, ["project_id", "filename", "age_in_day"])
        .withColumn("is_hot", F.coalesce(F.col("lowest_id") < F.col("pr_id"), F.lit(False)))
    )


def _with_hot_window(prs: DataFrame, touches: DataFrame, window: int) -> DataFrame:
    """Closed pull requests whose window holds any hot file, whatever they touch themselves."""
    days = touches.select("project_id", "age_in_day", _candidate().alias("_id")).unionByName(
        prs.filter("is_closed").select("project_id", "age_in_day", F.lit(None).alias("_id"))
    )
    lowest = lowest_prior_id(days, ["project_id"], F.col("_id"), window)
    return (
        prs.filter("is_closed")
        .join(lowest, ["project_id", "age_in_day"])
        .filter(F.col("lowest_id") < F.col("pr_id"))
        .select("project_id", "pr_id")
    )


def hot_commits(
    prs: DataFrame,
    pr_commits: DataFrame,
    files: DataFrame,
    window: int = 90,
    require_files: bool = False,
) -> DataFrame:
    """Commits of each closed pull request that touch a hot file.

    A pull request whose window holds no hot file gives no row; one that touches none
    of them gives 0, and so does one without any file unless ``require_files``.

    The touches are written once: readers with different columns would otherwise
    repeat the joins behind them.
    """
    keys = ["project_id", "pr_id"]
    touches = materialize(_touches(prs, pr_commits, files), "touches")
    counts = (
        _flag_hot(touches, window)
        .groupBy(*keys)
        .agg(F.count_distinct(F.when(F.col("is_hot"), F.col("sha"))).alias("_n"))
    )
    return (
        _with_hot_window(prs, touches, window)
        .join(counts, keys, "inner" if require_files else "left")
        .select(*keys, F.coalesce("_n", F.lit(0)).alias("n_hot_commits"))
    )


def hot_commits_local(
    prs: DataFrame, pr_commits: DataFrame, changed: DataFrame, window: int = 90
) -> DataFrame:
    """The same on the locally made change table, where removed files are no files at all."""
    kept = changed.filter(F.col("status") != "removed")
    return hot_commits(prs, pr_commits, kept, window, require_files=True)


def hot_files_per_commit(
    prs: DataFrame, pr_commits: DataFrame, files: DataFrame, window: int = 90
) -> DataFrame:
    """Hot files of each commit of a closed pull request; commits without any give no row."""
    touches = materialize(_touches(prs, pr_commits, files), "touches")
    return (
        _flag_hot(touches, window)
        .filter("is_hot")
        .groupBy("project_id", "pr_id", "sha")
        .agg(F.count(F.lit(1)).alias("n_hot_files"))
    )


def commit_hotness(
    prs: DataFrame, pr_commits: DataFrame, files: DataFrame, window: int = 90, block: int = 8192, chunk: int = 1 << 20
) -> DataFrame:
    """Earlier commits that touch any file of the pull request.

    Counts distinct commits of closed, lower-numbered pull requests of the window that
    share a file; removed files do not count. A pull request without files gives no
    row, one without such commits gives 0.

    Commits of one file can be met by that file only, so they are counted file by file (:func:`_shared_of_one_file`), which takes a
    row per pull request and file. Commits of several files, which may not be counted twice, are dealt by day into blocks, where each file
    has a bitmap of the commits that touch it (:func:`_shared_by_bitmaps`). Rows of request and commit are formed only for commits that
    several pull requests hold.
    """
    kept = files.filter(F.col("status") != "removed").select("sha", "filename").repartition("sha").distinct()
    kept = kept.groupBy("sha").agg(F.collect_list(F.struct("filename")).alias("names"))  # NULL names stay
    facts = prs.filter("is_closed").select("project_id", "pr_id", "age_in_day").distinct()
    commits = pr_commits.select("project_id", "pr_id", "sha").join(facts, ["project_id", "pr_id"])
    touched = materialize(commits.repartition("sha").distinct().join(kept, "sha"), "touched")
    held = touched.groupBy("project_id", "sha").agg(F.min("pr_id").alias("a"), F.max("pr_id").alias("z"))
    several, n_several = materialize_counted(held.filter(F.col("a") < F.col("z")).select("project_id", "sha"), "several")
    single = touched.join(several, ["project_id", "sha"], "left_anti") if n_several else touched
    one = F.size("names") == 1
    mine = touched
    if n_several:
        mine = touched.join(several.withColumn("_several", F.lit(True)), ["project_id", "sha"], "left")
        one &= F.col("_several").isNull()
    rows = mine.select("project_id", "pr_id", "age_in_day", F.explode("names").alias("name"), one.cast("int").alias("n"))
    rows = rows.select("project_id", F.col("name.filename").alias("filename"), "pr_id", F.col("age_in_day").alias("age"), "n")
    parts = _shared_of_one_file(rows, window, chunk).unionByName(
        _shared_by_bitmaps(single.filter(F.size("names") > 1), touched, window, block)
    )
    if n_several:
        each = touched.withColumn("filename", F.explode("names.filename"))
        parts = parts.unionByName(_shared_by_pairs(each.join(several, ["project_id", "sha"], "left_semi"), each, window))
    none = touched.select("project_id", "pr_id", F.lit(0).cast("long").alias("n"))
    return (
        parts.unionByName(none)
        .groupBy("project_id", "pr_id")
        .agg(F.sum("n").alias("n_prior_commits"))
    )


def _shared_of_one_file(rows: DataFrame, window: int, chunk: int) -> DataFrame:
    """``project_id, pr_id, n``: commits of one file, from ``project_id, filename, pr_id, age, n`` with the commits that a request has there.

    Counts how many points lie below and beside each, in one pass over the requests of a file in order of their number. A file of more
    than ``chunk`` rows is cut by number; what lies in its lower chunks comes to a chunk as one row per day.
    """
    keys = ["project_id", "filename"]
    rows = rows.where(F.col("age").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("pr_id").alias("lo"), F.max("pr_id").alias("hi"))
    crowded, n_crowded = materialize_counted(sizes.where(F.col("rows") > chunk), "crowded")
    cut = rows
    if n_crowded:
        marks = crowded.select(F.col("project_id").alias("_p"), F.col("filename").alias("_f"), "rows", "lo", "hi")
        same = F.col("project_id").eqNullSafe(F.col("_p")) & F.col("filename").eqNullSafe(F.col("_f"))
        share = (F.col("pr_id") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)
        no = F.floor(share * F.ceil(F.col("rows") / chunk)).cast("int")
        cut = rows.join(marks, same, "left").withColumn("chunk", F.coalesce(no, F.lit(0)))
        by_day = cut.where(F.col("_p").isNotNull()).groupBy(*keys, "chunk", "age").agg(F.sum("n").alias("n"))
        # a day of a lower chunk is carried to each higher one
        tops = by_day.groupBy(*keys).agg(F.max("chunk").alias("top"))
        tops = tops.select(F.col("project_id").alias("_p"), F.col("filename").alias("_f"), "top")
        carried = by_day.where("n > 0").join(tops, same).where(F.col("chunk") < F.col("top"))
        carried = carried.withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("top"))))
        carried = carried.select(*keys, F.lit(None).cast(rows.schema["pr_id"].dataType).alias("pr_id"), "age", "n", "chunk")
        cut = cut.select(*keys, "pr_id", "age", "n", "chunk").unionByName(carried)
        keys = [*keys, "chunk"]
    # groups stay whole: the aggregate keeps this deal only while none of the keys is a literal
    cut = cut.repartition(*keys).groupBy(*keys, "pr_id", "age").agg(F.sum("n").alias("n"))
    dealt = cut.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [*keys, "pr_id"]])
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("project_id", "pr_id"))
    return dealt.mapInArrow(_count_below(window, keys), f"{kinds}, n long")


def _count_below(window: int, keys: list[str], tile: int = 128):
    """Sorted rows of ``keys, pr_id, age, n`` in tiles; a tile is compared with itself, and with the days of its first group before it."""

    def changes(table: pa.Table, names: list[str]) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for name in names:
            column = table.column(name).combine_chunks()
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        days, sums = np.empty(0, np.int64), np.zeros(1, np.int64)

        def counted(table: pa.Table) -> pa.RecordBatch:
            nonlocal last, days, sums
            fresh = changes(table, keys)
            run_starts = np.flatnonzero(fresh | changes(table, ["pr_id"]))
            first = tuple(table.column(k)[0].as_py() for k in keys)
            group = np.cumsum(fresh)  # 1 for the first
            number = np.zeros(table.num_rows, np.int64)
            number[run_starts] = 1
            number = np.cumsum(number)
            age = table.column("age").to_numpy().astype(np.int64)
            n = table.column("n").to_numpy().astype(np.int64)
            found = np.zeros(table.num_rows, np.int64)
            open_group = 1 if first == last else 0
            at = 0
            while at < table.num_rows:
                upto = np.searchsorted(run_starts, at + tile, "right") - 1
                end = table.num_rows if at + tile >= table.num_rows else int(run_starts[upto])
                if end <= at:  # a run longer than a tile
                    upto = np.searchsorted(run_starts, at, "right")
                    end = int(run_starts[upto]) if upto < len(run_starts) else table.num_rows
                g, k, a, w = group[at:end], number[at:end], age[at:end], n[at:end]
                beside = a[None, :] - a[:, None]
                met = (g[:, None] == g[None, :]) & (k[None, :] < k[:, None]) & (beside >= 0) & (beside <= window)
                got = met @ w
                if g[0] == open_group and len(days):
                    m = int(np.searchsorted(g, open_group, "right"))
                    got[:m] += sums[np.searchsorted(days, a[:m] + window, "right")] - sums[np.searchsorted(days, a[:m], "left")]
                found[at:end] = got
                mine = g == g[-1]
                ages, weights = a[mine], w[mine]
                if g[-1] == open_group:
                    ages, weights = np.concatenate([days, ages]), np.concatenate([np.diff(sums), weights])
                days, which = np.unique(ages, return_inverse=True)
                sums = np.concatenate([[0], np.cumsum(np.bincount(which, weights, len(days)).astype(np.int64))])
                open_group, at = int(g[-1]), end
            last = tuple(table.column(k)[table.num_rows - 1].as_py() for k in keys)
            asked = pa.array(found > 0)
            if table.column("pr_id").null_count:  # carried days
                asked = pc.and_(asked, table.column("pr_id").is_valid().combine_chunks())
            out = pa.table({"project_id": table.column("project_id"), "pr_id": table.column("pr_id"), "n": found}).filter(asked)
            return out.combine_chunks()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 1 << 15:
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(changes(table, [*keys, "pr_id"]))[-1])  # the last run may go on
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
            if cut:
                yield from counted(table.slice(0, cut)).to_batches()
        if held:
            yield from counted(pa.Table.from_batches(held)).to_batches()

    return run


def _shared_by_bitmaps(single: DataFrame, touched: DataFrame, window: int, block: int) -> DataFrame:
    """``project_id, pr_id, n``, block by block; a commit of ``single`` belongs to one pull request.

    A block has about ``block`` changed files, up to 8 times as many where windows are so full that they would span more than four.
    """
    n = single.groupBy("project_id", "age_in_day").agg(F.sum(F.size("names")).alias("n"))
    asked = touched.select("project_id", "age_in_day").distinct()
    before = Window.partitionBy("project_id").orderBy("age_in_day").rowsBetween(Window.unboundedPreceding, -1)
    span = Window.partitionBy("project_id").orderBy("age_in_day").rangeBetween(0, window)
    days = asked.join(n, ["project_id", "age_in_day"], "left").fillna(0, ["n"]).withColumn("full", F.sum("n").over(span))
    most = F.max("full").over(Window.partitionBy("project_id"))
    days = days.withColumn("size", F.least(F.greatest(F.lit(block), F.ceil(most / 4)), F.lit(8 * block)))
    days = days.withColumn("first", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.col("size")))
    days = days.withColumn("wide", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("size"))))  # a crowded day is dealt by hash
    days = days.withColumn("last", F.max(F.when(F.col("n") > 0, F.col("first") + F.col("wide") - 1)).over(span))
    days = materialize(days.where(F.col("full") > 0).select("project_id", "age_in_day", "first", "wide", "last"), "days")
    files = touched.groupBy("project_id", "pr_id", "age_in_day").agg(F.flatten(F.collect_list("names.filename")).alias("names"))
    requests = files.join(days, ["project_id", "age_in_day"]).withColumn("block", F.explode(F.sequence("first", "last")))
    dealt = single.join(days, ["project_id", "age_in_day"]).withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("sha"), F.col("wide"))
    )
    columns = ["project_id", "block", "kind", "order", "pr_id", "age_in_day", "names"]
    pr_type = touched.schema["pr_id"].dataType
    rows = dealt.select(
        "project_id", "block", F.lit(0).alias("kind"), F.col("pr_id").alias("order"), "pr_id", "age_in_day",
        F.col("names.filename").alias("names"),
    ).unionByName(
        requests.withColumn("kind", F.lit(1)).withColumn("order", F.col("age_in_day").cast(pr_type)).select(*columns)
    )
    kinds = ", ".join(f"{n} {touched.schema[n].dataType.simpleString()}" for n in ("project_id", "pr_id"))
    return in_groups(rows, ["project_id", "block"], ["kind", "order"], _count_bits(window), f"{kinds}, n long")


def _count_bits(window: int):
    """Commits of a block in order of the number of their request (kind 0), then requests by day."""

    def each(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        by_file: dict = {}
        by_day: dict = {}
        numbers: list = []
        now, inside = None, 0
        for _, _, kind, _, pr_id, age, names in rows:
            if kind == 0:
                bit = 1 << len(numbers)
                numbers.append(pr_id)
                by_day[age] = by_day.get(age, 0) | bit
                for name in names:
                    by_file[name] = by_file.get(name, 0) | bit
                continue
            if age != now:
                now, inside = age, 0
                for day, bits in by_day.items():
                    if age <= day <= age + window:
                        inside |= bits
            lower = bisect_left(numbers, pr_id)
            if not inside or not lower:
                continue
            union = 0
            for name in names:
                union |= by_file.get(name, 0)
            union &= inside & (1 << lower) - 1
            if union:
                yield key[0], pr_id, union.bit_count()

    return each


def _shared_by_pairs(shared: DataFrame, touched: DataFrame, window: int) -> DataFrame:
    """The same for commits that several pull requests hold, by an equi-join on project, file and time bucket."""
    width = window + 1
    bucket = F.floor(F.col("age_in_day") / width)
    probes = touched.select("project_id", "pr_id", "filename", "age_in_day").distinct().select(
        "project_id",
        "pr_id",
        "filename",
        F.col("age_in_day").alias("age"),
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"),
    )
    earlier = shared.select(
        "project_id",
        "filename",
        bucket.alias("bucket"),
        F.col("pr_id").alias("prior_pr_id"),
        F.col("age_in_day").alias("prior_age"),
        "sha",
    )
    return (
        probes.join(earlier, ["project_id", "filename", "bucket"])
        .filter(
            F.col("prior_age").between(F.col("age"), F.col("age") + window)
            & (F.col("prior_pr_id") < F.col("pr_id"))
        )
        .groupBy("project_id", "pr_id")
        .agg(F.count_distinct("sha").alias("n"))
    )
