"""Pull requests of the recent past: interval joins and rolling day aggregates.

``age_in_day`` counts back from the snapshot, so an earlier pull request has the
greater age. The window of a pull request of age ``a`` is ``[a + low, a + window]``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forklore.operators.search import in_groups
from forklore.session import materialize


def prior_window_pairs(
    prs: DataFrame, window: int = 90, low: int = 0, lower_id_only: bool = True
) -> DataFrame:
    """Each pull request with the closed ones of its window: ``project_id, pr_id, prior_pr_id``.

    An equi-join on (project, time bucket): a bucket is as wide as the window, so a
    pull request probes two of them. A hot project is thus spread over all buckets of
    its history, and AQE splits the buckets that are still large.
    """
    width = window + 1
    left = prs.select(
        "project_id",
        "pr_id",
        F.col("age_in_day").alias("age"),
        F.explode(
            F.array(
                F.floor(F.col("age_in_day") / width), F.floor(F.col("age_in_day") / width) + 1
            )
        ).alias("bucket"),
    )
    right = prs.filter("is_closed").select(
        "project_id",
        F.col("pr_id").alias("prior_pr_id"),
        F.col("age_in_day").alias("prior_age"),
        F.floor(F.col("age_in_day") / width).alias("bucket"),
    )
    in_window = F.col("prior_age").between(F.col("age") + low, F.col("age") + window)
    if lower_id_only:
        in_window &= F.col("prior_pr_id") < F.col("pr_id")
    return (
        left.join(right, ["project_id", "bucket"])
        .filter(in_window)
        .select("project_id", "pr_id", "prior_pr_id")
    )


def lowest_prior_id(
    rows: DataFrame, keys: list[str], candidate, window: int = 90, low: int = 0
) -> DataFrame:
    """Per key and day, the lowest candidate id inside the window of that day.

    ``rows`` carries ``keys`` and ``age_in_day``; ``candidate`` is the id column, NULL on
    rows that are no candidates. "Some candidate with a lower id than mine lies in my
    window" then is one comparison, and no pair is ever formed. The rows are reduced
    to one per key and day first, so a window partition never holds more rows than
    there are days, however hot the key is.
    """
    days = rows.groupBy(*keys, "age_in_day").agg(F.min(candidate).alias("_low_of_day"))
    span = Window.partitionBy(*keys).orderBy("age_in_day").rangeBetween(low, window)
    return days.select(*keys, "age_in_day", F.min("_low_of_day").over(span).alias("lowest_id"))


def prior_window_summary(prs: DataFrame, window: int = 90, low: int = 1) -> DataFrame:
    """Number and lowest id of the closed pull requests in the window of each: ``n_prior, lowest_prior``.

    For windows without the lower-id rule. Rows are reduced to one per project and day; no pair is formed. Pull
    requests with an empty window have no row.
    """
    closed = F.when(F.col("is_closed"), F.col("pr_id"))
    days = prs.groupBy("project_id", "age_in_day").agg(F.count(closed).alias("_closed"), F.min(closed).alias("_low"))
    span = Window.partitionBy("project_id").orderBy("age_in_day").rangeBetween(low, window)
    rolled = days.select(
        "project_id", "age_in_day", F.sum("_closed").over(span).alias("n_prior"), F.min("_low").over(span).alias("lowest_prior")
    ).filter(F.col("n_prior") > 0)
    return prs.select("project_id", "pr_id", "age_in_day").join(rolled, ["project_id", "age_in_day"]).drop("age_in_day")


def _count_lower(low: int, window: int):
    """Requests of a chunk in order of their number, after the closed ones of lower chunks by day (kind 0)."""

    def each(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        project, _ = key
        days: list[int] = []
        tree: list[int] = []
        waiting: list[int] = []
        now = None

        def add(age: int, n: int) -> None:
            at = bisect_left(days, age) + 1
            while at < len(tree):
                tree[at] += n
                at += at & -at

        def upto(at: int) -> int:
            total = 0
            while at:
                total += tree[at]
                at -= at & -at
            return total

        for _, _, kind, pr_id, age, closed, n in rows:
            if kind == 0:
                days.append(age)
                waiting.append(n)
                continue
            if not tree:
                tree = [0] * (len(days) + 1)
                for day, count in zip(days, waiting):
                    add(day, count)
                waiting = []
            if pr_id != now:
                for day in waiting:
                    add(day, 1)
                waiting, now = [], pr_id
            n_prior = upto(bisect_right(days, age + window)) - upto(bisect_left(days, age + low))
            if closed:
                waiting.append(age)
            if n_prior:
                yield project, pr_id, n_prior

    return each


def prior_window_lower(prs: DataFrame, window: int = 90, low: int = 0, chunk: int = 1 << 20) -> DataFrame:
    """Number and lowest id of the closed, lower-numbered pull requests in the window of each: ``n_prior, lowest_prior``.

    Counts how many points lie below and beside each, without forming a pair. Requests are cut by number into
    chunks; the closed ones of all lower chunks come to a chunk as one row per day, and inside it requests pass in order
    of their number over a tree of day counts. So a project of any size is dealt to many tasks. Pull requests
    with an empty window have no row. A NULL age is in no window.
    """
    slim = prs.where(F.col("age_in_day").isNotNull()).select(
        "project_id", F.floor(F.col("pr_id") / chunk).alias("chunk"), "pr_id",
        F.col("age_in_day").cast("int").alias("age"), F.coalesce("is_closed", F.lit(False)).alias("closed"),
    )
    slim = materialize(slim, "requests")  # read by days, by numbers and for the result
    by_day = slim.groupBy("project_id", "chunk", "age").agg(F.count_if("closed").alias("n"))
    # every day of a project in each of its chunks: a row per day and chunk of requests
    grid = by_day.select("project_id", "age").distinct().join(by_day.select("project_id", "chunk").distinct(), "project_id")
    below = Window.partitionBy("project_id", "age").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(by_day, ["project_id", "chunk", "age"], "left").select(
        "project_id", "chunk", F.lit(0).alias("kind"), F.lit(None).cast(prs.schema["pr_id"].dataType).alias("pr_id"), "age",
        F.lit(False).alias("closed"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("n"),
    )
    rows = carried.unionByName(slim.select("*", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n")))
    schema = f"project_id {prs.schema['project_id'].dataType.simpleString()}, pr_id {prs.schema['pr_id'].dataType.simpleString()}"
    counts = in_groups(
        rows.select("project_id", "chunk", "kind", "pr_id", "age", "closed", "n"), ["project_id", "chunk"],
        ["kind", "pr_id", "age"], _count_lower(low, window), f"{schema}, n_prior long",
    )
    aged = slim.withColumnRenamed("age", "age_in_day")
    lowest = lowest_prior_id(aged, ["project_id"], F.when(F.col("closed"), F.col("pr_id")), window, low)
    facts = aged.select("project_id", "pr_id", "age_in_day").join(lowest, ["project_id", "age_in_day"])
    return counts.join(facts, ["project_id", "pr_id"]).select(
        "project_id", "pr_id", "n_prior", F.col("lowest_id").alias("lowest_prior")
    )


def prior_window_counts(prs: DataFrame, window: int = 90, low: int = 1) -> DataFrame:
    """Closed pull requests in the window of each pull request, by day histogram."""
    days = prs.groupBy("project_id", "age_in_day").agg(F.count_if("is_closed").alias("_closed"))
    span = Window.partitionBy("project_id").orderBy("age_in_day").rangeBetween(low, window)
    rolled = days.select(
        "project_id",
        "age_in_day",
        F.coalesce(F.sum("_closed").over(span), F.lit(0)).alias("n_prior"),
    )
    return prs.select("project_id", "pr_id", "age_in_day").join(
        rolled, ["project_id", "age_in_day"]
    ).select("project_id", "pr_id", "n_prior")
