"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forklore.llm.common import rank_within, row_digest, word_count

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words, dealt by weight under a ceiling.

    ``sizes``: ``source, size``. Sources in code point order, null last, weigh
    ``weights``, repeating. No target is above ``ceiling`` times its source's size; what
    is above goes to the others by weight. The final level is found from prefix sums over the sources sorted by
    the level at which they reach their ceiling; the sorts see one row per source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    each = each.withColumn("weight", weight).withColumn("most", ceiling * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(so_far), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    each = each.withColumn("level", level)
    each = each.withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    last = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(last * F.col("weight"))
    return each.select("source", "source_size", target.alias("target"))


def copies(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """How often the mix takes each row: ``doc_id, size, source_size, target, copies`` and the row's digest.

    Within a source each document is expected target / size times. The expectations are summed in
    order of (size, doc_id), one offset drawn from ``seed`` and the source is added, and a document is taken
    once for every integer its stretch of the sum crosses. Documents of like size stand together, so
    the words taken stay within about the largest document of the target. The rank
    that the sum needs is distributed (``rank_within``): a source may hold any share of the rows.

    A null text has size 0; a source of size 0 has target 0 and is not taken; a null source is a
    source. Rows with equal doc_id are separate documents. Reruns agree.
    """
    d1, d2 = row_digest(docs)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        d1.alias("d1"),
        d2.alias("d2"),
    )
    ranked = rank_within(slim, ["source"], ["size", "doc_id", "d1", "d2"], "place")
    targets = source_targets(ranked.select("source", "size"), weights, share, ceiling)
    targets = targets.withColumnRenamed("source", "_source")
    met = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    named = F.concat(F.lit(seed), F.lit("/"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    offset = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rate * F.col("place") + offset) - F.floor(rate * (F.col("place") - 1) + offset)
    return met.select(
        "doc_id", "size", "source_size", "target", crossed.cast("long").alias("copies"), "d1", "d2"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as :func:`copies` says, with the columns of ``docs``.

    Rows that are equal in all columns are counted together, so they stay interchangeable.
    """
    d1, d2 = row_digest(docs)
    taken = copies(docs, **options).groupBy("d1", "d2").agg(F.sum("copies").cast("int").alias("n"))
    rows = docs.select(F.struct("*").alias("row"), d1.alias("d1"), d2.alias("d2")).dropDuplicates(["d1", "d2"])
    met = rows.join(taken.where(F.col("n") > 0), ["d1", "d2"])
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("row.*")
