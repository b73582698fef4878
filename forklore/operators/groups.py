"""Order inside groups of unbounded size.

A plain window puts a whole group into one task. Here a group is cut into chunks of
bounded size along its order, the window runs inside the chunks, and only one summary
row per chunk is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
SLICE_DIGITS = 3


def previous_value(
    df: DataFrame, keys: list[str], position: str, value: str, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Add ``out``: the value of the row before, in the order of a unique integer position."""
    cut = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(position)
    lasts = cut.groupBy(*keys, "_chunk").agg(F.max_by(value, position).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_chunk")
    carried = lasts.select(*keys, "_chunk", F.lag("_last").over(over).alias("_carried"))
    return (
        cut.withColumn("_first", F.row_number().over(inner) == 1)
        .withColumn("_before", F.lag(value).over(inner))
        .join(carried, [*keys, "_chunk"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
        .drop("_chunk", "_first", "_before", "_carried")
    )


def shuffled_rank(df: DataFrame, keys: list[str], seed_key: Column, out: str) -> DataFrame:
    """Add ``out``: the 1-based rank of a row in its group in a reproducible random order.

    The order is that of the MD5 of ``seed_key``, so its leading hex digits cut any
    group into even slices; the slice counts give the offset of a slice.
    """
    ranked = df.withColumn("_hash", F.md5(seed_key.cast("string").cast("binary"))).withColumn(
        "_slice", F.substring("_hash", 1, SLICE_DIGITS)
    )
    sizes = ranked.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_hash")
    return (
        ranked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_hash", "_slice", "_inside", "_offset")
    )


def grouped_medians(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Exact median of several columns per group: ``*keys`` and one column per entry of ``values`` (name to column).

    Equal values are counted before the shuffle, and the middle is taken from running sums over the distinct
    values, which Spark sorts and spills. No buffer holds a group's values. NULL values do not count; a group of
    NULLs only, or a NULL key, has NULL medians.
    """
    stacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(column).cast("double").alias("value"))
        for name, column in values.items()
    ]))
    each = rows.select(*keys, stacked.alias("_v")).select(*keys, "_v.*")
    counts = each.groupBy(*keys, "name", "value").agg(F.count("value").alias("n"))
    over = Window.partitionBy(*keys, "name").orderBy(F.col("value").asc_nulls_first())
    whole = Window.partitionBy(*keys, "name")
    placed = counts.withColumn("upto", F.sum("n").over(over)).withColumn("total", F.sum("n").over(whole))
    low, high = F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2")
    before = F.col("upto") - F.col("n")
    holds = lambda place: (before < place) & (place <= F.col("upto"))
    middle = placed.groupBy(*keys, "name").agg(
        ((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("median")
    )
    return middle.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("median"))).alias(name) for name in values]
    )
