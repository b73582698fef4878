"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from forklore.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns: equal only for rows that are equal throughout."""
    columns = [
        F.map_entries(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def rank_within(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the 1-based rank of a row in its group, by ``order`` (nulls first).

    A group may hold any share of the rows: rows are dealt by range of (group, order),
    ranked inside a range, and only the number of rows a group has in each range is
    carried over. Ties in ``order`` must be rows that are interchangeable.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    df = materialize(df, "unranked")  # read twice: to find the ranges and to deal the rows
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *group).orderBy(*by[len(group):])
    counts = dealt.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        F.col("_range").alias("_r"),
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    ranked = dealt.withColumn("_inside", F.row_number().over(inside))
    return ranked.join(offsets.hint("merge"), same).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias(out)
    )


def usable_vector(vector: Column) -> Column:
    """True for arrays with a component other than zero, and no null, NaN or infinite one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the usable vectors in double precision; those of another length than most have no part."""
    slim = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    ).where(usable_vector(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = slim.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return slim.where(F.size("v") == (sizes["n"] if sizes else 0))


def hashed_sample(df: DataFrame, key: Column, total: int, most: int) -> DataFrame:
    """About ``most`` of ``total`` rows, the same ones in every run: those whose key hashes low."""
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(1 << 20)) < int((1 << 20) * most / total))


def in_blocks(dealt: DataFrame, shard: str, own: Column, crowd: int) -> DataFrame:
    """Cut shards of more than ``crowd`` rows into groups of two blocks each; adds ``block`` (the group) and ``inner``.

    ``dealt`` has ``home``: whether a row belongs to its shard or visits it. Rows at home meet each other and all visitors.
    Homes and visitors are cut into blocks of about ``crowd`` rows, by the hash ``own``. Each block of homes forms a group of
    its own, in which its rows meet each other (``inner``), and one with each later block and each block of visitors, in which
    only rows of different blocks meet. So each pair meets once, and no group holds more than two blocks.
    """
    sizes = dealt.groupBy(shard).agg(F.count_if("home").alias("_h"), F.count_if(~F.col("home")).alias("_v"))
    sizes = sizes.where(F.col("_h") + F.col("_v") > crowd).select(
        shard,
        F.greatest(F.ceil(F.col("_h") / crowd), F.lit(1)).cast("int").alias("_homes"),
        F.ceil(F.col("_v") / crowd).cast("int").alias("_visitors"),
    )
    # a row of three numbers for each crowded shard; how many shards there are is fixed when the index is fitted
    spread = dealt.join(F.broadcast(sizes), shard, "left")
    homes, visitors = F.coalesce("_homes", F.lit(1)), F.coalesce("_visitors", F.lit(0))
    later = homes + F.pmod(own, F.greatest(visitors, F.lit(1)))
    mine = F.when(F.col("home"), F.pmod(own, homes)).when(F.col("_homes").isNull(), 0).otherwise(later).cast("int")
    spread = spread.withColumn("_own", mine)
    others = F.when(F.col("home"), homes + visitors).otherwise(homes) - 1
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), others)))
    first, second = F.least("_own", "_other"), F.greatest("_own", "_other")
    spread = spread.withColumn("block", first.cast("long") * (1 << 31) + second).withColumn("inner", first == second)
    home = F.col("home") & (F.col("_other") >= F.col("_own"))
    return spread.withColumn("home", home).drop("_homes", "_visitors", "_own", "_other")
