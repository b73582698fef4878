"""Set algebra on commit sets, always keyed, never collected."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.operators.groups import shuffled_rank
from forklore.operators.search import in_groups
from forklore.session import materialize

# Branches on the two sides of a tile; the larger is the number of bits of Spark's bitmaps.
_INNER = 4_096
_OUTER = 32_768


def union_distinct(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def one_sided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in exactly one of the sets, with ``side`` ``left`` or ``right``.

    One aggregate over the tagged union; each set is read once.
    """
    tagged = a.select(*keys, F.lit(1).alias("_tag")).unionByName(
        b.select(*keys, F.lit(2).alias("_tag"))
    )
    return (
        tagged.groupBy(*keys)
        .agg(F.min("_tag").alias("_lo"), F.max("_tag").alias("_hi"))
        .filter(F.col("_lo") == F.col("_hi"))
        .select(*keys, F.when(F.col("_lo") == 1, "left").otherwise("right").alias("side"))
    )


def claimed_once(commits: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Commits that only one owner claims: a commit in two forks of a project is nobody's."""
    return (
        commits.groupBy(*keys)
        .agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
        .filter(F.col("_lo") == F.col("_hi"))
        .select(*keys, F.col("_lo").alias(owner))
    )


def combine_approaches(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the author-based, pull-request and graph-based commit sets.

    ``tagged`` has ``keys``, ``sha`` and ``source``, one of ``author_only_F``,
    ``author_F2U``, ``pr``, ``graph_only_F``, ``graph_F2U``, ``graph_U2F`` and
    ``graph_only_U``. A commit may end up both ``in_only_F`` and ``in_F2U``.
    """

    def has(*sources: str) -> Column:
        return F.coalesce(F.bool_or(F.col("source").isin(*sources)), F.lit(False))

    flags = tagged.filter(F.col("sha").isNotNull()).groupBy(*keys, "sha").agg(
        has("author_only_F", "graph_only_F").alias("in_only_F"),
        has("graph_only_U").alias("in_only_U"),
        has("author_F2U", "pr", "graph_F2U").alias("_f2u"),
        has("graph_U2F").alias("_u2f"),
    )
    return flags.select(
        *keys,
        "sha",
        "in_only_F",
        "in_only_U",
        (F.col("_f2u") & ~F.col("in_only_U")).alias("in_F2U"),
        (F.col("_u2f") & ~(F.col("_f2u") & ~F.col("in_only_U"))).alias("in_U2F"),
    )


def pr_commit_sets(rows: DataFrame, keys: list[str], precedence: str = "merged") -> DataFrame:
    """Attempted, merged and rejected pull-request commits per fork.

    ``rows`` has ``keys``, ``sha`` and ``state``. ``precedence`` names the set that
    keeps a commit found in both.
    """
    if precedence not in ("merged", "rejected"):
        raise ValueError(f"precedence must be merged or rejected, not {precedence}")
    per_sha = rows.groupBy(*keys, "sha").agg(
        F.bool_or(F.col("state") == "merged").alias("m"),
        F.bool_or(F.col("state") == "closed").alias("r"),
    )
    m, r = F.col("m"), F.col("r")
    merged = m if precedence == "merged" else m & ~r
    rejected = r & ~m if precedence == "merged" else r
    return per_sha.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(merged).alias("merged"),
        F.count_if(rejected).alias("rejected"),
    )


def contained_branches(branches: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Branches whose commits all are in a longer branch (of equal ones all but the last name).

    ``branches(repo, branch, sha)``. Equal branches are compared with one of their
    kind only, found by a fingerprint and then checked commit by commit. For the rest, a branch lies in those
    that hold all of its commits. That is found tile by tile, a tile being 4,096 branches against 32,768: a row is formed
    per commit and tile, with the two sets of branches that hold the commit, never per pair of branches or per member,
    and a task keeps one bit per pair of its tile, whatever the number of commits. A branch with a commit of its own is
    left out before.
    """
    members = materialize(branches.select(repo, "branch", "sha").distinct(), "members")
    prints = members.groupBy(repo, "branch").agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("sha")).alias("_xor"),
        F.bit_xor(F.xxhash64(F.lit(1), "sha")).alias("_xor2"),
    )
    kinds = prints.groupBy(repo, "size", "_xor", "_xor2").agg(
        F.max("branch").alias("outer_branch")
    )
    twins = (
        prints.join(kinds, [repo, "size", "_xor", "_xor2"])
        .filter(F.col("branch") != F.col("outer_branch"))
        .select(repo, "branch", "outer_branch", "size")
    )
    outer = members.withColumnRenamed("branch", "outer_branch")
    equal = materialize(_fully_shared(twins, members, outer, repo), "equal")
    left = prints.select(repo, "branch", "size").join(equal, [repo, "branch"], "left_anti")
    numbers = shuffled_rank(left, [repo], F.col("branch"), "_no")
    numbers = materialize(numbers.withColumn("_no", F.col("_no") - 1), "numbers")
    counts = numbers.groupBy(repo).agg(F.count(F.lit(1)).alias("_branches"))
    members = members.filter(F.col("sha").isNotNull()).join(numbers.drop("size"), [repo, "branch"])
    holders = materialize(_held_by(members, repo, _OUTER), "holders")
    own = holders.groupBy(repo, "sha").agg(F.sum("_n").alias("_n"))
    alone = members.join(own.filter(F.col("_n") == 1), [repo, "sha"], "left_semi").select(repo, "branch").distinct()
    inner = _held_by(members.join(alone, [repo, "branch"], "left_anti"), repo, _INNER).join(counts, repo)
    tiles = inner.select(
        repo, "sha", F.col("_part").alias("_tile"), "_branches", F.col("_few").alias("_few_in"), F.col("_bits").alias("_bits_in")
    ).join(holders.select(repo, "sha", F.col("_part").alias("_block"), "_few", "_bits"), [repo, "sha"])
    tiles = tiles.select(repo, "_tile", "_block", "_branches", "_few_in", "_bits_in", "_few", "_bits")
    kind = members.schema[repo].dataType.simpleString()
    schema = f"{repo} {kind}, _no long, _block long, size long, _holders long"
    common = in_groups(tiles, [repo, "_tile", "_block"], [], _common_holders, schema)
    held = common.join(numbers, [repo, "_no", "size"]).groupBy(repo, "branch").agg(F.sum("_holders").alias("_holders"))
    return equal.unionByName(held.filter(F.col("_holders") > 1).select(repo, "branch"))


def _held_by(members: DataFrame, repo: str, width: int) -> DataFrame:
    """The branches that hold a commit, ``width`` at a time: a list of places, or a bitmap where that is shorter.

    ``repo, sha, _part, _n, _few, _bits``; ``members`` has ``_no``. The exchange moves members, not bitmaps.
    """
    part, n = F.floor(F.col("_no") / width).alias("_part"), F.count(F.lit(1))
    at = (F.col("_no") % width).alias("_at")
    placed = members.select(repo, "sha", part, at).repartition(repo, "sha", "_part")
    many = n > width // 16
    bits = F.substring(F.bitmap_construct_agg("_at"), 1, width // 8)
    return placed.groupBy(repo, "sha", "_part").agg(
        n.alias("_n"),
        F.when(~many, F.collect_list(F.col("_at").cast("short"))).alias("_few"),
        F.when(many, bits).alias("_bits"),
    )


def _common_holders(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Per branch of a tile: its commits held in the block, and how many branches of the block hold all of those."""
    repo, tile, block = key
    every, seen = None, None
    for _, _, _, branches, few_in, bits_in, few, bits in rows:
        if every is None:
            height = min(_INNER, branches - tile * _INNER)
            width = (min(_OUTER, branches - block * _OUTER) + 7) // 8
            every = np.full((height, width), 255, dtype=np.uint8)
            seen = np.zeros(height, dtype=np.int64)
        if bits_in is None:
            at = np.asarray(few_in, dtype=np.int64)
        else:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits_in, dtype=np.uint8), bitorder="little")[:height])
        if bits is None:
            held = np.zeros(width * 8, dtype=np.uint8)
            held[few] = 1
            held = np.packbits(held, bitorder="little")
        else:
            held = np.frombuffer(bits, dtype=np.uint8)[:width]
        seen[at] += 1
        every[at] &= held
    for at in np.flatnonzero(seen).tolist():
        n = int(np.bitwise_count(every[at]).sum(dtype=np.int64))
        if n:
            yield repo, tile * _INNER + at, block, int(seen[at]), n


def _fully_shared(
    candidates: DataFrame, members: DataFrame, outer: DataFrame, repo: str
) -> DataFrame:
    """Candidate branches all of whose commits are in the candidate outer branch."""
    return (
        candidates.join(members, [repo, "branch"])
        .join(outer, [repo, "outer_branch", "sha"], "left_semi")
        .groupBy(repo, "branch", "outer_branch", "size")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") == F.col("size"))
        .select(repo, "branch")
        .distinct()
    )


def files_in_common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose file also is in ``b``; those left out are disjoint."""
    return a.join(b.select(*keys).distinct(), keys, "left_semi")
