"""Commit graphs of many repository pairs at once.

Tables are keyed by ``pair_id`` and ``sha``:

* ``edges(pair_id, sha, parent, parent_pos)``; a root has one row with a NULL parent;
* ``heads(pair_id, side, sha)``; ``side`` is any label, such as fork and upstream, or a
  branch name, and has one or more heads.

A first parent costs nothing to follow, any other parent costs one. Searches run block by block
(:mod:`forklore.operators.search`), so rounds do not grow with the length of first-parent lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.operators.search import (
    BLOCK,
    NODE,
    depths,
    each_step,
    free_first_parent,
    graph_blocks,
    least_costs,
    no_cost,
    traced,
)
from forklore.session import materialize, materialize_counted

# The distance printed for a commit that no head reaches, and the most
# heads a side had in the published counts. Neither limits a computation.
UNREACHED = 999
PUBLISHED_MAX_HEADS = 100



def edges_from_history(history: DataFrame) -> DataFrame:
    """``history(pair_id, sha, parents)`` to edges; roots keep a row with a NULL parent."""
    return history.dropDuplicates(NODE).select(
        *NODE, F.posexplode_outer("parents").alias("parent_pos", "parent")
    ).select(*NODE, "parent", F.coalesce("parent_pos", F.lit(0)).alias("parent_pos"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """0 for the first parent, and for a further parent that is the first one again."""
    first = edges.filter(F.col("parent_pos") == 0).select(*NODE, F.col("parent").alias("_first"))
    weight = F.when(F.col("parent") == F.col("_first"), 0).otherwise(1)
    return (
        edges.filter(F.col("parent").isNotNull())
        .join(first, NODE)
        .select(*NODE, "parent", "parent_pos", weight.alias("weight"))
    )


def merge_commits(edges: DataFrame) -> DataFrame:
    """Commits with more than one parent."""
    return edges.filter(F.col("parent_pos") > 0).select(*NODE).distinct()


def split_by_head_count(heads: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Heads of pairs within the limit on every side, and the pairs left out."""
    rejected = (
        heads.groupBy("pair_id", "side")
        .agg(F.count_distinct("sha").alias("n_heads"))
        .filter(F.col("n_heads") > limit)
        .groupBy("pair_id")
        .agg(F.max("n_heads").alias("n_heads"))
    )
    return heads.join(rejected.select("pair_id"), "pair_id", "left_anti"), rejected


def reached(edges: DataFrame, heads: DataFrame, block: int = BLOCK, depth: DataFrame | None = None) -> DataFrame:
    """Commits each side's heads reach, with the least number of non-first parents followed.

    ``pair_id, side, sha, distance``. Distance 0 is the first-parent line. ``depth`` are the depths of ``edges``, if known.
    """
    seeds = heads.select(
        "pair_id", "side", "sha", F.lit(0).alias("value"), F.lit(None).cast("string").alias("tag")
    ).distinct()
    blocks = graph_blocks(edges, block=block, depth=depth)
    found = least_costs(blocks, seeds, ["pair_id"], ["side"], free_first_parent)
    return found.select("pair_id", "side", "sha", F.col("value").alias("distance"))


def nearest_heads(edges: DataFrame, heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """The head of each side that is nearest to each commit it reaches: ``pair_id, side, sha, head, distance``.

    Nearest by the non-first parents followed, the least hash of equal ones. All heads of a side are searched at
    once; a commit passes on only the nearest.
    """
    seeds = heads.select(
        "pair_id", "side", "sha", F.lit(0).alias("value"), F.col("sha").alias("tag")
    ).distinct()
    found = least_costs(graph_blocks(edges, block=block), seeds, ["pair_id"], ["side"], free_first_parent)
    return found.select("pair_id", "side", "sha", F.col("tag").alias("head"), F.col("value").alias("distance"))


def head_distances(
    edges: DataFrame, heads: DataFrame, sides: tuple[str, ...] = ("fork", "upstream")
) -> DataFrame:
    """One row per commit with a distance column per side, NULL where it is not reached.

    ``pair_id, sha, is_merge, distance_<side>...``; see :func:`distance_label` for print.
    """
    got = reached(edges, heads)
    wide = got.groupBy(*NODE).agg(
        *[F.min(F.when(F.col("side") == s, F.col("distance"))).alias(f"distance_{s}") for s in sides]
    )
    parents = edges.groupBy(*NODE).agg(
        (F.count(F.col("parent")) > 1).alias("is_merge")
    )
    return parents.join(wide, NODE, "left").select(
        *NODE,
        "is_merge",
        *[f"distance_{s}" for s in sides],
    )


def distance_label(distance: str) -> Column:
    """The distance as it is printed: 999 for a commit that is not reached."""
    return F.coalesce(F.col(distance), F.lit(UNREACHED))


def decompose_branches(edges: DataFrame, heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """History of each branch (``side``), one row per commit, with its role.

    ``on_line``: on the first-parent line. ``role``: ``origin`` (on the line, no merge),
    ``merge_point`` (on the line, a merge), ``contribution`` (off the line, no merge) or
    ``inner_merge``.
    """
    parents = edges.groupBy(*NODE).agg((F.count(F.col("parent")) > 1).alias("is_merge"))
    on_line = F.col("distance") == 0
    role = (
        F.when(on_line & ~F.col("is_merge"), "origin")
        .when(on_line, "merge_point")
        .when(~F.col("is_merge"), "contribution")
        .otherwise("inner_merge")
    )
    depth = materialize(depths(edges, block), "depths")
    places = parents.join(depth, NODE)
    branches = reached(edges, heads, block, depth).join(places, NODE).select(
        "pair_id", "side", "sha", on_line.alias("on_line"), "is_merge", role.alias("role"), "depth"
    )
    return materialize(branches, "branches")


def two_parents(edges: DataFrame) -> DataFrame:
    """Merges with their first two parents."""
    return (
        edges.groupBy(*NODE)
        .agg(
            F.max(F.when(F.col("parent_pos") == 0, F.col("parent"))).alias("parent1"),
            F.max(F.when(F.col("parent_pos") == 1, F.col("parent"))).alias("parent2"),
        )
        .filter(F.col("parent2").isNotNull())
    )


def merge_contributions(edges: DataFrame, branches: DataFrame, block: int = BLOCK) -> DataFrame:
    """Commits each merge on a first-parent line brought in: ``pair_id, side, merge_sha, sha``.

    ``branches`` comes from :func:`decompose_branches` with one head per side. What a
    merge adds to its first parent's history belongs to the lowest commit of the line
    that reaches it, so the lowest ``depth`` is passed down from the line to all commits
    off it, in a search without costs; every commit gets one merge and no closure per merge is built.
    """
    side = ["pair_id", "side", "sha"]
    off_line = branches.filter(~F.col("on_line")).select(*side)
    line = branches.filter("on_line").select(*side, "depth")
    seeds = (
        line.join(edges.filter(F.col("parent").isNotNull()).select(*NODE, "parent"), NODE)
        .groupBy("pair_id", "side", F.col("parent").alias("sha"))
        .agg(F.min("depth").alias("value"))
        .join(off_line, side, "left_semi")
        .withColumn("tag", F.lit(None).cast("string"))
    )
    steps = off_line.join(edges.select(*NODE, "parent", "parent_pos"), NODE)
    labels = least_costs(graph_blocks(steps, ["side"], block, edges), seeds, ["pair_id", "side"], [], no_cost)
    labels = labels.select(*side, F.col("value").alias("depth"))
    merges = branches.filter(F.col("role") == "merge_point").select(
        "pair_id", "side", F.col("sha").alias("merge_sha"), "depth"
    )
    plain = branches.filter(F.col("role") == "contribution").select(*side)
    return (
        labels.join(plain, side, "left_semi")
        .join(merges, ["pair_id", "side", "depth"])
        .select("pair_id", "side", "merge_sha", "sha")
    )


def merge_sources(edges: DataFrame) -> DataFrame:
    """Where the merged line of each merge comes from: ``pair_id, sha, source``.

    The second parent; while that is a merge itself, its first parent instead. Pointer
    doubling along merge commits.
    """
    twos = two_parents(edges).select(*NODE, "parent1", "parent2")
    state = twos.select(*NODE, F.col("parent2").alias("source"))
    hop = twos.select("pair_id", F.col("sha").alias("source"), F.col("parent1").alias("_next"))
    while True:
        moved = state.join(hop, ["pair_id", "source"], "left")
        state, n_moved = materialize_counted(
            moved.select(
                *NODE,
                F.coalesce("_next", "source").alias("source"),
                F.col("_next").isNotNull().alias("_moved"),
            ),
            "sources",
            F.col("_moved"),
        )
        state = state.drop("_moved")
        if not n_moved:
            return state
        onward = hop.select(
            "pair_id", F.col("source").alias("_next"), F.col("_next").alias("_after")
        )
        hop = materialize(
            hop.join(onward, ["pair_id", "_next"], "left").select(
                "pair_id", "source", F.coalesce("_after", "_next").alias("_next")
            ),
            "hops",
        )


def shortest_paths(edges: DataFrame, requests: DataFrame, block: int = BLOCK) -> DataFrame:
    """Explicit ancestor paths for ``requests(pair_id, descendant, ancestor)``.

    ``pair_id, descendant, ancestor, step, sha`` with step 0 the descendant. Of the shortest paths the one
    whose commits, read from the ancestor, have the least hashes. No row where there is no path.
    """
    labels = ["descendant", "ancestor"]
    asked = requests.select("pair_id", *labels).distinct()
    seeds = asked.select(
        "pair_id", *labels, F.col("descendant").alias("sha"), F.lit(0).alias("value"),
        F.lit(None).cast(edges.schema["sha"].dataType).alias("tag"),
    )
    found = least_costs(graph_blocks(edges, block=block), seeds, ["pair_id"], labels, each_step, trace=True)
    path = traced(found, asked.withColumn("sha", F.col("ancestor")), ["pair_id"], labels)
    return path.select("pair_id", *labels, F.col("value").alias("step"), "sha")


def fork_tree(repositories: DataFrame) -> DataFrame:
    """Forks of forks: ``root_id, repo_id, level`` for every repository below a root.

    One round per level of the tree, all roots together.
    """
    known = repositories.select(F.col("repo_id").alias("parent_id"))
    roots = repositories.filter(F.col("parent_id").isNull()).unionByName(
        repositories.filter(F.col("parent_id").isNotNull()).join(known, "parent_id", "left_anti"),
        allowMissingColumns=True,
    )
    front = roots.select(
        F.col("repo_id").alias("root_id"), "repo_id", F.lit(0).alias("level")
    )
    front = materialize(front, "tree")
    levels = []
    children = repositories.select(F.col("parent_id").alias("_up"), F.col("repo_id").alias("_id"))
    while True:
        front, n_new = materialize_counted(
            front.join(children, front.repo_id == children._up).select(
                "root_id", F.col("_id").alias("repo_id"), (F.col("level") + 1).alias("level")
            ),
            "tree",
        )
        if not n_new:
            break
        levels.append(front)
    if not levels:
        return front
    return reduce(lambda a, b: a.unionByName(b), levels)


def fork_tree_recursive(repositories: DataFrame, max_levels: int = 100) -> DataFrame:
    """:func:`fork_tree` as one recursive query, for trees of few levels: one plan, and no table per level.

    Spark refuses, and does not cut, trees of more than ``max_levels`` levels or results of more rows than
    ``spark.sql.cteRecursionRowLimit``; :func:`fork_tree` has neither limit.
    """
    return repositories.sparkSession.sql(
        f"""WITH RECURSIVE tree(root_id, repo_id, level) MAX RECURSION LEVEL {int(max_levels)} AS (
          SELECT r.repo_id, r.repo_id, 0 FROM {{repositories}} r
            LEFT ANTI JOIN {{repositories}} p ON p.repo_id = r.parent_id
          UNION ALL
          SELECT t.root_id, c.repo_id, t.level + 1 FROM tree t JOIN {{repositories}} c ON c.parent_id = t.repo_id)
        SELECT root_id, repo_id, level FROM tree WHERE level > 0""",
        repositories=repositories.select("repo_id", "parent_id"),
    )


def resolve_upstream(repositories: DataFrame) -> DataFrame:
    """Each repository with its upstream's url: the parent of a fork, else itself."""
    parent = repositories.select(
        F.col("repo_id").alias("parent_id"), F.col("url").alias("_parent_url")
    )
    # Most repositories have no parent; joined, their NULL keys would meet in one task.
    forks = repositories.filter(F.col("parent_id").isNotNull()).join(parent, "parent_id", "left")
    roots = repositories.filter(F.col("parent_id").isNull())
    return forks.select(
        "repo_id", "url", F.coalesce("_parent_url", "url").alias("upstream_url")
    ).unionByName(roots.select("repo_id", "url", F.col("url").alias("upstream_url")))


def are_fork_and_upstream(pairs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Flag ``pairs(fork_url, upstream_url)`` that are fork and parent."""
    known = resolve_upstream(repositories).filter(F.col("url") != F.col("upstream_url"))
    true = known.select(
        F.col("url").alias("fork_url"), "upstream_url", F.lit(True).alias("is_pair")
    )
    return pairs.join(true, ["fork_url", "upstream_url"], "left").withColumn(
        "is_pair", F.coalesce("is_pair", F.lit(False))
    )
