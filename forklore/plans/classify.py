"""Classification of commits between fork and upstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.functions.commits import same_author
from forklore.operators.aggregates import category_counts
from forklore.operators.dag import (
    decompose_branches,
    head_distances,
    merge_contributions,
    merge_sources,
    split_by_head_count,
)
from forklore.operators.sets import one_sided
from forklore.session import materialize


def category_of(fork: Column, upstream: Column) -> Column:
    """Category from the distance to the fork's and the upstream's heads, NULL for not reached."""
    return (
        F.when(upstream.isNull(), "only_F")
        .when(fork.isNull(), "only_U")
        .when(fork < upstream, "F2U")
        .when(fork > upstream, "U2F")
        .otherwise("before")
    )


def classify_commits(
    edges: DataFrame, heads: DataFrame, roots_unreached: bool = False
) -> DataFrame:
    """Category of every commit that is no merge: ``pair_id, sha, category``.

    With ``roots_unreached`` commits without parents count as ``only_F``, as in the
    published counts, where they never got a distance.
    """
    distances = head_distances(edges, heads).filter(~F.col("is_merge"))
    if roots_unreached:
        roots = edges.filter(F.col("parent").isNull()).select(
            "pair_id", "sha", F.lit("only_F").alias("category")
        )
        inner = distances.join(roots, ["pair_id", "sha"], "left_anti")
        return _categories(inner).unionByName(roots)
    return _categories(distances)


def _categories(distances: DataFrame) -> DataFrame:
    both = F.col("distance_fork").isNull() & F.col("distance_upstream").isNull()
    return distances.filter(~both).select(
        "pair_id",
        "sha",
        category_of(F.col("distance_fork"), F.col("distance_upstream")).alias("category"),
    )


def four_way(classified: DataFrame) -> DataFrame:
    """The older form without a category for commits as near to both sides."""
    return classified.filter(F.col("category") != "before")


def override_by_date(classified: DataFrame, dates: DataFrame, forked: DataFrame) -> DataFrame:
    """A commit of the fork's birthday or older is from before the fork, whatever the graph says.

    ``dates(pair_id, sha, committed_at)``, ``forked(pair_id, forked_on)``. A commit or fork
    without a date keeps its category.
    """
    old = F.to_date("committed_at") <= F.col("forked_on")
    return (
        classified.join(dates, ["pair_id", "sha"], "left")
        .join(forked, "pair_id", "left")
        .withColumn(
            "category",
            F.when(F.coalesce(old, F.lit(False)), "before").otherwise(F.col("category")),
        )
        .select("pair_id", "sha", "category", "committed_at")
    )


def fork_commit_counts(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """The five counts per pair, however many heads a side has."""
    return category_counts(classify_commits(edges, heads), "pair_id")


def limited_fork_commit_counts(
    edges: DataFrame, heads: DataFrame, max_heads: int
) -> tuple[DataFrame, DataFrame]:
    """The counts of pairs within ``max_heads`` heads on every side, and the pairs left out."""
    usable, rejected = split_by_head_count(heads, max_heads)
    graph = edges.join(usable.select("pair_id").distinct(), "pair_id", "left_semi")
    return fork_commit_counts(graph, usable), rejected


def graph_result_lines(counts: DataFrame) -> DataFrame:
    """The printed line ``fork,upstream,only_F,only_U,F2U,U2F,`` with its trailing comma."""
    return counts.select(
        F.concat(
            F.concat_ws(",", "fork_url", "upstream_url", "only_F", "only_U", "F2U", "U2F"),
            F.lit(","),
        ).alias("line")
    )


def compare_histories(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Set-algebra classification of one fork branch against one upstream branch.

    Per pair the sizes of the sets ``only_F``, ``only_U``, ``only_U_with_prs``, ``F2U``,
    ``U2F``, ``U2F_with_prs`` and ``syncs``. A merge on the fork's line brings commits
    from the upstream if the line it merges begins on the upstream's own line
    (``U2F``) or anywhere in its history (``U2F_with_prs``), and the other way round.
    """
    branches = decompose_branches(edges, heads)
    moved = merge_contributions(edges, branches)
    sources = merge_sources(edges).withColumnRenamed("sha", "merge_sha")
    other = F.when(F.col("side") == "fork", "upstream").otherwise("fork")
    places = branches.select(
        "pair_id", other.alias("side"), F.col("sha").alias("source"), "role"
    )
    brought = materialize(
        moved.join(sources, ["pair_id", "merge_sha"])
        .join(places, ["pair_id", "side", "source"])
        .groupBy("pair_id", "side", "sha")
        .agg(F.bool_or(F.col("role") == "origin").alias("from_line")),
        "brought",
    )
    node = ["pair_id", "sha"]
    u2f_any = brought.filter(F.col("side") == "fork").select(*node)
    own = one_sided(
        brought.filter((F.col("side") == "fork") & F.col("from_line")).select(*node),
        brought.filter((F.col("side") == "upstream") & F.col("from_line")).select(*node),
        node,
    )
    flags = branches.groupBy(*node).agg(
        F.bool_or(F.col("side") == "fork").alias("in_fork"),
        F.bool_or(F.col("side") == "upstream").alias("in_upstream"),
        F.bool_or((F.col("side") == "fork") & (F.col("role") == "origin")).alias("fork_line"),
        F.bool_or((F.col("side") == "upstream") & (F.col("role") == "origin")).alias("up_line"),
        F.bool_or("is_merge").alias("is_merge"),
        F.bool_or((F.col("side") == "upstream") & (F.col("role") == "merge_point")).alias(
            "up_merge_point"
        ),
    )
    tagged = (
        flags.join(own.withColumnRenamed("side", "moved"), node, "left")
        .join(u2f_any.withColumn("moved_any", F.lit(True)), node, "left")
        .join(_merged_merges(edges, branches), node, "left")
    )
    is_f2u = F.coalesce(F.col("moved") == "right", F.lit(False))
    is_u2f = F.coalesce(F.col("moved") == "left", F.lit(False))
    any_u2f = F.coalesce("moved_any", F.lit(False))
    before = F.col("fork_line") & F.col("up_line")
    left_in_upstream = (
        F.col("in_upstream") & ~F.col("in_fork") & ~F.col("is_merge") & ~is_u2f & ~any_u2f
    )
    sync = F.coalesce("is_sync", F.lit(False)) & ~any_u2f & ~left_in_upstream
    return tagged.groupBy("pair_id").agg(
        F.count_if(F.col("fork_line") & ~before & ~is_f2u).alias("only_F"),
        F.count_if(F.col("up_line") & ~before & ~is_u2f).alias("only_U"),
        F.count_if(left_in_upstream).alias("only_U_with_prs"),
        F.count_if(is_f2u).alias("F2U"),
        F.count_if(is_u2f).alias("U2F"),
        F.count_if(any_u2f).alias("U2F_with_prs"),
        F.count_if(sync).alias("syncs"),
    )


def _merged_merges(edges: DataFrame, branches: DataFrame) -> DataFrame:
    """Merges that were themselves merged into the fork's line as a second parent."""
    line = branches.filter((F.col("side") == "fork") & (F.col("role") == "merge_point"))
    second = edges.filter(F.col("parent_pos") == 1).select("pair_id", "sha", "parent")
    merges = edges.filter(F.col("parent_pos") > 0).select("pair_id", F.col("sha").alias("parent"))
    return (
        second.join(line.select("pair_id", "sha"), ["pair_id", "sha"], "left_semi")
        .join(merges, ["pair_id", "parent"], "left_semi")
        .select("pair_id", F.col("parent").alias("sha"))
        .distinct()
        .withColumn("is_sync", F.lit(True))
    )


def classify_merges_by_parents(parents: DataFrame, membership: DataFrame) -> DataFrame:
    """Commit kinds from where the two parents of a merge are found.

    ``parents(pair_id, sha, parent1, parent2)`` with NULL parents where missing,
    ``membership(pair_id, side, sha)``. A two-parent commit of the upstream with exactly
    one parent in the fork is ``merge_to_upstream``; the mirror image is
    ``sync_from_upstream``; what is no merge is ``only_in_fork`` or
    ``only_in_upstream`` unless it is on both sides.
    """
    sides = materialize(
        membership.groupBy("pair_id", "sha").agg(
            F.bool_or(F.col("side") == "fork").alias("in_fork"),
            F.bool_or(F.col("side") == "upstream").alias("in_upstream"),
        ),
        "sides",
    )
    rows = parents.join(sides, ["pair_id", "sha"])
    two = F.col("parent1").isNotNull() & F.col("parent2").isNotNull()
    merges = rows.filter(two)
    for n in ("parent1", "parent2"):
        found = sides.select(
            "pair_id",
            F.col("sha").alias(n),
            F.col("in_fork").alias(f"{n}_in_fork"),
            F.col("in_upstream").alias(f"{n}_in_upstream"),
        )
        merges = merges.join(found, ["pair_id", n], "left")

    def one_of(side: str) -> Column:
        a = F.coalesce(f"parent1_in_{side}", F.lit(False))
        b = F.coalesce(f"parent2_in_{side}", F.lit(False))
        return a != b

    to_up = F.col("in_upstream") & one_of("fork")
    sync = F.col("in_fork") & one_of("upstream")
    of_merge = F.when(to_up & ~sync, "merge_to_upstream").when(
        sync & ~to_up, "sync_from_upstream"
    )
    of_other = F.when(F.col("in_fork") & ~F.col("in_upstream"), "only_in_fork").when(
        F.col("in_upstream") & ~F.col("in_fork"), "only_in_upstream"
    )
    return (
        merges.select("pair_id", "sha", of_merge.alias("kind"))
        .unionByName(rows.filter(~two).select("pair_id", "sha", of_other.alias("kind")))
        .filter(F.col("kind").isNotNull())
    )


def classify_by_author(
    commits: DataFrame, owners: DataFrame, upstream_owners: DataFrame
) -> DataFrame:
    """Type of each commit in a fork by who wrote it and whose parents it has.

    ``commits(repo_id, sha, login, name, email, parent1, parent2)``;
    ``owners(repo_id, owner_login, contacts)`` with an array of the owner's logins, names
    and e-mails; ``upstream_owners(repo_id, up_login, up_name, up_emails)``. Types:
    ``sync_upstream``, ``origin``, ``other``.
    """
    up = [F.col("up_login"), F.col("up_name"), F.col("up_emails")]
    rows = commits.join(owners, "repo_id", "left").join(upstream_owners, "repo_id", "left")
    by_upstream = same_author(
        F.col("owner_login"), up[0], F.col("name"), up[1], F.array("email"), up[2]
    ) | F.coalesce(F.col("login") == up[0], F.lit(False))
    mine = F.coalesce(
        F.arrays_overlap(F.array("login", "name", "email"), F.col("contacts")), F.lit(False)
    )
    single = F.col("parent1").isNotNull() & F.col("parent2").isNull()
    # Only merges look at their parents; joining the rest would pile up NULL keys.
    two = F.col("parent1").isNotNull() & F.col("parent2").isNotNull()
    plain = F.when(by_upstream, "sync_upstream").when(single & mine, "origin").otherwise("other")
    typed = rows.filter(~two).select("repo_id", "sha", plain.alias("commit_type"))
    merges = rows.filter(two)
    people = commits.select("repo_id", "sha", "login", "name", "email")
    for n in ("1", "2"):
        merges = merges.join(
            people.select(
                "repo_id",
                F.col("sha").alias(f"parent{n}"),
                F.col("login").alias(f"login{n}"),
                F.col("name").alias(f"name{n}"),
                F.col("email").alias(f"email{n}"),
            ),
            ["repo_id", f"parent{n}"],
            "left",
        )

    def parent_is_upstreams(n: str) -> Column:
        return same_author(
            F.col(f"login{n}"), up[0], F.col(f"name{n}"), up[1], F.array(f"email{n}"), up[2]
        )

    synced = by_upstream | parent_is_upstreams("1") | parent_is_upstreams("2")
    of_merge = F.when(synced, "sync_upstream").otherwise("other")
    return typed.unionByName(merges.select("repo_id", "sha", of_merge.alias("commit_type")))
