"""Helpers for groups of any size, with tiny chunks so that all paths are taken."""

import random

from pyspark.sql import functions as F

from forklore.operators import aggregates, groups, intervals, joins, sampling, sets
from forklore.plans import modularity


def test_previous_value_over_chunks(spark):
    rng = random.Random(1)
    data = [(k, p, f"v{k}-{p}") for k in range(3) for p in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(data, "k int, pos int, v string")
    got = {
        (r.k, r.pos): r.prev
        for r in groups.previous_value(df, ["k"], "pos", "v", "prev", chunk=7).collect()
    }
    for i, (k, p, _) in enumerate(data):
        assert got[(k, p)] == (data[i - 1][2] if i and data[i - 1][0] == k else None)


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 2)
    ranked = groups.shuffled_rank(df, ["k"], F.col("id"), "r").collect()
    for k in (0, 1):
        assert sorted(r.r for r in ranked if r.k == k) == list(range(1, 251))


def test_prior_window_forms_agree(spark):
    rng = random.Random(2)
    data = [(p % 2, p, rng.randrange(300), rng.random() < 0.7) for p in range(200)]
    prs = spark.createDataFrame(
        data, "project_id int, pr_id int, age_in_day int, is_closed boolean"
    )
    want = {
        (a, b): [q for (pj, q, age, c) in data if pj == a and c and q < b and ag <= age <= ag + 90]
        for (a, b, ag, _) in data
    }
    pairs = intervals.prior_window_pairs(prs).collect()
    assert {(r.project_id, r.pr_id, r.prior_pr_id) for r in pairs} == {
        (a, b, q) for (a, b), qs in want.items() for q in qs
    }
    low = intervals.lowest_prior_id(prs, ["project_id"], F.when(F.col("is_closed"), F.col("pr_id")))
    joined = prs.join(low, ["project_id", "age_in_day"]).collect()
    for r in joined:
        has = r.lowest_id is not None and r.lowest_id < r.pr_id
        assert has == bool(want[(r.project_id, r.pr_id)])


def test_names_inside_others(spark):
    names = ["a/b", "a/bc", "x", "xa/b", "zz"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name for r in joins.names_inside_others(df).collect()}
    assert got == {n for n in names for m in names if n in m and n != m}


def test_contained_branches_against_all_pairs(spark):
    rng = random.Random(3)
    branches = {f"b{i}": frozenset(rng.sample(range(12), rng.randint(1, 8))) for i in range(30)}
    df = spark.createDataFrame(
        [(1, b, s) for b, ss in branches.items() for s in ss], "repo_id int, branch string, sha int"
    )
    got = {r.branch for r in sets.contained_branches(df).collect()}
    want = {
        a for a, sa in branches.items() for b, sb in branches.items()
        if a != b and sa <= sb and (len(sa) < len(sb) or a < b)
    }
    assert got == want


def test_contained_branches_of_nested_and_of_many_branches(spark):
    """Branches that continue each other, equal ones, and more of them than one bitmap holds."""
    nested = [(1, f"v{i:03}", s) for i in range(60) for s in range(i + 1)]
    equal = [(2, b, s) for b in ("x", "y", "z") for s in (1, 2, 3)] + [(2, "w", 9)]
    many = [(3, f"m{i}", s) for i in range(40_000) for s in (i % 3, 100 + i % 2)] + [(3, "all", s) for s in (0, 1, 2, 100, 101)]
    few = [(3, "out", 0), (3, "out", 7)]
    df = spark.createDataFrame(nested + equal + many + few, "repo_id int, branch string, sha int")
    got = {(r.repo_id, r.branch) for r in sets.contained_branches(df).collect()}
    want = {(1, f"v{i:03}") for i in range(59)} | {(2, "x"), (2, "y")} | {(3, f"m{i}") for i in range(40_000)}
    assert got == want
    apart = spark.createDataFrame(
        [(4, f"p{i}", s) for i in range(40_000) for s in (i, 50_000)] + [(4, "q", 7), (4, "q", 50_000), (4, "q", 8)],
        "repo_id int, branch string, sha int",
    )
    assert {r.branch for r in sets.contained_branches(apart).collect()} == {"p7", "p8"}


def test_sample_is_exact_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "pr_id")
    one = {r.pr_id for r in sampling.sample_exactly(df, 37, "pr_id", 4).collect()}
    two = {r.pr_id for r in sampling.sample_exactly(df.repartition(5), 37, "pr_id", 4).collect()}
    assert len(one) == 37 and one == two


def test_pairs_of_files_of_large_commits(spark):
    rng = random.Random(11)
    commits = {sha: {f"f{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 3, 50]))} for sha in range(25)}
    df = spark.createDataFrame([(s, f) for s, names in commits.items() for f in names], "sha int, filename string")
    want = {}
    for names in commits.values():
        for a in names:
            for b in names:
                if a <= b:
                    want[a, b] = want.get((a, b), 0) + 1
    for block in (500, 7):
        got = {(r.file_a, r.file_b): r.support for r in aggregates.co_change_support(df.union(df), block=block).collect()}
        assert got == want


def test_modularity_of_a_commit_of_very_many_files(spark):
    """20,000 files in one commit, and some of them in others: pairs are counted, not formed."""
    rng = random.Random(12)
    n = 20_000
    touched = {"mass": set(range(n))} | {f"c{i}": set(rng.sample(range(n + 50), 40)) for i in range(12)}
    touched["aside"] = {n + 100, n + 101}
    files = spark.createDataFrame(
        [(sha, f"f{i}.{'py' if i % 3 else 'md'}", "modified") for sha, names in touched.items() for i in names],
        "sha string, filename string, status string",
    )
    commits = spark.createDataFrame(
        [(1, sha, f"2020-01-{i + 1:02}", "x") for i, sha in enumerate(touched)],
        "project_id int, sha string, committed_at string, login string",
    )
    found = modularity.modularity_grid(commits, files, [".py"], [None, 50], n_commits=100).collect()
    for limit in (None, 50):
        for scope in ("all_files", "source_only"):
            chosen = [
                {i for i in names if scope == "all_files" or i % 3} for names in touched.values()
                if limit is None or len(names) <= limit
            ]
            pairs = {(a, b) for names in chosen if len(names) < 100 for a in names for b in names if a < b}
            every = set().union(*chosen)
            count = len(pairs)
            if limit is None:
                mass = {i for i in range(n) if scope == "all_files" or i % 3}
                count = len(mass) * (len(mass) - 1) // 2 + len({p for p in pairs if not (p[0] in mass and p[1] in mass)})
            row = next(r for r in found if r.max_files == limit and r.scope == scope)
            assert (row.n_files, row.n_pairs) == (len(every), count)
