"""Hotness against plain loops, with one project, file and day that hold much of the data."""

import random

import pytest

from forklore.operators import intervals
from forklore.plans import hotness


@pytest.fixture(scope="module")
def history():
    rng = random.Random(8)
    prs, pr_commits, files = [], [], []
    for pr in range(160):
        project = 0 if rng.random() < 0.6 else rng.randrange(1, 4)
        age = 100 if rng.random() < 0.3 else rng.randrange(400)
        prs.append((project, pr, age, rng.random() < 0.7))
        for _ in range(rng.randrange(4)):
            sha = rng.randrange(300)
            pr_commits.append((project, pr, sha))
    for sha in range(300):
        for _ in range(rng.randrange(4)):
            name = "README" if rng.random() < 0.4 else f"f{rng.randrange(12)}"
            files.append((sha, name, rng.choice(["added", "modified", "removed"])))
    return prs, sorted(set(pr_commits)), sorted(set(files))


def plain(history, window=90):
    prs, pr_commits, files = history
    commits_of, files_of = {}, {}
    for project, pr, sha in pr_commits:
        commits_of.setdefault((project, pr), set()).add(sha)
    for sha, name, status in files:
        files_of.setdefault(sha, []).append((name, status != "removed"))
    hot_commits, prior_commits = {}, {}
    for project, pr, age, closed in prs:
        if not closed:
            continue
        prior = [
            q for (p2, q, age2, closed2) in prs
            if p2 == project and closed2 and q < pr and age <= age2 <= age + window
        ]
        hot = {
            n for q in prior for s in commits_of.get((project, q), ())
            for n, kept in files_of.get(s, ()) if kept
        }
        mine = commits_of.get((project, pr), set())
        touched = {s for s in mine if s in files_of}
        if hot:
            hot_commits[(project, pr)] = sum(
                any(n in hot for n, _ in files_of[s]) for s in touched
            )
        my_files = {n for s in touched for n, kept in files_of[s] if kept}
        if my_files:
            earlier = {s for q in prior for s in commits_of.get((project, q), ())}
            prior_commits[(project, pr)] = sum(
                any(kept and n in my_files for n, kept in files_of.get(s, ())) for s in earlier
            )
    return hot_commits, prior_commits


def test_both_metrics_equal_plain_loops(spark, history):
    prs = spark.createDataFrame(
        history[0], "project_id int, pr_id int, age_in_day int, is_closed boolean"
    )
    pr_commits = spark.createDataFrame(history[1], "project_id int, pr_id int, sha int")
    files = spark.createDataFrame(history[2], "sha int, filename string, status string")
    hot, prior = plain(history)
    got = hotness.hot_commits(prs, pr_commits, files).collect()
    assert {(r.project_id, r.pr_id): r.n_hot_commits for r in got} == hot
    got = hotness.commit_hotness(prs, pr_commits, files).collect()
    assert {(r.project_id, r.pr_id): r.n_prior_commits for r in got} == prior


def test_hotness_grows_with_the_window(spark, history):
    prs = spark.createDataFrame(
        history[0], "project_id int, pr_id int, age_in_day int, is_closed boolean"
    )
    pr_commits = spark.createDataFrame(history[1], "project_id int, pr_id int, sha int")
    files = spark.createDataFrame(history[2], "sha int, filename string, status string")
    small = hotness.hot_commits(prs, pr_commits, files, 30)
    large = hotness.hot_commits(prs, pr_commits, files, 90).withColumnRenamed(
        "n_hot_commits", "n_large"
    )
    both = small.join(large, ["project_id", "pr_id"], "left")
    assert both.filter("n_large IS NULL OR n_large < n_hot_commits").isEmpty()


def test_commit_hotness_and_prior_counts_equal_pairs(spark):
    """Commits of one and of several requests, crowded days, blocks and chunks of few rows."""
    rng = random.Random(6)
    prs, commits, files = [], [], []
    for project in (1, 2):
        for pr in range(120):
            prs.append((project, pr, rng.choice([5, 5, rng.randint(0, 300)]), rng.random() < 0.8))
            commits += [(project, pr, rng.choice([rng.randrange(30), 1000 * pr + i])) for i in range(rng.randint(0, 6))]
    for sha in {c[2] for c in commits}:
        files += [(sha, f"f{rng.randrange(12)}", rng.choice(["added", "modified", "removed"])) for _ in range(rng.randint(0, 4))]
    by_sha = {}
    for sha, name, status in files:
        if status != "removed":
            by_sha.setdefault(sha, set()).add(name)
    facts = {(p, n): (age, closed) for p, n, age, closed in prs}
    held = {}
    for project, pr, sha in commits:
        if facts[project, pr][1] and by_sha.get(sha):
            held.setdefault((project, pr), set()).add(sha)
    want = set()
    for (project, pr), shas in held.items():
        mine = set().union(*(by_sha[s] for s in shas))
        age = facts[project, pr][0]
        prior = {
            s for (q, other), theirs in held.items() for s in theirs
            if q == project and other < pr and age <= facts[q, other][0] <= age + 90 and by_sha[s] & mine
        }
        want.add((project, pr, len(prior)))
    frames = (
        spark.createDataFrame(prs, "project_id int, pr_id long, age_in_day int, is_closed boolean"),
        spark.createDataFrame(commits + commits[:9], "project_id int, pr_id long, sha long"),
        spark.createDataFrame(files, "sha long, filename string, status string"),
    )
    for block in (8192, 8):
        assert {tuple(r) for r in hotness.commit_hotness(*frames, block=block).collect()} == want
    counted = set()
    for project, pr, age, _ in prs:
        prior = [n for q, n, a, closed in prs if q == project and closed and n < pr and age <= a <= age + 90]
        if prior:
            counted.add((project, pr, len(prior), min(prior)))
    for chunk in (1 << 20, 16):
        got = intervals.prior_window_lower(frames[0], chunk=chunk).collect()
        assert {tuple(r) for r in got} == counted


def test_commit_hotness_forms_a_row_per_request_and_file(spark, monkeypatch):
    """Requests met each block of days of their window, so rows grew with the square of the commits in it."""
    rng = random.Random(11)
    prs = [(n % 2, n, rng.randrange(200), True) for n in range(1500)]
    commits = [(n % 2, n, 10 * n + i) for n in range(1500) for i in range(2)]
    files = [(sha, name if rng.random() < 0.95 else None, "added") for _, _, sha in commits
             for name in rng.sample(["hot", *(f"f{i}" for i in range(60))], 1 if sha % 7 else 3)]
    names_of, held = {}, {}
    for sha, name, _ in files:
        names_of.setdefault(sha, set()).add(name)
    for project, pr, sha in commits:
        held.setdefault((project, pr), []).append(sha)
    want = set()
    for project, pr, age, _ in prs:
        mine = set().union(*(names_of[s] for s in held[project, pr]))
        prior = [n for p, n, a, _ in prs if p == project and n < pr and age <= a <= age + 90]
        want.add((project, pr, sum(bool(names_of[s] & mine) for n in prior for s in held[project, n])))
    frames = (
        spark.createDataFrame(prs, "project_id int, pr_id long, age_in_day int, is_closed boolean"),
        spark.createDataFrame(commits, "project_id int, pr_id long, sha long"),
        spark.createDataFrame(files, "sha long, filename string, status string"),
    )
    dealt, in_groups = [], hotness.in_groups
    monkeypatch.setattr(hotness, "in_groups", lambda rows, *a: dealt.append(rows.count()) or in_groups(rows, *a))
    for block, chunk in ((8192, 1 << 20), (64, 1 << 20), (64, 20)):
        got = hotness.commit_hotness(*frames, block=block, chunk=chunk).collect()
        assert {tuple(r) for r in got} == want
    # a window of more than four blocks is not cut into more of them
    assert dealt[1] < 8 * len(prs)
