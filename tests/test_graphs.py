"""Random graphs against plain searches."""

import random
from collections import deque

import pytest
from test_fixtures import EDGES, HEADS, edge_rows, rows

from forklore.operators import dag
from forklore.plans import classify


def random_history(rng, n):
    """Long first-parent lines with branches, merges and octopus merges."""
    history = {0: []}
    for sha in range(1, n):
        recent = list(range(max(0, sha - 6), sha))
        first = sha - 1 if rng.random() < 0.7 else rng.choice(recent)
        parents = [first]
        if rng.random() < 0.3:
            parents += rng.sample(range(sha), min(sha, rng.choice([1, 1, 2])))
        history[sha] = list(dict.fromkeys(parents)) if rng.random() < 0.9 else parents
    return history


def distances(history, heads):
    best = {}
    queue = deque((h, 0) for h in heads)
    while queue:
        sha, d = queue.popleft()
        if best.get(sha, 10**9) <= d:
            continue
        best[sha] = d
        for i, parent in enumerate(history[sha]):
            free = i == 0 or parent == history[sha][0]
            (queue.appendleft if free else queue.append)((parent, d if free else d + 1))
    return best


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(5)
    made = {}
    for pair, n in enumerate([1, 2, 40, 150, 300]):
        history = random_history(rng, n)
        heads = {
            side: rng.sample(range(n), min(n, k)) for side, k in (("fork", 2), ("upstream", 1))
        }
        made[pair] = (history, heads)
    return made


def frames(spark, graphs):
    edges = [r for p, (h, _) in graphs.items() for r in edge_rows(h, p)]
    heads = [(p, s, x) for p, (_, hs) in graphs.items() for s, xs in hs.items() for x in xs]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(heads, HEADS)


def test_distances_equal_plain_search(spark, graphs):
    edges, heads = frames(spark, graphs)
    want = {
        (p, s, sha, d)
        for p, (h, hs) in graphs.items()
        for s, xs in hs.items()
        for sha, d in distances(h, xs).items()
    }
    got = rows(dag.reached(edges, heads), "pair_id", "side", "sha", "distance")
    assert got == want


def test_contributions_equal_closures(spark, graphs):
    single = {p: (h, {s: xs[:1] for s, xs in hs.items()}) for p, (h, hs) in graphs.items()}
    edges, heads = frames(spark, single)
    got = rows(
        dag.merge_contributions(edges, dag.decompose_branches(edges, heads)),
        "pair_id", "side", "merge_sha", "sha",
    )
    want = set()
    for p, (h, hs) in single.items():
        for side, (head,) in hs.items():
            at = head
            while True:
                parents = h[at]
                if len(parents) > 1:
                    new = set(distances(h, [at])) - set(distances(h, parents[:1])) - {at}
                    want |= {(p, side, at, c) for c in new if len(h[c]) < 2}
                if not parents:
                    break
                at = parents[0]
    assert got == want


def test_swapping_sides_swaps_categories(spark, graphs):
    edges, heads = frames(spark, graphs)
    swap = heads.replace({"fork": "upstream", "upstream": "fork"}, subset=["side"])
    one = rows(classify.classify_commits(edges, heads), "pair_id", "sha", "category")
    two = rows(classify.classify_commits(edges, swap), "pair_id", "sha", "category")
    other = {"only_F": "only_U", "only_U": "only_F", "F2U": "U2F", "U2F": "F2U", "before": "before"}
    assert {(p, s, other[c]) for p, s, c in one} == two


def test_shortest_path_is_a_path(spark, graphs):
    history, _ = graphs[3]
    edges = spark.createDataFrame(edge_rows(history, 3), EDGES)
    ask = spark.createDataFrame([(3, 149, 0), (3, 0, 149)], "pair_id int, descendant int, ancestor int")
    path = dag.shortest_paths(edges, ask).orderBy("step").collect()
    assert path[0].sha == 149 and path[-1].sha == 0
    assert all(b.sha in history[a.sha] for a, b in zip(path, path[1:]))


def test_blocks_change_nothing(spark, graphs):
    """Histories cut into many small blocks, some of them by hash within one depth."""
    edges, heads = frames(spark, graphs)
    for block in (7, 60):
        want = {
            (p, s, sha, d)
            for p, (h, hs) in graphs.items()
            for s, xs in hs.items()
            for sha, d in distances(h, xs).items()
        }
        assert rows(dag.reached(edges, heads, block), "pair_id", "side", "sha", "distance") == want
    whole = dag.decompose_branches(edges, heads)
    cut = dag.decompose_branches(edges, heads, 60)
    assert rows(cut, *whole.columns) == rows(whole, *whole.columns)


def test_contributions_in_blocks(spark, graphs):
    single = {p: (h, {s: xs[:1] for s, xs in hs.items()}) for p, (h, hs) in graphs.items()}
    edges, heads = frames(spark, single)
    branches = dag.decompose_branches(edges, heads)
    columns = "pair_id", "side", "merge_sha", "sha"
    whole = rows(dag.merge_contributions(edges, branches), *columns)
    assert rows(dag.merge_contributions(edges, branches, 40), *columns) == whole


def plain_path(history, descendant, ancestor):
    step = {descendant: 0}
    queue = deque([descendant])
    children = {}
    while queue:
        sha = queue.popleft()
        for parent in history[sha]:
            children.setdefault(parent, set()).add(sha)
            if parent not in step:
                step[parent] = step[sha] + 1
                queue.append(parent)
    if ancestor not in step:
        return []
    path = [ancestor]
    while path[-1] != descendant:
        path.append(min(c for c in children[path[-1]] if step.get(c) == step[path[-1]] - 1))
    return [(descendant, ancestor, step[sha], sha) for sha in path]


@pytest.mark.parametrize("block", [1 << 16, 50, 9])
def test_shortest_paths_equal_plain_search(spark, graphs, block):
    history, _ = graphs[4]
    ask = [(299, 0), (299, 150), (150, 7), (7, 150), (200, 200), (12345, 0)]
    edges = spark.createDataFrame(edge_rows(history, 4), EDGES)
    asked = spark.createDataFrame([(4, *a) for a in ask], "pair_id int, descendant int, ancestor int")
    got = rows(dag.shortest_paths(edges, asked, block), "descendant", "ancestor", "step", "sha")
    assert got == {r for a in ask if a[0] in history for r in plain_path(history, *a)}


def test_nearest_heads_equal_one_search_per_head(spark, graphs):
    wanted = set()
    many = {}
    for p, (h, _) in graphs.items():
        rng = random.Random(p)
        many[p] = (h, {s: rng.sample(sorted(h), min(len(h), 4)) for s in ("fork", "upstream")})
        for side, xs in many[p][1].items():
            best = {}
            for head in xs:
                for sha, d in distances(h, [head]).items():
                    best[sha] = min(best.get(sha, (d, head)), (d, head))
            wanted |= {(p, side, sha, head, d) for sha, (d, head) in best.items()}
    edges, heads = frames(spark, many)
    for block in (1 << 16, 50):
        assert rows(dag.nearest_heads(edges, heads, block), "pair_id", "side", "sha", "head", "distance") == wanted


def long_line(n):
    """A line of ``n`` commits; every fourth merges a side branch of two commits that began six below."""
    history = {sha: [sha - 1] if sha else [] for sha in range(n)}
    for sha in range(8, n, 4):
        side = n + 2 * sha
        history[side], history[side + 1] = [sha - 6], [side]
        history[sha] = [sha - 1, side + 1]
    return history


def test_rounds_do_not_grow_with_a_line(spark, monkeypatch):
    from forklore.operators import search

    made = []
    real = search.materialize_counted

    def counted(df, label, *rest):
        made.append(label)
        return real(df, label, *rest)

    monkeypatch.setattr(search, "materialize_counted", counted)
    history = long_line(2000)
    edges = spark.createDataFrame(edge_rows(history, 1), EDGES)
    heads = spark.createDataFrame([(1, "fork", 1999), (1, "upstream", 1500)], HEADS)
    ask = spark.createDataFrame([(1, 1999, 0)], "pair_id int, descendant int, ancestor int")
    path = dag.shortest_paths(edges, ask)
    assert made.count("found") == 1 and made.count("path") == 1
    assert rows(path, "descendant", "ancestor", "step", "sha") == set(plain_path(history, 1999, 0))
    branches = dag.decompose_branches(edges, heads)
    dag.merge_contributions(edges, branches).count()
    assert made.count("found") == 3
    # four blocks along the line: a round for each that a search crosses, not for each commit
    made.clear()
    dag.reached(edges, heads, 1000).count()
    assert made.count("found") <= 8


def test_doubling_writes_open_commits_only(spark, monkeypatch):
    from forklore.operators import search

    written = []
    real = search.materialize_counted

    def counted(df, label, *rest):
        made = real(df, label, *rest)
        if label == "depths":
            written.append(made[0].count())
        return made

    monkeypatch.setattr(search, "materialize_counted", counted)
    history = {sha: [sha - 1] if sha % 50 else [] for sha in range(1000)}
    history |= {1000 + sha: [999 + sha] if sha else [] for sha in range(600)}
    edges = spark.createDataFrame(edge_rows(history, 1), EDGES)
    got = rows(search.depths(edges, 100), "sha", "depth")
    assert got == {(s, s % 50) for s in range(1000)} | {(1000 + s, s) for s in range(600)}
    assert written == sorted(written, reverse=True) and written[-1] < written[0] / 4


def test_both_forms_of_the_fork_tree(spark):
    rng = random.Random(9)
    parents = {i: rng.choice([None, 1000, *range(i)]) if i else None for i in range(80)}
    df = spark.createDataFrame(list(parents.items()), "repo_id int, parent_id int")
    want = set()
    for repo in parents:
        at, level = repo, 0
        while parents[at] in parents:
            at, level = parents[at], level + 1
        if level:
            want.add((at, repo, level))
    columns = "root_id", "repo_id", "level"
    assert rows(dag.fork_tree(df), *columns) == want
    assert rows(dag.fork_tree_recursive(df), *columns) == want
