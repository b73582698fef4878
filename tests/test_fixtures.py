"""Hand-made micro tables with exact expectations."""

from pyspark.sql import functions as F

from forklore.functions import text
from forklore.operators import dag, windows
from forklore.plans import classify, duplicates, easiness, modularity, timeline


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def edge_rows(history, pair=1):
    out = []
    for sha, parents in history.items():
        if not parents:
            out.append((pair, sha, None, 0))
        out += [(pair, sha, p, i) for i, p in enumerate(parents)]
    return out


EDGES = "pair_id int, sha int, parent int, parent_pos int"
HEADS = "pair_id int, side string, sha int"


def test_worked_graph_distances(spark):
    history = {1: [], 2: [1], 3: [2], 4: [2], 7: [4], 5: [4, 7], 6: [3, 5]}
    edges = spark.createDataFrame(edge_rows(history), EDGES)
    heads = spark.createDataFrame([(1, "x", 6)], HEADS)
    got = rows(dag.reached(edges, heads), "sha", "distance")
    assert got == {(6, 0), (3, 0), (2, 0), (1, 0), (5, 1), (4, 1), (7, 2)}


def test_categories(spark):
    pairs = [(0, None, "only_F"), (None, 0, "only_U"), (998, 999, "F2U"), (0, 1, "F2U"), (1, 0, "U2F"), (0, 0, "before")]
    df = spark.createDataFrame(pairs, "f int, u int, want string")
    got = df.select("want", classify.category_of(F.col("f"), F.col("u")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_contribution_belongs_to_the_first_merge(spark):
    # 1-2-5-6 is the line; 3,4 is a side branch merged by 5; 7 is merged by 6 and sits on 4.
    history = {1: [], 2: [1], 3: [2], 4: [3], 5: [2, 4], 7: [4], 6: [5, 7]}
    edges = spark.createDataFrame(edge_rows(history), EDGES)
    heads = spark.createDataFrame([(1, "fork", 6)], HEADS)
    branches = dag.decompose_branches(edges, heads)
    assert rows(branches.filter("on_line"), "sha") == {(1,), (2,), (5,), (6,)}
    got = rows(dag.merge_contributions(edges, branches), "merge_sha", "sha")
    assert got == {(5, 3), (5, 4), (6, 7)}


TIMELINE = "thread_id int, event_pos int, event string, actor_id string"


def test_comments_around_close(spark):
    events = [
        (1, 0, "commented", "a"), (1, 1, "commented", "b"), (1, 2, "closed", "a"),
        (1, 3, "commented", "c"), (1, 4, "closed", "b"), (1, 5, "commented", "c"),
        (2, 0, "commented", "a"), (2, 1, "labeled", "z"),
    ]
    df = spark.createDataFrame(events, TIMELINE)
    got = {r.thread_id: r for r in windows.comments_around_close(df, ["thread_id"]).collect()}
    one, two = got[1], got[2]
    assert (one.comments_before, one.participants_before) == (3, 3)
    assert (one.comments_total, one.participants_total, one.comments_after) == (4, 3, 1)
    assert (two.comments_before, two.participants_before) == (1, 2)
    assert rows(windows.last_closer(df, ["thread_id"]), "thread_id", "closer_id") == {(1, "b")}


def test_core_team(spark):
    schema = (
        "project_id int, thread_type string, thread_id int, event_pos int, event string,"
        " actor_id string, association string"
    )
    events = [
        (1, "pr", 1, 0, "merged", "m", ""), (1, "pr", 1, 1, "closed", "m", ""),
        (1, "pr", 2, 0, "closed", "x", ""), (1, "pr", 3, 0, "closed", "y", ""),
        (1, "issue", 4, 0, "commented", "c", "member"), (1, "issue", 4, 1, "commented", "n", "NONE"),
    ]
    authors = [(1, "pr", 1, "m"), (1, "pr", 2, "y"), (1, "pr", 3, "y"), (1, "issue", 4, "o")]
    team = timeline.core_team(
        spark.createDataFrame(events, schema),
        spark.createDataFrame(
            authors, "project_id int, thread_type string, thread_id int, author_id string"
        ),
    )
    assert rows(team, "actor_id") == {("m",), ("x",), ("c",)}


def test_pre_communication(spark):
    schema = (
        "project_id int, thread_type string, thread_id int, event_pos int, event string,"
        " actor_id string, ref_pr_id int, ref_type string"
    )
    events = [
        (1, "issue", 9, i, "cross-referenced", who, pr, "pull_request")
        for i, (who, pr) in enumerate([("a", 1), ("a", 2), ("o", 3)])
    ]
    got = timeline.pre_communication(
        spark.createDataFrame(events, schema),
        spark.createDataFrame([(1, 9, "o")], "project_id int, thread_id int, owner_id string"),
        spark.createDataFrame(
            [(1, 1, "a"), (1, 2, "a"), (1, 3, "o")], "project_id int, pr_id int, author_id string"
        ),
    )
    assert rows(got, "pr_id", "same_owner") == {(2, False), (3, True)}


def test_easiness_both_rules(spark):
    prs = spark.createDataFrame([(1, 1)], "project_id int, pr_id int")
    pr_commits = spark.createDataFrame([(1, 1, "s")], "project_id int, pr_id int, sha string")
    commits = spark.createDataFrame([("s",)], "sha string")
    files = spark.createDataFrame(
        [("s", "a.py", "added"), ("s", "b.md", "added"), ("s", "a.py", "modified"),
         ("s", "c.py", "modified")],
        "sha string, filename string, status string",
    )
    for compat, raw in ((False, 2 / 3), (True, 2 / 4)):
        got = easiness.easiness(prs, pr_commits, commits, files, [".py"], compat).collect()[0]
        assert got.easiness == raw
        assert got.easiness_filtered == 0.5


def test_modularity(spark):
    commits = spark.createDataFrame(
        [(1, "x", 1, "u"), (1, "y", 2, "u"), (1, "z", 3, "u"), (2, "w", 1, "u")],
        "project_id int, sha string, committed_at int, login string",
    )
    files = spark.createDataFrame(
        [("x", "A"), ("x", "B"), ("y", "B"), ("y", "C"), ("z", "D"), ("w", "E")],
        "sha string, filename string",
    ).withColumn("status", F.lit("modified"))
    got = {r.project_id: r for r in modularity.modularity(commits, files, max_files=50, n_commits=50).collect()}
    assert (got[1].n_files, got[1].n_pairs, got[1].modularity) == (4, 2, 33.3333)
    assert got[2].modularity is None
    grid = modularity.modularity_grid(commits, files, ["a"], thresholds=(1, 2), n_commits=50).collect()
    source = [r for r in grid if r.scope == "source_only"]
    assert [(r.max_files, r.project_id, r.n_files) for r in source] == [(2, 1, 1)]
    assert {(r.max_files, r.project_id) for r in grid if r.scope == "all_files"} == {
        (1, 1), (1, 2), (2, 1), (2, 2)
    }


def test_duplicates(spark):
    comments = spark.createDataFrame(
        [(1, 5, 0, "me", "Duplicate of #12"), (1, 6, 0, "me", "it is fixed")],
        "project_id int, pr_id int, comment_pos int, commenter_id string, body string",
    )
    prs = spark.createDataFrame(
        [(1, 5, "z", False), (1, 6, "z", False), (1, 12, "me", True)],
        "project_id int, pr_id int, author_id string, is_merged boolean",
    )
    pairs = duplicates.duplicate_pairs(duplicates.duplicate_comments(comments), prs)
    assert rows(pairs, "pr_id", "dup_pr_id") == {(5, 12)}
    false = duplicates.false_positive_duplicates(pairs, prs)
    assert rows(false, "pr_id", "dup_pr_id") == {(5, 12)}


def test_text_functions(spark):
    df = spark.createDataFrame([("alice:dev/repo",), ("alice/repo",)], "u string")
    got = [r[0] for r in df.select(text.fork_url_canonical(F.col("u"))).collect()]
    assert got == ["alice/repo", "alice/repo"]
    fold = spark.createDataFrame([("Étude ß 北",), (None,)], "t string")
    assert [r[0] for r in fold.select(text.ascii_fold(F.col("t"))).collect()] == ["Etude  ", None]


def test_golden_line(spark):
    counts = spark.createDataFrame(
        [("f/framework", "u/framework", 1, 142, 0, 2631)],
        "fork_url string, upstream_url string, only_F int, only_U int, F2U int, U2F int",
    )
    line = classify.graph_result_lines(counts).collect()[0].line
    assert line == "f/framework,u/framework,1,142,0,2631,"
