"""Nothing is dropped by a limit, and threads and commits belong to their project."""

import pytest
from pyspark.sql import functions as F

from forklore import session
from forklore.functions import text
from forklore.operators import dag, filters, windows
from forklore.operators.groups import grouped_medians
from forklore.plans import classify, merge_status
from forklore.sources import exports, sinks


def line(pair, n, start=0):
    """A first-parent line of n commits, the newest with the highest number."""
    return [(pair, start + i, start + i - 1 if i else None, 0) for i in range(n)]


EDGE = "pair_id int, sha long, parent long, parent_pos int"
HEAD = "pair_id int, side string, sha long"


def test_pairs_with_many_heads_are_counted(spark):
    edges = spark.createDataFrame(line(1, 150), EDGE)
    heads = spark.createDataFrame([(1, "fork", i) for i in range(20, 150)] + [(1, "upstream", 40)], HEAD)
    counts = classify.fork_commit_counts(edges, heads).collect()
    assert len(counts) == 1 and counts[0]["only_F"] == 109 and counts[0]["before"] == 41
    kept, rejected = classify.limited_fork_commit_counts(edges, heads, dag.PUBLISHED_MAX_HEADS)
    assert kept.count() == 0 and [r["n_heads"] for r in rejected.collect()] == [130]


def test_heads_outside_the_graph(spark):
    edges = spark.createDataFrame(line(1, 5), EDGE)
    none = spark.createDataFrame([(1, "fork", 99)], HEAD)
    assert dag.reached(edges, none).count() == 0
    assert classify.fork_commit_counts(edges, none).count() == 0


def test_deep_merges_keep_their_distance(spark):
    """A chain of second parents: each step counts, far beyond what is printed for not reached."""
    n = 1010
    edges = [(1, i, -i, 0) for i in range(1, n)] + [(1, i, i - 1, 1) for i in range(2, n)]
    edges += [(1, -i, None, 0) for i in range(1, n)]
    edges = spark.createDataFrame([e for e in edges if e[1] > n - 8 or e[1] < -(n - 8)], EDGE)
    heads = spark.createDataFrame([(1, "fork", n - 1)], HEAD)
    got = {r["sha"]: r["distance_fork"] for r in dag.head_distances(edges, heads).collect()}
    assert got[n - 1] == 0 and got[n - 7] == 6
    far = spark.createDataFrame([(1500, 1200), (None, 1200), (1200, None)], "a int, b int")
    named = far.select(classify.category_of(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in named] == ["U2F", "only_U", "only_F"]


def test_branches_of_forks_without_a_date(spark):
    branches = spark.createDataFrame(
        [(1, "a", "x", "1970-01-02"), (2, "a", "y", "2020-01-02"), (2, "b", "z", "1990-01-02")],
        "pair_id int, branch string, sha string, head_at string",
    ).withColumn("head_at", F.to_timestamp("head_at"))
    known = spark.createDataFrame([(2, "2021-01-01")], "pair_id int, forked_at string").withColumn(
        "forked_at", F.to_timestamp("forked_at")
    )
    assert {r["sha"] for r in filters.stale_branches(branches, known).collect()} == {"x", "y", "z"}


def test_commits_without_a_date_keep_their_category(spark):
    classified = spark.createDataFrame([(1, "a", "only_F"), (1, "b", "only_F")], "pair_id int, sha string, category string")
    dates = spark.createDataFrame([(1, "a", "2019-01-01")], "pair_id int, sha string, d string").select(
        "pair_id", "sha", F.to_timestamp("d").alias("committed_at")
    )
    forked = spark.createDataFrame([(1, "2020-01-01")], "pair_id int, d string").select(
        "pair_id", F.to_date("d").alias("forked_on")
    )
    got = {r["sha"]: r["category"] for r in classify.override_by_date(classified, dates, forked).collect()}
    assert got == {"a": "before", "b": "only_F"}


def test_threads_of_two_projects(spark):
    rows = [(p, 7, i, f"u{p}{i}", e, None, "x") for p in (1, 2) for i, e in enumerate(["commented", "closed", "commented"][: 1 + p])]
    events = spark.createDataFrame(
        rows, "project_id int, thread_id int, event_pos int, actor_id string, event string, sha string, body string"
    )
    got = {r["project_id"]: r for r in windows.comments_around_close(events).collect()}
    assert (got[1]["comments_total"], got[2]["comments_total"], got[2]["comments_after"]) == (1, 2, 1)
    assert {r["closer_id"] for r in windows.last_closer(events).collect()} == {"u11", "u21"}


def test_a_commit_of_another_project_is_no_merge(spark):
    mention = "landed as 1234567 thanks"
    events = spark.createDataFrame(
        [(p, 7, 0, "u", "commented", None, mention) for p in (1, 2)]
        + [(p, 7, 1, "u", "committed", "1234567aa", None) for p in (1, 2)],
        "project_id int, thread_id int, event_pos int, actor_id string, event string, sha string, body string",
    )
    known = spark.createDataFrame([(1, "1234567aa")], "project_id int, sha string")
    got = {r["project_id"]: r["verdict"] for r in merge_status.merge_verdicts(events, known).collect()}
    assert got[1] == "merged-5" and got[2] != "merged-5"
    assert [r["project_id"] for r in merge_status.merged_by_own_commits(events, known).collect()] == [1]


def test_large_requests_are_mapped(spark):
    path = "/x/get_pr_commits.a.b_5.csv"
    raw = spark.createDataFrame(
        [(path, f"{i:040x}", "l", "e", "n", "2020") for i in range(60)],
        "path string, sha string, login string, email string, author_name string, created_at string",
    )
    assert exports.pr_commits(raw)[1].count() == 60
    assert exports.pr_commits(raw, exports.PUBLISHED_MAX_COMMITS)[1].count() == 0


def test_links_of_any_length(spark):
    df = spark.createDataFrame([("#7 and #100000, #12 #0 #99999999999999999999",)], "t string")
    both = df.select(text.issue_links(F.col("t")).alias("a"), text.issue_links(F.col("t"), published=True).alias("b"))
    assert [sorted(x) for x in both.first()] == [[7, 12, 100000], [12]]


def test_empty_word_list(spark):
    got = spark.createDataFrame([("a",)], "t string").select(
        text.ends_with_any(F.col("t"), []).alias("a"), text.contains_any(F.col("t"), []).alias("b")
    )
    assert tuple(got.first()) == (False, False)


def test_the_least_row_of_a_key_is_inserted(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 9), (2, "c", 3)], "k int, x string, y int")
    none = rows.limit(0)
    assert {tuple(r) for r in sinks.new_rows(rows.repartition(3), none, ["k"]).collect()} == {(1, "a", 9), (2, "c", 3)}


def test_a_new_checkpoint_keeps_what_is_there(spark, tmp_path):
    from forklore.streaming import ingest

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for turn, rows in enumerate([[(1, "a"), (1, "b")], [(1, "z"), (2, "c")], [(3, "d")]]):
        batch = spark.createDataFrame(rows, "k int, x string")
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        ingest.insert_new(stream, out, f"{tmp_path}/marks{turn // 2}", ["k"])
    got = {tuple(r) for r in spark.read.parquet(out).select("k", "x").collect()}
    assert got == {(1, "a"), (2, "c"), (3, "d")}


def test_a_hit_without_a_link_takes_no_other(spark):
    from forklore.sources.documents import search_hits

    html = (
        "<ul><li class='hit'><div>no link<br></div></li><li><a href='x'>else</a></li>"
        "<li class='hit'><p><a href='y'>one</a><a href='z'>two</a></p></li></ul>"
    )
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [r["name"] for r in search_hits(df, item_class="hit").collect()] == ["one"]


def test_grouped_medians(spark):
    rows = [(k % 3, float(v) if v % 7 else None, v % 4) for k, v in zip(range(90), range(5, 95), strict=True)]
    df = spark.createDataFrame([*rows, (9, None, 1)], "k int, v double, w int")
    want = {r["k"]: (r["v"], r["w"]) for r in df.groupBy("k").agg(F.median("v").alias("v"), F.median("w").alias("w")).collect()}
    got = {r["k"]: (r["a"], r["b"]) for r in grouped_medians(df, ["k"], {"a": "v", "b": "w"}).collect()}
    assert got == want


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
