"""Operators whose rows moved must not outgrow their input."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from forklore.catalog.views import Tables
from forklore.operators import search, sets
from forklore.plans import links
from forklore.session import shared_dir


def test_contained_branches_across_tiles_equals_brute_force(spark):
    rng = random.Random(5)
    masks = {i: rng.randrange(1, 1 << 14) for i in range(5000)}
    rows = [(1, f"b{i:05}", c) for i, m in masks.items() for c in range(14) if m >> c & 1]
    rows += [(2, "x", 1), (2, "x", 2), (2, "y", 1), (2, "z", None), (2, None, 1), (None, "n", 1), (None, "o", 1)]
    want = {(2, "y")}
    present, last = set(masks.values()), {}
    for i, m in masks.items():
        last[m] = max(last.get(m, -1), i)
    above = {m for m in present if any(m | 1 << c in present for c in range(14) if not m >> c & 1)}
    above |= {m for m in present - above if any(m & o == m and m != o for o in present)}
    want |= {(1, f"b{i:05}") for i, m in masks.items() if m in above or i != last[m]}
    got = sets.contained_branches(spark.createDataFrame(rows, "repo_id long, branch string, sha long"))
    assert {tuple(r) for r in got.collect()} == want


def test_contained_branches_form_no_bitmap_per_member(spark, tmp_path):
    """Commits that two branches hold moved a bitmap each, of some kilobytes."""
    rows = spark.range(30_000).select(
        F.lit(1).alias("repo_id"), F.col("id").alias("_no"), F.expr("id div 2").alias("sha")
    )
    held = sets._held_by(rows, "repo_id", sets._OUTER)
    kept = held.agg(F.sum(F.coalesce(F.length("_bits"), F.lit(0)) + F.coalesce(F.size("_few") * 2, F.lit(0)))).first()[0]
    assert held.count() == 15_000 and kept < 100_000


def test_depths_write_each_commit_a_fixed_number_of_times(spark):
    n = 4_000
    line = spark.range(n).select(
        F.lit(1).alias("pair_id"), F.col("id").alias("sha"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("parent_pos"),
    )
    folder = shared_dir(spark)
    before = set(glob.glob(f"{folder}/*/*.parquet"))
    got = search.depths(line, 100)
    assert {(r.sha, r.depth) for r in got.collect()} == {(i, i) for i in range(n)}
    written = sum(pq.read_metadata(f).num_rows for f in set(glob.glob(f"{folder}/*/*.parquet")) - before)
    assert written < 8 * n


def test_depths_of_many_roots_and_parents_outside_the_graph(spark):
    rng = random.Random(3)
    up = {i: (rng.randrange(max(0, i - 9), i) if i and rng.random() > 0.2 else rng.choice([None, -i - 1])) for i in range(600)}
    want: dict = {}
    for i, parent in up.items():
        want[i] = want[parent] + 1 if parent in want else 0
    edges = spark.createDataFrame([(1, i, p, 0) for i, p in up.items()], "pair_id int, sha long, parent long, parent_pos int")
    assert {(r.sha, r.depth) for r in search.depths(edges, 40).collect()} == set(want.items())


def test_linked_texts_are_dealt_by_rows(spark, sf_dir):
    """By bytes a task got millions of rows, as those of a shuffle are small."""
    t = Tables(spark, sf_dir)
    n = t.lineitem.count()
    dealt = t.spread("lineitem", "l_orderkey", 500)
    assert dealt.lineitem.rdd.getNumPartitions() == -(-n // 500) and dealt.lineitem.count() == n
    plain = links.pr_issue_links(t.issue, t.pr_comment)
    got = links.pr_issue_links(dealt.issue, dealt.pr_comment, parts=7)
    sizes = links.text_links(dealt.pr_comment, 7).groupBy(F.spark_partition_id()).count().count()
    assert sizes == 7 and sorted(got.collect()) == sorted(plain.collect()) and got.count() > 0
