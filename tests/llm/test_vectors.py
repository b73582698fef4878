"""Search and near-duplicates of vectors, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forklore.llm import ann, multiindex
from forklore.llm.common import in_blocks
from forklore.llm.simhash import settle

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n long, shard int"


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, 0, "v", 1, 2) for i, v in pairs], SCHEMA)


@pytest.fixture(scope="module")
def pairs():
    """Clusters, equal vectors, one crowded group, scaled copies and vectors that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [c + rng.normal(size=16) * 0.6 for c in centres for _ in range(50)]
    rows += [centres[0] + rng.normal(size=16) * 0.02 for _ in range(200)]
    rows += [centres[1] * 2] * 30 + [centres[1] * 5] * 5
    rows = [r.astype(np.float32).tolist() for r in rows]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], []]
    return list(enumerate(rows)) + [(2000 + i, b) for i, b in enumerate(bad)]


@pytest.mark.parametrize("options", [{}, {"rows_a_shard": 40, "queries_a_block": 10, "rows_a_bucket": 20}])
def test_search(spark, pairs, options):
    found = ann.search(frame(spark, pairs), every=5, k=10, sample=60, **options).toPandas()
    usable = [(i, np.array(v, float)) for i, v in pairs if i < 2000]
    ids, rows = np.array([i for i, _ in usable]), np.stack([v for _, v in usable])
    hits = total = 0
    for i, v in usable:
        if i % 5:
            continue
        scores = (rows * v).sum(1)
        order = [n for n in np.lexsort((ids, -scores)) if ids[n] != i][:10]
        mine = found[found["query_id"] == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1)) and len(mine) == 10
        assert np.allclose(mine["score"], [scores[np.flatnonzero(ids == n)[0]] for n in mine["vec_id"]])
        assert (np.diff(mine["score"]) <= 1e-12).all()
        hits += len(set(mine["vec_id"]) & set(ids[order].tolist()))
        total += 10
    assert hits >= 0.9 * total
    assert set(found["query_id"]) == {i for i, _ in usable if i % 5 == 0}


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)]
    got = ann.search(frame(spark, rows), every=20, k=5, rows_a_shard=7).toPandas().sort_values(["query_id", "rank"])
    assert got[got["query_id"] == 0]["vec_id"].tolist() == [1, 2, 3, 4, 5]
    assert got[got["query_id"] == 20]["vec_id"].tolist() == [0, 1, 2, 3, 4]


def test_search_of_few_rows(spark):
    assert ann.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [(0, [1.0, 0.0])])).count() == 0
    assert ann.search(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None)])).count() == 1


@pytest.mark.parametrize("n", [3, 10, 21, 30])
def test_every_query_gets_all_there_are(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
    got = ann.search(frame(spark, rows), every=2, rows_a_bucket=1, tables=1, recall=0.5, sample=3).toPandas()
    by = np.stack([v for _, v in rows])
    for i in range(0, n, 2):
        mine = got[got["query_id"] == i].sort_values("rank")
        order = [j for j in np.argsort(-(by * by[i]).sum(1), kind="stable") if j != i][:20]
        assert len(mine) == min(20, n - 1) and (n > 21 or mine["vec_id"].tolist() == order)


def test_vectors_of_mixed_length_get_full_results(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * 10.0 ** rng.integers(-3, 3)).tolist()) for i in range(600)]
    got = ann.search(frame(spark, rows), recall=0.5, rows_a_bucket=20, rows_a_shard=100, queries_a_block=4).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == 30


def test_groups_hold_two_blocks(spark):
    rows = spark.range(4000).selectExpr("id % 2 shard", "id % 3 > 0 or id % 2 = 1 home", "id")
    got = in_blocks(rows, "shard", F.xxhash64("id"), 300)
    assert got.groupBy("shard", "block").count().agg({"count": "max"}).first()[0] <= 2 * 1.2 * 300
    pairs = got.alias("a").join(got.alias("b"), ["shard", "block"]).where(
        "a.home and (not b.home or a.inner and a.id < b.id)"
    ).select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))
    met = rows.alias("a").join(rows.alias("b"), "shard").where("a.home and (not b.home or a.id < b.id)")
    assert pairs.count() == pairs.distinct().count() == met.count()


@pytest.mark.parametrize("options", [{}, {"rows_a_cell": 8, "crowd": 30}])
def test_near_duplicates(spark, pairs, options):
    got = multiindex.near_duplicates(frame(spark, pairs), **options).toPandas().sort_values("vec_id")
    assert len(got) == len(pairs)
    rows = np.stack([np.array(v, float) for i, v in pairs if i < 2000])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    n = len(rows)
    assert got["n_links"].sum() >= 0.99 * linked.sum()
    assert (got["n_links"].to_numpy()[:n] <= linked.sum(1)).all()
    want = settle(*np.nonzero(linked), n)
    assert (got["component_id"].to_numpy()[:n] == want).mean() >= 0.99
    rest = got.iloc[n:]
    assert (rest["n_links"] == 0).all() and (rest["component_id"] == rest["vec_id"]).all() and rest["kept"].all()
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_near_duplicates_of_few_rows(spark):
    assert multiindex.near_duplicates(frame(spark, [])).count() == 0
    none = multiindex.near_duplicates(frame(spark, [(1, None), (None, [1.0, 1.0])])).collect()
    assert sorted((r["vec_id"] is None, r["n_links"]) for r in none) == [(False, 0), (True, 0)]
    twice = multiindex.near_duplicates(frame(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in twice.collect()) == [
        (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)
    ]
    got = multiindex.near_duplicates(frame(spark, [(3, [1.0, 1.0]), (4, [2.0, 2.0]), (3, [1.0, 1.0])])).collect()
    assert all(r["n_links"] == 2 and r["component_id"] == 3 for r in got)
