"""Nearest neighbours by inner product with multiprobe p-stable hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forklore.llm.common import hashed_sample, vectors
from forklore.session import materialize, materialize_counted

_TIE = 1e-9


@dataclass
class StableHash:
    """``tables`` hash tables of Gaussian projections cut into slots of ``width``.

    Largest inner product is made nearest distance by one more component, which lifts every row to the
    length of the longest; queries have zero there.
    """

    projections: np.ndarray
    shifts: np.ndarray
    width: float
    longest: float
    probes: int = 1

    @classmethod
    def make(cls, dim: int, longest: float, tables: int, hashes: int, width: float, seed: int = 5) -> StableHash:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(size=(tables, dim + 1, hashes)),
            rng.uniform(0, width * longest, size=(tables, hashes)),
            width * longest,
            longest,
        )

    def slots(self, rows: np.ndarray, lift: bool) -> np.ndarray:
        """(table, row, hash) slot positions, not rounded."""
        extra = np.zeros(len(rows))
        if lift:
            extra = np.sqrt(np.maximum(self.longest**2 - (rows**2).sum(1), 0))
        full = np.concatenate([rows, extra[:, None]], 1)
        return (np.einsum("nd,tdk->tnk", full, self.projections) + self.shifts[:, None, :]) / self.width

    @property
    def steps(self) -> np.ndarray:
        """All perturbations of a bucket: each slot one down, the same, or one up."""
        return np.array(list(product((-1, 0, 1), repeat=self.projections.shape[2])), np.int64)

    @staticmethod
    def key(slots: np.ndarray) -> np.ndarray:
        """One number per bucket."""
        mixed = np.zeros(slots.shape[:-1], np.uint64)
        for i in range(slots.shape[-1]):
            mixed = (mixed ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        return mixed.view(np.int64)

    def costs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own slots, cost of every perturbation): the sum of squared distances to the edges crossed.

        The likelihood that a near row lies in a bucket falls with this cost. Shape (table, query, ...).
        """
        at = self.slots(queries, lift=False)
        own = np.floor(at)
        inside = at - own
        down, up = inside**2, (1 - inside) ** 2
        steps = self.steps
        cost = down @ (steps == -1).T.astype(float) + up @ (steps == 1).T.astype(float)
        return own.astype(np.int64), cost

    def probe(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, (table, bucket) of the ``probes`` likeliest buckets over all tables, in order."""
        own, cost = self.costs(queries)
        tables, n, each = cost.shape
        steps, found = self.steps, []
        flat = cost.transpose(1, 0, 2).reshape(n, tables * each)
        for q in range(n):
            best = np.argsort(flat[q], kind="stable")[: self.probes]
            table, step = best // each, best % each
            found.append((table, self.key(own[table, q] + steps[step])))
        return found


def top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int):
    """(ids, scores) of the k rows of largest inner product, ties to smaller ids.

    ``scores`` come from a matrix product, whose last digits depend on its shape; what
    may be among the k is computed again, product by product.
    """
    near = np.flatnonzero(ids != own)
    if len(near) > k:
        floor = np.partition(scores[near], len(near) - k)[len(near) - k]
        near = near[scores[near] >= floor - _TIE * max(1.0, abs(floor))]
    exact = (rows[near] * query).sum(1)
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near][order], exact[order]


def _neighbours(base: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The true k nearest rows of a few queries, with their vectors; every batch of rows sends k at most."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, names = np.stack(batch["v"].to_numpy()), batch["vec_id"].to_numpy()
            scores, place, out = queries @ rows.T, {n: i for i, n in enumerate(names)}, []
            for i in range(len(queries)):
                got, score = top(scores[i], names, rows, queries[i], int(ids[i]), k)
                out += [(i, int(n), float(s), rows[place[n]]) for n, s in zip(got, score, strict=True)]
            yield pd.DataFrame(out, columns=["q", "vec_id", "score", "v"])

    every = base.mapInPandas(scan, "q int, vec_id long, score double, v array<double>")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).toPandas()


def fit(
    base: DataFrame, total: int, k: int, tables: int, recall: float, width: float, rows_a_bucket: int, sample: int
) -> StableHash | None:
    """Choose the number of hashes by the rows, and of probes by the recall of sampled queries against brute force."""
    if not total:
        return None
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = base.agg(F.max(norm)).first()[0]
    picked = hashed_sample(base, F.col("vec_id"), total, sample).toPandas()
    picked = picked.sort_values("vec_id").drop_duplicates("vec_id").head(2 * sample)
    if not len(picked):
        picked = base.orderBy("vec_id").limit(1).toPandas()
    queries = np.stack(picked["v"].to_numpy())
    slots = max(2.0, 4.0 / width)
    hashes = int(np.clip(round(np.log(max(2.0, total / rows_a_bucket)) / np.log(slots)), 2, 8))
    made = StableHash.make(queries.shape[1], longest, tables, hashes, width)
    near = _neighbours(base, queries, picked["vec_id"].to_numpy(), k)
    own, cost = made.costs(queries)
    each = cost.shape[2]
    ranks = []
    order = np.argsort(cost.transpose(1, 0, 2).reshape(len(queries), -1), axis=1, kind="stable")
    if len(near):
        at = np.floor(made.slots(np.stack(near["v"].to_numpy()), lift=True)).astype(np.int64)
        place = np.argsort(order, axis=1)
        for i, q in enumerate(near["q"]):
            step = at[:, i] - own[:, q]
            digit = (step + 1) @ (3 ** np.arange(hashes)[::-1])
            ok = (np.abs(step) <= 1).all(1)
            ranks.append(min([place[q, t * each + digit[t]] for t in np.flatnonzero(ok)], default=tables * each))
    ranks = np.sort(ranks) if ranks else np.zeros(1)
    made.probes = int(min(tables * each, ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1))
    return made


def search(
    rows: DataFrame,
    every: int = 20,
    k: int = 20,
    tables: int = 3,
    recall: float = 0.96,
    width: float = 2.0,
    rows_a_bucket: int = 512,
    sample: int = 100,
    rows_a_shard: int = 8192,
    queries_a_block: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose vec_id is divisible by ``every``.

    Every row is in every table. A shard holds buckets of one table, about ``rows_a_shard`` rows in all; a bucket with more
    is cut into parts that lie in different shards, and a query goes to all of them. A shard
    scores a block of queries at a time and sends each query's best k, as far as they can still be among the k of all. They are
    merged over shards and tables: rows found by several tables count once. A query that found fewer than k rows, though
    there are more, goes to all buckets of the first table, which holds every row; so each gets k, or all there are.
    Vectors that are null, zero or hold null or non-finite components, rows without a vec_id, and vectors of
    another length than most take no part. Rows that share a vec_id are one candidate, with its best score.
    An empty table gives an empty result.
    """
    base, total = materialize_counted(vectors(rows), "vectors", None)
    made = fit(base, total, k, tables, recall, width, rows_a_bucket, sample)
    out = "query_id long, vec_id long, score double"
    if made is None:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    candidates = base.agg(F.count_distinct("vec_id")).first()[0] - 1
    n_shards = max(1, -(-total // rows_a_shard))
    n_blocks = max(1, -(-total // every // queries_a_block))

    parts: dict[tuple[int, int], int] = {}

    def spot(bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        mixed = (bucket.view(np.uint64) ^ part.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(n_shards)).astype(np.int64)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.floor(made.slots(np.stack(batch["v"].to_numpy()), lift=True)).astype(np.int64)
            ids = batch["vec_id"].to_numpy()
            for t in range(tables):
                bucket = made.key(at[t])
                cut = np.array([parts.get((t, b), 1) for b in bucket.tolist()])
                part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cut
                yield pd.DataFrame(
                    {"tab": t, "shard": spot(bucket, part), "bucket": bucket, "vec_id": ids, "v": batch["v"]}
                )

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                found = made.probe(np.stack(part["v"].to_numpy()))
                rows = []
                for name, v, (table, bucket) in zip(part["vec_id"], part["v"], found, strict=True):
                    cut = np.array([parts.get(tb, 1) for tb in zip(table.tolist(), bucket.tolist(), strict=True)])
                    which = np.repeat(np.arange(len(cut)), cut)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)
                    shard = spot(bucket[which], nth)
                    for t, s in np.unique(np.stack([table[which], shard]), axis=1).T:
                        mine = which[(table[which] == t) & (shard == s)]
                        rows.append((int(t), int(s), name, v, np.unique(bucket[mine])))
                yield pd.DataFrame(rows, columns=["tab", "shard", "query_id", "q", "buckets"])

    deal = "tab int, shard long, bucket long, vec_id long, v array<double>"
    counts = base.mapInPandas(hashed, deal).groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.where(F.col("n") > rows_a_shard).collect()
    parts.update({(r["tab"], r["bucket"]): -(-r["n"] // rows_a_shard) for r in crowded})
    # waves of 1, 2, 4 ... shards: each sends only what beats the k-th score of the waves before
    index = F.col("tab") + tables * F.col("shard")
    wave = F.floor(F.log2(index + 1)).cast("int")
    waves = int(np.floor(np.log2(tables * n_shards))) + 1
    members = base.mapInPandas(hashed, deal).withColumn("wave", wave)
    members = materialize(members, "members", "wave")
    asked = base.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    wanted = asked.mapInPandas(probing, "tab int, shard long, query_id long, q array<double>, buckets array<long>")
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    wanted = materialize(wanted.withColumn("wave", wave), "wanted", "wave")

    def score(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asking):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        held = held.sort_values(["bucket", "vec_id"])
        rows, ids = np.stack(held["v"].to_numpy()), held["vec_id"].to_numpy()
        here, start = np.unique(held["bucket"].to_numpy(), return_index=True)
        sizes = np.diff(np.append(start, len(ids)))
        out = []
        bars = asking["bar"].to_numpy()
        for nth, (name, q, buckets) in enumerate(asking[["query_id", "q", "buckets"]].itertuples(index=False)):
            met = slice(None) if buckets is None else np.repeat(np.isin(here, buckets), sizes)
            some = rows[met]
            got, found = top(some @ q, ids[met], some, q, int(name), k)
            fair = found >= bars[nth]
            out.append((np.full(fair.sum(), name), got[fair], found[fair]))
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], map(np.concatenate, zip(*out)), strict=True)))

    keys = ["tab", "shard", "block"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(held: DataFrame, asking: DataFrame, kept: DataFrame | None) -> DataFrame:
        """``kept`` with what the asking rows find. Members go to the blocks of queries that ask their shard, and no others."""
        pairs = asking.select(*[F.col(c).alias(c) for c in keys]).distinct()
        here = held.join(pairs, ["tab", "shard"]).select(*keys, "bucket", "vec_id", "v").groupBy(*keys)
        asking = asking.select(*keys, "query_id", "q", "buckets", "bar").groupBy(*keys)
        found = here.cogroup(asking).applyInPandas(score, out)
        if kept is not None:
            found = found.unionByName(kept.select("query_id", "vec_id", "score"))
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return materialize(once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "nearest")

    none = F.lit(float("-inf"))
    kept = None
    for n in range(waves):
        now = wanted.where(F.col("wave") == n)
        if kept is None:
            now = now.withColumn("bar", none)
        else:
            bar = kept.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
            now = now.join(bar, "query_id", "left").fillna(float("-inf"), ["bar"])
        kept = met(members.where(F.col("wave") == n), now, kept)
    full = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, candidates))
    short = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(full, "query_id", "left_anti")
    short, lacking = materialize_counted(short, "short", None)
    if lacking and candidates:
        rest = short.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
        block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-lacking // queries_a_block)))).cast("int")
        rest = rest.select(
            F.lit(0).alias("tab"), "shard", block.alias("block"), "query_id", "q",
            F.lit(None).cast("array<long>").alias("buckets"), none.alias("bar"),
        )
        kept = met(members.where(F.col("tab") == 0), rest, kept)
    return kept.select("query_id", "rank", "vec_id", "score")
