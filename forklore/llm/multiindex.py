"""Near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.llm.common import hashed_sample, in_blocks, shuffle_partitions, vectors
from forklore.llm.components import connected_components
from forklore.llm.simhash import settle
from forklore.session import materialize, materialize_counted

_BINS = 256
_SPAN = 2.0


def codebook(points: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k centres by Lloyd's method, started on points of the sample."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


@dataclass
class MultiIndex:
    """One codebook for each half of a vector; their product is a grid of cells.

    ``reach``: a vector visits the cells whose two squared distances sum to at most this much more than
    those of its own cell. That is the multi-sequence order cut where the target recall is met.
    """

    left: np.ndarray
    right: np.ndarray
    reach: float = 0.0

    @classmethod
    def fit(cls, sample: np.ndarray, k: int) -> MultiIndex:
        points = unit(sample)
        cut = points.shape[1] // 2
        return cls(codebook(points[:, :cut], k), codebook(points[:, cut:], k, seed=4))

    def excess(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell, excess distance to each left centre, to each right centre)."""
        points, cut = unit(rows), self.left.shape[1]
        a, b = distances(points[:, :cut], self.left), distances(points[:, cut:], self.right)
        cell = a.argmin(1) * len(self.right) + b.argmin(1)
        return cell, a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)

    def traverse(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is_home): each row's own cell and the later cells within reach, nearest first in each half."""
        own, a, b = self.excess(rows)
        who, cells = [np.arange(len(rows))], [own]
        order_a, order_b = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        for r in range(len(rows)):
            near_a, near_b = a[r, order_a[r]], b[r, order_b[r]]
            depth = np.searchsorted(near_b, self.reach - near_a, "right")
            i = np.repeat(order_a[r], depth)
            j = order_b[r][np.arange(len(i)) - np.repeat(np.cumsum(depth) - depth, depth)]
            visit = i * len(self.right) + j
            visit = visit[visit > own[r]]
            who.append(np.full(len(visit), r))
            cells.append(visit)
        home = np.zeros(sum(map(len, who)), bool)
        home[: len(rows)] = True
        return np.concatenate(who), np.concatenate(cells), home


def _fit_reach(index: MultiIndex, base: DataFrame, sample: np.ndarray, least: float, recall: float) -> float:
    """The reach that finds ``recall`` of the true links of the sampled vectors, by brute force over all rows.

    Executors send histograms of the excess at which a link is met, so a vector with very many links costs no more.
    The reach is the larger of that for all links, and for links that count inversely to how many their vector has.
    """
    sample_unit = unit(sample)
    cell_s, a_s, b_s = index.excess(sample)
    width = len(index.right)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(sample), _BINS), np.int64)
        for batch in batches:
            rows = np.stack(batch["v"].to_numpy())
            cell, a, b = index.excess(rows)
            q, r = np.nonzero(sample_unit @ unit(rows).T >= least)
            # the one with the earlier cell visits the other
            visits = np.where(
                cell_s[q] < cell[r],
                a_s[q, cell[r] // width] + b_s[q, cell[r] % width],
                a[r, cell_s[q] // width] + b[r, cell_s[q] % width],
            )
            visits[cell_s[q] == cell[r]] = 0
            np.add.at(seen, (q, np.minimum(visits / _SPAN * _BINS, _BINS - 1).astype(int)), 1)
        q, bins = np.nonzero(seen)
        yield pd.DataFrame({"q": q, "bin": bins, "n": seen[q, bins]})

    rows = base.mapInPandas(scan, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((len(sample), _BINS))
    for q, at, n in rows:
        seen[q, at] = n
    seen[:, 0] -= 1  # a vector meets itself
    total = np.maximum(seen.sum(1, keepdims=True), 1)
    ends = []
    for weighed in (seen.sum(0), (seen / total).sum(0)):
        share = np.cumsum(weighed) / max(weighed.sum(), 1e-9)
        ends.append(int(np.argmax(share >= recall)) if weighed.sum() > 0 else _BINS // 8)
    return (max(ends) + 1) / _BINS * _SPAN


def near_duplicates(
    rows: DataFrame,
    least: float = 0.9,
    recall: float = 0.999,
    sample: int = 8192,
    probes: int = 512,
    rows_a_cell: int = 64,
    crowd: int = 8192,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Links join vectors of cosine ``least`` or more. Equal vectors are one node that counts as often as it
    occurs. The codebooks are fitted on at most about ``sample`` vectors, the reach on ``probes``. Each
    vector is at home in one cell and visits later cells within reach, where it is compared in
    double precision; so a pair meets once at most. Cells of more than ``crowd`` rows are cut into
    blocks, of which a task holds two. A cell sends counts and stars, not pairs.

    Vectors that are null, zero or hold null or non-finite components, or have another length than most,
    link with nothing: 0 links, own component, kept. So do rows without a vec_id (component null). Rows that
    repeat a vec_id are separate vectors, each with its own links and component. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    hashes = F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")
    base = materialize(vectors(rows).select("vec_id", "v", *hashes), "vectors")
    each = base.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    # numbers are written with the rows, so they stay what they are; vec_ids may repeat with unlike vectors
    nodes, total = materialize_counted(each.withColumn("node", F.monotonically_increasing_id()), "nodes", None)
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not total:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.lit(True).alias("kept"))
    picked = hashed_sample(nodes.select("rep", "h1", "v"), F.col("rep"), total, sample).toPandas().sort_values(["rep", "h1"])
    if not len(picked):
        picked = nodes.orderBy("rep", "h1").limit(1).select("rep", "v").toPandas()
    points = np.stack(picked["v"].to_numpy())
    if points.shape[1] < 2:
        index = MultiIndex(np.zeros((1, 0)), np.zeros((1, points.shape[1])))
    else:
        index = MultiIndex.fit(points, int(np.clip(np.sqrt(total / rows_a_cell), 1, 1024)))
        trial = hashed_sample(nodes, F.xxhash64("rep"), total, probes).select("rep", "h1", "v").toPandas()
        trial = trial.sort_values(["rep", "h1"])
        trial = np.stack(trial["v"].to_numpy()) if len(trial) else points[:probes]
        index.reach = _fit_reach(index, nodes.select("v"), trial, least, recall)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                who, cell, home = index.traverse(np.stack(part["v"].to_numpy()))
                yield pd.DataFrame({
                    "shard": cell, "home": home, "node": part["node"].to_numpy()[who], "n": part["n"].to_numpy()[who],
                    "v": part["v"].to_numpy()[who],
                })

    nodes_dealt = nodes.select("node", "n", "v").repartition(shuffle_partitions(spark), "node")
    dealt = nodes_dealt.mapInPandas(deal, "shard long, home boolean, node long, n long, v array<double>")
    dealt = in_blocks(materialize(dealt, "cells"), "shard", F.xxhash64("node"), crowd)

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["home", "node"], ascending=[False, True])
        held, inner = int(cell["home"].sum()), bool(cell["inner"].iloc[0])
        rows, weight = np.stack(cell["v"].to_numpy()), cell["n"].to_numpy()
        # scaled first, so that no square overflows
        rows = rows / np.abs(rows).max(1, keepdims=True)
        norms = np.sqrt((rows**2).sum(1))
        links = np.zeros(len(rows), np.int64)
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start in range(0 if inner else held, len(rows), 1024):
            some = slice(start, min(start + 1024, len(rows)))
            cosine = rows[some] @ rows[:held].T / (norms[some, None] * norms[None, :held])
            a, b = np.nonzero(cosine >= least)
            a = a + start
            once = b < a
            a, b = a[once], b[once]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            label = settle(np.concatenate([*us, a]), np.concatenate([*vs, b]), len(rows))
            u = np.flatnonzero(label != np.arange(len(rows)))
            us, vs = [u], [label[u]]
        root = np.arange(len(rows))
        root[us[0]] = vs[0]
        met = np.flatnonzero(links)
        node = cell["node"].to_numpy()
        return pd.DataFrame({"u": node[met], "v": node[root[met]], "links": links[met]})

    found = dealt.groupBy("shard", "block").applyInPandas(compare, "u long, v long, links long")
    found = materialize(found, "cell_links")
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("u", "v"))
    named = nodes.select("h1", "h2", "node", "rep", "n").join(counts, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    linked = base.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    slim = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    used = base.select("vec_id", "h1", "h2").distinct().select("vec_id", "h1", "h2", F.lit(True).alias("used"))
    rest = slim.select("vec_id", *hashes).join(used, ["vec_id", "h1", "h2"], "left_anti").select("vec_id")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
