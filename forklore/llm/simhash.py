"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

Fingerprints that differ in few bits are linked. Equal fingerprints are one node. A
vantage-point tree is fitted on a bounded sample of the distinct fingerprints: each node
keeps the fingerprints within a radius of its vantage on one side. Every fingerprint is
sent to its leaf, and, where the triangle inequality cannot rule out a partner, to the leaves beyond the
boundaries it is close to. A leaf is a shard; crowded shards are cut into blocks that
meet in pairs of blocks. Inside, fingerprints stand in rings around a vantage of their own, and only
rings that are close enough are compared, so every pair is found exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forklore.llm.common import hashed_sample, in_blocks, row_digest, shuffle_partitions
from forklore.llm.components import connected_components
from forklore.session import materialize, materialize_counted

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; zero without words.

    A-Z are lower-cased; words are runs of characters other than space and U+0009 to U+000D (which is how
    bytes are split). A shingle is ``width`` words joined by a space, or all words if fewer.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    total = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, total)
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        octets = hashes[start : start + _CHUNK].view(np.uint8).reshape(-1, 8)
        for b in range(8):
            seen = np.bincount(octets[:, b], minlength=256)
            counts[8 * b : 8 * b + 8] += seen @ _BITS
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, columns: list[Column], width: int) -> DataFrame:
    """``columns`` and ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.select(*columns, fp(F.col("text")).alias("fp"))


class VantageTree:
    """A tree over 64-bit fingerprints: arrays of vantage, radius and children; leaves are numbered in order."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.child: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._rng = np.random.default_rng(seed)
        self._grow(np.asarray(sample, np.uint64), max(1, len(sample) // max(1, leaves)))

    def _grow(self, points: np.ndarray, least: int) -> int:
        at = len(self.leaf)
        self.vantage.append(0)
        self.radius.append(-1)
        self.child.append([-1, -1])
        self.leaf.append(-1)
        if len(points) >= 2 * least and len(points) > 1:
            for vantage in self._rng.choice(points, min(4, len(points)), replace=False):
                far = np.bitwise_count(points ^ vantage)
                radius = int(np.median(far))
                inside = far <= radius
                if 4 * inside.sum() <= 3 * len(points):
                    self.vantage[at], self.radius[at] = int(vantage), radius
                    self.child[at][0] = self._grow(points[inside], least)
                    self.child[at][1] = self._grow(points[~inside], least)
                    return at
        self.leaf[at] = self.leaves
        self.leaves += 1
        return at

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, is_home): each point's own leaf, and later leaves that may hold points within ``reach``.

        Two points within ``reach`` meet in the home leaf of the one with the later leaf.
        """
        found = []
        todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            at, who, home = todo.pop()
            if not len(who):
                continue
            if self.leaf[at] >= 0:
                found.append((who, np.full(len(who), self.leaf[at]), home))
                continue
            far = np.bitwise_count(points[who] ^ np.uint64(self.vantage[at])).astype(np.int16)
            radius = self.radius[at]
            left, right = self.child[at]
            inside = far <= radius
            # a visitor goes wherever a partner may be; a point at home visits only what comes later
            into = inside | (~home & (far <= radius + reach))
            todo.append((left, who[into], home[into]))
            out = ~inside | (far > radius - reach)
            todo.append((right, who[out], (home & ~inside)[out]))
        who, leaf, home = (np.concatenate(x) for x in zip(*found, strict=True))
        return who, leaf, home


def settle(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def ring_links(points: np.ndarray, home: np.ndarray, mate: np.ndarray, reach: int, block: int = 512, inner: bool = True):
    """(node, least node) of the components among ``points`` within ``reach`` bits.

    Compares ``home`` with ``mate`` (both masks), and with itself if ``inner``. Rings around a vantage: only those at most ``reach``
    apart can hold partners. Links are folded into stars as they come, so memory
    follows the number of points and not of pairs.
    """
    held = np.flatnonzero(home)
    if not len(held):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    vantage = points[held[0]]
    ring = np.bitwise_count(points[held] ^ vantage).astype(np.int64)
    order = np.argsort(ring, kind="stable")
    held, ring = held[order], ring[order]
    values = points[held]
    ask = np.flatnonzero(home | mate if inner else mate)
    if not len(ask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    around = np.bitwise_count(points[ask] ^ vantage).astype(np.int64)
    order = np.argsort(around, kind="stable")
    ask, around = ask[order], around[order]
    us, vs, waiting = [], [], 0
    for start in range(0, len(ask), block):
        some = ask[start : start + block]
        lo = np.searchsorted(ring, around[start] - reach, "left")
        hi = np.searchsorted(ring, around[start + len(some) - 1] + reach, "right")
        close = np.bitwise_count(points[some][:, None] ^ values[None, lo:hi]) <= reach
        a, b = np.nonzero(close)
        a, b = some[a], held[lo + b]
        other = a != b
        us.append(a[other])
        vs.append(b[other])
        waiting += int(other.sum())
        if waiting > 2_000_000:
            us, vs = _fold(us, vs, len(points))
            waiting = len(us[0])
    us, vs = _fold(us, vs, len(points))
    return us[0], vs[0]


def _fold(us: list[np.ndarray], vs: list[np.ndarray], n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    label = settle(np.concatenate(us), np.concatenate(vs), n)
    node = np.flatnonzero(label != np.arange(n))
    return [node], [label[node]]


def fingerprint_links(
    distinct: DataFrame, total: int, reach: int = 3, leaf: int = 16_384, sample: int = 1 << 17, crowd: int = 100_000
) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (``fp``) within ``reach`` bits of another.

    ``total`` is the number of rows. The tree is fitted on at most about ``sample`` fingerprints,
    picked by hash. Shards with more than ``crowd`` fingerprints are cut into blocks, of which a task holds two.
    """
    spark = distinct.sparkSession
    picked = hashed_sample(distinct.select("fp"), F.col("fp"), total, sample)
    rows = np.array([r[0] for r in picked.sort("fp").collect()], np.int64).view(np.uint64)
    tree = VantageTree(rows, max(1, total // leaf))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy().view(np.uint64)
            who, shard, home = tree.route(points, reach)
            yield pd.DataFrame({"shard": shard, "home": home, "fp": points[who].view(np.int64)})

    dealt = distinct.select("fp").repartition(shuffle_partitions(spark)).mapInPandas(
        deal, "shard long, home boolean, fp long"
    )
    dealt = materialize(dealt, "shards")
    dealt = in_blocks(dealt, "shard", F.xxhash64("fp"), crowd)

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        points = shard["fp"].to_numpy().view(np.uint64)
        home = shard["home"].to_numpy()
        node, least = ring_links(points, home, ~home, reach, inner=bool(shard["inner"].iloc[0]))
        signed = points.view(np.int64)
        return pd.DataFrame({"u": signed[node], "v": signed[least]})

    return dealt.groupBy("shard", "block").applyInPandas(link, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, reach: int = 3, **options) -> DataFrame:
    """``doc_id, fp, component_id`` (least doc_id reachable), ``root`` (its least fingerprint) and the row's digest ``d1, d2``.

    Two documents are linked if their fingerprints differ in at most ``reach`` bits. Texts that are null,
    empty or blank have fingerprint zero and are linked like any other. Rows may repeat; a null doc_id is
    never the least unless a component has no other. An empty table gives an empty result.
    """
    d1, d2 = row_digest(docs)
    each = with_fingerprint(
        docs, [F.col("doc_id").cast("long").alias("doc_id"), d1.alias("d1"), d2.alias("d2")], width
    )
    each = materialize(each, "fingerprints")
    distinct, total = materialize_counted(
        each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", None
    )
    links = fingerprint_links(distinct, total, reach, **options)
    roots = connected_components(links)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return each.join(named, "fp").select("doc_id", "fp", "component_id", "root", "d1", "d2")


def keep_one(docs: DataFrame, width: int = 3, reach: int = 3, **options) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of each group of near duplicates, one row per group."""
    found = near_duplicates(docs, width, reach, **options)
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "d1", "d2")).alias("first")
    )
    first = first.select("first.d1", "first.d2")
    d1, d2 = row_digest(docs)
    rows = docs.select(F.struct("*").alias("row"), d1.alias("d1"), d2.alias("d2"))
    return rows.join(first, ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select("row.*")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
