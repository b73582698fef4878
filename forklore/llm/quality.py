"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (3, 4, 5)
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 200_000
#: Weight of the vector that stands for any word pair of one word twice; a word has about as many subwords.
_TWICE = 8


def subwords(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of every subword: the words themselves and their 3- to 5-grams of code points.

    A word stands between ``<`` and ``>``. Buckets are the top ``bits`` bits of a polynomial hash.
    """
    marked = "<" + "><".join(words) + ">"
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    shift = np.uint64(64 - bits)
    at = np.arange(len(codes)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, _PRIME))
    whole = np.add.reduceat((codes + np.uint64(1)) * powers[at], starts)
    buckets, owners = [((whole ^ (whole >> np.uint64(29))) * _MIX) >> shift], [np.arange(len(words))]
    rolled = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * _PRIME + codes[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(rolled)] == owner[n - 1 :]
            found = rolled[inside] + np.uint64(n)
            buckets.append(((found ^ (found >> np.uint64(29))) * _MIX) >> shift)
            owners.append(owner[: len(rolled)][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """``pull[b]``: what bucket b adds to the log-odds, being its vector times the softmax difference.

    The last bucket is the word pair of one word twice.
    """

    pull: np.ndarray
    bias: float
    bits: int

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        """Probability of label 1 of each text: the softmax of the mean vector. A text without words has the bias only."""
        owners, words, sums, counts = [], [], [], []
        n = 0

        def flush():
            if not words:
                return
            index: defaultdict = defaultdict()
            index.default_factory = index.__len__
            which = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            bucket, word = subwords(list(index), self.bits)
            pulls = np.bincount(word, self.pull[bucket], len(index))
            grams = np.bincount(word, minlength=len(index))
            doc = np.repeat([d for d, _ in owners], [k for _, k in owners])
            low = owners[0][0]
            twice = np.append(False, (which[1:] == which[:-1]) & (doc[1:] == doc[:-1])) * _TWICE
            sums.append((
                low,
                np.bincount(doc - low, pulls[which] + twice * self.pull[-1]),
                np.bincount(doc - low, grams[which] + twice),
            ))
            owners.clear()
            words.clear()

        for text in texts:
            split = text.split() if text else []
            for start in range(0, len(split), _SLICE):
                some = split[start : start + _SLICE]
                owners.append((n, len(some)))
                words.extend(some)
                if len(words) >= _SLICE:
                    flush()
            n += 1
        flush()
        total, counts = np.zeros(n), np.zeros(n)
        for low, pulls, grams in sums:
            total[low : low + len(pulls)] += pulls
            counts[low : low + len(grams)] += grams
        odds = total / np.maximum(counts, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def train(
    texts: list[str | None],
    labels: list[int],
    bits: int = 18,
    dim: int = 8,
    epochs: int = 6,
    rate: float = 0.5,
    batch: int = 16,
    seed: int = 11,
) -> Model:
    """Stochastic gradient descent on the mean subword vectors and a softmax of two labels.

    The rarer label weighs as much as the other in sum. The step falls linearly to zero. Without
    both labels every score is the share of label 1 (one half without rows).
    """
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros((1 << bits) + 1, np.float32), float(np.log(share / (1 - share))), bits)
    docs = []
    for text in texts:
        words = (text or "").split()
        seen = Counter(words)
        if not seen:
            docs.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        bucket, word = subwords(list(seen), bits)
        weight = np.fromiter(seen.values(), np.float64, len(seen))[word]
        used, place = np.unique(bucket, return_inverse=True)
        summed = np.bincount(place, weight)
        twice = sum(map(str.__eq__, words, words[1:]))
        if twice:
            used, summed = np.append(used, 1 << bits), np.append(summed, _TWICE * twice)
        docs.append((used.astype(np.int32), (summed / summed.sum()).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random(((1 << bits) + 1, dim)) - 0.5) / dim).astype(np.float32)
    soft, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    balance = len(y) / (2.0 * np.bincount(y, minlength=2))
    steps, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            some = order[start : start + batch]
            sizes = [len(docs[i][0]) for i in some]
            ids = np.concatenate([docs[i][0] for i in some])
            share = np.concatenate([docs[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            now = rate * (1 - step / steps)
            step += 1
            rows = vectors[ids]
            mean = np.stack([np.bincount(owner, share * rows[:, k], len(some)) for k in range(dim)], 1)
            odds = mean @ soft.T + bias
            odds -= odds.max(1, keepdims=True)
            p = np.exp(odds)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= balance[y[some]][:, None]
            back = p @ soft
            soft -= (now * p.T @ mean).astype(np.float32)
            bias -= (now / len(some) * p.sum(0)).astype(np.float32)
            # a bucket's own step is scaled up by the usual number of buckets in a document
            scale = np.float32(now) * np.sqrt(np.maximum(sizes, 1))[owner] * share
            np.subtract.at(vectors, ids, (scale[:, None] * back[owner]).astype(np.float32))
    toward = soft[1] - soft[0]
    return Model((vectors @ toward).astype(np.float32), float(bias[1] - bias[0]), bits)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_chars: int = 50_000, **options) -> Model:
    """Train on at most ``max_docs`` labelled documents of at most ``max_chars`` characters, picked by hash.

    Labels of held-out rows and null labels are not used. The picked ids are a table of bounded size,
    so the documents are scanned once and not shuffled.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    each = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    picked = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    text = F.when(F.char_length("text") <= max_chars, F.col("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    met = slim.where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    rows = met.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [int(r["quality"]) for r in rows], **options)


def score_column(docs: DataFrame, model: Model) -> Column:
    """A column expression: the score of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return score(F.col("text"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; whole texts are read.

    Null and empty texts get the score of the bias. Rows without a doc_id are held out. Repeated rows
    are scored alike. An empty table gives an empty result; without usable labels the score is one half.
    """
    model = fit(docs, labels, **options)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    model = fit(docs, labels, **options)
    rows = docs.select(F.struct("*").alias("row"), score_column(docs, model).alias("score"))
    return rows.where(F.col("score") >= threshold).select("row.*")
