"""Packing documents into sequences: length patterns by non-negative least squares, best fit for the rest.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver, where the plan is
made: groups of equally filled sequences, each a list of (length, how many) with a count. Pieces are
ranked within their length on the executors and look their place up in the plan, whose size
depends on the number of lengths and not on the number of documents.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forklore.session import materialize

END = (1).to_bytes(4, "little")
_CACHE_WORDS = 800_000
#: A stop or comma after a plain letter or digit (ASCII, Latin, Greek, Cyrillic): one that normalization leaves a single letter.
#: The capital dotted I is none, as it gains a combining mark in lower case.
_STOP = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-įı-ſΑ-ΡΣ-ωЀ-ҁҊ-ԯ])[.,](?=[ \n]|$)")
_SPECIAL = "<|"
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins what it parts, and plain letters and digits part from
    the stop or comma after them. So a text's ids are those of its words, stops and commas between spaces and line feeds, one
    after the other. Words repeat: their ids are kept in two stores; when the newer is full it
    becomes the older, and what is still in use moves on. Literals of special tokens have their special ids, as the
    tokenizer gives them by itself; they are case-sensitive, so texts that may hold one keep their case here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self, new: set[str]) -> None:
        need = []
        for word in new:
            if (ids := self.older.get(word)) is None:
                need.append(word)
            else:
                self.known[word] = ids
        found = self.tokenizer.encode_batch_fast(need, add_special_tokens=False)
        for word, e in zip(need, found, strict=True):
            self.known[word] = struct.pack(f"<{len(e)}I", *e.ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        cased = text if _SPECIAL in text else text.encode().lower().decode()
        words = _STOP.sub(r" \g<0>", cased).replace("\n", " ").split(" ")
        if len(self.known) > _CACHE_WORDS:
            self.known, self.older = {}, self.known
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(set(words).difference(self.known))
            return b"".join(map(self.known.__getitem__, words))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """The pieces of every document; ``nth`` counts pieces of equal length within ``part``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text) + END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(some) // 4, zlib.crc32(some), part, 0))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["nth"] = out.groupby("length").cumcount().to_numpy() + seen[out["length"].to_numpy()]
            seen += np.bincount(out["length"], minlength=capacity + 1)
            yield out

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInPandas(cut, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 with least |ax - b|: active sets, at most ``rounds`` entries entering."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        enters = int(np.argmax(slope))
        if slope[enters] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[enters] = True
        while True:
            z = np.zeros_like(x)
            some = a[:, active]
            z[active] = np.linalg.solve(some.T @ some + 1e-9 * np.eye(some.shape[1]), some.T @ b)
            low = active & (z <= 0)
            if not low.any():
                break
            gap = x[low] - z[low]
            step = float(np.min(np.where(gap > 0, x[low] / np.where(gap > 0, gap, 1), 0)))
            x += step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
        x = z if active.any() else np.zeros_like(x)
    return x


@dataclass
class Group:
    """``count`` sequences, each holding ``slots`` (length, how many) in this order."""

    count: int
    slots: tuple[tuple[int, int], ...] = ()
    used: int = 0


@dataclass
class Plan:
    capacity: int
    groups: list[Group] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(g.count for g in self.groups)

    def table(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, how many in a sequence, offset), sorted by length and rank."""
        rows, rank, base = [], dict[int, int](), 0
        for g in self.groups:
            offset = 0
            for length, many in g.slots:
                rows.append((length, rank.get(length, 0), base, many, offset))
                rank[length] = rank.get(length, 0) + many * g.count
                offset += many * length
            base += g.count
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _patterns(classes: list[int], capacity: int, width: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``most`` length classes (by upper bound) whose lengths can fill a sequence exactly."""
    found, known = [], set(classes)
    for k in range(1, most + 1):
        for head in combinations_with_replacement(classes, k - 1):
            rest = capacity - sum(head)
            first = max(head[-1] if head else width, -(-rest // width) * width)
            for last in range(first, rest + k * (width - 1) + 1, width):
                if last in known:
                    found.append((*head, last))
    return found


def plan_packing(
    histogram: dict[int, int], capacity: int = 4096, width: int = 32, most: int = 3, rounds: int = 200
) -> Plan:
    """Pack pieces, given how many there are of each length.

    Lengths are gathered in classes ``width`` wide. All patterns of at most ``most`` classes that can fill a
    sequence are enumerated, and their repeat counts fitted to the class histogram by
    non-negative least squares and rounded down. A pattern is filled with lengths of
    its classes that fill the sequence to the last token, as far as there are. Then the rest goes, longest first, to the fullest sequence it
    fits in, or a new one.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    plan = Plan(capacity)
    runs: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        runs.setdefault(-(-n // width) * width, []).append(n)
    classes = sorted(runs)
    patterns = _patterns(classes, capacity, width, most)
    if patterns:
        at = {c: i for i, c in enumerate(classes)}
        a = np.zeros((len(classes), len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[at[c], j] += 1
        b = np.array([float(sum(left[n] for n in runs[c])) for c in classes])
        counts = nnls(a, b, rounds)
        for j in np.argsort(-counts, kind="stable"):
            todo = int(counts[j])
            last = patterns[j][-1]
            for head in product(*(runs[c] for c in patterns[j][:-1])):
                if todo <= 0:
                    break
                end = capacity - sum(head)
                if not last - width < end <= last or end not in left:
                    continue
                used = Counter((*head, end))
                times = min([todo, *(left[n] // k for n, k in used.items())])
                if times > 0:
                    for n, k in used.items():
                        left[n] -= times * k
                    todo -= times
                    plan.groups.append(Group(times, tuple(sorted(used.items(), reverse=True)), capacity))
    _best_fit(plan, left)
    return plan


def _best_fit(plan: Plan, left: dict[int, int]) -> None:
    """Best fit by decreasing length, over groups of sequences with equal room."""
    open_by_room: dict[int, list[Group]] = {}
    for g in plan.groups:
        open_by_room.setdefault(plan.capacity - g.used, []).append(g)
    rooms = sorted(open_by_room)
    done: list[Group] = []

    def put(group: Group) -> None:
        room = plan.capacity - group.used
        if room not in open_by_room:
            open_by_room[room] = []
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        open_by_room[room].append(group)

    for n in sorted((k for k, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count:
            i = int(np.searchsorted(rooms, n))
            if i == len(rooms):
                many = plan.capacity // n
                whole, rest = divmod(count, many)
                if whole:
                    put(Group(whole, ((n, many),), n * many))
                if rest:
                    put(Group(1, ((n, rest),), n * rest))
                break
            room = rooms[i]
            group = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(i)
            many = room // n
            whole = min(group.count, count // many)
            if whole:
                put(Group(whole, (*group.slots, (n, many)), group.used + many * n))
                count -= whole * many
            over = group.count - whole
            if over and count and count < many:
                put(Group(1, (*group.slots, (n, count)), group.used + count * n))
                count, over = 0, over - 1
            if over:
                put(Group(over, group.slots, group.used))
    for groups in open_by_room.values():
        done.extend(groups)
    plan.groups = done


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, **options) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and the id 1; only longer ones than ``capacity`` are cut. A null or empty text
    is the id 1 alone. Rows that repeat are packed as often. An empty table gives an empty result.
    """
    cut = materialize(pieces(docs, capacity, tokenizer or tokenizer_path()), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    per_part = materialize(per_part, "lengths")
    histogram = per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    plan = plan_packing({r["length"]: r["n"] for r in histogram}, capacity, **options)
    slots = docs.sparkSession.sparkContext.broadcast(plan.table())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col("part").alias("_p"),
        F.col("length").alias("_l"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
    )
    # merged and not broadcast: there is a row for each length in each part, and parts grow with the input
    ranked = cut.join(offsets.hint("merge"), (F.col("part") == F.col("_p")) & (F.col("length") == F.col("_l")))
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("nth"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = slots.value
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = rows[np.searchsorted(key, length << 48 | rank, "right") - 1]
            nth, many = rank - row[:, 1], row[:, 3]
            batch["sequence_id"] = row[:, 2] + nth // many
            batch["offset"] = row[:, 4] + nth % many * length
            yield batch.drop(columns="rank")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInPandas(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
