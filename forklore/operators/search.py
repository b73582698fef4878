"""Least-cost search in many graphs at once, block by block.

A graph (the commits of a pair, or of one side of it) is cut into blocks of neighbouring commits. A task holds one block,
searches it to the end from all its entries, and hands what leaves the block to the blocks it leads to, in the next
round. So most graphs, being smaller than a block, take one round and one exchange, long histories one round per block
they cross rather than one per commit, and no task holds more than a block, however large a graph is. Only blocks that were
entered are read again. Each round appends a table in the shared folder: nothing that is settled is written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forklore.session import materialize, materialize_counted

#: Rows of a graph that one task holds.
BLOCK = 1 << 16
NODE = ["pair_id", "sha"]


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def in_groups(df: DataFrame, keys: list[str], order: list[str], each: Callable, schema: str) -> DataFrame:
    """``each(key, rows)`` over the rows of each group, in order, as they stream by; it yields rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    arrow, names, n = to_arrow_schema(struct), df.columns, len(keys)
    at = itemgetter(*[names.index(k) for k in keys])

    def run(batches):
        made = (row for key, rows in groupby(_rows(batches, names), at) for row in each(key if n > 1 else (key,), rows))
        yield from _batches(made, arrow)

    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    return df.repartition(*keys).sortWithinPartitions(*by).mapInArrow(run, struct)


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def crowded(rows: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, int]:
    """Keys of the graphs with more than ``block`` rows, and their number."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    return materialize_counted(sizes.drop("_n"), "crowded")


def _walked_depths(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Depth of each commit, its steps away from ``up``; a commit without a row here has depth 0."""
    up_of = {sha: (up, steps) for _, sha, up, steps in rows}
    depth: dict = {}
    for sha in up_of:
        line = []
        while sha is not None and sha not in depth and sha in up_of:
            line.append(sha)
            sha = up_of[sha][0]
        below = depth.get(sha, 0)
        for commit in reversed(line):
            below += up_of[commit][1]
            depth[commit] = below
    yield from ((*key, sha, d) for sha, d in depth.items())


def _contracted_depths(first: DataFrame, block: int) -> DataFrame:
    """Depths by contraction, for graphs of more than ``block`` commits.

    In each round about a quarter of the commits is taken out, none of them next to another, and the commits above
    step over them, until a task can walk what is left of a graph. Then the commits taken out get theirs from the commit
    they lead to, round by round backwards. So a round costs three quarters of the one before, and all together a fixed
    number of passes over the graph.
    """
    first = materialize(first, "first")
    known = first.select("pair_id", F.col("sha").alias("first"), F.lit(True).alias("_known"))
    inner = first.where(F.col("first").isNotNull()).join(known, ["pair_id", "first"], "left")
    inner = materialize(inner.select(*NODE, F.when(F.col("_known"), F.col("first")).alias("up")), "depths")
    nought = F.lit(0).cast("long").alias("depth")
    roots = first.where(F.col("first").isNull()).select(*NODE, nought).unionByName(
        inner.where(F.col("up").isNull()).select(*NODE, nought)
    )
    links = inner.where(F.col("up").isNotNull()).withColumn("steps", F.lit(1).cast("long"))

    def side(commit: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(len(taken)), F.col(commit)), F.lit(2)) == 1

    taken: list[DataFrame] = []
    n_links = None
    while (n_links is None or n_links > block) and crowded(links, ["pair_id"], block)[1]:
        # two neighbours are never taken out together: one would have to be on both sides
        out = F.coalesce(~side("sha") & side("up"), F.lit(False))
        over = links.where(out).select(
            "pair_id", F.col("sha").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps")
        )
        stay = links.where(~out).join(over, ["pair_id", "up"], "left")
        steps = F.col("steps") + F.coalesce("_steps", F.lit(0))
        taken.append(links.where(out))
        stay = stay.select(*NODE, F.coalesce("_up", "up").alias("up"), steps.alias("steps"))
        links, n_links = materialize_counted(stay, "depths")
    schema = f"{_types(first, NODE)}, depth long"
    done = [materialize(in_groups(links, ["pair_id"], [], _walked_depths, schema), "depths")]
    while taken:
        out = taken.pop()
        # a commit taken out leads to one of the other side, or to a root, whose depth is 0
        below = reduce(lambda a, b: a.unionByName(b), done).where(side("sha"))
        below = below.select("pair_id", F.col("sha").alias("up"), F.col("depth").alias("_depth"))
        depth = F.col("steps") + F.coalesce("_depth", F.lit(0))
        done.append(materialize(out.join(below, ["pair_id", "up"], "left").select(*NODE, depth.alias("depth")), "depths"))
    return reduce(lambda a, b: a.unionByName(b), [roots, *done])


def depths(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pair_id, sha, depth``: the first parents below each commit, as far as they are commits of the graph."""
    first = edges.groupBy(*NODE).agg(F.min(F.when(F.col("parent_pos") == 0, F.col("parent"))).alias("first"))
    large, n_large = crowded(edges, ["pair_id"], block)
    small = first.join(large, "pair_id", "left_anti") if n_large else first
    rows = small.withColumn("steps", F.lit(1).cast("long"))
    found = in_groups(rows, ["pair_id"], [], _walked_depths, f"{_types(edges, NODE)}, depth long")
    found = found.withColumn("depth", F.col("depth") - 1)
    if not n_large:
        return found
    return found.unionByName(_contracted_depths(first.join(large, "pair_id", "left_semi"), block))


def _blocks(depth: DataFrame, block: int) -> DataFrame:
    """``pair_id, sha, block``: commits of like depth together, about ``block`` of them; more of one depth by hash."""
    counts = depth.groupBy("pair_id", "depth").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("pair_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    first = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / block)
    counts = counts.select("pair_id", "depth", first.alias("_first"), F.ceil(F.col("_n") / block).alias("_wide"))
    return depth.join(counts, ["pair_id", "depth"]).select(
        *NODE, (F.col("_first") + F.pmod(F.xxhash64("sha"), F.col("_wide"))).cast("long").alias("block")
    )


@dataclass
class Blocks:
    """A graph cut into blocks: ``rows`` are edges with ``block`` and ``there``, the block of the parent.

    ``places`` (``pair_id, sha, block``) has the commits of pairs of several blocks; all others lie in block 0.
    """

    rows: DataFrame
    places: DataFrame | None


def graph_blocks(
    edges: DataFrame, extra: list[str] | None = None, block: int = BLOCK, sized_by: DataFrame | None = None,
    depth: DataFrame | None = None,
) -> Blocks:
    """Cut ``edges`` (``pair_id``, ``extra``, ``sha, parent, parent_pos``) into blocks.

    ``extra`` columns tell apart the graphs of a pair. A commit without parents needs a row, whose parent is null.
    Which pairs are cut is counted in ``sized_by``, a table with a row for each edge at least (``edges`` if none is given).
    ``depth`` are the :func:`depths` of ``edges``, where they are known already.
    """
    columns = ["pair_id", *(extra or []), "sha", "parent", "parent_pos"]
    large, n_large = crowded(edges if sized_by is None else sized_by, ["pair_id"], block)
    nought = F.lit(0).cast("long")
    if not n_large:
        return Blocks(edges.select(*columns, nought.alias("block"), nought.alias("there")), None)
    small = edges.join(large, "pair_id", "left_anti").select(*columns, nought.alias("block"), nought.alias("there"))
    many = edges.select(*columns).join(large, "pair_id", "left_semi")
    placed = depths(many, block) if depth is None else depth.join(large, "pair_id", "left_semi")
    at = materialize(_blocks(placed, block), "blocks")
    to = at.select("pair_id", F.col("sha").alias("parent"), F.col("block").alias("there"))
    # a parent that is no commit of the graph leaves a row without one: the commit itself can be reached
    linked = many.where(F.col("parent").isNotNull()).join(to, ["pair_id", "parent"], "left")
    linked = linked.withColumn("parent", F.when(F.col("there").isNotNull(), F.col("parent")))
    roots = many.where(F.col("parent").isNull()).withColumn("there", F.lit(None).cast("long"))
    rows = linked.unionByName(roots).join(at, NODE).select(*columns, "block", "there")
    # in the order of blocks a file is read only where it holds the blocks asked for
    return Blocks(materialize(small.unionByName(rows).sortWithinPartitions("block"), "graph"), at)


def free_first_parent(pos: int, parent, first) -> int:
    """A first parent costs nothing to follow, nor does a further parent that is the first again; others cost one."""
    return int(pos > 0 and parent != first)


def each_step(pos: int, parent, first) -> int:
    return 1


def no_cost(pos: int, parent, first) -> int:
    return 0


def _settle(steps: dict, entries: list[tuple], known: dict, here: int, cost: Callable, trace: bool) -> tuple[dict, dict]:
    """Commits of a block that the entries reach at less cost than known, and the least entries to other blocks."""
    found: dict = {}
    leaving: dict = {}
    heapify(entries)
    while entries:
        value, tag, sha, came = heappop(entries)
        if sha not in steps or (sha in known and known[sha] <= (value, tag)):
            continue
        known[sha] = (value, tag)
        found[sha] = (value, tag, came)
        first = next((p for pos, p, _ in steps[sha] if pos == 0), None)
        for pos, parent, there in steps[sha]:
            if parent is None:
                continue
            step = (value + cost(pos, parent, first), sha if trace else tag)
            if there == here:
                heappush(entries, (*step, parent, here))
            elif parent not in leaving or step < leaving[parent][:2]:
                leaving[parent] = (*step, there)
    return found, leaving


def _search_block(n_keys: int, n_labels: int, cost: Callable, trace: bool) -> Callable:
    def each(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        steps: dict = {}
        here = key[-1]
        for label, part in groupby(rows, itemgetter(slice(n_keys + 1, n_keys + 1 + n_labels + 1))):
            known: dict = {}
            entries = []
            for row in part:
                kind, sha, parent, pos, there, value, tag, came = row[n_keys + n_labels + 2 :]
                if kind == 0:
                    steps.setdefault(sha, []).append((pos, parent, there))
                elif kind == 1:
                    known[sha] = min(known.get(sha, (value, tag)), (value, tag))
                else:
                    entries.append((value, tag, sha, came))
            if label[0]:
                found, leaving = _settle(steps, entries, known, here, cost, trace)
                for sha, (value, tag, came) in found.items():
                    yield (*key, *label[1:], sha, value, tag, came, False)
                for sha, (value, tag, there) in leaving.items():
                    yield (*key[:-1], there, *label[1:], sha, value, tag, here, True)

    return each


@dataclass
class _Touched:
    """The blocks a round reads: their keys, their number, and the least and largest ``block``."""

    keys: DataFrame
    n: int
    low: int | None
    high: int | None
    #: Most blocks that are sent to every task; more are joined by an exchange.
    FEW = 100_000

    @classmethod
    def by(cls, rows: DataFrame, names: list[str], cut: bool = True) -> _Touched:
        """Blocks of ``rows``; where no graph is cut (``cut``) there is nothing to choose from."""
        keys = rows.select(*names).distinct()
        if not cut:
            return cls(keys, cls.FEW + 1, 0, 0)
        return cls(keys, *keys.agg(F.count(F.lit(1)), F.min("block"), F.max("block")).first())

    def only(self, rows: DataFrame) -> DataFrame:
        """Rows of these blocks at least; few blocks are looked up in place, without an exchange of ``rows``."""
        if self.low is None:
            return rows.where(F.lit(False))
        rows = rows.where(F.col("block").between(self.low, self.high))
        if self.n > self.FEW:
            return rows
        asked = self.keys.toDF(*[f"_{n}" for n in self.keys.columns])
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in self.keys.columns])
        return rows.join(F.broadcast(asked), same, "left_semi")

    def meets(self, other: _Touched) -> bool:
        return None not in (self.low, other.low) and self.low <= other.high and other.low <= self.high


def least_costs(
    blocks: Blocks, seeds: DataFrame, keys: list[str], labels: list[str], cost: Callable, trace: bool = False
) -> DataFrame:
    """Least cost from the seeds to every commit they reach, label by label.

    ``blocks`` come from :func:`graph_blocks`; ``seeds`` has ``keys``, ``labels``, ``sha, value`` and ``tag``. Result:
    ``keys, block, labels, sha, value, tag, came``. Of paths of equal cost the one with the least tag counts. A tag is
    carried along from its seed; with ``trace`` it is the commit one came from instead, ``came`` its block.
    """
    node = [*keys, "block"]
    graph = blocks.rows
    entries = seeds.select(*keys, *labels, "sha", "value", "tag", F.lit(-1).cast("long").alias("came"))
    if blocks.places is None:
        entries = entries.withColumn("block", F.lit(0).cast("long"))
    else:  # seeds that are no commits of the graph come to nothing in block 0
        entries = entries.join(blocks.places, NODE, "left").withColumn("block", F.coalesce("block", F.lit(0).cast("long")))
    data = ["sha", "parent", "parent_pos", "there", "value", "tag", "came"]
    kinds = {n: graph.schema[n].dataType for n in (*keys, "block", "sha", "parent", "parent_pos", "there")}
    kinds |= {n: entries.schema[n].dataType for n in (*labels, "value", "tag", "came")}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        filled = [F.col(n).cast(kinds[n]).alias(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n)
                  for n in (*node, *labels, *data)]
        # edges come first in their block, then each label's known costs and entries
        df = df.select(*filled).withColumn("labelled", F.lit(kind > 0)).withColumn("kind", F.lit(kind))
        return df.select(*node, "labelled", *labels, "kind", *data)

    out = [*node, *labels, "sha", "value", "tag", "came"]
    schema = ", ".join(f"{n} {kinds[n].simpleString()}" for n in out) + ", leaves boolean"
    each = _search_block(len(keys), len(labels), cost, trace)
    settled: list[tuple[DataFrame, _Touched]] = []
    while True:
        touched = _Touched.by(entries, node, blocks.places is not None)
        every = rows(touched.only(graph), 0)
        for part, blocks_of_part in settled:
            if touched.meets(blocks_of_part):
                every = every.unionByName(rows(touched.only(part), 1))
        every = every.unionByName(rows(entries, 2))
        found = in_groups(every, node, ["labelled", *labels, "kind"], each, schema)
        found, n_leaving = materialize_counted(found, "found", F.col("leaves"))
        settled.append((found.where(~F.col("leaves")).drop("leaves"), touched))
        if not n_leaving:
            break
        entries = found.where("leaves").drop("leaves")
    if len(settled) == 1:
        return settled[0][0]
    best = F.min(F.struct("value", "tag", "came")).alias("best")
    return reduce(lambda a, b: a.unionByName(b), [part for part, _ in settled]).groupBy(*node, *labels, "sha").agg(best).select(
        *node, *labels, "sha", "best.*"
    )


def _walk_block(n_keys: int, n_labels: int) -> Callable:
    def each(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        # key: keys, labels, block; a row: key, kind, sha, value, tag, came
        via: dict = {}
        for row in rows:
            kind, sha, value, tag, came = row[n_keys + n_labels + 1 :]
            if kind == 0:
                via[sha] = (value, tag, came)
                continue
            while sha is not None:
                value, tag, came = via[sha]
                yield (*key, sha, value, False)
                if tag is None or came != key[-1]:
                    if tag is not None:
                        yield (*key[:-1], came, tag, value, True)
                    break
                sha = tag

    return each


def traced(found: DataFrame, ends: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """``keys, labels, sha, value``: the commits from each of ``ends`` (``keys, labels, sha``) back to the seed.

    ``found`` comes from :func:`least_costs` with ``trace``. One round per block that a path crosses.
    """
    found = materialize(found.sortWithinPartitions("block"), "traces")
    whole = [*keys, *labels, "block"]
    marks = ends.join(found.select(*whole, "sha"), [*keys, *labels, "sha"])
    schema = f"{_types(found, [*whole, 'sha', 'value'])}, leaves boolean"
    none = {n: F.lit(None).cast(found.schema[n].dataType).alias(n) for n in ("value", "tag", "came")}
    each = _walk_block(len(keys), len(labels))
    paths: list[DataFrame] = []
    while True:
        rows = _Touched.by(marks, whole).only(found).select(*whole, F.lit(0).alias("kind"), "sha", *none)
        rows = rows.unionByName(marks.select(*whole, F.lit(1).alias("kind"), "sha", *none.values()))
        step, n_leaving = materialize_counted(in_groups(rows, whole, ["kind"], each, schema), "path", F.col("leaves"))
        paths.append(step.where(~F.col("leaves")).select(*keys, *labels, "sha", "value"))
        if not n_leaving:
            return reduce(lambda a, b: a.unionByName(b), paths)
        marks = step.where("leaves").select(*whole, "sha")
