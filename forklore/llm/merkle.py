"""Merkle trees over a table, one per group, and a tree over their roots.

A row's leaf is the hash of its columns. In each group the leaves ascend by key; every ``arity`` consecutive nodes
become their hash, level by level, until one node, the group's root, is left; the roots of the groups, ordered by
group, are hashed on likewise to the root of the whole table.

All of it is fixed-offset windows. A node of level l stands in the row of its first leaf, so its siblings stand in rows
``j * arity**l`` before and after: lag and lead columns, masked by the node's slot in its run. A run that ends early
has no row there. Rows in first slots hash the parents. Rows of a group are cut into blocks of ``arity**levels``, in which
no run crosses an edge, so one sort by (group, block) serves all levels of a block and a group of any size is dealt to many
tasks. The blocks' top nodes are the leaves of the next round. On the way down each block's path to the root is
merged into its rows, which are still dealt and sorted by (group, block): the hashes of siblings are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forklore.llm.common import rank_within, shuffle_partitions
from forklore.session import materialize, materialize_counted

ARITY = 3
LEVELS = 7
BLOCK = ["g", "block"]


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns, each told apart from its neighbours by its length."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` (hex) leads to with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of ``path``, from the leaf up, left to right within a level."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _levels(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Add ``block``, ``left_l`` and ``right_l`` for each level, in the first row of each node, and ``top``.

    ``nodes`` has ``g, pos, node`` (binary). ``top`` is the node of the block, in its first row. In a group whose
    nodes have come down to one, levels are null and the node stays.
    """
    size = arity**levels
    rows = nodes.withColumn("block", F.floor(F.col("pos") / size))
    # hashing is much work for few bytes: deal rows to all tasks, whatever their bytes
    rows = rows.repartition(shuffle_partitions(nodes.sparkSession), *BLOCK).withColumn("_0", _hex(F.col("node")))
    inside = Window.partitionBy(*BLOCK).orderBy("pos")
    pos = F.col("pos")
    for level in range(levels):
        step, node = arity**level, F.col(f"_{level}")
        slot = F.floor(pos / step) % arity
        beside = {j: F.col(f"_by{j}") for j in range(1 - arity, arity) if j}
        rows = rows.select(
            "*",
            *[F.lag(node, -j * step).over(inside).alias(f"_by{j}") for j in beside if j < 0],
            *[F.lead(node, j * step).over(inside).alias(f"_by{j}") for j in beside if j > 0],
        )
        left = F.concat(*[F.when(slot >= -j, beside[j]).otherwise("") for j in range(1 - arity, 0)])
        right = F.concat(
            *[F.when(slot + j < arity, F.coalesce(beside[j], F.lit(""))).otherwise("") for j in range(1, arity)]
        )
        alone = (pos == 0) & beside[1].isNull()  # the first node of a group, and no second
        here = (pos % step == 0) & ~alone
        rows = rows.withColumn(f"left_{level}", F.when(here, left)).withColumn(f"right_{level}", F.when(here, right))
        parent = F.when(alone, node).otherwise(F.sha2(F.concat(node, F.col(f"right_{level}")), 256))
        rows = rows.withColumn(f"_{level + 1}", F.when(pos % (step * arity) == 0, parent))
        rows = rows.drop(node, *beside.values())
    return rows.withColumnRenamed(f"_{levels}", "top")


def _tops(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The top node of each block as a node of the next round."""
    found = _levels(nodes, arity, levels).where(F.col("pos") % arity**levels == 0)
    return found.select("g", F.col("block").alias("pos"), F.unhex("top").alias("node"))


def _path_below(nodes: DataFrame, above: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` with ``path`` to the end of the path of their block (``above``: ``g, pos, path`` and more)."""
    rows = _levels(nodes, arity, levels)
    sofar = Window.partitionBy(*BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # an ancestor stands in the nearest row at or before this one that begins a node of its level
    at = [
        F.struct(*[F.last(f"{side}_{level}", ignorenulls=True).over(sofar).alias(side) for side in ("left", "right")])
        for level in range(levels)
    ]
    names = [f"_at{level}" for level in range(levels)]
    rows = rows.select(*nodes.columns, "block", *[a.alias(n) for a, n in zip(at, names)])
    above = above.withColumnRenamed("pos", "block").withColumnRenamed("path", "_above")
    own = F.filter(F.array(*names), lambda a: a["left"].isNotNull())
    more = [c for c in above.columns if c not in (*BLOCK, "_above")]
    return rows.join(above, BLOCK).select(*nodes.columns, *more, F.concat(own, "_above").alias("path"))


def _climb(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Tables of nodes, block by block, until each group has one; the last has no position above 0."""
    rounds = [nodes]
    while True:
        tops, n_more = materialize_counted(_tops(rounds[-1], arity, levels), "tops", F.col("pos") > 0)
        rounds.append(tops)
        if not n_more:
            return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, arity: int, levels: int) -> DataFrame:
    """The nodes of the first round with their paths; ``above`` has those of the last."""
    for nodes in reversed(rounds[1:-1]):
        above = materialize(_path_below(nodes, above, arity, levels).drop("node"), "paths")
    return _path_below(rounds[0], above, arity, levels)


def manifest(
    docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "source",
    carry: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot`` (of its group), ``root``, ``path`` and ``carry``.

    ``path`` holds, from the leaf's level to the root, the hashes left and right of the node in its run (empty
    text for none); :func:`fold` recomputes the root with it. All hashes are lowercase hex. ``carry`` names further
    columns to take along, by expressions over ``docs``.

    Rows of one key are ordered by their leaves, so repeated rows are interchangeable; a null key comes first. A null
    group is a group and comes before all others, which are ordered bytewise. A group of one row has
    its leaf for subroot. Columns that are not named play no part. An empty table gives an empty result.
    """
    carry = carry or {}
    slim = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n")).alias("g"),
        F.unhex(leaf_hash(*[F.col(c) for c in columns])).alias("node"),
        *[value.alias(f"with_{name}") for name, value in carry.items()],
    )
    ranked = rank_within(slim, ["g"], ["key", "node"], "pos").withColumn("pos", F.col("pos") - 1)
    leaves = materialize(ranked, "leaves")
    rounds = _climb(leaves, arity, levels)
    roots = rounds[-1].select("g", F.col("node").alias("subroot"))
    line = rank_within(roots, [], ["g"], "pos").select(
        F.lit("all").alias("g"), (F.col("pos") - 1).alias("pos"), F.col("subroot").alias("node"), F.col("g").alias("of")
    )
    upper = _climb(materialize(line, "subroots"), arity, levels)
    ends = upper[-1].select(
        "g", "pos", F.array().cast("array<struct<left:string,right:string>>").alias("path"), _hex(F.col("node")).alias("root")
    )
    tops = _descend(upper, ends, arity, levels).select(
        F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "root", _hex(F.col("node")).alias("subroot")
    )
    found = _descend(rounds, materialize(tops, "paths"), arity, levels)
    return found.select(
        F.col("key").alias(key), _hex(F.col("node")).alias("leaf"), "subroot", "root", "path",
        *[F.col(f"with_{name}").alias(name) for name in carry],
    )


def tampering(docs: DataFrame, columns: list[str], key: str = "doc_id") -> Column:
    """The leaf of a row whose text has lost its line feeds; null where it stays as it is.

    Rows whose key has an even CRC-32 are meant; a null key or text is left alone.
    """
    even = F.crc32(F.col(key).cast("string")) % 2 == 0
    fed = even & F.contains(F.col("text"), F.lit("\n"))
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return F.when(fed, F.unhex(leaf_hash(*[cut if c == "text" else F.col(c) for c in columns])))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(found: DataFrame) -> DataFrame:
    """What a manifest with the column ``seen`` (binary leaves met later, null for unchanged) proves of each row."""
    leaf = F.coalesce(_hex(F.col("seen")), F.col("leaf"))
    folded = found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(leaf, F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and what it says of a copy of the table that was tampered with (:func:`tampering`)."""
    return audit(manifest(docs, COLUMNS, carry={"seen": tampering(docs, COLUMNS)}))
